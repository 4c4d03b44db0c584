"""Places where the subword tokens of a text start, for cutting texts by a token budget."""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np

#: Fixed value: how byte-level BPE vocabularies of this family part a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A line break before a character that is no white space. By PATTERN it is a token of its own, and what stands on either side is parted as if alone.
BREAK = re.compile("\n(?=[^\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])")
#: Lines whose tokens are remembered at most, and characters of these lines.
LINES, HELD = 2_000, 1_000_000


class SubwordOffsets:
    """A function text -> start of each token, in code points, by a byte-level BPE vocabulary (lines of a base64 token and its rank).

    A character may take several tokens, and a token may end inside one. A token that starts inside a character is no place to cut: it gets the
    start of the token before it, so equal neighbours stay together. Special tokens in a text are ordinary text; an empty text has none.
    The file is read once, here, and travels to tasks as a table; the encoder is made once in each of them. With the usual pattern a text's lines are
    encoded apart, with the same tokens, and the last ones remembered: chunking counts the same lines in sections, joined texts and chunks.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern, self.encoder = pattern, None
        self.lines, self.counts, self.held = {}, {}, 0
        self.length = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.length[rank] = len(token)

    def __getstate__(self):
        return {**self.__dict__, "encoder": None, "lines": {}, "counts": {}, "held": 0}

    def __call__(self, text: str) -> list[int]:
        if self.pattern != PATTERN:
            return self._encoded(text)
        out, begin = [], 0
        for line in BREAK.split(text):
            if begin:
                out.append((begin - 1,))  # the break before the line
            at = self._known(self.lines, line, self._encoded)
            out.append([begin + x for x in at] if begin else at)
            begin += len(line) + 1
        return list(chain.from_iterable(out))

    def count(self, text: str) -> int:
        """How many tokens a text has."""
        if self.pattern != PATTERN:
            return self._count(text)
        lines = BREAK.split(text)
        return len(lines) - 1 + sum(self._known(self.counts, line, self._count) for line in lines)

    def _known(self, memory: dict, line: str, make):
        got = memory.get(line)
        if got is None:
            if len(memory) >= LINES or self.held > HELD:
                self.lines.clear()
                self.counts.clear()
                self.held = 0
            got = memory[line] = make(line)
            self.held += len(line)
        return got

    def _count(self, text: str) -> int:
        return len(self._encoder().encode_ordinary(text)) if text else 0

    def _encoder(self):
        if self.encoder is None:
            import tiktoken

            self.encoder = tiktoken.Encoding("subwords", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self.encoder

    def _encoded(self, text: str) -> list[int]:
        if not text:
            return []
        sizes = self.length[self._encoder().encode_ordinary(text)]
        begins = np.cumsum(sizes) - sizes
        if text.isascii():
            return begins.tolist()
        leads = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return np.maximum.accumulate(np.where(leads[begins], np.cumsum(leads)[begins] - 1, -1)).tolist()
