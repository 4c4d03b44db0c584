"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list.

A piece of text starts as its bytes; the queue holds each mergeable pair of neighbours by rank, then place. Popping the
least entry merges the two symbols unless the entry is stale (one of them has merged since); then the pairs with the
new neighbours are queued. Decoding concatenates the vocabulary's strings. The vocabulary file is a tokenizers JSON and
its path a parameter; the driver reads it and broadcasts it (a vocabulary of fixed size, 1.6 MB).

Null or empty text: no ids and an empty decoded text. Pairs of equal rank merge from the left. Repeated rows each get a row; an
empty table gives an empty one. Very long texts are read whole; a very long piece costs n log n. Further columns are ignored. A special
token's string in a text becomes its id, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows

#: Distinct pieces whose ids a task keeps.
CACHE = 200_000
#: The pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in such a vocabulary: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


class Bpe:
    """Encoder and decoder for the vocabulary in the JSON text of a tokenizers file."""

    def __init__(self, source: str):
        j = json.loads(source)
        model = j["model"]
        byte = {c: b for b, c in byte_characters().items()}
        vocab = {t: i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.strings = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.strings.update({i: t.encode() for t, i in self.special.items()})
        self.start = [vocab[c] for _, c in sorted(byte_characters().items())]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.cache: dict[str, tuple[int, ...]] = {}
        import regex

        self.pieces = regex.compile(PATTERN).findall
        self.around = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece."""
        ids = [self.start[b] for b in text.encode("utf-8", "replace")]
        n, merges = len(ids), self.merges
        queue = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
        if not queue:
            return tuple(ids)
        heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            _, i, pair = heappop(queue)
            j = after[i]
            if j < 0 or ids[i] != pair[0] or ids[j] != pair[1]:
                continue  # stale
            ids[i], ids[j] = merges[pair][1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (p := (ids[i], ids[k])) in merges:
                    heappush(queue, (merges[p][0], i, p))
            h = before[i]
            if h >= 0 and (p := (ids[h], ids[i])) in merges:
                heappush(queue, (merges[p][0], h, p))
        return tuple(x for x in ids if x >= 0)

    def _plain(self, text: str, out: array) -> None:
        cache, get, extend = self.cache, self.cache.get, out.extend
        for p in self.pieces(text):
            ids = get(p)
            if ids is None:
                ids = self.piece(p)
                if len(cache) < CACHE and len(p) < 40:
                    cache[p] = ids
            extend(ids)

    def encode(self, text: str) -> array:
        out = array("I")
        for n, part in enumerate(self.around(text) if self.around else [text]):
            if n % 2:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """(doc_id, ids, decoded), or their lengths and hashes with ``digests``."""
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def make(batches):
        bpe = Bpe(source.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for doc_id, text in rows(batches, "doc_id", "text"):
            ids = bpe.encode(text or "")
            decoded = bpe.decode(ids)
            yield (doc_id, len(ids), sha(_little(ids)), sha(decoded.encode())) if digests else (doc_id, ids.tolist(), decoded)

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, f"doc_id long, {columns}", 4096 if digests else 256)


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    return encode(docs, vocabulary, digests=True)
