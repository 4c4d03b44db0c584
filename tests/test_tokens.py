"""Budgets in subword tokens: cuts at characters, whole texts, counts of the vocabulary's own library."""

import base64
import pickle
import random

import pytest

from corpusloom.functions.tokens import PATTERN, SubwordOffsets
from corpusloom.operators import chunking

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def offsets():
    return SubwordOffsets(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n):
    rng = random.Random(11)
    letters = "ab e. ,\n驾驶员必须é😀🏽‍߷ 。<|endoftext|>"
    return ["", "😀", "x", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(n))]


def decodes(data):
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def test_starts_are_those_of_the_tokens(offsets, library):
    for text in texts(200):
        tokens, at, begin = library.decode_tokens_bytes(library.encode_ordinary(text)), offsets(text), 0
        assert len(at) == len(tokens) and at == sorted(at)
        for i, token in enumerate(tokens):
            before = decodes(text.encode()[:begin])
            assert at[i] == (at[i - 1] if before is None else len(before))
            begin += len(token)


def test_hard_cuts_take_the_longest_whole_characters(offsets, library):
    for text in ["驾驶员必须联系当地法院处理罚款。" * 20, *texts(60)]:
        ids = library.encode_ordinary(text)
        tokens = library.decode_tokens_bytes(ids)
        for budget in (1, 2, 7, 64):
            want, first = [], 0
            while first < len(tokens):
                ends = [*range(min(first + budget, len(tokens)), first, -1), *range(first + 1, len(tokens) + 1)]
                end = next(e for e in ends if decodes(b"".join(tokens[first:e])) is not None)
                want.append(b"".join(tokens[first:end]).decode())
                first = end
            cuts = [0, *chunking.hard_cuts(offsets(text), budget), len(text)]
            assert [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b] == want


def test_tails_are_suffixes_of_whole_characters(offsets):
    text = "您的驾驶执照可能会因违反交通规则而被暂停。"
    for n in range(1, 60):
        tail = chunking.tail(text, n, offsets)
        assert text.endswith(tail) and len(offsets(tail)) <= n
    assert chunking.tail(text, 0, offsets) == "" and chunking.tail(text, 1000, offsets) == text


def test_splits_keep_every_character(offsets):
    text = "支付罚款。不要忽略法院通知！联系当地法院？" * 10
    for budget in (1, 7, 20, 64):
        assert "".join(chunking.split_to_size(text, budget, offsets)) == text
    for text in texts(60):
        for budget in (1, 7, 64):
            assert "".join("".join(chunking.split_to_size(text, budget, offsets)).split()) == "".join(text.split())


def test_chunks_of_documents(spark, offsets, library):
    rng = random.Random(12)
    body = lambda n: " ".join(rng.choice(["court", "fine", "pay", "法院", "😀"]) for _ in range(n))
    rows = [(1, f"# A\n{body(30)}\n## B\n{body(400)}\n## C\n{body(2000)}"), (2, ""), (3, None), (4, "# only"), (5, "驾驶员" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunking.chunk_documents(docs, 64, 8, pickle.loads(pickle.dumps(offsets))).orderBy("doc_id", "ordinal").collect()
    assert {r.doc_id for r in got} == {1, 4, 5}
    for r in got:
        assert r.token_count == len(library.encode_ordinary(r.text)) <= 2 * 64 + 8 + 16
    held = "".join(r.text for r in got if r.doc_id == 1)
    assert all(held.count(w) >= rows[0][1].count(w) for w in ("court", "fine", "pay", "法院", "😀"))


def test_lines_encoded_apart_have_the_tokens_of_the_whole_text():
    import random

    import public_tokenizers

    from corpusloom.functions import tokens

    whole = tokens.SubwordOffsets(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    bits = ["\n", "\n\n", " ", "\t", "\r", "\x0b", "\x1c", "\x85", "　", "\xa0", "word", "'s", "12", "!?", "é", "😀", "漢", ". A"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert whole(text) == whole._encoded(text) and whole.count(text) == len(whole(text))
    asked = []
    whole.counts.clear()
    made, whole._count = whole._count, lambda line: asked.append(line) or made(line)
    assert whole.count("one line\nanother\n\nthird") == whole.count("third\nanother\n\none line") and len(asked) <= 5  # each line is encoded once
