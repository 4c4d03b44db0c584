"""What the secret and personal-data methods add to their patterns, and that long texts take little time."""

import random
import time

from corpusloom.llm import pii, secrets

from .conftest import prose
from .test_operators import by_id, luhn

SYLLABLES = "the ing tion er and re at en es on of to in an ha nd ti ou".split()
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def phone(rng):
    return f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"


def test_planted_identifiers_are_found(spark):
    """Four kinds of context, among numbers that stand anywhere."""
    rng = random.Random(51)
    fill = lambda: prose(rng, 25)
    code = lambda: f"{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}"
    seeded, planted, noise = [], [], []
    for _ in range(12):
        seeded += [f"{fill()} reach us under {phone(rng)} {fill()}", f"{fill()} Fax: {phone(rng)} daily {fill()}", f"{fill()} id {phone(rng)} on file {fill()}", f"{fill()} mailbox <a{rng.randint(10, 99)}@mail.example.com> {fill()}"]
    for _ in range(10):
        planted += [(t, v) for v in [code()] for t in (f"{fill()} reach us under {v} {fill()}",)]  # two words before
        planted += [(f"{fill()} xx Fax: {v} daily {fill()}", v) for v in [code()]]  # words around
        planted += [(f"{fill()} zz {v} on file {fill()}", v) for v in [f"+{rng.randint(1, 9)} ({rng.randint(1, 9)}) 5-55"]]  # shape and words after
    for _ in range(200):
        noise.append(f"{fill()} {code()} {fill()} {rng.randint(10000, 10**9)} {fill()}")
    texts = seeded + [t for t, _ in planted] + noise
    got = by_id(pii.query(table(spark, texts)))
    hit = wrong = 0
    for i, r in got.items():
        found = [texts[i][int(s) : int(e)] for k, s, e in (x.split(":") for x in filter(None, r.spans.split(","))) if k == "context"]
        if len(seeded) <= i < len(seeded) + len(planted):
            hit += found == [planted[i - len(seeded)][1]]
        else:
            wrong += len(found)
    recall, precision = hit / len(planted), hit / max(1, hit + wrong)
    assert recall >= 0.6 and precision >= 0.95, (recall, precision)


def test_found_values_support_new_patterns(spark):
    """Values found in one context make another context confident, which finds more."""
    rng = random.Random(52)
    fill, ids = lambda: prose(rng, 10), [f"{k}77-{k}88-{k}" for k in range(10, 40)]
    texts = [f"{fill()} please call {phone(rng)} {fill()}" for _ in range(150)]
    texts += [f"{fill()} please call {v} {fill()}" for v in ids[:20]] + [f"{fill()} account holder {v} {fill()}" for v in ids[:20]]
    last = [f"{fill()} account holder Q{v} {fill()}" for v in ids[20:22]]
    got = by_id(pii.query(table(spark, texts + last)))
    assert all(got[len(texts) + i].n_context == 1 for i in range(2))
    one = by_id(pii.scan(table(spark, texts + last), rounds=1))
    assert all(not one[len(texts) + i].context for i in range(2))


def test_refuted_numbers_are_not_found(spark):
    rng = random.Random(53)
    check = lambda s: next(s + str(d) for d in range(10) if luhn(s + str(d)))
    texts = [f"{prose(rng, 9)} card number {check(str(rng.randint(10**14, 10**15 - 1)))} {prose(rng, 9)}" for _ in range(30)] + [f"{prose(rng, 9)} card number 4111111111111112 {prose(rng, 9)}", f"{prose(rng, 9)} card number 41111-1234 {prose(rng, 9)}"]
    got = by_id(pii.query(table(spark, texts)))
    assert got[30].n_card == 0 and got[30].n_context == 0 and got[31].n_context == 1


def test_words_before_are_whole(spark):
    rng = random.Random(54)
    long = "w" * 3000
    texts = [f"{prose(rng, 5)} {long} calls {phone(rng)} now" for _ in range(6)] + [f"{long} calls 7777-12345", f"{'v' * 200}{long[:80]} calls 7777-12345"]
    got = by_id(pii.query(table(spark, texts)))
    assert got[6].n_context == 1 and got[7].n_context == 0


def test_planted_keys_are_found(spark):
    """Random keys with nothing before them, in small and larger corpora, at the stated rate of false calls."""
    for n, seed in ((40, 55), (400, 56)):
        rng = random.Random(seed)
        texts, keys = [], []
        for i in range(n):
            key = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([24, 32, 40, 64])))
            say = lambda k, by=" ": by.join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(k))  # noqa: B023, E731
            texts.append([f"{say(20)} {key} {say(9)}", f"{say(20)} {say(12, '')} {say(5, '/')}/{rng.randint(1, 99)} {say(3)}"][i % 2])
            keys.append(key if i % 2 == 0 else None)
        got = by_id(secrets.query(table(spark, texts)))
        hit = wrong = 0
        for i, key in enumerate(keys):
            found = [texts[i][int(s) : int(e)] for k, s, e in (x.split(":") for x in filter(None, got[i].spans.split(","))) if k == "random"]
            hit += key in found
            wrong += len(found) - (key in found)
        assert hit >= 0.9 * n / 2 and wrong <= secrets.RATE * (hit + wrong) + 1, (n, hit, wrong)


def test_long_texts_take_little_time(spark):
    numbers = " ".join(f"{i}7" for i in range(250_000))
    mixed = " ".join(f"10.0.{i % 256}.7 u{i}@h.example.com key{i}={i:032x}" for i in range(20_000))
    docs = table(spark, [numbers, mixed])
    for run in (lambda: pii.query(docs), lambda: secrets.query(docs), lambda: pii.redact(docs)):
        began = time.time()
        got = run().collect()
        assert len(got) == 2 and time.time() - began < 60, time.time() - began


def test_redaction_keeps_clashing_columns(spark):
    got = pii.redact(spark.createDataFrame([(1, "mail a.b@c.example.org now", 5, "x", "k")], "doc_id long, text string, _row long, _spans string, `a b.c` string"))
    assert got.columns == ["doc_id", "text", "_row", "_spans", "a b.c"]
    assert tuple(got.first()) == (1, "mail [EMAIL] now", 5, "x", "k")
