import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASH = "key string, start int, spans string, score double, predicted int, same string, node long, fp long, words string, lines string, hex string, _row long, _spans string, _key string, _s string, near string, kind string, email string, assign string, row long, task int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


_r = random.Random(7)
WORDS = ["".join(_r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(_r.randint(2, 9))) for _ in range(900)]


@pytest.fixture(scope="session")
def texts():
    """Ordinary, copied, nearly copied, awkward and very long texts; None among them."""
    rng = random.Random(11)
    base = [prose(rng, rng.choice([3, 20, 60, 150, 400])) for _ in range(40)]
    shared = prose(rng, 60)
    out = [*base, base[4], base[4], base[5].upper(), None, "", " \t\n\x0b ", "one", "a b", "of " * 300, shared, f"{base[6]} {shared} {base[7]}", shared.replace(" ", "\n"), f"{shared} end", "x y z \U0001f600é", "word " + "w" * 30_000, prose(rng, 20_000)]
    for i in (8, 9, 10):
        words = base[i].split()
        words[len(words) // 2] += "q"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def awkward(spark, texts):
    """Null ids, repeated rows and columns with clashing names."""
    some = [None, "", texts[4], texts[4], "password = abcdefgh", "x@y.example.com", *texts[:3]]
    rows = [(i if i % 4 else None, t, "en", "s", 0) + ("k", 1, "s", 0.5, 1, "same", 7, 8, "w", "l", "h", 9, "x", "y", "z", "n", "k", "e", "a", 4, 5) for i, t in enumerate(some)]
    rows += rows[-2:]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASH}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
