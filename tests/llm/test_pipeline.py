import random
import re

from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from corpusloom.llm.queries import vocabulary

from .conftest import prose
from .test_operators import PII, spans_of


def small_corpus(spark, folder):
    rng = random.Random(21)
    items = [prose(rng, 30) for _ in range(5)]
    texts = []
    for i in range(360):
        t = prose(rng, 120)
        if i % 9 == 0:
            t = t.replace(" ", " blorgish ", 1) + " snarfled " + prose(rng, 10)
        if i % 50 == 7:
            t = f"{t} {items[i % 5]} {prose(rng, 20)}"
        if i % 30 == 11:
            t += " mail me at someone@mail.example.org or +1 (212) 555-7788 thanks"
        texts.append(t)
    for i in (2, 3, 4):
        texts.append(texts[i])
        words = texts[i + 10].split()
        words[60] += "x"
        texts.append(" ".join(words))
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int("blorgish" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, items


def plainly(texts, items):
    """The stages over a small table in plain Python: doc_id to redacted text."""
    left = {i: t for i, t in enumerate(texts) if "blorgish" not in t}
    grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in left.items() for w in [t.lower().split()]}
    root = {i: i for i in left}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(left)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if find(i) == i and not any(x in t for x in items)}
    out = {}
    for i, t in left.items():
        spans = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans_of(t, PII, False)))
        for s, e, k in reversed(spans):
            t = f"{t[:s]}[{k.upper()}]{t[e:]}"
        out[i] = t
    return out


def test_pipeline(spark, tmp_path):
    texts, items = small_corpus(spark, str(tmp_path))
    want = plainly(texts, items)
    assert 0 < len(want) < len(texts) and any("[EMAIL]" in t and "[PHONE]" in t for t in want.values())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for i, t in want.items():
        assert got[i].decoded == t
        assert list(got[i].ids) == library.encode(t, add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids)


def test_stages_keep_columns(spark, tmp_path):
    small_corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    redacted = corpus_pipeline.redact_personal_data(spark, docs, str(tmp_path)).collect()
    assert all(r.n_chars == len(r.text) and not re.search(r"@mail", r.text) for r in redacted)


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
