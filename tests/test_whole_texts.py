import re

from corpusloom.operators import chunking
from corpusloom.plans import text_queries


def test_section_chunks_hold_the_whole_text(spark, tmp_path, monkeypatch):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(7))
    spark.createDataFrame([(1, text), (2, "one line " * 40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    chunk = chunking.chunk_documents
    monkeypatch.setattr(chunking, "chunk_documents", lambda docs, *a, **b: seen.append(chunk(docs, *a, **b)) or seen[-1])
    got = text_queries.q37_section_chunks(spark, str(tmp_path)).collect()
    held = {r.doc_id: "" for r in seen[0].collect()}
    for r in seen[0].collect():
        held[r.doc_id] += f" {r.text}"
    assert len(got) == seen[0].count()
    assert set(re.findall(r"\S+", text)) <= set(held[1].split()) and held[2].split().count("one") >= 40
