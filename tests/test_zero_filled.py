"""Categories without rows are in a report with zeros."""

import pytest

from corpusloom.operators import judging, rollups


def test_stated_categories_without_rows(spark):
    counts = spark.createDataFrame([("md", "en", 3, 1.5, "x"), (None, "en", 1, 0.5, "y"), ("odd", "fr", 2, None, "z")], "format string, lang string, n long, mean double, note string")
    got = {(r.format, r.lang): (r.n, r["mean"], r.note) for r in rollups.zero_filled(counts, {"format": ["md", "pdf", None], "lang": ["en", "fr"]}).collect()}
    assert got == {("md", "en"): (3, 1.5, "x"), ("md", "fr"): (0, 0.0, None), ("pdf", "en"): (0, 0.0, None), ("pdf", "fr"): (0, 0.0, None), (None, "en"): (1, 0.5, "y"), (None, "fr"): (0, 0.0, None), ("odd", "fr"): (2, None, "z")}
    only_n = rollups.zero_filled(counts, {"format": ["pdf"], "lang": ["en"]}, ["n"]).where("format = 'pdf'").first()
    assert (only_n.n, only_n["mean"]) == (0, None)
    assert rollups.zero_filled(counts.limit(0), {"format": ["md"], "lang": ["en"]}).first().n == 0
    with pytest.raises(ValueError, match="combinations"):
        rollups.zero_filled(counts, {"format": list(map(str, range(400))), "lang": list(map(str, range(400)))})


def test_labels_without_cases_in_a_summary(spark):
    cases = spark.createDataFrame([("a", "q1", "ok", "answer")], "candidate string, question_id string, status string, label string")
    marks = spark.createDataFrame([("a", "q1", "correctness", "ok", 1.0)], "candidate string, question_id string, metric string, status string, score double")
    counted = ["n", "failures", "correct", "unknown", "faith_n", "faith_sum", "no_fact", "faith_unknown", "cp_n", "cp_sum", "cp_unknown"]
    got = {r.label: (r.n, r.correct, r.correctness_lo) for r in rollups.zero_filled(judging.summary(cases, marks, ["label"]), {"label": ["answer", "clarify", "refuse"]}, counted).collect()}
    assert got == {"answer": (1, 1.0, 1.0), "clarify": (0, 0.0, None), "refuse": (0, 0.0, None)}
