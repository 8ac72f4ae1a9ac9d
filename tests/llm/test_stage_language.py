"""The pipeline's language-ID stage on texts that tie between two languages."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_short_ties_stay_and_long_ones_leave(spark):
    same = "the old house by the river was sold last year and nobody knows who lives there now " * 5
    rows = [(k, same, lang) for k, lang in enumerate(["en", "fr"] * 20)]  # both languages learn the same text: all scores are 0
    rows += [(100, "Re.", "en"), (101, "The river.", None), (102, "12 !", "en"), (103, None, "en"), (104, "Re. " + "1 " * 400, "fr")]
    docs = spark.createDataFrame([(i, t, lang, "web", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect())
    assert kept == [100, 101, 104]
