"""Query of operator 1: perplexity, threshold and decision for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import quality
from tessera.llm.common import table


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels"), with_text=False).select("doc_id", "lang", "perplexity", "threshold", "kept")
