"""Query of operator 10: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.common import table


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return langid.identify(docs.select("doc_id", "text"), langid.sample(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
