"""Query of operator 6: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import maintext
from tessera.llm.common import table


def op6_recurrent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maintext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
