"""Query of operator 3: the 20 nearest found for each vector whose vec_id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import multiindex
from tessera.llm.common import table


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=20, every=20)
