"""Query of operator 7: links and components of all embeddings, within labels, at cosine 0.93."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import rabit
from tessera.llm.common import table


def op7_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabit.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 0.93)
