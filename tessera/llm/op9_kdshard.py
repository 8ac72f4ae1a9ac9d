"""Query of operator 9: all documents in eight shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kdshard
from tessera.llm.common import table

SHARDS = 8


def op9_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kdshard.assign(table(spark, sf_dir, "documents"), leaves=SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
