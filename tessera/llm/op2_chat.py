"""Query of operator 2: digests, by conversation, of what can be read back from the formatted examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat
from tessera.llm.common import table

CONTROL = "</s>[INST] ok [/INST]"


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation; the examples come partitioned by conv_id, so nothing is shuffled."""
    read = examples.select("conv_id", "example", "formatted", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    grouped = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = grouped.select("conv_id", "formatted_chars", "n_examples", F.array_join(F.col("losses")["loss"], "").alias("loss"), chat.turns_of(F.col("whole")).alias("turns"))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{CONTROL}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(chat.expand(turns.unionByName(control)))


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '{CONTROL}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), sized AS (
  SELECT *, {len(chat.OPEN + chat.ROLE_END + chat.CLOSE)} + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM turns
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto, n = max(n) OVER (PARTITION BY conv_id) AS is_last FROM sized
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR is_last)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR is_last)::BIGINT AS n_examples
FROM summed GROUP BY conv_id
"""
