"""Broadcast hints behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; larger sides are joined by shuffle (and AQE's skew handling).
BROADCAST_ROWS = 200_000
#: Rows that a task sorts and groups, some 300 bytes each.
TASK_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, known: int | None = None) -> DataFrame:
    """The hint if ``df`` has no more than ``rows`` rows, else ``df`` as it is.

    ``known`` is an upper bound that follows from how ``df`` was made (say k for each of n items); without it rows are counted
    up to the bound, which runs the plan of ``df`` once more.
    """
    size = df.limit(rows + 1).count() if known is None else known
    return F.broadcast(df) if size <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input has fewer files than there are cores (one row group is one task else).

    For work that costs more than a shuffle of its rows; large inputs have more files than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows dealt by ``key`` over partitions for TASK_ROWS of ``rows`` each, where the session's own would be fewer: what a task holds doesn't
    grow with the input, joins and groups by ``key`` need no other shuffle, and AQE doesn't merge the partitions.

    Both sides of a join take the same ``rows``.
    """
    spark = df.sparkSession
    parts = -(-rows // TASK_ROWS)
    usual = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, key) if parts > usual else df
