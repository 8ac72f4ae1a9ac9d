"""Ranking, budgets, segments and shards over explicit orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.bounded import broadcast_if_small
from tessera.tables import written


def adaptive_threshold(rows: DataFrame, seq: str, pos: str, value: str, n: int, gamma: float) -> DataFrame:
    """Adds ``boundary``: value over gamma * sample deviation + mean of the ``n`` values before it (false with fewer than two)."""
    w = Window.partitionBy(seq).orderBy(pos).rowsBetween(-n, -1)
    limit = F.lit(gamma) * F.stddev_samp(value).over(w) + F.avg(value).over(w)
    return rows.withColumn("boundary", F.coalesce(F.col(value) > limit, F.lit(False)))


def chunk_threshold(rows: DataFrame, seq: str, pos: str, value: str, chunk: int, local: int, gamma: float) -> DataFrame:
    """As the above with one limit for each chunk, from the ``local`` positions up to the chunk's beginning.

    Sums by (seq, chunk) come first, and the trailing range runs over those, so no window holds single positions.
    """
    c = F.expr(f"{pos} div {chunk}").alias("chunk")
    sums = rows.groupBy(seq, c).agg(F.count("*").alias("k"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    w = Window.partitionBy(seq).orderBy("chunk").rangeBetween(-(local // chunk), -1)
    k, s, q = (F.sum(x).over(w) for x in ("k", "s", "q"))
    limits = sums.select(seq, "chunk", F.when(k > 1, F.lit(gamma) * F.sqrt(F.greatest(F.lit(0.0), (q - s * s / k) / (k - 1))) + s / k).alias("limit"))
    return rows.withColumn("chunk", c).join(limits, [seq, "chunk"]).withColumn("boundary", F.coalesce(F.col(value) > F.col("limit"), F.lit(False)))


def islands(rows: DataFrame, seq: str, pos: str, boundary: str = "boundary") -> DataFrame:
    """Adds ``segment``: the number of boundaries up to and with each row."""
    return rows.withColumn("segment", F.sum(F.col(boundary).cast("int")).over(Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))


def bounded_segments(rows: DataFrame, seq: str, pos: str, least: int, most: int, boundary: str = "boundary") -> DataFrame:
    """(seq, begin, length): segments of ``least`` to ``most`` positions; a shorter one is held until it is long enough, a longer one is cut.

    The state is the number of positions since the last cut; chunks of a sequence are composed (``scans``), so no task or row holds a whole one.
    """
    from tessera.operators.scans import numbered_parts

    def step(run, flag):
        begins = (run == 0) | (flag & (run >= least)) | (run >= most)
        return np.where(begins, 1, run + 1).clip(max=most), begins

    parts = numbered_parts(rows.select(seq, pos, F.coalesce(boundary, F.lit(False)).cast("boolean").alias("flag")), seq, [pos], "flag", step, most + 1)
    return parts.groupBy(seq, "part").agg(F.min("ordinal").cast("int").alias("begin"), F.count("*").cast("int").alias("length")).drop("part")


def within_budget(rows: DataFrame, group: str, order: list, size: str, cap: float) -> DataFrame:
    """Ranked rows up to the cap; the row that crosses it stays only if it lands closer to it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(size).over(w)
    before = F.col("upto") - F.col(size)
    ranked = rows.withColumn("upto", upto)
    fits = (F.col("upto") <= cap) | ((before < cap) & (F.abs(F.lit(cap) - F.col("upto")) < F.abs(F.lit(cap) - before)))
    return ranked.filter(fits)


def evict_least_recent(rows: DataFrame, group: str, order: list, size: str, need: float) -> DataFrame:
    """Rows to evict, the least recently used first, until ``need`` is freed."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("freed_before", F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("freed_before") < need)


def neighbours(selected: DataFrame, group: str, block: str, rank: str, n_blocks: str, cap: int) -> DataFrame:
    """For each selected block the next and the one before, in rank order, not selected themselves, each once, ``cap`` at most."""
    near = selected.select(group, rank, n_blocks, F.posexplode(F.array(F.col(block) + 1, F.col(block) - 1)).alias("side", "neighbour"))
    inside = near.filter((F.col("neighbour") >= 0) & (F.col("neighbour") < F.col(n_blocks)))
    fresh = inside.join(selected.select(group, F.col(block).alias("neighbour")), [group, "neighbour"], "left_anti")
    first = fresh.groupBy(group, "neighbour").agg(F.min(F.struct(rank, "side")).alias("at"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("at"))
    return first.withColumn("place", place).filter(F.col("place") <= cap).select(group, "neighbour", "place")


def ordinal(rows: DataFrame, order: list[str], part_rows: int = 1_000_000, least_parts: int = 1, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``ordinal`` from 0 in the whole order (of each group ``within``, nulls first), without one task that sees all rows.

    Rows are ranged by all keys, so that ties on the first are split by the others, and written with their part; parts are counted, and
    rows are numbered inside each part from where the parts before it end.
    """
    spark = rows.sparkSession
    parts = max(least_parts, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // part_rows))
    ranged = written(rows.repartitionByRange(parts, *within, *order).withColumn("_part", F.spark_partition_id()))
    named = {c: f"_of_{c}" for c in within}
    counts = ranged.groupBy("_part", *[F.col(c).alias(n) for c, n in named.items()]).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*named.values()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("_part").alias("_at"), *named.values(), F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order))
    same = F.col("_part") == F.col("_at")
    for c, other in named.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    joined = ranged.withColumn("_rank", own).join(broadcast_if_small(starts), same)
    return joined.withColumn("ordinal", F.col("_start") + F.col("_rank") - 1).drop("_part", "_at", "_rank", "_start", *named.values())


def shuffled_stride(rows: DataFrame, key: str, seed: int, world: int, drop_last: bool = False) -> DataFrame:
    """(key, place, rank): rows in the order of a seeded hash, dealt in strides, the same number for each rank.

    With ``drop_last`` the surplus at the end goes; else the first rows come again at the end until it is even.
    """
    hashed = rows.select(key, F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("long").alias("_hash"))
    placed = ordinal(hashed, ["_hash", key]).select(key, F.col("ordinal").alias("place"))
    n = rows.count()
    even = n // world * world if drop_last else -(-n // world) * world
    if not drop_last and n:
        turns = F.expr(f"sequence(place, {even} - 1, {n}L)")
        placed = placed.filter(F.col("place") < even).select(key, F.explode(turns).alias("place"))
    return placed.filter(F.col("place") < even).withColumn("rank", F.pmod("place", F.lit(world)).cast("int"))


def contiguous_shard(at: Column, n: int, world: int) -> Column:
    """Shard of an ordinal when ``n`` rows go to ``world`` shards in runs, the first ones taking the remainder."""
    size, rest = divmod(n, world)
    wide = rest * (size + 1)
    narrow = F.lit(rest) + F.floor((at - wide) / max(1, size))
    return F.when(at < wide, F.floor(at / (size + 1))).otherwise(narrow).cast("int")
