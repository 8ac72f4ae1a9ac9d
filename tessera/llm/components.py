"""Connected components by alternating large and small stars, and joins inside groups of any size by block pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, stored


#: Links of one node from which on it is a hub, and how many hubs there may be: with more links more are needed to be one.
HUB, HUBS = 256, 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``edges`` (a, b), longs that aren't null.

    Each round hangs every node's larger neighbours, then its smaller ones, under its least neighbour; it ends when a round
    changes no edge.  Rounds grow with the logarithm of the longest chain.  Edges are written to the shared folder each round.  The least
    node of a large component has a link to most of its nodes; such hubs, HUBS at most, are broadcast, so that their links stay where they are.
    """

    def large(pairs: DataFrame, links: int) -> DataFrame:
        lower = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")  # only a smaller neighbour can be the least
        busy = pairs.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > max(HUB, links // HUBS)).select("v")
        hubs = F.broadcast(busy.join(lower, "v", "left"))
        light = pairs.join(F.broadcast(busy), "v", "left_anti").join(lower, "v", "left")
        hung = light.select("u", "v", "m").unionByName(pairs.join(hubs, "v").select("u", "v", "m"))
        return hung.select("u", F.coalesce("m", "v").alias("v"))

    def small(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        joined = pairs.join(least, "u").filter("v <> m")
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seal = mark(now)
    while seal[0]:
        before, now = now, stored(small(large(now, seal[0])))
        forget(before)
        last, seal = seal, mark(now)
        if seal == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def block_pairs(rows: DataFrame, keys: list[str], item: str, block: int) -> DataFrame:
    """``rows`` copied to the pairs of blocks (i, j), i <= j, that their group is compared in, as columns left, i, j.

    A group of no more than ``block`` rows is one block; a larger one is dealt to blocks by a hash of ``item``, and any two of
    its rows meet in exactly one pair of blocks (rows of one block in (i, i)).  ``left`` tells the side of block i.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("group_rows"))
    blocks = F.ceil(F.col("group_rows") / block).cast("int")
    sized = rows.join(sizes, keys).withColumn("blocks", blocks).drop("group_rows")
    own = F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")
    spread = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(*rows.columns, (F.col("own") <= F.col("other")).alias("left"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
