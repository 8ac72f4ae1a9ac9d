"""Folds by composed chunks against plain folds over one long sequence, and numbering in the whole order."""

import random

from pyspark.sql import functions as F

from tessera.operators import packing, scans, windows


def test_segments_of_a_million_positions_under_one_key(spark):
    n = 1_000_000
    flag = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    rows = spark.range(n, numPartitions=4).select(F.lit("s").alias("seq"), F.col("id").alias("pos"), F.when(F.col("id") % 1001 > 0, flag).alias("boundary"))
    found = sorted((r["begin"], r["length"]) for r in windows.bounded_segments(rows, "seq", "pos", 4, 16).collect())
    flags = [bool(r[0]) for r in rows.orderBy("pos").select("boundary").collect()]
    expected, begin, run = [], 0, 0
    for at, f in enumerate(flags):
        if run and ((f and run >= 4) or run >= 16):
            expected.append((begin, run))
            begin, run = at, 0
        run += 1
    assert found == [*expected, (begin, run)]


def test_many_levels_and_groups(spark):
    r = random.Random(2)
    sizes = {g: [r.choice([0, 1, 2, 3, 7, 40, 90]) for _ in range(n)] for g, n in (("a", 700), ("b", 1), ("c", 60), (None, 33))}
    rows = spark.createDataFrame([(g, i, s) for g, own in sizes.items() for i, s in enumerate(own)] + [("d", 0, None)], "g string, i long, s long")

    def step(used, n):
        import numpy as np

        begins = (used == 0) | (used + n > 50)
        return np.where(begins, n, used + n).clip(max=50), begins & (n > 0)

    whole = rows.fillna(0, ["s"])
    found = {(x["g"], x["i"]): max(0, x["part"]) for x in scans.numbered_parts(whole, "g", ["s", "i"], "s", step, 51, chunk=5, fan=3).collect()}
    packed = {(x["g"], x["i"]): x["bin"] for x in packing.pack_first_fit(rows, "g", "i", "s", 50).collect()}
    assert found == packed == {(g, i): b for g, own in (sizes | {"d": [0]}).items() for i, b in enumerate(packing.first_fit(own, 50))}


def test_empty_sequences(spark):
    rows = spark.createDataFrame([], "seq string, pos long, boundary boolean")
    assert windows.bounded_segments(rows, "seq", "pos", 4, 16).collect() == []
    assert windows.ordinal(rows, ["pos"]).collect() == []


def test_ties_on_the_first_key_are_spread(spark):
    """All rows tie on the first key: parts follow the second one, nulls come first."""
    rows = spark.range(5000).select(F.lit(1).alias("a"), F.when(F.col("id") > 10, F.col("id")).alias("b"), "id")
    found = windows.ordinal(rows, ["a", "b", "id"], part_rows=300)
    assert [r["id"] for r in found.orderBy("ordinal").collect()] == list(range(5000))
    assert [r["ordinal"] for r in found.orderBy("id").collect()] == list(range(5000))


def test_nothing_written_is_left(spark):
    import os

    from tessera.tables import shared_dir, working

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with working(spark):
        rows = spark.range(100).select(F.lit(1).alias("s"), F.col("id").alias("p"), (F.col("id") % 7 == 0).alias("boundary"))
        assert windows.bounded_segments(rows, "s", "p", 2, 5).count() > 0
        assert len(set(os.listdir(folder)) - before) == 1  # what the plan reads
    assert set(os.listdir(folder)) <= before
