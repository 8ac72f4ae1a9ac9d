"""Hard-negative mining over a vector-approximation file (operator 11).

Vectors become whole numbers, floor(scale * x).  Each dimension is cut into cells (quantiles of the SAMPLE rows with the least hashes; the outermost
cells end at the table's own extremes), and the file holds one cell a byte.  For an anchor, a table of each dimension's cells
gives the least and the largest product that a component there can have; looked up and added, they bound a row's score.

Two searches, one for positives and one for negatives, go over the file in units of ANCHORS anchors and ROWS rows:
1. A unit keeps the rows whose upper bound reaches the k-th largest lower bound among those that surely count: rows of the
   anchor's label for positives; for negatives rows of other labels whose bounds lie inside a positive's window.  Rows that can't be in a
   window, or can't come first in it, are never scored.
2. The k-th largest lower bound over all units thins them out again; the survivors' vectors are fetched and scored exactly.

What is copied to the units are bytes of cells, not vectors: a row's once for each block of anchors, an anchor once for each block of rows.
Rows of one label with equal vectors are one entry with its least vec_ids, so that copies neither crowd a window nor gather anywhere.

Edge cases: rows with null vec_id, null label, null vector or null or non-finite components take no part, neither do those with a component of
LARGEST or more after scaling (sums of squares don't fit) or of another length than the most common one (the shorter, if there are
two).  Of rows with one vec_id the least by label and vector counts.  Equal scores go to the smaller vec_id.  An anchor without positives, or a
positive without negatives, gives no rows; so does an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow, scope, stored
from tessera.llm.groups import whole_groups
from tessera.llm.hamerly import whole_numbers

#: Products of two components stay below 2^52, so that sums over 2,000 dimensions fit.
LARGEST = 2**26
#: A cell takes a byte in the file.
CELLS, SAMPLE = 256, 4_096
ANCHORS, ROWS = 1_024, 8_192


class Cells:
    """For each dimension the least and largest whole number of each cell."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, largest: np.ndarray):
        self.begins = []
        for column, low in zip(sample.T, least):
            cuts = np.unique(np.quantile(column, np.arange(1, CELLS) / CELLS, method="higher"))
            self.begins.append(np.concatenate([[low], cuts[cuts > low]]))
        self.ends = [np.append(b[1:] - 1, max(high, b[-1])) for b, high in zip(self.begins, largest)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, d], side="right") - 1 for d, b in enumerate(self.begins)], axis=1).astype(np.uint8)

    def bounds(self, anchor: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the anchor's inner product with rows, given the rows' cells by dimension."""
        low, high = (np.zeros(len(codes[0]) if codes else 0, dtype=np.int64) for _ in range(2))
        for a, begin, end, code in zip(anchor.tolist(), self.begins, self.ends, codes):
            one, other = a * begin, a * end
            low += np.minimum(one, other).take(code)
            high += np.maximum(one, other).take(code)
        return low, high


def _kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest, if there are so many."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The inner products of ``a`` and ``v`` instead of them."""
    for batch in batches:
        if batch.num_rows:
            a, v = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64) for c in ("a", "v"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("anchor_id", "target", "ids")), pa.array(np.einsum("ij,ij->i", a, v))], names=["anchor_id", "target", "ids", "score"])


class Miner:
    """The file over one table, and the searches over it."""

    def __init__(self, vectors: DataFrame, every: int, scale: int, ids: int):
        """``ids``: the most rows of one vector and label that any result can hold."""
        fits, whole = whole_numbers("embedding", scale, LARGEST)
        taking = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fits)
        rows = taking.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
        self.common = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
        self.every, self.spark = every, vectors.sparkSession
        if self.common is None:
            return
        once = rows.filter(F.size("v") == self.common["size"]).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*")
        first = Window.partitionBy("label", "v").orderBy("vec_id")
        few = once.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= ids)
        self.entries = stored(few.groupBy("label", "v").agg(F.min("vec_id").alias("name"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
        self.anchors = stored(once.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("a")))
        size = self.common["size"]
        sample = np.array([r["v"] for r in self.entries.orderBy(F.xxhash64("v"), "name").limit(SAMPLE).select("v").collect()], dtype=np.int64).reshape(-1, size)
        ends = self.entries.agg(F.count("*"), *[f(F.get("v", F.lit(d))) for f in (F.min, F.max) for d in range(size)]).first()
        self.cells = cells = Cells(sample, np.array(ends[1 : size + 1]), np.array(ends[size + 1 :]))
        self.blocks = max(1, -(-self.anchors.count() // ANCHORS)), max(1, -(-ends[0] // ROWS))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, size)
                    yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("label"), pa.array([c.tobytes() for c in cells.codes(x)], pa.binary())], names=["name", "label", "cells"])

        self.file = stored(self.entries.select("name", "label", "v").transform(in_arrow, code, "name long, label long, cells binary"))

    def candidates(self, asked: DataFrame, k: int, positives: bool) -> DataFrame:
        """anchor_id, target, name of the rows that may be among the first k of a target of ``asked`` (anchor_id, anchor_label, a, targets).

        ``targets`` are (target, least, most) structs: scores from least to most, in hundredths, count.
        """
        cells, (across, down) = self.cells, self.blocks
        nothing = {c: F.lit(None).cast(t) for c, t in (("a", "array<int>"), ("targets", "array<struct<target:long,least:long,most:long>>"), ("cells", "binary"))}
        rows = self.file.select(F.col("name").alias("id"), "label", "cells", F.pmod(F.xxhash64("name"), F.lit(down)).cast("int").alias("row_block"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("block"))
        dealt = asked.select(F.col("anchor_id").alias("id"), F.col("anchor_label").alias("label"), "a", "targets", F.pmod(F.xxhash64("anchor_id"), F.lit(across)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("row_block"))
        columns = ["block", "row_block", "id", "label", "cells", "a", "targets"]
        units = rows.withColumns({c: nothing[c] for c in ("a", "targets")}).select(columns).unionByName(dealt.withColumn("cells", nothing["cells"]).select(columns))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, group in whole_groups(batches, ["block", "row_block"]):
                bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
                for begin, end in zip(bounds, bounds[1:]):
                    yield from unit(table.slice(begin, end - begin))

        def unit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            is_row = table.column("cells").is_valid().to_numpy()
            given, anchors = table.filter(pa.array(is_row)), table.filter(pa.array(~is_row))
            if not given.num_rows or not anchors.num_rows:
                return
            order = np.argsort(given.column("label").to_numpy(), kind="stable")
            label, name = given.column("label").to_numpy()[order], given.column("id").to_numpy()[order]
            codes = np.frombuffer(b"".join(given.column("cells").to_pylist()), np.uint8).reshape(len(order), -1)[order]
            whole = [np.ascontiguousarray(c) for c in codes.T.astype(np.intp)]
            out: list[tuple] = []
            for anchor, own, a, targets in zip(*(anchors.column(c).to_pylist() for c in ("id", "label", "a", "targets"))):
                at, to = np.searchsorted(label, own, "left"), np.searchsorted(label, own, "right")
                if positives:
                    low, high = cells.bounds(np.array(a, dtype=np.int64), [c[at:to] for c in whole])
                    names = name[at:to]
                else:
                    low, high = cells.bounds(np.array(a, dtype=np.int64), whole)
                    low[at:to], high[at:to] = 1, 0  # none of these
                    names = name
                for t in targets:
                    may = (100 * high >= t["least"]) & (100 * low <= t["most"]) & (low <= high)
                    sure = may & (100 * low >= t["least"]) & (100 * high <= t["most"])
                    kth = _kth(low[sure], k)
                    found = np.flatnonzero(may if kth is None else may & (high >= kth))
                    out.append((np.full(len(found), anchor), np.full(len(found), t["target"]), names[found], low[found], high[found], sure[found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor_id", "target", "name", "low", "high", "sure"])

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keys = ["block", "row_block"]
        found = stored(units.repartition(parts, *keys).sortWithinPartitions(*keys).transform(in_arrow, search, "anchor_id long, target long, name long, low long, high long, sure boolean"))
        best = found.filter("sure").withColumn("at", F.row_number().over(Window.partitionBy("anchor_id", "target").orderBy(F.desc("low")))).filter(F.col("at") <= k)
        floor = best.groupBy("anchor_id", "target").agg(F.count("*").alias("n"), F.min("low").alias("kth")).filter(F.col("n") == k)
        return found.join(floor.drop("n"), ["anchor_id", "target"], "left").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("anchor_id", "target", "name")

    def scored(self, candidates: DataFrame) -> DataFrame:
        """anchor_id, target, vec_id, score: exact scores, a row for each of an entry's vec_ids."""
        vectors = candidates.join(self.entries.select("name", "v", "ids"), "name").join(self.anchors.select("anchor_id", "a"), "anchor_id")
        scores = vectors.select("anchor_id", "target", "ids", "a", "v").transform(in_arrow, _products, "anchor_id long, target long, ids array<long>, score long")
        return scores.select("anchor_id", "target", "score", F.explode("ids").alias("vec_id"))


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``rank``, from 1, and the first k by score, ties to the smaller vec_id."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over ``vectors`` (vec_id, label, a whole number, embedding).

    Anchors are rows whose vec_id is divisible by ``every``; their positives the ``positives`` best other rows of their label; a
    positive's negatives the ``negatives`` best rows of other labels whose score is from ``least`` to ``most`` hundredths of the positive's.
    """
    with scope() as own:
        spark = vectors.sparkSession
        miner = Miner(vectors, every, scale, max(positives + 1, negatives))
        if miner.common is None:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        limit = F.lit(2**62)
        target = lambda target, low, high: F.struct(target.cast("long").alias("target"), low.cast("long").alias("least"), high.cast("long").alias("most"))
        any_score = miner.anchors.withColumn("targets", F.array(target(F.lit(0), -limit, limit)))
        near = miner.scored(miner.candidates(any_score, positives + 1, True)).filter("vec_id <> anchor_id")
        positive = stored(_first(near, ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        windows = positive.filter("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(target(F.col("positive_id"), F.col("positive_score") * least, F.col("positive_score") * most)).alias("targets"))
        found = miner.scored(miner.candidates(miner.anchors.join(windows, "anchor_id"), negatives, False)).withColumnRenamed("target", "positive_id").join(positive, ["anchor_id", "positive_id"])
        inside = found.filter((F.col("score") * 100 >= F.col("positive_score") * least) & (F.col("score") * 100 <= F.col("positive_score") * most))
        told = _first(inside, ["anchor_id", "positive_id"], negatives)
        return own.keep(stored(told.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
