"""Exact nearest vectors of very many queries: rows in blocks around centroids, blocks that can't hold a neighbour skipped.

Rows belong to the nearest of some centroids (of a bounded sample) and stay there.  By Cauchy-Schwarz no row of a block with centroid c, radius r
and largest norm m scores more than min(<q, c> + |q| r, |q| m).  A query first looks into its most promising block; its k-th best score
there is its bar, and then it goes to those other blocks only whose bound reaches the bar.  A block's rows are sent once for every
QUERIES queries that come to it, so what is copied is what can matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import working, written

SAMPLE, MOST_BLOCKS, BLOCK_ROWS, QUERIES = 8_192, 4_096, 32_768, 4_096
#: Scores, or (query, block) rows with their vectors, that a worker holds at a time.
SCORES, VISITS = 1_000_000, 20_000
SLACK = 1e-9
_FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy().reshape(n, -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


class Blocks:
    """Centroids, and each block's radius, largest norm and number of rows."""

    def __init__(self, measure: str):
        self.measure = measure

    def fit(self, x: np.ndarray, blocks: int) -> None:
        x = self.scaled(x)
        self.centers = x[:: max(1, len(x) // blocks)][:blocks].copy()
        for _ in range(5):
            near = self.nearest(x)
            for c in range(len(self.centers)):
                if (near == c).any():
                    self.centers[c] = x[near == c].mean(axis=0)
        self.radius, self.norm, self.size = (np.zeros(len(self.centers)) for _ in range(3))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if self.measure == "cosine" else x

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.centers**2).sum(axis=1) - 2 * x @ self.centers.T).argmin(axis=1)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """[query, block]: what no row of the block exceeds; minus infinity for empty blocks."""
        length = np.linalg.norm(q, axis=1)[:, None]
        bound = np.minimum(q @ self.centers.T + length * self.radius, length * self.norm) + SLACK
        return np.where(self.size > 0, bound, -np.inf)


class BlockSearch:
    """Blocks over ``rows`` (vec_id, embedding); ``skipped`` is the share of (query, block) pairs that the last search left out."""

    def __init__(self, rows: DataFrame, measure: str = "dot", blocks: int | None = None, block_rows: int = BLOCK_ROWS):
        self.skipped, self.blocks = 0.0, Blocks(measure)
        given = rows.filter(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        n = given.count()
        blocks = blocks or max(1, min(MOST_BLOCKS, max(int(n**0.5 / 4), -(-n // block_rows))))
        sample = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
        made = self.blocks
        made.fit(np.array([r["embedding"] for r in sample], dtype=np.float64).reshape(len(sample), -1), blocks)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = made.scaled(_matrix(batch.column("embedding"), batch.num_rows))
                    block = made.nearest(x)
                    columns = [batch.column("vec_id"), _lists(x), pa.array(block, pa.int32()), pa.array(np.linalg.norm(x - made.centers[block], axis=1)), pa.array(np.linalg.norm(x, axis=1))]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "block", "far", "norm"])

        self.rows = written(given.mapInArrow(file, "vec_id long, embedding array<double>, block int, far double, norm double"))
        for r in self.rows.groupBy("block").agg(F.max("far").alias("far"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect():
            made.radius[r["block"]], made.norm[r["block"]], made.size[r["block"]] = r["far"], r["norm"], r["n"]

    def _met(self, asked: DataFrame, k: int) -> DataFrame:
        """The best k + 1 of each (query, block) of ``asked`` (query_id, embedding, block), and what equals the last."""
        counts = {r["block"]: r["n"] for r in asked.groupBy("block").agg(F.count("*").alias("n")).collect()}
        split = F.create_map(*[F.lit(v) for b, n in counts.items() for v in (b, -(-n // QUERIES))]) if counts else F.create_map(F.lit(0), F.lit(1))
        left = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), split[F.col("block")]).cast("int"))
        right = self.rows.filter(split[F.col("block")].isNotNull()).select("vec_id", "embedding", "block", F.explode(F.sequence(F.lit(0), split[F.col("block")] - 1)).alias("turn"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            q, x = _matrix(a.column("embedding"), a.num_rows), _matrix(b.column("embedding"), b.num_rows)
            ids, vec = a.column("query_id").to_numpy(), b.column("vec_id").to_numpy()
            out, step = [], max(1, SCORES // len(vec))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                scores = part @ x.T
                least = np.partition(scores, len(vec) - k - 1, axis=1)[:, len(vec) - k - 1] - SLACK if len(vec) > k + 1 else np.full(len(part), -np.inf)
                i, j = np.nonzero(scores >= least[:, None])
                score = np.concatenate([np.einsum("ij,ij->i", part[i[b : b + VISITS]], x[j[b : b + VISITS]]) for b in range(0, max(1, len(i)), VISITS)])
                out.append((ids[at + i], vec[j], score))
            return pa.table({name: pa.array(np.concatenate(c)) for name, c in zip(("query_id", "vec_id", "score"), zip(*out))})

        return left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInArrow(meet, _FOUND)

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, score, rank of the k best other rows of each query (query_id, embedding); ties to the smaller vec_id."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
        with working(queries.sparkSession) as keep:
            made = self.blocks
            asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))

            def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                """Each query with the block that it looks into first (no bar) or those that its bar leaves open besides."""
                step = max(1, VISITS // max(1, len(made.size)))  # a query can go to every block
                for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
                    q = made.scaled(_matrix(batch.column("embedding"), batch.num_rows))
                    bound = made.bounds(q)
                    first = bound.argmax(axis=1)
                    if "bar" in batch.schema.names:
                        bar = np.array(batch.column("bar").fill_null(-np.inf).to_pylist())
                        open_ = (bound >= bar[:, None] - 2 * SLACK) & (made.size > 0)
                        open_[np.arange(len(q)), first] = False
                        i, block = np.nonzero(open_)
                    else:
                        i, block = np.arange(len(q)), first
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(i)), _lists(q[i]), pa.array(block, pa.int32())], names=["query_id", "embedding", "block"])

            fields = "query_id long, embedding array<double>, block int"
            begun = written(asked.mapInArrow(visits, fields))
            seen = written(self._met(begun, k).filter("query_id <> vec_id"))
            bars = seen.withColumn("rank", rank).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
            again = written(asked.join(bars, "query_id", "left").select("query_id", "embedding", "bar").mapInArrow(visits, fields))
            n = begun.count()
            self.skipped = 1 - (n + again.count()) / max(1, n * int((made.size > 0).sum()))
            found = seen.unionByName(self._met(again, k).filter("query_id <> vec_id"))
            done = written(found.withColumn("rank", rank).filter(F.col("rank") <= k))
            keep.append(done)
        return done
