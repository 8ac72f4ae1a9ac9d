"""Similarity search, tensor averages and community measures of similarity matrices in long form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vectors import cosine, dot, norm  # noqa: F401
from tessera.operators.blocksearch import BlockSearch

#: Queries that are held on every executor; more of them look into blocks of about ROW_BLOCK rows (``blocksearch``).
QUERY_BLOCK, ROW_BLOCK = 4_096, 32_768
#: Scores that a worker holds at a time, and pairs whose vectors it gathers.
SCORES, PAIRS = 1_000_000, 50_000
_FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array | pa.ChunkedArray, n: int, measure: str) -> np.ndarray:
    x = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy().reshape(n, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if measure == "cosine" else x


def _nearest(ids: np.ndarray, q: np.ndarray, vec: np.ndarray, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of the k + 1 best rows of each query and those that equal the last; SCORES products at a time."""
    step = max(1, SCORES // max(1, len(vec)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        scores = part @ x.T
        least = np.partition(scores, len(vec) - k - 1, axis=1)[:, len(vec) - k - 1] - 1e-9 if len(vec) > k + 1 else np.full(len(part), -np.inf)
        i, j = np.nonzero(scores >= least[:, None])
        for begin in range(0, len(i), PAIRS):  # equal rows can be many
            a, b = i[begin : begin + PAIRS], j[begin : begin + PAIRS]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at + a]), pa.array(vec[b]), pa.array(np.einsum("ij,ij->i", part[a], x[b]))], names=["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, rows: DataFrame, k: int, measure: str = "dot") -> DataFrame:
    """Exact (query_id, vec_id, score, rank): matrix products against all rows with a partial top-k in each batch, or blocks with bounds."""
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    given = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    held = asked.limit(QUERY_BLOCK + 1).collect()
    if len(held) <= QUERY_BLOCK:
        ids, q = np.array([r["query_id"] for r in held], dtype=np.int64), np.array([r["embedding"] for r in held], dtype=np.float64)
        if measure == "cosine" and len(q):
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(q):
                    yield from _nearest(ids, q, batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding"), batch.num_rows, measure), k)

        found = given.mapInArrow(run, _FOUND)
    else:
        return BlockSearch(given, measure, block_rows=ROW_BLOCK).top_k(asked, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return found.filter("query_id <> vec_id").withColumn("rank", rank).filter(F.col("rank") <= k)


def tensor_mean(rows: DataFrame, group: str, vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """Element-wise mean (or weighted sum) of vectors by group: explode by position, partial sums, gather in order."""
    w = F.col(weight) if weight else F.lit(1.0)
    long = rows.select(group, w.alias("w"), F.posexplode(vector).alias("pos", "value"))
    total = F.sum(F.col("w") * F.col("value").cast("double"))
    by_place = long.groupBy(group, "pos").agg((total if weight else total / F.count("*")).alias("value"))
    return by_place.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: F.round(x["value"], 6)).alias("vector"))


def split_measures(weights: DataFrame, size: int) -> DataFrame:
    """(t, modularity, conductance, intra_inter) of each split of 0..size-1 at t, from (i, j, w) of a symmetric matrix.

    Undefined ratios are null.  Sums by (i < t, j < t) for all t come from prefix sums over ``max(i, j)`` and ``i``, so each weight is read once and not once per split.
    """
    cells = weights.select("i", "j", "w")
    # inside the first part: both below t; its volume: i below t
    inside = cells.groupBy(F.greatest("i", "j").alias("at")).agg(F.sum("w").alias("w_in"), F.count("*").alias("n_in"))
    volume = cells.groupBy(F.col("i").alias("at")).agg(F.sum("w").alias("w_vol"), F.count("*").alias("n_vol"))
    total = cells.agg(F.sum("w").alias("w_all"), F.count("*").alias("n_all"))
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as the matrix has lines
    places = weights.sparkSession.range(size).withColumnRenamed("id", "at")
    joined = places.join(inside, "at", "left").join(volume, "at", "left").fillna(0)
    sums = joined.select((F.col("at") + 1).alias("t"), *[F.sum(c).over(upto).alias(c) for c in ("w_in", "n_in", "w_vol", "n_vol")]).filter(F.col("t") < size)
    whole = total.first()
    w_all, n_all = F.lit(float(whole["w_all"] or 0.0)), F.lit(int(whole["n_all"]))
    a_in, a_vol = F.col("w_in"), F.col("w_vol")
    b_vol = w_all - a_vol
    cut = a_vol - a_in
    b_in = b_vol - cut
    whole_w = F.nullif(w_all, F.lit(0.0))
    modularity = ((a_in - a_vol * a_vol / whole_w) + (b_in - b_vol * b_vol / whole_w)) / (2 * whole_w)
    conductance = F.least(cut / F.greatest(a_vol, F.lit(1e-15)), cut / F.greatest(b_vol, F.lit(1e-15)))
    n_cut = F.col("n_vol") - F.col("n_in")
    n_b_in = n_all - F.col("n_vol") - n_cut
    zero = F.lit(0)
    intra = (a_in + b_in) / F.nullif(F.col("n_in") + n_b_in, zero)
    inter = cut / F.nullif(n_cut, zero)
    return sums.select("t", modularity.alias("modularity"), conductance.alias("conductance"), (intra / F.nullif(inter, F.lit(0.0))).alias("intra_inter"))


#: Similarity measures by name, as columns of ``split_measures``; conductance is better when smaller.
MEASURES = {"modularity": "modularity", "conductance": "conductance", "intra_inter_sim": "intra_inter"}


def best_split(measures: DataFrame, name: str) -> DataFrame:
    if name not in MEASURES:
        raise ValueError(f"unknown measure: {name}")
    value = F.col(MEASURES[name])
    key = value if name == "conductance" else -value
    return measures.filter(value.isNotNull()).agg(F.min_by("t", F.struct(key.alias("v"), F.col("t"))).alias("t"))
