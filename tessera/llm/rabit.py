"""Embedding near-duplicates with randomised-rotation binary codes (operator 7).

A vector is normalised, rotated by a fixed random orthogonal matrix and stored as the signs of its coordinates (one bit each)
with a correction factor a, the inner product of the rotated vector and its code c (signs over the root of the dimension).  For
another vector y, <c, y> / a is an unbiased estimate of <x, y> over rotations.  The other side is stored in whole numbers of four bits
a coordinate, as bit planes: <c, q> then is a sum of population counts of packed bits, and what q lacks of y is bounded by the length e
of the difference, stored too.

Which pairs need exact recomputation is decided by the estimate <c, q> / a and its confidence bound, taken at full confidence: from
x = a c + rest follows that a pair at the threshold t has <c, y> >= cos(arccos a + arccos t), so that its estimate is t - w at least,
w = t - (cos(arccos a + arccos t) - e) / a.  A pair whose estimates, either vector being the code, reach that is recomputed in double
precision on the original vectors; all others are surely below the threshold, so no link is lost.

1. Equal vectors of a label are one, with their number.  Codes, factors and planes, a sixth of the vectors' bytes, go to pairs of blocks
   of BLOCK rows; each returns the rows that have a pair to be recomputed.
2. Only those rows' vectors are fetched for the pair of blocks, where the open pairs are recomputed.  A unit returns for each vector
   its number of links and one link towards its component, never all pairs.

Work grows with the square of a group's size, at some nanoseconds a pair; bytes that move are those of codes.

Edge cases: null label, null or zero vectors and vectors with null or non-finite components link with nothing; vectors
of different lengths don't link; rows with one vec_id are one vector (the least label and embedding, nulls last); ties don't
matter; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, in_arrow, stored
from tessera.llm.components import block_pairs, components
from tessera.llm.groups import Forest, whole_groups

BLOCK, SEED = 1_024, 7
#: Bits a coordinate on the other side, pairs recomputed at a time, and what rounding may be off by.
PLANES, RECOMPUTED, SLACK = 4, 50_000, 1e-9

_rotations: dict[int, np.ndarray] = {}


def rotation(dimension: int) -> np.ndarray:
    """The random orthogonal matrix of a dimension."""
    if dimension not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimension, dimension)))
        _rotations[dimension] = q * np.sign(np.diag(r))
    return _rotations[dimension]


class Codes:
    """Codes of unit vectors (rows): packed signs and factors, and for the other side planes, step, offset and the length of what they lack."""

    def __init__(self, bits: np.ndarray, planes: np.ndarray, numbers: np.ndarray, dimension: int):
        self.bits, self.planes, self.dimension = bits, planes, dimension
        self.factor, self.step, self.least, self.total, self.lack = numbers.T

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        n, dimension = unit.shape
        turned = unit @ rotation(dimension)
        factor = np.abs(turned).sum(axis=1) / np.sqrt(dimension)
        least = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - least) / (2**PLANES - 1), 1e-12)
        whole = np.rint((turned - least[:, None]) / step[:, None]).astype(np.uint8)
        rounded = least[:, None] + step[:, None] * whole
        lack = np.linalg.norm(turned - rounded, axis=1)
        words = -(-dimension // 64) * 64
        padded = np.zeros((n, PLANES + 1, words), dtype=bool)
        padded[:, 0, :dimension] = turned >= 0
        for p in range(PLANES):
            padded[:, p + 1, :dimension] = whole >> p & 1
        packed = np.packbits(padded, axis=2, bitorder="little").view("<u8")
        numbers = np.stack([factor, step, least, rounded.sum(axis=1), lack], axis=1)
        return cls(packed[:, 0], packed[:, 1:], numbers, dimension)

    def take(self, rows: np.ndarray) -> Codes:
        return Codes(self.bits[rows], self.planes[rows], np.stack([self.factor, self.step, self.least, self.total, self.lack], axis=1)[rows], self.dimension)

    def estimates(self, other: Codes) -> np.ndarray:
        """[i, j]: <c_i, q_j>, from population counts: the sum of q_j where the sign is positive, twice, less all of it."""
        where = np.zeros((len(self.bits), len(other.bits)), dtype=np.int32)
        for p in range(PLANES):
            for w in range(self.bits.shape[1]):
                where += np.left_shift(np.bitwise_count(self.bits[:, None, w] & other.planes[None, :, p, w]).astype(np.int32), p)
        positive = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        return (2 * (where * other.step + positive[:, None] * other.least) - other.total) / np.sqrt(self.dimension)

    def allowed(self, other: Codes, threshold: float) -> np.ndarray:
        """[i, j]: whether the unbiased estimate of <x_i, y_j> and its bound leave room for the threshold."""
        least = np.cos(np.minimum(np.arccos(np.clip(self.factor, -1, 1)) + np.arccos(threshold), np.pi))
        estimate = self.estimates(other) / self.factor[:, None]
        width = threshold - (least[:, None] - other.lack[None, :] - SLACK) / self.factor[:, None]
        return estimate >= threshold - width


def usable(embedding: str) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    c = F.col(embedding)
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(c, lambda v: v != 0)


def _units(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Instead of the embedding its packed bits (signs, then planes) and numbers."""
    for batch in batches:
        vectors = batch.column("embedding").to_pylist()
        bits, numbers = [b""] * len(vectors), np.zeros((len(vectors), 5))
        for size in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == size]
            found = Codes.of(_units(np.array([vectors[i] for i in at], dtype=np.float64)))
            numbers[at] = np.stack([found.factor, found.step, found.least, found.total, found.lack], axis=1)
            for i, sign, planes in zip(at, found.bits, found.planes):
                bits[i] = sign.tobytes() + planes.tobytes()
        rest = batch.drop_columns(["embedding"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(bits, pa.binary()), *[pa.array(n) for n in numbers.T]], names=[*rest.schema.names, "bits", "factor", "step", "low", "total", "lack"])


def _sides(unit: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two sides of a unit, and whether they are two."""
    across = unit.column("i")[0].as_py() != unit.column("j")[0].as_py()
    left = unit.column("left").to_numpy()
    return (np.flatnonzero(left), np.flatnonzero(~left), True) if across else (np.arange(unit.num_rows), np.arange(unit.num_rows), False)


def _open(a: Codes, b: Codes, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that need recomputing."""
    maybe = a.allowed(b, threshold)
    if across:
        maybe &= b.allowed(a, threshold).T
    else:
        maybe = np.triu(maybe & maybe.T, 1)
    return np.nonzero(maybe)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Units of more than one row; batches are sorted by label, size, i, j."""
    for table, group in whole_groups(batches, ["label", "size", "i", "j"]):
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for begin, end in zip(bounds, bounds[1:]):
            if end - begin > 1:
                yield table.slice(begin, end - begin)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector in ``vectors`` (vec_id long, embedding, label)."""
    last = F.struct(F.col("label").isNull(), "label", F.col("embedding").isNull(), "embedding").alias("row")
    rows = vectors.groupBy("vec_id").agg(F.min(last).alias("row")).select("vec_id", "row.label", "row.embedding")
    taking = rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("embedding"))
    named = stored(taking.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.size("embedding").alias("size"), F.col("embedding").cast("array<double>").alias("embedding")))
    whole = ["label", "size", "embedding"]
    equal = stored(named.groupBy(*whole).agg(F.min("vec_id").alias("name"), F.count("*").alias("copies")))  # a row for each different vector
    kind = equal.schema["label"].dataType.simpleString()
    schema = f"name long, label {kind}, size int, copies long, bits binary, factor double, step double, low double, total double, lack double"
    coded = stored(equal.select("name", "label", "size", "copies", "embedding").transform(in_arrow, _coded, schema))
    units = block_pairs(coded, ["label", "size"], "name", BLOCK)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "size", "i", "j"]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _groups(batches):
            a, b, across = _sides(unit)
            dimension = unit.column("size")[0].as_py()
            words = -(-dimension // 64)
            bits = np.frombuffer(b"".join(unit.column("bits").to_pylist()), dtype="<u8").reshape(unit.num_rows, PLANES + 1, words)
            codes = Codes(bits[:, 0], bits[:, 1:], np.stack([unit.column(c).to_numpy() for c in ("factor", "step", "low", "total", "lack")], axis=1), dimension)
            i, j = _open(codes.take(a), codes.take(b), across, threshold)
            if len(i):
                found = unit.select(["name", "copies", *keys, "left"]).take(pa.array(np.unique(np.concatenate([a[i], b[j]]))))
                yield from found.combine_chunks().to_batches()

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _groups(batches):
            a, b, across = _sides(unit)
            x = _units(unit.column("embedding").combine_chunks().flatten().to_numpy().reshape(unit.num_rows, -1))
            codes, names, copies = Codes.of(x), unit.column("name").to_numpy(), unit.column("copies").to_numpy()
            i, j = _open(codes.take(a), codes.take(b), across, threshold)
            count, forest = np.zeros(len(names), dtype=np.int64), Forest(len(names))
            for at in range(0, len(i), RECOMPUTED):
                p, q = a[i[at : at + RECOMPUTED]], b[j[at : at + RECOMPUTED]]
                linked = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[linked], q[linked]
                np.add.at(count, p, copies[q])
                np.add.at(count, q, copies[p])
                forest.join(p, q)
            found = np.flatnonzero(count)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(names[found]), pa.array(count[found]), pa.array(names[forest.root[found]])], names=["a", "n", "b"])

    left = f"name long, copies long, label {kind}, size int, i int, j int, left boolean"
    asked = stored(units.repartition(parts, *keys).sortWithinPartitions(*keys).transform(in_arrow, screen, left))
    again = asked.join(equal.select("name", "embedding"), "name").repartition(parts, *keys).sortWithinPartitions(*keys)
    found = stored(again.transform(in_arrow, recompute, "a long, n long, b long"))
    counts = found.groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("links"))
    parts_of = components(found.select("a", "b")).withColumnRenamed("node", "name")
    told = stored(equal.join(counts, "name", "left").join(parts_of, "name", "left").select(*whole, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "name").alias("component")))
    forget(coded, asked, found)
    every = named.join(told, whole).select("vec_id", "n_links", "component")
    joined = rows.select("vec_id").join(every, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
