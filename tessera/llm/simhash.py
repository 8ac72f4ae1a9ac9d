"""SimHash near-duplicates with pivot distance tables (operator 8).

Fingerprints: 64 bits by majority over the hashes of a text's word shingles.  Equal fingerprints are one row from then on.
Two fingerprints at RADIUS bits or fewer leave at least two of five bit blocks untouched, so each is filed under
its ten pairs of blocks and only fingerprints that share such a key are compared: no link is missed, and random
fingerprints share a key of 25 or 26 bits once in tens of millions.

Inside a key, distances to PIVOTS reference fingerprints are tabulated.  By the triangle inequality two fingerprints within RADIUS
have distances to each reference that differ by RADIUS at most: rows are sorted by the first distance and walked
only that far apart, pairs whose greatest coordinate difference is larger are discarded, and the rest verified bit by bit.
A key with many fingerprints is compared in pairs of blocks of BLOCK rows, each a unit of work of its own; what a unit
returns are links that span its components, at most one a row, never all pairs.

Edge cases: a text of fewer words is one shingle; null, empty or blank texts have fingerprint zero and link like any other; null
doc_id takes part but never names a component (null if it is alone there); repeated rows are rows with the same result; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow, stored
from tessera.llm.components import block_pairs, components
from tessera.llm.groups import Forest, whole_groups

SHINGLE, SEED, RADIUS = 3, 42, 3
PIVOTS, BLOCK = 16, 512
BLOCK_BITS = (13, 13, 13, 13, 12)
#: Shingles whose bits are counted at a time.
COUNTED = 200_000


def references(n: int) -> np.ndarray:
    """The reference fingerprints: n numbers of a fixed random sequence."""
    return np.random.default_rng(20_240_229).integers(0, 2**64, size=n, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of a text, ASCII letters lower-cased, words parted by ASCII white space."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    if len(found) < words:
        return [xxh64_intdigest(b" ".join(found), SEED)]
    return [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(found[i:] for i in range(words))))]


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set (lowest first)."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    bits = majority(np.array(hashes, dtype=np.uint64)) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                fps = np.array([fingerprint(t.as_py(), words) for t in rows.column("text")], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).transform(in_arrow, run, f"doc_id {kind}, fp long")


def block_keys(fp: Column) -> list[Column]:
    """The ten keys of a 64-bit fingerprint: its pairs of bit blocks."""
    starts = [sum(BLOCK_BITS[:i]) for i in range(len(BLOCK_BITS))]
    parts = [F.shiftrightunsigned(fp, s).bitwiseAND((1 << n) - 1) for s, n in zip(starts, BLOCK_BITS)]
    pairs = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    return [F.lit(k << 26) + F.shiftleft(parts[a], BLOCK_BITS[b]) + parts[b] for k, (a, b) in enumerate(pairs)]


def _filed(nodes: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under its ten pairs of bit blocks."""
    return nodes.select(F.explode(F.array(*block_keys(F.col("fp")))).alias("key"), "fp")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) of each group (key, i, j)."""
    pivots = references(PIVOTS)
    for table, group in whole_groups(batches, ["key", "i", "j"]):
        fps = table.column("fp").to_numpy().view(np.uint64)
        across = table.column("i").to_numpy() != table.column("j").to_numpy()
        left = table.column("left").to_numpy(zero_copy_only=False)
        distance = np.stack([np.bitwise_count(fps ^ p) for p in pivots], axis=1).astype(np.int8)
        order = np.lexsort((distance[:, 0], group))
        fps, across, left, distance, group = fps[order], across[order], left[order], distance[order], group[order]
        forest, active, step = Forest(len(fps)), np.arange(len(fps) - 1), 0
        while len(active):
            step += 1
            active = active[active + step < len(fps)]
            other = active + step
            near = (group[active] == group[other]) & (distance[other, 0] - distance[active, 0] <= RADIUS)
            active, other = active[near], other[near]  # farther rows of the sorted group are no nearer
            open_ = (~across[active] | (left[active] != left[other])) & (forest.root[active] != forest.root[other])
            a, b = active[open_], other[open_]
            for k in range(1, PIVOTS, 5):  # coordinate differences, a few references at a time
                fits = np.abs(distance[a, k : k + 5] - distance[b, k : k + 5]).max(axis=1, initial=0) <= RADIUS
                a, b = a[fits], b[fits]
            same = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
            forest.join(a[same], b[same])
        hung = np.flatnonzero(forest.root != np.arange(len(fps)))
        if len(hung):
            yield pa.RecordBatch.from_arrays([pa.array(fps[hung].view(np.int64)), pa.array(fps[forest.root[hung]].view(np.int64))], names=["a", "b"])


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of ``nodes`` (fp, distinct)."""
    filed = _filed(nodes)
    shared = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    units = block_pairs(filed.join(shared, "key", "left_semi"), ["key"], "fp", BLOCK)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").transform(in_arrow, _links, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that links reach, or the row's own) of each row."""
    rows = stored(fingerprints(docs, text, doc_id, words))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp")))
    labelled = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))
    labelled = stored(labelled)
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.join(labelled.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
