"""SimHash near-duplicates by similarity (operator 8 for word shingles and a Jaccard threshold, as the pipeline needs it).

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more; groups are what links connect.
A radius of 3 bits of 64 can't say that: at 0.8 a bit differs with probability 0.15.  So fingerprints are wider here, BITS bits, and the
radius follows from the threshold.  Over all sizes of two sets at 0.8, nested ones included, a bit differs with probability 0.1612 at most
(0.151 in large ones), but for 4 of 5 shingles; so more than RADIUS bits differ in one such pair of 10^17, while unrelated texts differ
in 128.  Pairs whose smaller set has SMALL shingles or fewer aren't discarded by fingerprints at all.

1. Fingerprints are filed as in operator 8, each of their 64-bit words under its ten pairs of bit blocks.  Under a key, pairs are discarded by
   size, by the greatest coordinate difference of their distances to PIVOTS reference fingerprints, and by their own distance.  Most
   near copies are found here; wide radii can't be filed by bit blocks for certain, so there is an exact way for the rest.
2. What two linked texts must have in common is a shingle of their prefixes.  Shingles have one order for all texts (those found to be common in a
   sample last, others by hash).  Two linked sets share 0.8 of the larger one at least, so the first n - ceil(0.8 n) + 1 shingles
   of each share one.  Shingles whose texts step 1 has all connected add nothing and go; under the others pairs that aren't connected yet
   are discarded as in step 1.
3. The components of the candidates of both are compared in pairs of blocks: whole shingle sets, exact counts.  A unit returns links that span
   its components, at most one a text.

Keys with many texts are compared in pairs of blocks of BLOCK texts.
Which shingles count as common decides how many candidates there are, never what is linked.

Edge cases: a text of fewer words is one shingle; null, empty or blank texts are one another's copies; ASCII letters are lower-cased.
Null and repeated doc_ids are told apart by their texts' hashes, repeated rows get one group; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column_names, forget, in_arrow, scope, stored
from tessera.llm.components import block_pairs, components
from tessera.llm.groups import Forest, whole_groups
from tessera.llm.simhash import SEED, block_keys

SHINGLE, BITS, RADIUS, SMALL, PIVOTS = 5, 256, 98, 5, 4
BLOCK = 512
#: One text of SAMPLED is looked at for common shingles: those of OFTEN such texts, MOST of them at most.
SAMPLED, OFTEN, MOST = 16, 8, 50_000
#: Rows up to which a table of row names is broadcast instead of shuffling the texts to it.
BROADCAST_ROWS = 200_000
#: Hashes of words that a worker remembers.
WORDS = 200_000


class WordHashes(dict):
    """Word to XXH64, a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= WORDS:
            self.clear()
        found = self[word] = xxh64_intdigest(word, SEED)
        return found


_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order: of its words' hashes, one after the other."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.array(list(map(_words.__getitem__, words)), dtype=np.uint64)
    n = min(SHINGLE, len(own))
    size = len(own) - n + 1
    found = np.full(size, n, dtype=np.uint64)
    for k in range(n):
        found = mixed(found + own[k : k + size])
    return np.unique(found)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """BITS bits, each by majority over the shingles."""
    steps = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(found), 20_000):
        wide = mixed(found[at : at + 20_000, None] + steps)
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")


def references() -> np.ndarray:
    """The reference fingerprints, of a fixed random sequence."""
    return np.random.default_rng(20_240_229).integers(0, 2**64, size=(PIVOTS, BITS // 64), dtype=np.uint64)


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of a set that one of those it is linked to has among its own first ones; common ones last (``common`` is sorted)."""
    n = len(found)
    take = n - (4 * n + 4) // 5 + 1 if n else 0
    if not len(common):
        return found[:take]
    often = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
    return np.concatenate([found[~often], found[often]])[:take]


def _common(docs: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of shingles that many different texts hold, by a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(t.as_py()) for t in batch.column("text").slice(at, 256)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    texts = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct()
    counted = texts.transform(in_arrow, run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    rows = counted.orderBy(F.desc("n"), "key").limit(MOST).collect()
    return np.sort(np.array([r["key"] for r in rows], dtype=np.int64).view(np.uint64))


def _nodes(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, copy (a hash of the text), node (a hash of its shingle set), size, fp and keys (its prefix; both null where the task has had the node)."""
    common = _common(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        had: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                node, size, fps, keys = [], [], [], []
                for t in rows.column("text"):
                    found = shingles(t.as_py())
                    node.append(xxh64_intdigest(found.tobytes()))
                    size.append(len(found))
                    new = node[-1] not in had
                    fps.append(fingerprint(found).view(np.int64) if new else None)
                    keys.append(prefix(found, common).view(np.int64) if new else None)
                    had.add(node[-1])
                columns = [rows.column("doc_id"), rows.column("copy"), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "node", "size", "fp", "keys"])

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("copy"))
    return stored(named.transform(in_arrow, run, f"doc_id {kind}, copy long, node long, size int, fp array<long>, keys array<long>"))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) of the pairs under each (key, i, j) that sizes and fingerprints allow, between ``part``s: what is connected already."""
    pivots = references()
    for table, group in whole_groups(batches, ["key", "i", "j"]):
        part, size = table.column("part").to_numpy(), table.column("size").to_numpy().astype(np.int64)
        across = table.column("i").to_numpy() != table.column("j").to_numpy()
        left = table.column("left").to_numpy(zero_copy_only=False)
        fps = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(part), -1)
        distance = np.stack([np.bitwise_count(fps ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)
        order = np.lexsort((size, group))
        part, size, across, left, fps, distance, group = part[order], size[order], across[order], left[order], fps[order], distance[order], group[order]
        forest, active, step = Forest(len(part)), np.arange(len(part) - 1), 0
        known = np.lexsort((part, group))
        again = np.flatnonzero((part[known][1:] == part[known][:-1]) & (group[known][1:] == group[known][:-1]))
        forest.join(known[again], known[again + 1])
        while len(active):
            step += 1
            active = active[active + step < len(part)]
            other = active + step
            near = (group[active] == group[other]) & (5 * size[active] >= 4 * size[other])
            active, other = active[near], other[near]  # the rows after it in the sorted group are larger still
            open_ = (~across[active] | (left[active] != left[other])) & (forest.root[active] != forest.root[other])
            a, b = active[open_], other[open_]
            small = size[a] <= SMALL
            fits = small | (np.abs(distance[a] - distance[b]).max(axis=1, initial=0) <= RADIUS)
            a, b, small = a[fits], b[fits], small[fits]
            same = small | (np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int16) <= RADIUS)
            forest.join(a[same], b[same])
        hung = np.flatnonzero(part[forest.root] != part)
        if len(hung):
            yield pa.RecordBatch.from_arrays([pa.array(part[hung]), pa.array(part[forest.root[hung]])], names=["a", "b"])


def spanning(sets: list[np.ndarray], left: np.ndarray | None = None) -> np.ndarray:
    """For each set the least place that links reach; with ``left``, only links between its two sides count."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    _, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    side = None if left is None else np.asarray(left)[order]
    forest, present = Forest(len(sets)), np.zeros(ids.max(initial=-1) + 1, dtype=bool)
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(4 * sizes, 5 * sizes[i], side="right"))  # larger ones are too large
        others = np.arange(i + 1, end)
        open_ = forest.root[others] != forest.root[i]
        if side is not None:
            open_ &= side[others] != side[i]
        others = others[open_]
        if not len(others):
            continue
        own = ids[begins[i] : ends[i]]
        present[own] = True
        # what each open set shares with this one: running sums over its places
        both = np.array([np.count_nonzero(present[ids[begins[k] : ends[k]]]) for k in others]) if len(others) < 8 else np.add.reduceat(present[ids[begins[others[0]] : ends[others[-1]]]], begins[others[0] : others[-1] + 1] - begins[others[0]], dtype=np.int64)[others - others[0]]
        present[own] = False
        linked = others[5 * both >= 4 * (sizes[i] + sizes[others] - both)]
        if len(linked):
            forest.join(np.full(len(linked), i), linked)
    out = np.empty(len(sets), dtype=np.int64)
    out[order] = order[forest.root]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) of each unit (component, i, j); rows are sorted by unit and node."""
    unit, node, sets, left = None, [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            root = spanning(sets, np.array(left) if unit[1] != unit[2] else None)
            hung = np.flatnonzero(root != np.arange(len(sets)))
            if len(hung):
                names = np.array(node, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[hung]), pa.array(names[root[hung]])], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "node", "left")]
        for at, (component, i, j, n, side) in enumerate(zip(*columns)):
            if (component, i, j) != unit:
                yield from done()
                unit, node, sets, left = (component, i, j), [], [], []
            if not node or node[-1] != n:
                node.append(n)
                sets.append(shingles(batch.column("text")[at].as_py()))
                left.append(side)
    yield from done()


def with_names(docs: DataFrame, names: DataFrame, how: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` joined with ``names`` (doc_id, copy, ...) by id, null ones too, and hash of the text."""
    few = names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own_id, own_copy = column_names(docs, "name_id", "name_copy")
    names = names.withColumnsRenamed({"doc_id": own_id, "copy": own_copy})
    return docs.join(F.broadcast(names) if few else names, F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_copy)), how)


def without_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (doc_id, copy) that aren't among ``names``; ids may be null."""
    other = names.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left_anti")


def _compared(filed: DataFrame, told: DataFrame) -> DataFrame:
    """Spanning links (a, b) between parts of ``filed`` (key, node, part), by the sizes and fingerprints that ``told`` holds of nodes."""
    parts = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = block_pairs(filed, ["key"], "node", BLOCK).join(told.select("node", "size", "fp"), "node")
    return units.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").transform(in_arrow, _candidates, "a long, b long")


def close(told: DataFrame) -> DataFrame:
    """(node, component) of the texts among ``told`` (node, size, fp) that lie within RADIUS of another under a key of their fingerprints."""
    words = [F.col("fp")[w] for w in range(BITS // 64)]
    keys = [F.lit(w << 30) + key for w, word in enumerate(words) for key in block_keys(word)]
    filed = told.filter(F.col("size") > SMALL).select(F.explode(F.array(*keys)).alias("key"), "node", F.col("node").alias("part"))
    shared = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    many = stored(filed.join(shared, "key", "left_semi"))
    found = stored(components(_compared(many, told)))
    forget(many)
    return found


def _connected(rows: DataFrame, told: DataFrame, near: DataFrame) -> DataFrame:
    """(node, component): ``near`` joined with what texts that share a shingle of their prefixes add."""
    few = near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = rows.filter("keys IS NOT NULL").join(F.broadcast(near) if few else near, "node", "left")
    filed = placed.select(F.explode("keys").alias("key"), "node", F.coalesce("component", "node").alias("part"))
    shared = stored(filed.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("key"))
    many = stored(filed.join(shared, "key").distinct())
    found = components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_compared(many, told)))
    forget(shared, many)
    return found


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, copy (xxhash64 of the text), group_id of each row."""
    with scope() as own:
        return own.keep(_groups(docs, text, doc_id))


def _groups(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = _nodes(docs, text, doc_id)
    told = rows.filter("fp IS NOT NULL").groupBy("node").agg(F.min("size").alias("size"), F.min("fp").alias("fp"), F.min(F.struct("copy", "doc_id")).alias("row"))
    told = stored(told.select("node", "size", "fp", "row.copy", "row.doc_id"))
    found = _connected(rows, told, close(told))
    candidates = stored(found.join(told, "node").select("component", "node", "copy", "doc_id"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = with_names(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), block_pairs(candidates, ["component"], "node", BLOCK), "inner")
    links = texts.select("component", "i", "j", "node", "left", "text").repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "node").transform(in_arrow, _verified, "a long, b long")
    linked = components(links).withColumnsRenamed({"component": "group_id"})
    return stored(rows.select("doc_id", "copy", "node").join(linked, "node", "left").select("doc_id", "copy", F.coalesce("group_id", "node").alias("group_id")))
