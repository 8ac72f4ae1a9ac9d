"""Sharding by a k-d tree (operator 9, DataFrame functions only).

The rows are split recursively along the widest metadata dimension (range within the node over the range of all rows;
ties to the first dimension) at the weighted median, weights being bytes, until a leaf has the target bytes; a node
due n leaves is cut where n // 2 of n parts lie left, so any number of shards comes out near equal.  Dimensions are the columns named in
DIMENSIONS, as far as they are there, and the size: numbers by their place between zero (or the table's least, if it is less) and the greatest, words by their
rank among the different ones, which is numbered part by part of their order.

The median is found without sorting: the node's key range is cut into 256 bins, bytes are summed by (node, bin) with
partial sums, and the search goes on inside the bin that crosses the target, until what it holds is within TOLERANCE of the
node or one key.  All nodes of a level are searched together, and only one row per node comes to the driver.  A key
joins the dimension's value and the text's CRC, values being the least among the rows of a text, so equal texts have equal keys and stay
on one side, the cut going to the nearer end of a key; only where one key weighs more than SPLIT of the node is it cut inside, by a hash of
doc_id, since shards would be uneven otherwise.

Rows are narrowed to numbers once and stored in the shared folder, so the passes don't read texts again.  Slots are
numbered in 256 hashed parts of each shard, each beginning where the parts before it end, so no task numbers a whole shard.

Edge cases: a null text has no bytes (size 1, CRC of nothing); null metadata (and numbers that are none) come before all others; null doc_id hashes as the word null; repeated rows are rows of their own and go together unless their key
is cut; fewer rows than shards leave shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import scope, stored
from tessera.llm.hotkeys import join_values

BINS, TOLERANCE, SPLIT, PARTS = 256, 0.002, 0.03, 256
BROADCAST_NODES, PLACES = 10_000, 2**31 - 2
DIMENSIONS = ("source", "lang", "n_chars")


def _value(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the metadata of ``column`` in ``out`` as a number from 1 to PLACES that keeps its order, null as 0."""
    if not isinstance(rows.schema[column].dataType, T.StringType):
        number = F.col(column).cast("double")
        number = F.when(~F.isnan(number), number)
        low, high = rows.agg(F.min(number), F.max(number)).first()
        low, high = (-1.7e308 if low == float("-inf") else low, 1.7e308 if high == float("inf") else high) if low is not None else (0.0, 0.0)
        low = min(low, 0.0)
        scale = min(1.0, (PLACES - 1) / max(1.0, high / 2 - low / 2) / 2)
        place = F.floor(F.greatest(F.lit(0.0), F.least((number / 2 - low / 2) * (2 * scale), F.lit(PLACES - 1.0)))) + 1
        return rows.withColumn(out, F.when(number.isNull(), F.lit(0)).otherwise(place).cast("long"))
    words = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("word")).agg(F.count("*").alias("n"))
    parted = stored(words.orderBy("word").withColumn("part", F.spark_partition_id()))
    ends, total = {}, 0
    for r in sorted(parted.groupBy("part").agg(F.count("*").alias("n")).collect()):
        ends[r["part"]] = total
        total += r["n"]
    if not total:
        return rows.withColumn(out, F.lit(0).cast("long"))
    start = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])[F.col("part")]
    rank = start + F.row_number().over(Window.partitionBy("part").orderBy("word"))
    ranks = stored(parted.select(F.col("word").alias(column), F.ceil(rank * min(1.0, PLACES / total)).cast("long").alias(out), "n"))
    unknown = rows.filter(F.col(column).isNull()).withColumn(out, F.lit(0).cast("long"))
    return stored(join_values(rows.filter(F.col(column).isNotNull()), ranks, [column], "n").select(*rows.columns, out).unionByName(unknown))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of each row, its keys k0, k1 ... by dimension, equal for equal texts, and its hash."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    there = [c for c in DIMENSIONS if c in docs.columns]
    rows = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), *[F.col(c).alias(f"m{k}") for k, c in enumerate(there)])
    rows = stored(rows)
    for k in range(len(there)):
        rows = _value(rows, f"m{k}", f"v{k}")
    text = ["text_crc32", "size"]
    least = rows.groupBy(*text).agg(*[F.min(f"v{k}").alias(f"v{k}") for k in range(len(there))], F.min("size").alias(f"v{len(there)}"))
    keys = [(F.shiftleft(F.least(F.col(f"v{k}"), F.lit(PLACES + 1)), 32) + F.col("text_crc32")).alias(f"k{k}") for k in range(len(there) + 1)]
    own = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1).alias("hash")
    return rows.select("doc_id", *text).join(least, text).select("doc_id", *text, *keys, own)


def _keys(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c[0] == "k" and c[1:].isdigit()]


def _chosen(keys: list[str]) -> Column:
    """The value of the column that ``key`` names."""
    found = F.col("hash")
    for name in keys:
        found = F.when(F.col("key") == name, F.col(name)).otherwise(found)
    return found


def _joined(rows: DataFrame, nodes: list[tuple], fields: str) -> DataFrame:
    """``rows`` with the fields of their node; the nodes are broadcast while they are few."""
    table = rows.sparkSession.createDataFrame(nodes, fields)
    return rows.join(F.broadcast(table) if len(nodes) <= BROADCAST_NODES else table, "node")


def _cuts(rows: DataFrame, keys: list[str], wanted: dict[int, tuple[str, int, int, int]], weight: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """Where to cut each node: (key below which rows go left, bytes that are left of it, bytes of the first key not left).

    ``wanted``: by node its key column, the least and greatest key, and the bytes wanted on the left; ``weight``: its bytes.
    """
    found: dict[int, tuple[int, int, int]] = {}
    open_ = {node: (key, low, high, left, 0) for node, (key, low, high, left) in wanted.items()}
    while open_:
        nodes = [(node, key, low, high, max(1, -(-(high - low + 1) // BINS)), float(left - below)) for node, (key, low, high, left, below) in open_.items()]
        inside = _joined(rows, nodes, "node int, key string, low long, high long, step long, target double")
        bins = (
            inside.withColumn("v", _chosen(keys))
            .filter(F.col("v").between(F.col("low"), F.col("high")))
            .groupBy("node", "low", "step", "target", F.expr("(v - low) div step").alias("bin"))
            .agg(F.sum("size").alias("bytes"))
        )
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))
        crossing = bins.withColumn("upto", upto).filter(F.col("upto") >= F.col("target")).groupBy("node").agg(F.min(F.struct("bin", "bytes", "upto")).alias("at"))
        hits = {r["node"]: r["at"] for r in crossing.collect()}
        still = {}
        for node, key, low, high, step, _ in nodes:
            left, below = open_[node][3], open_[node][4]
            at = hits.get(node)
            if at is None:  # all that is there is wanted on the left
                found[node] = (high + 1, below, 0)
                continue
            start, before = low + at["bin"] * step, below + at["upto"] - at["bytes"]
            if step == 1 or at["bytes"] <= TOLERANCE * weight[node]:
                after = before + at["bytes"]
                if at["bytes"] <= SPLIT * weight[node] and abs(after - left) < abs(before - left):
                    found[node] = (min(start + step, high + 1), after, 0)
                else:
                    found[node] = (start, before, at["bytes"] if step == 1 else 0)
            else:
                still[node] = (key, start, min(start + step - 1, high), left, before)
        open_ = still
    return found


def shard(rows: DataFrame, leaves: int) -> DataFrame:
    """``rows`` (as from ``measured``) with their leaf in ``shard``, from 0 in the tree's order."""
    keys = _keys(rows)
    now = rows.withColumn("node", F.lit(0))
    due, first = {0: leaves}, {0: 0}  # by node the leaves it will have, and the first one's number
    extents = [x for key in keys for x in (F.min(key).alias(f"{key}_min"), F.max(key).alias(f"{key}_max"))]
    whole: dict[str, int] = {}
    while any(n > 1 for n in due.values()):
        stats = {r["node"]: r for r in now.groupBy("node").agg(F.sum("size").alias("bytes"), *extents).collect()}

        def width(node: int, key: str) -> int:
            return (stats[node][f"{key}_max"] >> 32) - (stats[node][f"{key}_min"] >> 32)

        if not whole and stats:
            whole = {key: max(1, width(0, key)) for key in keys}
        wanted, weight, by = {}, {}, {}
        for node, n in due.items():
            if n > 1 and node in stats:
                key = by[node] = max(keys, key=lambda k: width(node, k) / whole[k])
                weight[node] = stats[node]["bytes"]
                wanted[node] = (key, stats[node][f"{key}_min"], stats[node][f"{key}_max"], weight[node] * (n // 2) // n)
        cuts = _cuts(now, keys, wanted, weight) if wanted else {}
        heavy = {node: at for node, at in cuts.items() if at[2] > SPLIT * weight[node]}
        inner = {}
        if heavy:  # keys that must be cut inside: by the hash of doc_id, among that key's rows
            chosen = _joined(now, [(node, by[node], at[0]) for node, at in heavy.items()], "node int, key string, one long")
            same = chosen.filter(_chosen(keys) == F.col("one")).select("node", "size", "hash", *keys)
            ask = {node: ("hash", 0, 2**63 - 2, wanted[node][3] - at[1]) for node, at in heavy.items()}
            inner = {node: at[0] for node, at in _cuts(same, keys, ask, weight).items()}
        plan, due_next, first_next = [], {}, {}
        for node, n in due.items():
            left, right = (2 * node + 1, 2 * node + 2) if n > 1 else (node, node)
            cut = cuts.get(node, (0, 0, 0))
            plan.append((node, by.get(node, keys[0]), cut[0], node in inner, inner.get(node, 0), left, right))
            if n > 1:
                due_next |= {left: n // 2, right: n - n // 2}
                first_next |= {left: first[node], right: first[node] + n // 2}
            else:
                due_next[node], first_next[node] = 1, first[node]
        goes_left = (_chosen(keys) < F.col("cut")) | (F.col("split") & (_chosen(keys) == F.col("cut")) & (F.col("hash") < F.col("inside")))
        now = _joined(now, plan, "node int, key string, cut long, split boolean, inside long, left int, right int").select(*rows.columns, F.when(goes_left, F.col("left")).otherwise(F.col("right")).alias("node"))
        due, first = due_next, first_next
    return _joined(now, [(node, at) for node, at in first.items()], "node int, shard int").select(*rows.columns, "shard")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: from 0 without gaps in each shard, by part and then doc_id."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int"))
    sums = parts.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")))
    return ranked.join(starts, ["shard", "part"]).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long")).drop("part", "start", "rank")


def assign(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row; as many leaves as given, or as the target bytes need."""
    with scope() as own:
        rows = stored(measured(docs))
        if leaves is None:
            total = rows.agg(F.sum("size")).first()[0] or 0
            leaves = max(1, -(-total // target_bytes))
        return numbered(own.keep(stored(shard(rows, leaves).select("doc_id", "size", "text_crc32", "shard"))))
