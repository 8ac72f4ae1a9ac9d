"""A memory of blocks for each sequence, kept over steps: retrieval within a budget, a neighbour buffer, eviction by last use.

A step of a sequence brings new blocks (a size and a representative vector each) and asks with a query vector.  Blocks are ranked by their
inner product with it and taken until the cap is reached (all, if they fit); the block that crosses it stays only if it lands
closer.  The blocks next to the taken ones go to a buffer with a cap of its own, which is merged with that of the steps before.  What is
taken or buffered is used now; the least recently used other blocks leave the cache until it holds ``cache`` again.

``remember`` runs on a stream or on a table alike (a StatefulProcessor keyed by sequence: blocks are a map state, so a step reads
and writes what it needs in RocksDB, and no task holds more than one sequence).  A step at or before the last one of its sequence is ignored,
so rows that come again change nothing.  With ``idle`` a sequence that saw no step for so long leaves, by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEP = "seq bigint, step bigint, blocks array<struct<size:int,rep:array<double>>>, query array<double>"
TOLD = "seq bigint, step bigint, taken array<int>, buffer array<int>, evicted array<int>, cached_tokens bigint"


@dataclass(frozen=True)
class Budget:
    """Tokens that a step may take, those of its buffer, and those that the cache holds."""

    cap: int
    buffer: int
    cache: int


def _closer_without(cap: int, before: int, after: int) -> bool:
    """Whether the row that crossed the cap leaves again."""
    return abs(cap - before) <= abs(after - cap)


def taken(scores: np.ndarray, sizes: np.ndarray, cap: int) -> list[int]:
    """Blocks by falling score, ties to the earlier, up to the cap; in their own order if all fit."""
    if sizes.sum() <= cap:
        return list(range(len(sizes)))
    order = np.argsort(-scores, kind="stable")
    upto = np.cumsum(sizes[order])
    at = int(np.searchsorted(upto, cap))  # the first that reaches the cap
    return order[: at + (not _closer_without(cap, int(upto[at] - sizes[order[at]]), int(upto[at])))].tolist()


def buffered(top: list[int], old: list[int], sizes: np.ndarray, cap: int) -> list[int]:
    """The buffer after a step that took ``top``: new neighbours, the last found first, before what still fits of the old buffer."""

    def gather(found: list[int], blocks: Iterator[int] | list[int], length: int) -> tuple[int, bool]:
        inside = set(top)
        for block in blocks:
            if block in found or block in inside or not 0 <= block < len(sizes):
                continue
            found.append(block)
            length += int(sizes[block])
            if length >= cap:
                if _closer_without(cap, length - int(sizes[block]), length):
                    length -= int(sizes[found.pop()])
                return length, True
        return length, False

    new: list[int] = []
    length, full = gather(new, (b for t in top for b in (t + 1, t - 1)), 0)
    if not new:
        return old
    if not old or full:
        return new[::-1]
    if int(sizes[old].sum()) + length < cap:
        return old + new[::-1]
    gather(new, old[::-1], length)
    return new[::-1]


class _Memory(StatefulProcessor):
    def __init__(self, budget: Budget, idle_ms: int | None):
        self.budget, self.idle_ms = budget, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block int", "size int, rep array<double>")
        self.used = handle.getMapState("used", "block int", "step bigint")  # the cache: what isn't there is not in it
        self.now = handle.getValueState("now", "step bigint, n int, buffer array<int>, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        steps = sorted((r for r in rows if r["step"] is not None), key=lambda r: r["step"])
        last, n, buffer, timer = self.now.get() if self.now.exists() else (None, 0, [], None)
        buffer = list(buffer)
        fresh = [r for r in steps if last is None or r["step"] > last]
        if fresh:
            stored = sorted((k[0], v[0], v[1]) for k, v in self.blocks.iterator()) if n else []
            sizes, reps = [s for _, s, _ in stored], [r for _, _, r in stored]
            cache = {k[0]: v[0] for k, v in self.used.iterator()} if n else {}
            before = dict(cache)
            for row in fresh:
                if last is not None and row["step"] <= last:
                    continue  # the same step twice
                last = row["step"]
                for block in row["blocks"] or []:
                    self.blocks.updateValue((len(sizes),), (block["size"], block["rep"]))
                    sizes.append(block["size"])
                    reps.append(block["rep"])
                size = np.array(sizes, dtype=np.int64)
                top = taken(np.array(reps) @ np.array(row["query"]), size, self.budget.cap) if sizes else []
                buffer = buffered(top, buffer, size, self.budget.buffer) if top else buffer
                use = dict.fromkeys([*buffer, *top])
                surplus = sum(sizes[b] for b in {*cache, *use}) - self.budget.cache
                evicted = []
                for block in sorted(cache, key=lambda b: (cache[b], b)):
                    if surplus <= 0:
                        break
                    if block not in use:
                        del cache[block]
                        surplus -= sizes[block]
                        evicted.append(block)
                cache.update(dict.fromkeys(use, last))
                yield Row(seq=key[0], step=last, taken=top, buffer=buffer, evicted=evicted, cached_tokens=sum(sizes[b] for b in cache))
            for block in before.keys() - cache.keys():
                self.used.removeKey((block,))
            for block, step in cache.items():
                if before.get(block) != step:
                    self.used.updateValue((block,), (step,))
            n = len(sizes)
        if self.idle_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        if last is not None or timer is not None:
            self.now.update((last, n, buffer, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The sequence leaves with all that it has in the cache."""
        gone = sorted(k[0] for k in self.used.keys())
        for state in (self.blocks, self.used, self.now):
            state.clear()
        yield Row(seq=key[0], step=None, taken=[], buffer=[], evicted=gone, cached_tokens=0)

    def close(self) -> None:
        pass


def remember(steps: DataFrame, budget: Budget, idle_ms: int | None = None) -> DataFrame:
    """seq, step, taken (blocks by rank), buffer, evicted and cached_tokens of each step of ``steps`` (seq, step, blocks, query).

    Blocks are numbered from 0 in the order in which a sequence gets them.  On a table each sequence's rows are folded in the order of their
    steps; a stream must bring them in that order, batch by batch.  Null sequences are one sequence, null steps are left out.
    """
    spark = steps.sparkSession
    spark.conf.set(STORE, ROCKS)
    _ = spark.streams.active  # the state stores' coordinator comes with the stream manager, which a table alone doesn't start
    rows = steps.selectExpr("seq", "step", "blocks", "query").to(spark.createDataFrame([], STEP).schema)
    return rows.groupBy("seq").transformWithState(_Memory(budget, idle_ms), TOLD, "Append", "ProcessingTime" if idle_ms is not None else "None")
