"""The memory over steps against a plain fold, as a table, as a stream, and restarted from its checkpoint."""

import os
import random
import shutil
import time

import pytest
from pyspark.sql import Row

from tessera.streaming import memory

BUDGET = memory.Budget(cap=20, buffer=9, cache=40)


def history(seqs=3, steps=12, seed=4):
    r = random.Random(seed)
    vector = lambda: [float(r.randint(-2, 2)) for _ in range(3)]
    return [(s, k, [Row(size=r.randint(1, 9), rep=vector()) for _ in range(r.randint(0, 4))], vector()) for s in range(seqs) for k in range(steps)]


def plain_fold(rows, budget):
    """Step by step, in lists, by the rules as they are told."""
    told, memories = [], {}
    for seq, step, blocks, query in sorted(rows, key=lambda r: (r[0], r[1])):
        own = memories.setdefault(seq, {"blocks": [], "buffer": [], "cache": {}})
        own["blocks"] += blocks
        size = [b.size for b in own["blocks"]]
        top, length = [], 0
        if sum(size) <= budget.cap:
            top = list(range(len(size)))
        else:
            for b in sorted(range(len(size)), key=lambda b: (-sum(x * y for x, y in zip(own["blocks"][b].rep, query)), b)):
                if length + size[b] < budget.cap:
                    top.append(b)
                    length += size[b]
                    continue
                if abs(length + size[b] - budget.cap) < abs(budget.cap - length):
                    top.append(b)
                break
        if top:
            new, length, full = [], 0, False
            wanted = [b for t in top for b in (t + 1, t - 1)]

            def take(wanted):
                nonlocal length
                for b in wanted:
                    if b in new or b in top or b < 0 or b >= len(size):
                        continue
                    if length + size[b] < budget.buffer:
                        new.insert(0, b)
                        length += size[b]
                        continue
                    if abs(length + size[b] - budget.buffer) < abs(budget.buffer - length):
                        new.insert(0, b)
                        length += size[b]
                    return True
                return False

            full = take(wanted)
            old = own["buffer"]
            if new and (not old or full):
                own["buffer"] = new
            elif new and sum(size[b] for b in old) + length < budget.buffer:
                own["buffer"] = old + new
            elif new:
                take(old[::-1])
                own["buffer"] = new
        use, cache, evicted = set(top) | set(own["buffer"]), own["cache"], []
        while sum(size[b] for b in set(cache) | use) > budget.cache and set(cache) - use:
            gone = min(set(cache) - use, key=lambda b: (cache[b], b))
            del cache[gone]
            evicted.append(gone)
        cache.update({b: step for b in use})
        told.append((seq, step, top, own["buffer"], evicted, sum(size[b] for b in cache)))
    return told


def plain(rows):
    return sorted((tuple(r) for r in rows if r["step"] is not None), key=lambda r: r[:2])


def test_table_of_steps(spark):
    rows = history()
    expected = plain_fold(rows, BUDGET)
    assert plain(memory.remember(spark.createDataFrame(rows + rows[5:9], memory.STEP), BUDGET).collect()) == expected
    assert any(r[4] for r in expected) and any(len(r[3]) > 1 for r in expected)  # evictions and merged buffers are there
    assert memory.remember(spark.createDataFrame([(1, None, [], [0.0])], memory.STEP), BUDGET).collect() == []


def run(spark, folder):
    stream = spark.readStream.schema(memory.STEP).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in")
    told = memory.remember(stream, BUDGET)
    query = told.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert query.exception() is None
    return spark.read.schema(memory.TOLD).parquet(f"{folder}/out").collect()


def test_stream_restarts_where_it_was(spark, tmp_path):
    folder = str(tmp_path)
    rows = history(seqs=2, steps=6, seed=9)
    expected = plain_fold(rows, BUDGET)

    def bring(name, some):
        spark.createDataFrame(some, memory.STEP).coalesce(1).write.parquet(f"{folder}/{name}")
        os.makedirs(f"{folder}/in", exist_ok=True)
        for k, f in enumerate(sorted(x for x in os.listdir(f"{folder}/{name}") if x.endswith(".parquet"))):
            shutil.move(f"{folder}/{name}/{f}", f"{folder}/in/{name}-{k}.parquet")

    bring("a", [r for r in rows if r[1] < 2])
    bring("b", [r for r in rows if 2 <= r[1] < 4])
    assert plain(run(spark, folder)) == [r for r in expected if r[1] < 4]
    bring("c", [r for r in rows if r[1] >= 3])  # step 3 once more
    assert plain(run(spark, folder)) == expected
    assert plain(run(spark, folder)) == expected  # nothing new


def test_idle_sequences_leave(spark, tmp_path):
    """A timer sends each sequence away with what is cached, once (a stream with timers doesn't end by itself)."""
    folder, rows = str(tmp_path), history(seqs=2, steps=3)
    spark.createDataFrame(rows, memory.STEP).coalesce(1).write.parquet(f"{folder}/in")
    told = memory.remember(spark.readStream.schema(memory.STEP).parquet(f"{folder}/in"), BUDGET, idle_ms=1)
    query = told.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        for _ in range(60):
            time.sleep(1)
            found = spark.table("idle").collect()
            if sum(r["step"] is None for r in found) >= 2:
                break
    finally:
        query.stop()
    assert plain(found) == plain_fold(rows, BUDGET)
    gone = {r["seq"]: r["evicted"] for r in found if r["step"] is None}
    assert sorted(gone) == [0, 1] and all(gone.values())


def test_rule_of_the_crossing_block():
    import numpy as np

    assert memory.taken(np.array([3.0, 2.0, 1.0]), np.array([6, 6, 6]), 10) == [0, 1]
    assert memory.taken(np.array([3.0, 2.0, 1.0]), np.array([6, 8, 6]), 10) == [0]
    assert memory.taken(np.array([1.0, 1.0]), np.array([4, 5]), 9) == [0, 1]

