"""What a Python worker holds at a time doesn't grow with the input."""

import tracemalloc

import numpy as np
import pytest

from tessera.operators import blocksearch, retrieval, vectors


def peak_mb(run):
    """Greatest MB that numpy and Python held while ``run`` ran, and its result."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_nearest_holds_few_scores():
    r = np.random.default_rng(3)
    q, x, k = r.normal(size=(1500, 8)), r.normal(size=(4000, 8)), 3
    found, peak = peak_mb(lambda: [b for b in vectors._nearest(np.arange(1500), q, np.arange(4000), x, k)])
    pairs = {(a, b) for batch in found for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
    best = np.argsort(-(q @ x.T), axis=1)[:, : k + 1]
    assert pairs == {(i, int(j)) for i in range(1500) for j in best[i]} and peak < 60


def test_equal_rows_leave_in_parts():
    found = list(vectors._nearest(np.arange(40), np.ones((40, 4)), np.arange(5000), np.ones((5000, 4)), 3))
    assert sum(b.num_rows for b in found) == 40 * 5000 and max(b.num_rows for b in found) <= vectors.PAIRS


@pytest.mark.parametrize("scores, visits", [(50, 30), (1, 1)])
def test_blocks_hold_few_visits(spark, monkeypatch, scores, visits):
    """Rows of a query's vector for every open block leave in parts; results are those of whole batches."""
    monkeypatch.setattr(blocksearch, "SCORES", scores)
    monkeypatch.setattr(blocksearch, "VISITS", visits)
    x = np.random.default_rng(4).normal(size=(120, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    found = blocksearch.BlockSearch(rows, blocks=10).top_k(rows.withColumnRenamed("vec_id", "query_id"), 4).collect()
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in found} == {(i, n + 1): int(j) for i in range(120) for n, j in enumerate(np.argsort(-near[i])[:4])}


@pytest.mark.parametrize("best", [None, 3])
def test_hits_are_counted_in_parts(spark, monkeypatch, best):
    """Whatever is counted at a time, pairs are the same, and with ``best`` a task leaves that many an item, not a batch."""
    texts = [" ".join(f"t{(i * k) % 17}" for k in range(1, 2 + i % 9)) if i % 10 else None for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = docs.filter("doc_id % 9 = 1").withColumnRenamed("doc_id", "item_id")
    monkeypatch.setattr(retrieval, "spread", lambda df: df)

    def found(batch):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        return sorted(map(tuple, retrieval.token_overlap(items, docs, best=best).collect()))

    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        whole = found("10000")
        monkeypatch.setattr(retrieval, "HITS", 40)
        monkeypatch.setattr(retrieval, "LEAVING", 7)
        assert found("10") == whole and whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    per_item = {}
    for item, *_ in whole:
        per_item[item] = per_item.get(item, 0) + 1
    assert best is None or max(per_item.values()) <= best
