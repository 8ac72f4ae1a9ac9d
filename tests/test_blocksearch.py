"""Exact search over blocks against brute force, and how much it skips."""

import numpy as np
import pytest

from tessera.operators import blocksearch
from tessera.operators.blocksearch import BlockSearch


def table(spark, x, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(10**6, None)], f"{key} long, embedding array<double>")


def brute(x, q, k, measure):
    if measure == "cosine":
        x, q = (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300) for y in (x, q))
    scores = q @ x.T
    out = set()
    for i in range(len(q)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-round(scores[i, j], 9), j))[:k]
        out |= {(i, j, rank + 1) for rank, j in enumerate(order)}
    return out


@pytest.mark.parametrize("measure", ["dot", "cosine"])
def test_clusters_are_skipped_and_results_exact(spark, monkeypatch, measure):
    monkeypatch.setattr(blocksearch, "QUERIES", 7)  # blocks are sent several times
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(20, 8)) * 10, 60, axis=0) + r.normal(size=(1200, 8)) * 0.2
    x[7] = x[8] = x[9]
    x[50] = 0
    search = BlockSearch(table(spark, x, "vec_id"), measure, blocks=40)
    found = {(r["query_id"], r["vec_id"], r["rank"]) for r in search.top_k(table(spark, x[:100], "query_id"), 5).collect()}
    expected = brute(x, x[:100], 5, measure)
    assert {f for f in found if f[0] != 50} == {e for e in expected if e[0] != 50} and {f[1] for f in found if f[0] == 50} == {e[1] for e in expected if e[0] == 50}
    assert search.skipped > 0.5


def test_without_structure_and_fewer_rows_than_k(spark):
    x = np.random.default_rng(6).normal(size=(300, 16))
    search = BlockSearch(table(spark, x, "vec_id"))
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in search.top_k(table(spark, x[:20], "query_id"), 3).collect()} == brute(x, x[:20], 3, "dot")
    few = BlockSearch(table(spark, x[:3], "vec_id"))
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in few.top_k(table(spark, x[:3], "query_id"), 5).collect()} == brute(x[:3], x[:3], 5, "dot")
