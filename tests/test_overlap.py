"""The index with bounds against all pairs, and against the way for few items."""

import random

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import overlap, retrieval


def token_sets(df, key, name):
    return df.select(key, text.token_set(F.col("text")).alias(name))


def plain(items, docs, best):
    out = {}
    for i, q in items.items():
        scores = []
        for d, own in docs.items():
            common = len(q & own)
            if common:
                s = min(1.0, common / len(q | own) + (0.3 if common == min(len(q), len(own)) else 0.0))
                scores.append((-round(s, 9), d))
        out[i] = sorted(scores)[:best]
    return out


def test_best_overlaps_equal_all_pairs(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    make = lambda most: " ".join(r.choices(vocabulary, weights, k=r.randint(0, most)))
    docs = [(i, make(60)) for i in range(1500)] + [(2000 + i, f"w0 w{i % 5}") for i in range(40)] + [(3000, None), (3001, "")]
    items = [(i, make(25)) for i in range(60)] + [(100, "w0 w1 w2"), (101, "w399"), (102, "nowhere else"), (103, None), (104, docs[7][1])]
    sets = lambda rows: {i: {w for w in (t or "").split() if len(w) > 1} for i, t in rows}
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for best in (1, 5):
        found = overlap.best_overlaps(token_sets(q, "item_id", "q"), token_sets(d, "doc_id", "d"), "item_id", "doc_id", best)
        got = {}
        for x in retrieval.top(found, "item_id", F.round("similarity", 9), "doc_id", best).collect():
            got.setdefault(x["item_id"], []).append((-round(x["similarity"], 9), x["doc_id"]))
        expected = plain(sets(items), sets(docs), best)
        assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in expected.items() if x}


def test_frequent_tokens_are_not_joined_whole(spark):
    """A token of every document adds few candidates once rarer ones have set the bar."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.array(F.lit("the")), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.lit("t"), (F.col("id") * 7 + k).cast("string")))).alias("d"))
    items = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("item_id"), F.col("d").alias("q"))
    assert overlap.best_overlaps(items, docs, "item_id", "doc_id", 3).count() < 40 * 60


def test_both_ways_rank_alike(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "benchmark"))
    ranks = lambda: sorted(tuple(r) for r in retrieval.top(retrieval.token_overlap(items, docs, best=4), "item_id", F.round("similarity", 9), "doc_id", 4).select("item_id", "doc_id", "rank").collect())
    few = ranks()
    monkeypatch.setattr(retrieval, "POSTINGS", 0)
    assert ranks() == few
