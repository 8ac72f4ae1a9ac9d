"""Collections: only changed buckets are rewritten, failed writes change nothing, caches compute what is missing."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import collections
from tessera.sources.collections import Collection, Conflict, cached, query_key

SCHEMA = "pkg string, id long, v string"


def made(spark, tmp_path, **more):
    return Collection(spark, f"{tmp_path}/c", ["pkg", "id"], SCHEMA, **more)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_get_remove(spark, tmp_path):
    c = made(spark, tmp_path, buckets=8)
    assert rows(c.get()) == [] and c.version == 0
    first = [("a", i, f"v{i}") for i in range(50)] + [(None, None, "nulls"), (None, 1, None)]
    c.upsert(spark.createDataFrame([*first, ("a", 3, "less")], SCHEMA))
    assert rows(c.get()) == sorted(first, key=str)
    before = c.manifest()["folders"]
    assert c.upsert(spark.createDataFrame(first[:20], SCHEMA)) == [] and c.version == 1  # all there as they are
    (bucket,) = c.upsert(spark.createDataFrame([("a", 7, "new")], SCHEMA))
    after = c.manifest()["folders"]
    assert {b for b in after if after[b] != before.get(b)} == {str(bucket)}  # the others' folders stay
    assert rows(c.get(spark.createDataFrame([("a", 7), (None, None), ("b", 7)], "pkg string, id long"))) == [("a", 7, "new"), (None, None, "nulls")]
    assert rows(c.get(version=1)) == sorted(first, key=str)  # the version before
    assert rows(c.missing(spark.createDataFrame([("a", 7), ("b", 7), ("b", 7), (None, 1)], "pkg string, id long"))) == [("b", 7)]
    c.remove(F.col("id") >= 10)
    assert len(rows(c.get())) == 12
    c.vacuum()
    again = Collection(spark, f"{tmp_path}/c")
    assert len(rows(again.get())) == 12 and again.key == ["pkg", "id"]
    assert len(os.listdir(f"{tmp_path}/c/manifests")) <= 2  # and its checksum


def test_lookup_reads_only_its_buckets(spark, tmp_path):
    c = made(spark, tmp_path, buckets=16)
    c.upsert(spark.range(500).select(F.lit("p").alias("pkg"), F.col("id"), F.col("id").cast("string").alias("v")))
    files = c.get(spark.createDataFrame([("p", 5)], "pkg string, id long")).inputFiles()
    assert {f.split("_bucket=")[1].split("/")[0] for f in files} == {str(spark.range(5, 6).select(F.pmod(F.xxhash64(F.lit("p"), "id"), F.lit(16))).first()[0])}


def test_failed_and_concurrent_writes_leave_the_last_version(spark, tmp_path, monkeypatch):
    c = made(spark, tmp_path)
    c.upsert(spark.createDataFrame([("a", 1, "one")], SCHEMA))
    boom = F.udf(lambda x: 1 // 0, "string")
    with pytest.raises(Exception, match="division"):
        c.upsert(spark.createDataFrame([("a", 1, "x"), ("a", 2, "two")], SCHEMA).withColumn("v", boom("v")))
    publish = Collection._publish
    with monkeypatch.context() as m:
        m.setattr(Collection, "_publish", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            c.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    assert rows(c.get()) == [("a", 1, "one")] and len(os.listdir(f"{tmp_path}/c/data")) == 1

    def slow(self, version, manifest):
        monkeypatch.setattr(Collection, "_publish", publish)
        Collection(spark, f"{tmp_path}/c").upsert(spark.createDataFrame([("a", 9, "other")], SCHEMA))  # is first
        publish(self, version, manifest)

    monkeypatch.setattr(Collection, "_publish", slow)
    with pytest.raises(Conflict):
        c.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    assert rows(c.get()) == [("a", 1, "one"), ("a", 9, "other")]


def test_cache_computes_what_is_missing(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/e", ["key"], "key string, ids array<long>")
    asked = []

    def compute(items):
        asked.append(items.count())
        return items.select("key", F.array(F.length("q").cast("long")).alias("ids"))

    items = spark.createDataFrame([("how",), ("what is it",)], "q string").withColumn("key", query_key(F.col("q"), "model", "docs", 5))
    once = rows(cached(c, items, compute))
    assert rows(cached(c, items, compute)) == once and asked == [2]
    more = items.unionByName(spark.createDataFrame([("why",)], "q string").withColumn("key", query_key(F.col("q"), "model", "docs", 5)))
    assert len(rows(cached(c, more, compute))) == 3 and asked == [2, 1]
    c.remove(F.element_at("ids", 1) == 3)  # purged entries are computed again
    cached(c, more, compute)
    assert asked == [2, 1, 2]
    assert collections.BUCKETS >= 1
