"""What a task of the masked dependencies holds doesn't grow with the edges."""

from pyspark.sql import functions as F

from tessera.operators import bounded, deps


def test_partitions_grow_with_the_edges(spark, monkeypatch):
    monkeypatch.setattr(bounded, "TASK_ROWS", 1000, raising=False)
    edges = spark.range(40_000).select(F.expr("id div 4").alias("task"), F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("pkg"))
    allowed = spark.range(0, 10_000, 2).select(F.col("id").alias("task"), F.when(F.col("id") % 4 == 0, F.array(F.lit("p1"))).otherwise(F.array().cast("array<string>")).alias("packages"))
    masked = deps.mask_dependencies(edges, allowed)
    held = masked.groupBy("task", "pkg").count().groupBy(F.spark_partition_id()).agg(F.sum("count").alias("n")).collect()
    plain = [(i // 4, f"p{i % 3}") for i in range(40_000) if i // 4 % 2 or (i // 4 % 4 == 0 and i % 3 == 1)]
    assert max(r["n"] for r in held) <= 1500 and sum(r["n"] for r in held) == len(plain)
    assert sorted((r["task"], r["pkg"]) for r in masked.collect()) == sorted(plain)
