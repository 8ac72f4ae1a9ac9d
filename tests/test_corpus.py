"""Corpus partitions found at run time: what is read, and that it is right."""

from pyspark.sql import functions as F

from tessera.sources import files


def scans(df):
    """(partitions read, has a pruning subquery) of the file scans of a plan that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    leaves, found = plan.collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if "QueryStage" in leaf.getClass().getName():
            inner = leaf.plan().collectLeaves()
            leaf = inner.apply(0)
        if "FileSourceScan" in leaf.getClass().getName():
            found.append((leaf.metrics().apply("numPartitions").value(), "dynamicpruning" in leaf.toString()))
    return found


def test_only_named_partitions_are_read(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("p"), (F.col("id") % 20).cast("string")).alias("pkg"), F.concat((F.col("id") % 5).cast("string"), F.lit(".0")).alias("version"), F.col("id").cast("string").alias("value"))
    files.write_corpus(rows, f"{tmp_path}/corpus")
    edges = spark.createDataFrame([("p3", "3.0", "x"), ("p3", "3.0", "y"), ("p7", "2.0", "x"), ("p99", "1.0", "x"), (None, "1.0", "x"), ("p4", None, "x")], "pkg string, version string, target string")
    edges.write.parquet(f"{tmp_path}/edges")
    found = files.corpus_of_edges(spark, f"{tmp_path}/corpus", spark.read.parquet(f"{tmp_path}/edges"))
    got = sorted(int(r["value"]) for r in found.collect())
    assert got == [i for i in range(2000) if (i % 20, i % 5) in ((3, 3), (7, 2))]
    assert (2, True) in scans(found)  # of twenty
    assert {(r["pkg"], r["version"]) for r in found.select("pkg", "version").distinct().collect()} == {("p3", "3.0"), ("p7", "2.0")}
