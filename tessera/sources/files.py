"""JSON, JSON lines and text: strict and tolerant readers, writers, manifests.  All paths are Spark's, local or remote."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.bounded import broadcast_if_small

BAD = "_corrupt_record"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array (or one object)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): blank lines are skipped, bad lines come apart as ``value``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    wanted = T.StructType.fromDDL(schema)
    marked = lines.select("value", F.from_json("value", wanted.add(BAD, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("row"))
    good = marked.filter(F.col(f"row.{BAD}").isNull() & F.col("row").isNotNull())
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    return good.select(*[F.col(f"row.{name}") for name in fields]), marked.filter(F.col(f"row.{BAD}").isNotNull() | F.col("row").isNull()).select("value")


def read_json_by_name(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines for ``.jsonl``, else an array or a single object."""
    return read_jsonl_tolerant(spark, path, schema)[0] if path.rstrip("/").endswith(".jsonl") else read_json_array(spark, path, schema)


def read_concatenated_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, value): the objects of files that hold several one after the other, whatever stands between."""
    from tessera.functions.jsonfix import complete_objects

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, k, o) for f, text in zip(pdf["file"], pdf["value"]) for k, o in enumerate(complete_objects(text)[0])]
            yield pd.DataFrame(rows, columns=["file", "ordinal", "value"]).astype({"ordinal": "int64"})

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.mapInPandas(run, "file string, ordinal long, value string")


def read_corpus(spark: SparkSession, base: str) -> DataFrame:
    """Raw lines of ``base/pkg=.../version=...`` text partitions; filters on pkg and version prune folders."""
    return spark.read.option("basePath", base).text(base)


def corpus_of_edges(spark: SparkSession, base: str, edges: DataFrame) -> DataFrame:
    """(pkg, version, value): the corpus lines of the edges' (pkg, version) partitions, each once.

    Which folders are read is found out at run time from the edges (dynamic partition pruning), so a wide corpus isn't listed into a scan
    for a few edges.  Edges without a name or version name no partition.
    """
    wanted = edges.select(F.col("pkg").cast("string").alias("pkg"), F.col("version").cast("string").alias("version")).filter((F.length("pkg") > 0) & (F.length("version") > 0)).distinct()
    corpus = spark.read.option("basePath", base).schema("value string, pkg string, version string").text(base)
    return corpus.join(broadcast_if_small(wanted), ["pkg", "version"])


def write_corpus(rows: DataFrame, base: str) -> None:
    """(pkg, version, value) as partitioned text."""
    rows.select("pkg", "version", "value").write.mode("overwrite").partitionBy("pkg", "version").text(base)


def json_to_jsonl(spark: SparkSession, source: str, target: str, schema: str) -> None:
    read_json_array(spark, source, schema).write.mode("overwrite").json(target)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something under ``path``, on any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_results(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends rows whose key isn't stored yet; a retried append adds nothing twice.  Returns what was new."""
    spark, fresh = rows.sparkSession, rows
    if path_exists(spark, path):
        done = spark.read.schema(rows.schema).parquet(path)
        fresh = rows.join(done.select(key), key, "left_anti").select(rows.columns)
    fresh = fresh.dropDuplicates([key])
    fresh.write.mode("append").parquet(path)
    return fresh


def merge_ranks(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """Outputs of workers in rank order; of equal keys the last rank's counts."""
    parts = [spark.read.parquet(p).withColumn("_rank", F.lit(k)) for k, p in enumerate(paths)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    columns = [c for c in whole.columns if c not in (key, "_rank")]
    latest = whole.groupBy(key).agg(F.max_by(F.struct(*columns), "_rank").alias("row"))
    return latest.select(key, "row.*")


def package_manifest(versions: DataFrame) -> DataFrame:
    """``pkg:version`` lines in order, one column ``value``, for ``write.text``."""
    return versions.select(F.concat_ws(":", "pkg", "version").alias("value")).distinct().orderBy("value")


def matching_logs(spark: SparkSession, path: str, pattern: str, least: int = 10) -> int:
    """Number of files over ``least`` bytes whose text matches."""
    logs = spark.read.format("binaryFile").load(path).filter(F.col("length") > least)
    return logs.filter(F.col("content").cast("string").rlike(pattern)).count()
