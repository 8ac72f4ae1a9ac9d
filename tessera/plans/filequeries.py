"""Queries of the file sources: small tables are written in each form and read back by the source that is for it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.base import query
from tessera.sources import files, jsonsource
from tessera.tables import delete, shared_dir, written

NATION = "n_nationkey INT, n_name STRING, n_regionkey INT"


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A new folder where all executors can write, which goes at the end; what was read of it must be ``written`` before."""
    base = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    try:
        yield base
    finally:
        delete(spark, base)


def _read(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.sum("n_nationkey").cast("long").alias("keys"), F.max("n_name").alias("last"))


@query("""WITH a AS (SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS keys, max(n_name) AS last FROM nation)
SELECT source, n, keys, last FROM a, (VALUES ('lines'), ('tolerant'), ('array'), ('by name'), ('concatenated'), ('log')) AS s(source)
UNION ALL SELECT 'rejects', 2, NULL, 'not json' UNION ALL SELECT 'corpus', count(*), max(n_regionkey)::BIGINT, max(n_name) FROM nation WHERE n_regionkey = 1""")
def json_sources(t):
    """What each source reads of the same table: lines, tolerant lines and their rejects, an array, by name, objects one after the other,
    one partition of a corpus, and a result log that is appended twice."""
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    with folder(nation.sparkSession) as base:
        return written(_json_sources(nation, base))


def _json_sources(nation: DataFrame, base: str) -> DataFrame:
    spark = nation.sparkSession
    objects = nation.select(F.to_json(F.struct("*")).alias("value"))
    objects.coalesce(1).write.text(f"{base}/lines.jsonl")
    spoiled = spark.createDataFrame([("",), ("not json",), ("not json",)], "value string")
    objects.unionByName(spoiled).coalesce(1).write.text(f"{base}/spoiled.jsonl")
    gathered = objects.agg(F.array_join(F.collect_list("value"), ",\n").alias("value"))
    gathered.select(F.concat(F.lit("["), "value", F.lit("]")).alias("value")).coalesce(1).write.text(f"{base}/array.json")
    objects.agg(F.array_join(F.collect_list("value"), " ").alias("value")).coalesce(1).write.text(f"{base}/joined")
    corpus = nation.select(F.col("n_regionkey").cast("string").alias("pkg"), F.lit("1.0").alias("version"), F.col("n_name").alias("value"))
    files.write_corpus(corpus, f"{base}/corpus")
    for _ in range(2):
        files.append_results(nation, f"{base}/log", "n_nationkey")
    tolerant, rejects = files.read_jsonl_tolerant(spark, f"{base}/spoiled.jsonl", NATION)
    joined = files.read_concatenated_json(spark, f"{base}/joined").select(F.from_json("value", NATION).alias("row")).select("row.*")
    one = files.read_corpus(spark, f"{base}/corpus").filter("pkg = '1'")
    found = [
        _read("lines", files.read_jsonl(spark, f"{base}/lines.jsonl", NATION)),
        _read("tolerant", tolerant),
        _read("array", files.read_json_array(spark, f"{base}/array.json", NATION)),
        _read("by name", files.read_json_by_name(spark, f"{base}/lines.jsonl", NATION)),
        _read("concatenated", joined),
        _read("log", spark.read.parquet(f"{base}/log")),
        rejects.agg(F.lit("rejects").alias("source"), F.count("*").alias("n"), F.lit(None).cast("long").alias("keys"), F.max("value").alias("last")),
        one.agg(F.lit("corpus").alias("source"), F.count("*").alias("n"), F.max(F.col("pkg").cast("long")).alias("keys"), F.max("value").alias("last")),
    ]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


@query("""WITH r AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS rank FROM nation) SELECT n_nationkey, rank::INT AS rank, n_regionkey AS value FROM r""")
def merged_ranks(t):
    """Outputs of two workers merged; of equal keys the last worker's counts."""
    nation = t("nation").select("n_nationkey", F.col("n_regionkey").alias("value"))
    with folder(nation.sparkSession) as base:
        nation.withColumn("rank", F.lit(0)).write.parquet(f"{base}/rank0")
        nation.filter("n_nationkey % 3 = 0").withColumn("rank", F.lit(1)).write.parquet(f"{base}/rank1")
        return written(files.merge_ranks(nation.sparkSession, [f"{base}/rank0", f"{base}/rank1"], "n_nationkey").select("n_nationkey", "rank", "value"))


@query("SELECT DISTINCT 'nation' || n_regionkey || ':' || n_name AS value FROM nation")
def package_manifest(t):
    """pkg:version lines, written and read back."""
    nation = t("nation").select(F.concat(F.lit("nation"), F.col("n_regionkey").cast("string")).alias("pkg"), F.col("n_name").alias("version"))
    with folder(nation.sparkSession) as base:
        files.package_manifest(nation).write.text(f"{base}/manifest")
        return written(nation.sparkSession.read.text(f"{base}/manifest"))


@query("SELECT count(*) FILTER (n_regionkey IN (1, 2))::BIGINT AS n FROM nation")
def matching_logs(t):
    """Log files of more than ten bytes that match, a folder of one log a nation."""
    nation = t("nation").select("n_nationkey", F.concat(F.lit("Ran "), F.col("n_regionkey").cast("string"), F.lit(" tests in 1s")).alias("value"))
    spark = nation.sparkSession
    with folder(spark) as base:
        nation.repartition(25, "n_nationkey").write.partitionBy("n_nationkey").text(f"{base}/logs")
        return spark.createDataFrame([(files.matching_logs(spark, f"{base}/logs/*/*", "Ran [12] tests"),)], "n long")


@query("""SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations""")
def concatenated_ranges(t):
    """Turns as JSON objects one after the other, read back by ranges of bytes."""
    turns = t("conversations").select("conv_id", "turn", "role", "text")
    spark = turns.sparkSession
    jsonsource.register(spark)
    with folder(spark) as base:
        turns.select(F.to_json(F.struct("*")).alias("value")).write.option("lineSep", " ").text(f"{base}/turns")
        rows = spark.read.format("concatenated_json").option("rangeBytes", 1 << 20).load(f"{base}/turns")
        row = F.from_json("value", turns.schema)
        return written(rows.select(row.alias("row")).select("row.conv_id", "row.turn", "row.role", F.length("row.text").alias("n_chars")))


@query("""WITH e AS (SELECT DISTINCT lang, source FROM documents WHERE doc_id % 97 = 0)
SELECT d.lang AS pkg, d.source AS version, count(*)::BIGINT AS n_docs, max(d.doc_id)::BIGINT AS last FROM documents d JOIN e ON d.lang = e.lang AND d.source = e.source GROUP BY ALL""")
def corpus_of_edges(t):
    """A corpus in folders by (pkg, version), of which only those that the edges name are read."""
    docs = t("documents").select(F.col("lang").alias("pkg"), F.col("source").alias("version"), F.col("doc_id").cast("string").alias("value"), "doc_id")
    spark = docs.sparkSession
    with folder(spark) as base:
        files.write_corpus(docs.repartition("pkg", "version"), f"{base}/corpus")
        lines = files.corpus_of_edges(spark, f"{base}/corpus", docs.filter("doc_id % 97 = 0"))
        return written(lines.groupBy("pkg", "version").agg(F.count("*").alias("n_docs"), F.max(F.col("value").cast("long")).alias("last")))
