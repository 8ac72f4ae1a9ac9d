"""Aggregation queries: counts, coverage, distributions, duplicates, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import joins
from tessera.plans.base import query


@query("SELECT p_brand AS pkg, list_sort(list(DISTINCT p_size)) AS versions, count(DISTINCT p_size)::BIGINT AS n FROM part GROUP BY 1")
def versions_per_package(t):
    return t("part").groupBy(F.col("p_brand").alias("pkg")).agg(F.array_sort(F.collect_set("p_size")).alias("versions")).withColumn("n", F.size("versions").cast("long"))


@query("""WITH v AS (SELECT p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY 1) SELECT count(*)::BIGINT AS packages, sum(n)::BIGINT AS versions, avg(n) AS per_package FROM v""")
def package_totals(t):
    v = t("part").groupBy("p_brand").agg(F.countDistinct("p_size").alias("n"))
    return v.agg(F.count("*").alias("packages"), F.sum("n").alias("versions"), F.avg("n").alias("per_package"))


@query("SELECT p_brand AS pkg, p_size AS version, count(*)::BIGINT AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
def package_version_rollup(t):
    return t("part").rollup(F.col("p_brand").alias("pkg"), F.col("p_size").alias("version")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_orderkey)::BIGINT AS n_tasks FROM lineitem")
def distinct_tasks(t):
    return t("lineitem").agg(F.countDistinct("l_orderkey").alias("n_tasks"))


@query("""WITH x AS (SELECT DISTINCT doc_id, unnest([lang, source]) AS domain FROM documents), c AS (SELECT domain, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT 'Cryptography', 0)
SELECT domain, n::BIGINT AS n, n / (SELECT count(*) FROM documents)::DOUBLE AS share FROM c""")
def domain_distribution(t):
    """Distinct domains of a task each count; shares are of tasks, so they sum to more than one.  A seeded domain starts at nil."""
    docs = t("documents")
    counted = docs.select(F.explode(F.array_distinct(F.array("lang", "source"))).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))
    seeded = joins.append_missing(counted, docs.sparkSession.createDataFrame([("Cryptography", 0)], "domain string, n long"), "domain")
    total = docs.agg(F.count("*")).first()[0]
    return seeded.withColumn("share", F.col("n") / F.lit(float(total)))


@query("""WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT d.lang, count(*) FILTER (l.quality = 1) AS p1, count(*) FILTER (l.quality = 1 OR l.toxic = 1) AS p3 FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1)
SELECT a.lang AS domain, coalesce(p1, 0) / n::DOUBLE AS pass1, coalesce(p3, 0) / n::DOUBLE AS pass3 FROM a LEFT JOIN p ON a.lang = p.lang""")
def domain_pass_rate(t):
    """Passes over the domain's count of all tasks, tried or not."""
    docs = t("documents").select("doc_id", "lang")
    n = docs.groupBy("lang").agg(F.count("*").alias("n"))
    passed = t("labels").join(docs, "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("p1"), F.count_if((F.col("quality") == 1) | (F.col("toxic") == 1)).alias("p3"))
    return n.join(passed, "lang", "left").select(F.col("lang").alias("domain"), (F.coalesce("p1", F.lit(0)) / F.col("n")).alias("pass1"), (F.coalesce("p3", F.lit(0)) / F.col("n")).alias("pass3"))


@query("""WITH j AS (SELECT d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT count(*)::BIGINT AS total, count(*) FILTER (quality = 1)::BIGINT AS passed, count(*) FILTER (quality = 0)::BIGINT AS failed, sum(n_chars)::BIGINT AS tests, sum(CASE WHEN quality = 1 THEN n_chars ELSE n_chars // 2 END)::BIGINT AS tests_passed,
 round(avg(CASE WHEN toxic = 1 THEN quality::DOUBLE ELSE (CASE WHEN quality = 1 THEN n_chars ELSE n_chars // 2 END) / n_chars::DOUBLE END), 9) AS mean_proportional FROM j""")
def run_summary(t):
    """Pass and error counts, test totals, and the mean of each task's share of tests passed (1 or 0 without tests)."""
    j = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id")
    ok = F.when(F.col("quality") == 1, F.col("n_chars")).otherwise(F.expr("n_chars div 2"))
    return j.agg(
        F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), F.sum("n_chars").alias("tests"), F.sum(ok).alias("tests_passed"),
        F.round(F.avg(F.when(F.col("toxic") == 1, F.col("quality").cast("double")).otherwise(ok / F.col("n_chars"))), 9).alias("mean_proportional"),
    )


@query("""SELECT CASE WHEN n_chars < 4000 THEN '0-4k' WHEN n_chars < 8000 THEN '4-8k' ELSE '8k+' END AS bucket, round(100 * avg(quality), 2) AS score, count(*)::BIGINT AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def score_by_length_bucket(t):
    bucket = F.when(F.col("n_chars") < 4000, "0-4k").when(F.col("n_chars") < 8000, "4-8k").otherwise("8k+")
    return t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id").groupBy(bucket.alias("bucket")).agg(F.round(100 * F.avg("quality"), 2).alias("score"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_orderkey, count(l_orderkey) AS attempted, count(l_orderkey) FILTER (l_returnflag = 'N') AS ok FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT sum(attempted)::BIGINT AS attempted, sum(ok)::BIGINT AS successful, count(*) FILTER (ok > 0)::BIGINT AS with_any, count(*) FILTER (attempted > 0 AND ok = attempted)::BIGINT AS full_success, sum(ok) / sum(attempted)::DOUBLE AS rate FROM a""")
def adapter_coverage(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("attempted"), F.count_if(F.col("l_returnflag") == "N").alias("ok"))
    a = t("orders").select("o_orderkey").join(lines, "o_orderkey", "left").fillna(0)
    return a.agg(F.sum("attempted").alias("attempted"), F.sum("ok").alias("successful"), F.count_if(F.col("ok") > 0).alias("with_any"), F.count_if((F.col("attempted") > 0) & (F.col("ok") == F.col("attempted"))).alias("full_success"), (F.sum("ok") / F.sum("attempted")).alias("rate"))


@query("""SELECT role AS status, count(*)::BIGINT AS n, avg(length(text)) AS mean_chars FROM conversations GROUP BY 1""")
def status_histogram(t):
    return t("conversations").groupBy(F.col("role").alias("status")).agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean_chars"))


@query("""WITH g AS (SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY 1) SELECT count(*)::BIGINT AS distinct_ids, sum(n - 1)::BIGINT AS surplus, count(*) FILTER (n > 1)::BIGINT AS repeated FROM g""")
def duplicate_report(t):
    g = t("documents").groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("distinct_ids"), F.sum(F.col("n") - 1).alias("surplus"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("""WITH w AS (SELECT doc_id, md5(text) AS k, lang, source, first_value(lang) OVER x AS fl, first_value(source) OVER x AS fs, row_number() OVER x AS n FROM documents WINDOW x AS (PARTITION BY md5(text) ORDER BY doc_id)),
b AS (SELECT *, bool_or(lang <> fl OR source <> fs) OVER (PARTITION BY k) AS bad FROM w) SELECT doc_id, lang, source FROM b WHERE n = 1 AND NOT bad""")
def consistent_merge(t):
    """Groups whose rows agree with their first keep it; others are dropped."""
    d = t("documents").select("doc_id", F.md5("text").alias("k"), "lang", "source")
    g = d.groupBy("k").agg(F.min_by(F.struct("doc_id", "lang", "source"), "doc_id").alias("first"), F.countDistinct("lang", "source").alias("kinds"))
    return g.filter("kinds = 1").select("first.*")


@query("""WITH n AS (SELECT len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS n FROM documents), b AS (SELECT unnest(['0-256', '256-512', '512-768', '768-1024', '1024-2048', '2048-4096', '4096+']) AS bucket, unnest([0, 256, 512, 768, 1024, 2048, 4096]) AS lo, unnest([256, 512, 768, 1024, 2048, 4096, 1000000000]) AS hi)
SELECT bucket, count(n)::BIGINT AS n FROM b LEFT JOIN n ON n >= lo AND n < hi GROUP BY 1""")
def length_histogram(t):
    bounds = [0, 256, 512, 768, 1024, 2048, 4096]
    names = [f"{a}-{b}" for a, b in zip(bounds, bounds[1:])] + ["4096+"]
    size = F.size(text.words(F.col("text")))
    number = F.lit(0)
    for k, low in enumerate(bounds[1:], 1):
        number = F.when(size >= low, k).otherwise(number)
    docs = t("documents")
    counted = docs.select(number.alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    # the innermost condition must lose against higher ones, so the ladder is built upwards
    table = docs.sparkSession.createDataFrame(list(enumerate(names)), "k int, bucket string")
    return table.join(counted, "k", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""WITH g AS (SELECT source, sum(len(json_keys(props::JSON)))::BIGINT AS n FROM (SELECT event_type AS source, props FROM events) GROUP BY 1) SELECT source, n FROM g""")
def keys_per_partition(t):
    """Number of keys, which is what a record's length counts."""
    return t("events").groupBy(F.col("event_type").alias("source")).agg(F.sum(F.size(F.json_object_keys("props")).cast("long")).alias("n"))


@query("""SELECT event_type, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def mean_and_spread(t):
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_pop("value"), 9).alias("std"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, max(value) AS best FROM events GROUP BY 1) SELECT round(100 * avg(best), 2) AS score, count(*)::BIGINT AS n FROM r""")
def best_over_references(t):
    return t("events").groupBy("user_id").agg(F.max("value").alias("best")).agg(F.round(100 * F.avg("best"), 2).alias("score"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id % 4 AS rank, count(*) AS n FROM documents GROUP BY 1) SELECT min(n)::BIGINT AS lo, max(n)::BIGINT AS hi, avg(n) AS mean, stddev_pop(n) AS std, sum(n) / (SELECT count(DISTINCT doc_id) FROM documents)::DOUBLE AS coverage FROM s""")
def shard_balance(t):
    docs = t("documents").select("doc_id")
    s = docs.groupBy((F.col("doc_id") % 4).alias("rank")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))
    return s.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), (F.sum("n") / F.sum("ids")).alias("coverage"))


@query("""WITH want AS (SELECT DISTINCT p_brand AS pkg, p_size AS version FROM part), have AS (SELECT DISTINCT p_brand AS pkg, p_size AS version FROM part WHERE p_retailprice > 1000),
s AS (SELECT w.pkg, w.version, CASE WHEN w.version = 13 THEN 'error' WHEN h.pkg IS NULL THEN 'missing' ELSE 'existing' END AS status FROM want w LEFT JOIN have h ON w.pkg = h.pkg AND w.version = h.version)
SELECT pkg, status, list_sort(list(version)) AS versions FROM s GROUP BY ALL""")
def training_plan(t):
    """Which (package, version) are there, missing or faulty, by package."""
    part = t("part").select(F.col("p_brand").alias("pkg"), F.col("p_size").alias("version"), "p_retailprice")
    have = part.filter("p_retailprice > 1000").select("pkg", "version").distinct().withColumn("there", F.lit(True))
    status = F.when(F.col("version") == 13, "error").when(F.col("there").isNull(), "missing").otherwise("existing")
    return part.select("pkg", "version").distinct().join(have, ["pkg", "version"], "left").groupBy("pkg", status.alias("status")).agg(F.array_sort(F.collect_list("version")).alias("versions"))


@query("""SELECT CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM documents GROUP BY 1""")
def prefilter_reasons(t):
    reason = F.when(F.length(F.trim("text")) == 0, "empty").when(F.col("n_chars") < 200, "short").when(F.col("lang") != "en", "language").otherwise("kept")
    return t("documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT count(*)::BIGINT AS total, count(*) FILTER (value > 20)::BIGINT AS success, count(*) FILTER (event_type = 'view')::BIGINT AS exact, round(avg(CASE WHEN value > 20 THEN value END), 9) AS mean_time, count(*) FILTER (value > 20) / count(*)::DOUBLE AS rate FROM events""")
def retrieval_stats(t):
    ok = F.col("value") > 20
    return t("events").agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(F.col("event_type") == "view").alias("exact"), F.round(F.avg(F.when(ok, F.col("value"))), 9).alias("mean_time"), (F.count_if(ok) / F.count("*")).alias("rate"))


@query("""SELECT conv_id, count(*)::BIGINT AS n_queries, count(*) FILTER (text ILIKE '%the%')::BIGINT AS kept FROM conversations GROUP BY ROLLUP (conv_id)""")
def query_filter_totals(t):
    """Queries kept per sample, and over all (null id)."""
    return t("conversations").rollup("conv_id").agg(F.count("*").alias("n_queries"), F.count_if(F.contains(F.lower("text"), F.lit("the"))).alias("kept"))


@query("""SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""")
def grouping_sets_totals(t):
    docs = t("documents")
    return docs.groupingSets([[docs.source], [docs.lang], []], docs.source, docs.lang).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, lang, source)::INT AS place FROM g""")
def sorted_by_count(t):
    g = t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "lang", "source")))  # one row for each of a few pairs
