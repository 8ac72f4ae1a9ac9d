"""Dependency queries: orders stand for tasks, their lines for edges to packages (brand) and versions (size)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text, versions
from tessera.operators import deps
from tessera.plans.base import query

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
EDGES_SQL = """edges AS (SELECT l.l_orderkey AS task, p.p_brand AS pkg, p.p_size::VARCHAR AS version, l.* FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def edges(t):
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("pkg"), F.col("p_size").cast("string").alias("version"))
    return t("lineitem").join(part, "l_partkey").withColumn("task", F.col("l_orderkey"))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT task, pkg, version FROM edges")
def explode_dependencies(t):
    return deps.explode_dependencies(deps.dependency_maps(edges(t)))


@query(f"""WITH {EDGES_SQL}, r AS (SELECT *, coalesce(sum((pkg <> 'Brand#2')::INT) OVER (PARTITION BY task ORDER BY {', '.join(LINE_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM edges)
SELECT task, pkg, version, l_linenumber, l_partkey FROM r WHERE b < 2""")
def cap_dependencies(t):
    return deps.cap_dependencies(edges(t), 2, LINE_ORDER, exempt="Brand#2").select("task", "pkg", "version", "l_linenumber", "l_partkey")


@query(f"""WITH {EDGES_SQL} SELECT task, pkg, list_sort(list(DISTINCT version)) AS versions, NOT bool_or(l_returnflag <> 'R') AS missing_in_target FROM edges GROUP BY task, pkg""")
def combine_source_target_versions(t):
    e = edges(t)
    return deps.combine_dependencies(e.filter("l_returnflag <> 'R'"), e.filter("l_returnflag = 'R'"))


@query(f"""WITH {EDGES_SQL}, allowed AS (
  SELECT o_orderkey AS task, CASE WHEN o_orderpriority LIKE '1%' THEN ['Brand#1', 'Brand#2', 'Brand#3'] ELSE [] END AS packages FROM orders WHERE o_orderpriority < '3')
SELECT e.task, e.pkg, e.version, count(*)::BIGINT AS n FROM edges e LEFT JOIN allowed a ON e.task = a.task
WHERE a.packages IS NULL OR list_contains(a.packages, e.pkg) GROUP BY ALL""")
def mask_dependencies(t):
    few = F.array(*[F.lit(f"Brand#{i}") for i in (1, 2, 3)])
    allowed = t("orders").filter("o_orderpriority < '3'").select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderpriority").startswith("1"), few).otherwise(F.array().cast("array<string>")).alias("packages"))
    return deps.mask_dependencies(edges(t), allowed, known=t("lineitem").count()).groupBy("task", "pkg", "version").agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES_SQL}, pairs AS (SELECT DISTINCT task, pkg, version FROM edges),
keyed AS (SELECT task, string_agg(pkg || '_' || version, '_' ORDER BY pkg, version) AS k, string_agg(pkg || version, '_' ORDER BY pkg, version) AS env FROM pairs GROUP BY task)
SELECT md5(k) AS dependency_hash, env, count(*)::BIGINT AS n_tasks FROM keyed GROUP BY ALL""")
def dependency_set_hash(t):
    sets = edges(t).select("task", "pkg", "version").distinct().groupBy("task").agg(F.collect_list(F.struct("pkg", "version")).alias("pairs"))
    return sets.select(deps.dependency_hash(F.col("pairs")).alias("dependency_hash"), deps.environment_key(F.col("pairs")).alias("env")).groupBy("dependency_hash", "env").agg(F.count("*").alias("n_tasks"))


@query(f"""WITH {EDGES_SQL}, lists AS (SELECT task, string_agg(pkg || '=' || version, ',' ORDER BY {', '.join(LINE_ORDER)}) AS k FROM edges GROUP BY task)
SELECT count(DISTINCT k)::BIGINT AS n_ordered_sets, count(*)::BIGINT AS n_tasks FROM lists""")
def ordered_dependency_sets(t):
    rows = edges(t).groupBy("task").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "pkg", "version"))).alias("r"))
    keys = rows.select(F.array_join(F.transform("r", lambda x: F.concat_ws("=", x["pkg"], x["version"])), ",").alias("k"))
    return keys.agg(F.countDistinct("k").alias("n_ordered_sets"), F.count("*").alias("n_tasks"))


@query("""WITH v AS (SELECT DISTINCT p_brand AS pkg, (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR AS version, p_size // 10 AS a, p_size % 10 AS b FROM part),
d AS (SELECT x.pkg, x.version, y.version AS other, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS distance FROM v x JOIN v y ON x.pkg = y.pkg AND x.version <> y.version)
SELECT pkg, version, other, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY pkg, version ORDER BY distance, other)::INT AS rank FROM d) WHERE rank <= 3""")
def closest_versions(t):
    v = t("part").select(F.col("p_brand").alias("pkg"), F.expr("concat(p_size div 10, '.', p_size % 10)").alias("version")).distinct()
    return deps.closest_versions(v, 3).withColumn("distance", F.round("distance", 6))


@query("""WITH v AS (SELECT DISTINCT p_brand AS pkg, '1.' || (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR AS version, p_size // 10 AS minor FROM part)
SELECT x.pkg, x.version, y.version AS other FROM v x JOIN v y ON x.pkg = y.pkg AND x.version <> y.version AND x.minor = y.minor""")
def same_minor_versions(t):
    v = t("part").select(F.col("p_brand").alias("pkg"), F.expr("concat('1.', p_size div 10, '.', p_size % 10)").alias("version")).distinct()
    other = v.withColumnRenamed("version", "other")
    return v.join(other, "pkg").filter("version <> other").filter(versions.version_strategy("same_minor")(F.col("version"), F.col("other")))


@query("""WITH v AS (SELECT DISTINCT p_brand AS pkg, (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR AS version, p_size // 10 AS a, p_size % 10 AS b FROM part),
d AS (SELECT x.pkg, x.version, y.version AS other, x.a = y.a AND x.b = y.b AS same, row_number() OVER (PARTITION BY x.pkg, x.version ORDER BY sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)), y.version) AS rank FROM v x JOIN v y ON x.pkg = y.pkg AND x.version <> y.version)
SELECT 'closest_n' AS strategy, pkg, version, other FROM d WHERE rank <= 2 UNION ALL SELECT 'same_minor', pkg, version, other FROM d WHERE same UNION ALL SELECT 'all', pkg, version, other FROM d""")
def version_strategies(t):
    """The versions that strategies pick, by their names."""
    v = t("part").select(F.col("p_brand").alias("pkg"), F.expr("concat(p_size div 10, '.', p_size % 10)").alias("version")).distinct()
    found = [deps.by_strategy(v, name, 2).select(F.lit(name).alias("strategy"), "pkg", "version", "other") for name in ("closest_n", "same_minor", "all")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH want AS (SELECT DISTINCT source AS v FROM documents), have AS (SELECT source AS candidate, min(doc_id) AS ord FROM documents GROUP BY source)
SELECT v AS wanted, arg_min(candidate, ord) AS matched FROM want JOIN have ON candidate = v OR starts_with(candidate, v) GROUP BY v""")
def version_prefix_match(t):
    docs = t("documents")
    want, have = docs.select(F.col("source").alias("wanted")).distinct(), docs.groupBy(F.col("source").alias("candidate")).agg(F.min("doc_id").alias("ord"))
    # every prefix of a candidate is a row of its own, so that any wanted one, however short, meets it by equality
    prefixes = have.select("*", F.explode(F.sequence(F.lit(1), F.length("candidate"))).alias("n")).withColumn("wanted", F.expr("left(candidate, n)"))
    pairs = want.join(prefixes, "wanted")
    return pairs.groupBy("wanted").agg(F.min_by("candidate", "ord").alias("matched"))


@query("""WITH tags AS (SELECT DISTINCT source AS tag FROM documents), v AS (SELECT DISTINCT (p_size)::VARCHAR AS version FROM part)
SELECT version, arg_min(tag, length(tag) * 1000 + replace(tag, 'src', '')::INT) AS tag FROM v JOIN tags ON contains(tag, version) GROUP BY version""")
def tag_for_version(t):
    """The shortest tag that contains a version; tags' substrings meet the versions by an equi-join."""
    tags = t("documents").select(F.col("source").alias("tag")).distinct()
    v = t("part").select(F.col("p_size").cast("string").alias("version")).distinct()
    pairs = deps.containing(tags, "tag", v, "version")
    return pairs.groupBy("version").agg(F.min_by("tag", F.struct(F.length("tag"), F.replace("tag", F.lit("src"), F.lit("")).cast("int"))).alias("tag"))


def _specs(t):
    op = F.element_at(F.array(*[F.lit(x) for x in ("==", ">=", "<=", "", ">=<=", "~=")]), F.col("p_partkey").cast("int") % 6 + 1)
    return t("part").select("p_partkey", F.concat(op, F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string")).alias("spec"))


@query("""WITH s AS (SELECT p_partkey, ['==', '>=', '<=', '', '>=<=', '~='][(p_partkey % 6 + 1)::INT] || p_size || '.' || (p_partkey % 7) AS spec FROM part)
SELECT p_partkey, spec, regexp_replace(regexp_replace(regexp_replace(spec, '^>=', ''), '^<=', ''), '^==', '') AS version FROM s""")
def strip_version_operators(t):
    return _specs(t).withColumn("version", text.strip_version_operator(F.col("spec")))


_PATHS = ["np.sum", "scipy.stats.norm", "matplotlib.pyplot.plot", "sklearn.svm.SVC", "torch.nn", "seaborn.heatmap", "tf", "pandas.DataFrame.sum"]


@query("""WITH p AS (SELECT p_partkey, ['np.sum', 'scipy.stats.norm', 'matplotlib.pyplot.plot', 'sklearn.svm.SVC', 'torch.nn', 'seaborn.heatmap', 'tf', 'pandas.DataFrame.sum'][(p_partkey % 8 + 1)::INT] AS path FROM part)
SELECT p_partkey, path, CASE path WHEN 'np.sum' THEN 'numpy' WHEN 'scipy.stats.norm' THEN 'scipy' WHEN 'matplotlib.pyplot.plot' THEN 'matplotlib' WHEN 'sklearn.svm.SVC' THEN 'scikit-learn' WHEN 'torch.nn' THEN 'torch'
  WHEN 'seaborn.heatmap' THEN 'seaborn' WHEN 'tf' THEN 'tensorflow' ELSE 'pandas' END AS package,
  CASE path WHEN 'np.sum' THEN 'numpy' WHEN 'scipy.stats.norm' THEN 'scipy' WHEN 'matplotlib.pyplot.plot' THEN 'matplotlib' WHEN 'sklearn.svm.SVC' THEN 'sklearn' WHEN 'torch.nn' THEN 'torch'
  WHEN 'seaborn.heatmap' THEN 'seaborn' WHEN 'tf' THEN 'tensorflow' ELSE 'pandas' END AS normal FROM p""")
def package_of_api_path(t):
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), F.col("p_partkey").cast("int") % 8 + 1)
    rows = t("part").select("p_partkey", path.alias("path")).withColumn("package", text.api_package(F.col("path")))
    return rows.withColumn("normal", text.normalize_package(F.col("package")))


@query("""SELECT o_orderkey AS task, CASE WHEN o_orderstatus = 'F' THEN 'VACE' ELSE 'VSCC' END AS kind,
CASE WHEN o_orderstatus = 'F' THEN 'target' ELSE 'declared' END || CASE WHEN o_orderkey % 5 = 0 THEN ':true' ELSE '' END AS chosen FROM orders""")
def dependency_by_task_kind(t):
    """Edit tasks use the target dependency, others the declared one; a true one, where given, replaces either."""
    rows = t("orders").select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "VACE").otherwise("VSCC").alias("kind"))
    true = lambda name: F.when(F.col("task") % 5 == 0, f"{name}:true")
    chosen = F.when(F.col("kind") == "VACE", F.coalesce(true("target"), F.lit("target"))).otherwise(F.coalesce(true("declared"), F.lit("declared")))
    return rows.withColumn("chosen", chosen)
