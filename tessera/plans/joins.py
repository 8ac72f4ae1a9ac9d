"""Join queries: resume, semi and anti joins, merges, matches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import joins
from tessera.plans.base import query


#: Versions that a plan asks for in every package: a stated list.
MOST_VERSIONS = 10_000


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_left_anti(t):
    return joins.resume(t("documents").select("doc_id", "lang"), t("labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def allowlist_semi(t):
    return t("documents").select("doc_id", "lang").join(t("labels").filter("quality = 1"), "doc_id", "left_semi")


@query("""SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def append_baseline(t):
    return joins.append_missing(t("labels").select("doc_id", "quality"), t("documents").select("doc_id", F.lit(-1).alias("quality")), "doc_id")


@query("""WITH c AS (SELECT CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id END AS item, turn, conv_id FROM conversations),
k AS (SELECT coalesce(item, conv_id)::VARCHAR AS key_item, CASE WHEN item IS NULL THEN 0 ELSE turn END AS key_index FROM c),
done AS (SELECT conv_id::VARCHAR AS key_item, turn AS key_index FROM conversations WHERE role = 'assistant')
SELECT key_item, key_index::BIGINT AS key_index, count(*)::BIGINT AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.key_item = k.key_item AND d.key_index = k.key_index) GROUP BY ALL""")
def composite_resume(t):
    rows = t("conversations").select(F.when(F.col("conv_id") % 3 != 0, F.col("conv_id")).alias("original_item_id"), F.col("turn").alias("query_index"), F.col("conv_id").alias("id"))
    done = t("conversations").filter("role = 'assistant'").select(F.col("conv_id").cast("string").alias("key_item"), F.col("turn").alias("key_index"))
    keyed = rows.select(*joins.composite_key())
    return joins.resume(keyed, done, ["key_item", "key_index"]).groupBy("key_item", "key_index").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events WHERE event_type = 'error' GROUP BY 1), b AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, list_concat(coalesce(a.ids, []), coalesce(b.ids, [])) AS ids FROM a FULL JOIN b ON a.user_id = b.user_id""")
def merge_error_sources(t):
    """Two checkers' findings by id, the first one's ahead."""
    side = lambda kind: t("events").filter(F.col("event_type") == kind).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return joins.merge_lists(side("error"), side("click"), "user_id", "ids")


@query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def conflicting_ids(t):
    return t("labels").filter("quality = 1").select("doc_id").intersect(t("labels").filter("toxic = 1").select("doc_id"))


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS n FROM labels)
SELECT d.doc_id, r.quality, r.doc_id IS NULL AS missing FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.n = 1""")
def prediction_with_first_match(t):
    return joins.with_first_match(t("documents").select("doc_id"), t("labels").select("doc_id", "quality", "toxic"), "doc_id", ["quality", "toxic"]).select("doc_id", "quality", "missing")


@query("""SELECT e.event_id, e.user_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'error'""")
def errors_with_code(t):
    return t("events").filter("event_type = 'error'").join(t("customer").withColumnRenamed("c_custkey", "user_id"), "user_id").select("event_id", "user_id", "c_name")


@query("""SELECT user_id, count(*)::BIGINT AS n_errors, list(event_id ORDER BY event_id) AS ids FROM events WHERE event_type = 'error' AND value > 100 GROUP BY user_id""")
def diagnostics_by_id(t):
    """Diagnostics of the wanted severity by id; ids without one vanish."""
    return t("events").filter("event_type = 'error' AND value > 100").groupBy("user_id").agg(F.count("*").alias("n_errors"), F.array_sort(F.collect_list("event_id")).alias("ids"))


@query("SELECT l.doc_id::VARCHAR AS id, d.lang FROM labels l JOIN documents d ON l.doc_id::VARCHAR = d.doc_id::VARCHAR WHERE l.quality = 1")
def results_join_tasks(t):
    """Mixed number and text ids meet as text."""
    a = t("labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return a.join(t("documents").select(F.col("doc_id").cast("string").alias("id"), "lang"), "id")


@query("""WITH x AS (SELECT conv_id, string_agg('[' || role || ']', '' ORDER BY turn) AS extra FROM conversations WHERE role <> 'user' GROUP BY 1)
SELECT c.conv_id, c.turn, c.role || coalesce(x.extra, '') AS answer FROM conversations c LEFT JOIN x ON c.conv_id = x.conv_id WHERE c.role = 'user'""")
def answers_with_extra_info(t):
    """Extra information is appended once for each match, in order."""
    c = t("conversations")
    extra = c.filter("role <> 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.format_string("[%s]", "role").alias("x")))).alias("xs"))
    joined = c.filter("role = 'user'").join(extra, "conv_id", "left")
    return joined.select("conv_id", "turn", F.concat("role", F.coalesce(F.array_join(F.col("xs")["x"], ""), F.lit(""))).alias("answer"))


@query("""WITH d AS (SELECT lang, source, doc_id FROM documents), e AS (SELECT DISTINCT lang, source FROM documents WHERE doc_id % 7 = 0)
SELECT d.lang, d.source, count(*)::BIGINT AS n_docs FROM d JOIN e ON d.lang = e.lang AND d.source = e.source GROUP BY ALL""")
def edges_join_corpus(t):
    """Dependency edges to corpus partitions on (pkg, version)."""
    docs = t("documents").select("lang", "source", "doc_id")
    wanted = docs.filter("doc_id % 7 = 0").select("lang", "source").distinct()
    return docs.join(wanted, ["lang", "source"]).groupBy("lang", "source").agg(F.count("*").alias("n_docs"))


@query("""WITH want AS (SELECT DISTINCT lang, p.v AS source FROM documents, (SELECT DISTINCT source AS v FROM documents UNION ALL SELECT 'src99') p), have AS (SELECT DISTINCT lang, source FROM documents WHERE length(trim(text)) > 0)
SELECT w.lang, w.source, h.lang IS NOT NULL AS has_data FROM want w LEFT JOIN have h ON w.lang = h.lang AND w.source = h.source""")
def partition_has_data(t):
    docs = t("documents")
    sources = [r["source"] for r in docs.select("source").distinct().limit(MOST_VERSIONS + 1).collect()] + ["src99"]
    if len(sources) > MOST_VERSIONS:
        raise ValueError(f"more than {MOST_VERSIONS} versions to plan for")
    wanted = docs.select("lang").distinct().select("lang", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    have = docs.filter(F.length(F.trim("text")) > 0).select("lang", "source").distinct().withColumn("has_data", F.lit(True))
    return wanted.join(have, ["lang", "source"], "left").select("lang", "source", F.coalesce("has_data", F.lit(False)).alias("has_data"))


@query("""SELECT p_partkey, arg_min(p_type2, (d, p_type2)) AS best, min(d)::BIGINT AS distance FROM (
  SELECT p.p_partkey, q.p_type2, levenshtein(p.p_name, q.p_type2) AS d FROM part p JOIN (SELECT DISTINCT p_brand, lower(p_type) AS p_type2 FROM part) q ON p.p_brand = q.p_brand) GROUP BY p_partkey""")
def edit_distance_best(t):
    """The nearest candidate of the same package by edit distance, ties to the first."""
    part = t("part")
    candidates = part.select("p_brand", F.lower("p_type").alias("candidate")).distinct()
    pairs = part.select("p_partkey", "p_brand", "p_name").join(candidates, "p_brand").withColumn("d", F.levenshtein("p_name", "candidate").cast("long"))
    return pairs.groupBy("p_partkey").agg(F.min_by("candidate", F.struct("d", "candidate")).alias("best"), F.min("d").alias("distance"))


@query("""SELECT p_name, p_brand, min(p_partkey) AS first_key FROM part GROUP BY ALL""")
def exact_lookup_first(t):
    """Exact corpus lookup by path; the first line of a partition wins."""
    part = t("part").select("p_partkey", "p_name", "p_brand")
    return joins.first_wins(part, ["p_name", "p_brand"], ["p_partkey"]).select("p_name", "p_brand", F.col("p_partkey").alias("first_key"))


@query("""SELECT c.c_custkey, n.n_name AS download_name, r.last_key FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN (SELECT n_regionkey, max(n_nationkey) AS last_key FROM nation GROUP BY 1) r ON n.n_regionkey = r.n_regionkey""")
def import_download_names(t):
    """A name map looked up both ways; the way back keeps the last of duplicates."""
    nation = t("nation")
    back = joins.last_wins(nation, ["n_regionkey"], ["n_nationkey"]).select("n_regionkey", F.col("n_nationkey").alias("last_key"))
    forth = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("download_name"), "n_regionkey")
    return t("customer").select("c_custkey", "c_nationkey").join(forth, "c_nationkey").join(back, "n_regionkey").select("c_custkey", "download_name", "last_key")


@query("""WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position FROM documents), b AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS position FROM documents)
SELECT a.lang, a.position::INT AS position, a.doc_id, b.n_chars FROM a JOIN b ON a.lang = b.lang AND a.position = b.position""")
def zip_by_position(t):
    docs = t("documents")
    return joins.zip_by_position(docs.select("lang", "doc_id"), docs.select("lang", "n_chars", F.col("doc_id").alias("_d")), ["doc_id"], ["n_chars", "_d"], ["lang"]).drop("_d")


@query("""WITH s AS (SELECT DISTINCT doc_id % 5 AS rank, length(text) AS idx FROM documents)
SELECT a.rank AS rank_a, b.rank AS rank_b, count(*)::BIGINT AS common, list_slice(list_sort(list(a.idx)), 1, 5) AS first_five FROM s a JOIN s b ON a.idx = b.idx AND a.rank < b.rank GROUP BY ALL""")
def shard_overlap(t):
    """Pairs of ranks that hold the same index: how many, and the first five."""
    s = t("documents").select((F.col("doc_id") % 5).alias("rank"), F.length("text").cast("long").alias("idx")).distinct()
    pairs = s.select(F.col("rank").alias("rank_a"), "idx").join(s.select(F.col("rank").alias("rank_b"), "idx"), "idx").filter("rank_a < rank_b")
    return pairs.groupBy("rank_a", "rank_b").agg(F.count("*").alias("common"), F.slice(F.array_sort(F.collect_list("idx")), 1, 5).alias("first_five"))


@query("""SELECT c.c_mktsegment AS domain, count(DISTINCT o.o_orderkey)::BIGINT AS n_tasks, count(*)::BIGINT AS n_results FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL""")
def task_domain_results(t):
    domains = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("domain"))
    tasks = t("orders").select("o_orderkey", "o_custkey").join(domains, "o_custkey")
    results = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    counted = results.groupBy("o_orderkey").agg(F.count("*").alias("n"))  # before the join, so that one row a task moves
    return tasks.join(counted, "o_orderkey").groupBy("domain").agg(F.count("*").alias("n_tasks"), F.sum("n").alias("n_results"))


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN d.source ELSE 'labelled' END AS source FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id""")
def overwrite_by_lookup(t):
    lookup = t("labels").select("doc_id").distinct().withColumn("source", F.lit("labelled"))
    return joins.overwrite_field(t("documents").select("doc_id", "source"), lookup, "doc_id", "source")


@query("""SELECT conv_id, count(*)::BIGINT AS n_turns FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') <> 3""")
def resume_incomplete(t):
    """Tasks whose outputs aren't as many as asked for."""
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "assistant").alias("outputs")).filter("outputs <> 3").select("conv_id", "n_turns")


@query("""SELECT lang AS kind, doc_id AS id FROM documents WHERE lang = 'en' UNION ALL SELECT role, conv_id FROM conversations WHERE role = 'system'""")
def union_by_flags(t):
    sets = {"documents": t("documents").filter("lang = 'en'").select(F.col("lang").alias("kind"), F.col("doc_id").alias("id")), "system": t("conversations").filter("role = 'system'").select(F.col("role").alias("kind"), F.col("conv_id").alias("id"))}
    first, *others = sets.values()
    for one in others:
        first = first.unionByName(one)
    return first


@query("""SELECT id, arg_max(v, ord) AS v FROM (SELECT doc_id AS id, lang AS v, 0 AS ord FROM documents UNION ALL SELECT doc_id, 'q' || quality, 1 FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)) GROUP BY id""")
def merge_later_wins(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("v"), F.lit(0).alias("ord"))
    later = t("labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), F.col("q")).alias("v"), F.lit(1).alias("ord"))
    return docs.unionByName(later).groupBy("id").agg(F.max_by("v", "ord").alias("v"))


@query("""SELECT source FROM documents EXCEPT SELECT source FROM documents WHERE doc_id % 2 = 0""")
def set_difference(t):
    docs = t("documents")
    return docs.select("source").subtract(docs.filter("doc_id % 2 = 0").select("source"))


@query("""SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1""")
def set_union_of_keys(t):
    labels = t("labels")
    return labels.filter("quality = 0").select("doc_id").union(labels.filter("toxic = 1").select("doc_id")).distinct()
