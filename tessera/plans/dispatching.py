"""Queries of the dispatch over ways to a context, filters in order, caches, and metrics by data set."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import metrics, text
from tessera.operators import dispatch, packing, retrieval
from tessera.operators.bounded import spread
from tessera.plans.base import query
from tessera.plans.retrieval import _OVERLAP, fill_candidates, ranked
from tessera.sources.collections import Collection
from tessera.tables import delete, shared_dir, written


def _tasks(t):
    """Tasks of four items with their way: every fifth has fixed documents, every seventh a locked collection, every third one query."""
    own = t("benchmark").select(F.expr("item_id div 4").alias("task"), "item_id").groupBy("task").agg(F.count("*").alias("n"))
    n = F.when(F.col("task") % 3 == 2, F.least(F.lit(1), "n")).otherwise(F.col("n"))
    return own.select("task", dispatch.way(n, F.col("task") % 5 == 0, F.col("task") % 7 == 6).alias("way"))


def _ways(near):
    """The ways that ask for no rounds, of the nearest documents (item_id, doc_id, rank)."""
    top = near.filter("rank <= 5").withColumn("task", F.expr("item_id div 4"))
    fixed = retrieval.first_seen(top, "task", "doc_id", ["item_id", "rank"])
    fixed = fixed.select("task", F.row_number().over(Window.partitionBy("task").orderBy("first")).cast("long").alias("place"), F.col("doc_id").alias("doc"))
    single = top.filter("item_id % 4 = 0").select("task", F.col("rank").cast("long").alias("place"), F.col("doc_id").alias("doc"))
    return {dispatch.FIXED: fixed, dispatch.NEAREST: single}


@query()
def dispatch_contexts(t):
    """Each task's documents by its way: fixed ones, rounds over its queries, one query's five nearest, none where it is locked."""
    near = written(ranked(t, 12).select("item_id", "doc_id", "rank"))  # the search runs once for all ways
    return dispatch.dispatch(_tasks(t), _ways(near) | {dispatch.ROUNDS: packing.fill_tasks(fill_candidates(t, 12, near=near), 2000)})


@query(f"""WITH {_OVERLAP}, n AS (SELECT item_id // 4 AS task, count(*) AS n FROM benchmark GROUP BY 1), w AS (SELECT task, CASE WHEN task % 7 = 6 THEN 'locked' WHEN task % 5 = 0 THEN 'fixed'
  WHEN task % 3 <> 2 AND n > 1 THEN 'rounds' ELSE 'nearest' END AS way FROM n),
f AS (SELECT item_id // 4 AS task, doc_id, min((item_id, rank)) AS first FROM ranked WHERE rank <= 5 GROUP BY ALL),
d AS (SELECT task, 'fixed' AS way, row_number() OVER (PARTITION BY task ORDER BY first) AS place, doc_id AS doc FROM f UNION ALL SELECT item_id // 4, 'nearest', rank, doc_id FROM ranked WHERE rank <= 5 AND item_id % 4 = 0)
SELECT w.task::BIGINT AS task, w.way, d.place::BIGINT AS place, d.doc FROM w LEFT JOIN d USING (task, way) WHERE w.way <> 'rounds'""")
def dispatch_without_rounds(t):
    """The tasks that take no rounds, whose documents SQL can tell."""
    return dispatch.dispatch(_tasks(t).filter("way <> 'rounds'"), _ways(written(ranked(t, 5).select("item_id", "doc_id", "rank"))))


@query("""WITH q AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'python.' || p_size ELSE lower(split_part(p_type, ' ', 1)) || '.' || p_size END AS api FROM part),
first AS (SELECT p_brand, arg_min(coalesce(api, '-'), p_partkey) AS api FROM q GROUP BY 1)
SELECT q.p_brand, q.p_partkey, q.api FROM q JOIN first f USING (p_brand) WHERE f.api <> '-' AND q.api IS NOT NULL AND split_part(q.api, '.', 1) IN ('standard', 'small', 'python', 'promo', 'economy') AND split_part(q.api, '.', 1) <> 'python'""")
def target_api_filter(t):
    """Queries of a brand whose API is of a package that the target depends on; none where the first names no API."""
    api = F.when(F.col("p_partkey") % 9 == 0, None).when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("python."), F.col("p_size").cast("string"))).otherwise(F.concat(F.lower(F.substring_index("p_type", " ", 1)), F.lit("."), F.col("p_size").cast("string")))
    asked = t("part").select("p_brand", F.struct("p_partkey", api.alias("target_api")).alias("q")).groupBy("p_brand").agg(F.array_sort(F.collect_list("q")).alias("queries"))
    packages = F.array(*[F.lit(p) for p in ("standard", "small", "python", "promo", "economy")])
    kept = asked.select("p_brand", F.explode(dispatch.with_target_api(F.col("queries"), packages)).alias("q"))
    return kept.select("p_brand", F.col("q.p_partkey").alias("p_partkey"), F.col("q.target_api").alias("api"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def filters_in_order(t):
    """Orders not processed yet, not masked, of wanted customers, before anything is masked inside them."""
    orders = t("orders")
    done = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    left = dispatch.ordered_filters(orders, "o_orderkey", done=done, banned=orders.filter("o_orderpriority = '1-URGENT'"))
    wanted = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return dispatch.ordered_filters(left, "o_custkey", wanted=wanted).select("o_orderkey", "o_orderstatus")


@query("""SELECT user_id, event_type, count(*) FILTER (value > 20) AS n_ids FROM events GROUP BY ALL HAVING count(*) FILTER (value > 20) > 0""")
def purge_empty_cached(t):
    """Cached queries without those whose first list of ids is empty."""
    cached = t("events").groupBy("user_id", "event_type").agg(F.array(F.collect_list(F.when(F.col("value") > 20, F.col("event_id")))).alias("ids"))
    return cached.filter(F.size(F.element_at("ids", 1)) > 0).select("user_id", "event_type", F.size(F.element_at("ids", 1)).cast("long").alias("n_ids"))


@query("""WITH w AS (SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL), c AS (SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id % 50 <> 7 GROUP BY ALL)
SELECT w.lang, w.source, w.n, w.chars, c.n IS NOT NULL AS cached FROM w LEFT JOIN c ON c.lang = w.lang AND c.source = w.source AND c.n = w.n""")
def cached_or_computed(t):
    """Partitions whose cached result is of as many documents as there are now, and the others computed anew."""
    sums = lambda df: df.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    docs = t("documents").select("doc_id", "lang", "source", "n_chars")
    wanted = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return dispatch.cached_or_computed(sums(docs.filter("doc_id % 50 <> 7")), wanted, ["lang", "source"], lambda stale: sums(docs.join(stale.select("lang", "source"), ["lang", "source"], "left_semi")))


@query("""WITH s AS (SELECT doc_id, text, k, len(list_filter(string_split_regex(substr(text, k * 1000 + 1, 1000), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS n FROM documents, LATERAL (SELECT unnest(generate_series(0, (length(text) - 1) // 1000)) AS k) WHERE length(text) > 0),
c AS (SELECT doc_id, k, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT d.doc_id, coalesce(max((k + 1) * 1000) FILTER (before < 300), 0)::INT AS position FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1""")
def truncation_position(t):
    """Characters to read until there are 300 tokens, in steps of 1,000."""
    return t("documents").select("doc_id", F.coalesce(dispatch.truncation_position(F.col("text"), 300, 1000), F.lit(0)).cast("int").alias("position"))


@query()
def random_splits(t):
    sized = t("documents").select("doc_id", F.size(text.words(F.col("text"))).alias("n")).filter("n > 1")
    return sized.select("doc_id", "n", dispatch.random_splits(F.col("doc_id"), F.col("n")).alias("splits"))


#: A data set for each kind of metric that the conversations stand in for.
_ASKED = ["passkey", "longdialogue_qa_eng", "passage_retrieval_en", "kv_retrieval", "code_debug", "passage_count"]


@query("""WITH c AS (SELECT conv_id, turn, text, ['passkey', 'longdialogue_qa_eng', 'passage_retrieval_en', 'kv_retrieval', 'code_debug', 'passage_count'][((conv_id + turn) % 6 + 1)::INT] AS dataset, 'Paragraph ' || (conv_id % 3) AS place, (conv_id % 3)::VARCHAR AS digit,
  split_part(text, ' ', 2) AS word FROM conversations WHERE text IS NOT NULL), p AS (SELECT *, text || ' ' || digit || ' 7' AS pred FROM c),
n AS (SELECT *, regexp_extract_all(pred, '[0-9]+') AS numbers FROM p)
SELECT dataset, count(*) AS n, round(100 * avg(CASE dataset WHEN 'passkey' THEN (numbers[1] = digit)::INT WHEN 'longdialogue_qa_eng' THEN contains(pred, word)::INT WHEN 'kv_retrieval' THEN list_contains(string_split_regex(translate(pred, chr(10) || ':".,?!{}' || chr(39), '          '), '[ \\t\\n\\r\\f\\v]+'), word)::INT
  WHEN 'code_debug' THEN (regexp_extract(pred, '\\b([A-D])\\b', 1) = 'A')::INT ELSE len(list_filter(numbers, lambda x: x = digit)) / len(numbers)::DOUBLE END), 2) AS score FROM n GROUP BY 1""")
def score_by_dataset(t):
    """Mean score of each data set by its own metric, in percent."""
    dataset = F.element_at(F.array(*[F.lit(x) for x in _ASKED]), ((F.col("conv_id") + F.col("turn")) % 6).cast("int") + 1)
    digit = (F.col("conv_id") % 3).cast("string")
    truth = F.when(dataset.isin("passkey", "passage_count"), digit).when(dataset == "passage_retrieval_en", F.concat(F.lit("Paragraph "), digit)).when(dataset == "code_debug", "A").otherwise(F.coalesce(F.try_element_at(F.split("text", " "), F.lit(2)), F.lit("")))
    rows = spread(t("conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text")).select(dataset.alias("dataset"), truth.alias("truth"), F.concat("text", F.lit(" "), digit, F.lit(" 7")).alias("prediction"))
    scored = rows.withColumn("score", metrics.score(F.col("dataset"), F.col("prediction"), F.col("truth"), F.lit(None).cast("array<string>"), _ASKED))
    return scored.groupBy("dataset").agg(F.count("*").alias("n"), F.round(100 * F.avg("score"), 2).alias("score"))


@query("""WITH a AS (SELECT lang, source, doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT lang, source, doc_id, n_chars * 2 AS n_chars FROM documents WHERE doc_id % 3 <> 1)
SELECT doc_id, max(n_chars)::BIGINT AS n_chars, (count(*) > 1) AS replaced FROM (SELECT doc_id, n_chars FROM a UNION ALL SELECT doc_id, n_chars FROM b) u WHERE doc_id % 5 <> 0 GROUP BY doc_id""")
def collection_upsert(t):
    """A stored collection of documents: rows are put in, some replaced, some removed, and all read back."""
    docs = t("documents").filter("doc_id IS NOT NULL").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    try:
        kept = Collection(spark, path, ["doc_id"], "doc_id long, n_chars long, replaced boolean", buckets=16)
        kept.upsert(docs.filter("doc_id % 3 <> 0").withColumn("replaced", F.lit(False)))
        both = docs.filter("doc_id % 3 <> 1").select("doc_id", (F.col("n_chars") * 2).alias("n_chars"), (F.col("doc_id") % 3 == 2).alias("replaced"))
        kept.upsert(both)
        kept.remove(F.col("doc_id") % 5 == 0)
        return written(kept.get())
    finally:
        delete(spark, path)
