"""Retrieval queries: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import contexts, dispatch, documents, packing, retrieval
from tessera.operators.bounded import broadcast_if_small
from tessera.plans.base import query
from tessera.tables import written

_OVERLAP = """qt AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 1)) AS q FROM benchmark),
dt AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 1)) AS d FROM documents),
qx AS (SELECT item_id, len(q) AS nq, unnest(q) AS token FROM qt), dx AS (SELECT doc_id, len(d) AS nd, unnest(d) AS token FROM dt),
pairs AS (SELECT item_id, doc_id, nq, nd, count(*) AS common FROM qx JOIN dx USING (token) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, least(1.0::DOUBLE, common / (nq + nd - common)::DOUBLE + CASE WHEN common = least(nq, nd) THEN 0.3::DOUBLE ELSE 0 END) AS s FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id)::INT AS rank FROM scored)"""


def ranked(t, k):
    scored = retrieval.token_overlap(t("benchmark"), t("documents"), best=k)
    return retrieval.top(scored, "item_id", F.round("similarity", 9), "doc_id", k)


@query(f"WITH {_OVERLAP} SELECT item_id, doc_id, round(s, 6) AS similarity, rank FROM ranked WHERE rank <= 3")
def topk_docs_by_token_overlap(t):
    return ranked(t, 3).select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {_OVERLAP}, g AS (SELECT item_id, string_agg(text, chr(10) ORDER BY rank) AS c FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1)
SELECT item_id, array_to_string(list_slice(list_filter(string_split_regex(c, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''), 1, 200), ' ') AS context FROM g""")
def pack_context_budget(t):
    """The three nearest documents in rank order, first 200 tokens; texts are joined to the few that were chosen."""
    chosen = ranked(t, 3).select("item_id", "doc_id", "rank")
    texts = t("documents").select("doc_id", "text").join(broadcast_if_small(chosen, known=3 * t("benchmark").count()), "doc_id")
    return retrieval.pack_context(texts, "item_id", "text", 200)


@query(f"""WITH {_OVERLAP}, f AS (SELECT item_id // 4 AS task, doc_id, min((item_id, rank)) AS first FROM ranked WHERE rank <= 5 GROUP BY ALL)
SELECT task::BIGINT AS task, doc_id, row_number() OVER (PARTITION BY task ORDER BY first)::INT AS place FROM f""")
def fixed_docs_per_query_dedup(t):
    """Top five of each query, first-seen dedup over the queries of a task (four items)."""
    found = retrieval.first_seen(ranked(t, 5).withColumn("task", F.expr("item_id div 4")), "task", "doc_id", ["item_id", "rank"])
    return found.select("task", "doc_id", F.row_number().over(Window.partitionBy("task").orderBy("first")).alias("place"))


@query(f"""WITH {_OVERLAP}, e AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), x AS (
SELECT item_id, doc_id, 0 AS phase, 1.0::DOUBLE AS s FROM e UNION ALL SELECT item_id, doc_id, 1, s FROM scored WHERE (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM e))
SELECT item_id, doc_id, phase = 0 AS exact, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY phase, CASE WHEN phase = 0 THEN 0 ELSE -round(s, 9) END, doc_id)::INT AS rank FROM x) WHERE rank <= 5""")
def exact_then_similarity(t):
    """Exact hits (documents that hold the item) in document order, then by similarity, to five: of the ten nearest, five aren't exact
    hits unless there are five of those."""
    scored = retrieval.token_overlap(t("benchmark"), t("documents"), best=10)
    exact = retrieval.containment(t("benchmark"), t("documents")).withColumn("exact", F.lit(True))
    joined = scored.join(exact, ["item_id", "doc_id"], "full").withColumn("exact", F.coalesce("exact", F.lit(False)))
    order = [F.desc("exact"), F.when(F.col("exact"), 0.0).otherwise(-F.round("similarity", 9)), "doc_id"]
    best = joined.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter("rank <= 5")
    return best.select("item_id", "doc_id", "exact", F.round(F.when(F.col("exact"), 1.0).otherwise(F.col("similarity")), 6).alias("score"), "rank")


def fill_candidates(t, top_n: int, most_tokens: int | None = None, near=None):
    """task, phase, query, rank, doc, tokens.  Phase one: every document that holds the query, in order, or else the nearest one;
    phase two: the ``top_n`` nearest (what was chosen in phase one is skipped when it is filled).  A task is four queries.
    Both searches run once (``near``: the nearest documents, where they are known already).  With ``most_tokens`` a document counts as what is left of it after a cut, and blank ones are left out."""
    near = written(ranked(t, top_n).select("item_id", "doc_id", "rank")) if near is None else near
    exact = written(retrieval.containment(t("benchmark"), t("documents")))
    first = exact.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")))
    first = first.unionByName(near.filter("rank = 1").join(exact, "item_id", "left_anti")).withColumn("phase", F.lit(1))
    rest = near.withColumn("phase", F.lit(2))
    size = F.size(text.words(F.col("text")))
    sizes = t("documents").select("doc_id", (size if most_tokens is None else F.least(size, F.lit(most_tokens))).alias("tokens"))
    sizes = sizes if most_tokens is None else sizes.filter("tokens > 0")
    sized = sizes.join(broadcast_if_small(first.unionByName(rest)), "doc_id")
    return sized.select(F.expr("item_id div 4").alias("task"), "phase", F.col("item_id").alias("query"), "rank", F.col("doc_id").alias("doc"), "tokens")


@query()
def progressive_fill(t):
    """Contexts of four queries a task: exact picks first, then round-robin over the twelve nearest of each, within 2,000 tokens."""
    return packing.fill_tasks(fill_candidates(t, 12), 2000)


@query()
def progressive_contexts(t):
    """The contexts that filling by rounds gives: documents that aren't blank, each cut to 300 tokens, in the order in which they were
    taken, a line each, and the whole ended after 2,000 tokens."""
    chosen = written(packing.fill_tasks(fill_candidates(t, 12, 300), 2000))
    texts = t("documents").select(F.col("doc_id").alias("doc"), "text").join(broadcast_if_small(chosen), "doc")
    cut = texts.select("task", F.struct("place", F.array_join(F.slice(text.words(F.col("text")), 1, 300), " ").alias("body")).alias("part"))
    whole = cut.groupBy("task").agg(F.count("*").alias("n_docs"), F.array_join(F.array_sort(F.collect_list("part"))["body"], "\n").alias("whole"))
    found = F.split("whole", "(?<=[ \n])")  # tokens with the white space after them
    return whole.select("task", "n_docs", F.rtrim(F.array_join(F.slice(found, 1, 2000), "")).alias("context"))


_RELEVANCE = """e AS (SELECT event_id, ['np.sum', 'pandas.read_csv', 'os.path.join', 'torch.nn.Linear'][(event_id % 4 + 1)::INT] AS path, CASE WHEN user_id % 3 = 0 THEN 'uses PANDAS here' ELSE 'plain' END AS description,
CASE WHEN event_type = 'view' THEN 'PyTorch' END AS package FROM events), r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'path' WHEN event_id % 4 = 1 THEN 'path' WHEN description LIKE '%PANDAS%' THEN 'description' ELSE 'none' END AS reason FROM e)"""


@query(f"WITH {_RELEVANCE} SELECT event_id, reason <> 'none' AS relevant, reason FROM r")
def query_relevance(t):
    paths = F.array(*[F.lit(x) for x in ("np.sum", "pandas.read_csv", "os.path.join", "torch.nn.Linear")])
    targets = F.array(F.lit("numpy"), F.lit("pandas"))
    e = t("events").select("event_id", F.element_at(paths, F.col("event_id").cast("int") % 4 + 1).alias("path"), F.when(F.col("user_id") % 3 == 0, "uses PANDAS here").otherwise("plain").alias("description"), F.when(F.col("event_type") == "view", "PyTorch").alias("package"))
    found = retrieval.relevance(F.col("path"), F.col("description"), F.col("package"), targets)
    return e.select("event_id", found["relevant"].alias("relevant"), found["reason"].alias("reason"))


@query("""SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AS exact, CASE WHEN p_partkey % 3 < 2 THEN 'exact_api_match' WHEN p_size > 25 THEN 'rag_string_match' ELSE 'rag_fallback' END AS method, CASE WHEN p_partkey % 3 < 2 THEN '' ELSE p_name END AS context FROM part""")
def method_tags(t):
    asked = F.lit("scipy.fftpack.dct")
    path = F.when(F.col("p_partkey") % 3 == 0, "scipy.fft.dct").otherwise("other.path")
    aliases = F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit("scipy.fftpack.dct"))).otherwise(F.array(F.lit("x.y")))
    match = retrieval.document_match(asked, path, aliases, F.col("p_name"))
    tag = retrieval.retrieval_method(match["exact"], F.col("p_size") > 25, F.col("p_name"))
    return t("part").select("p_partkey", match["exact"].alias("exact"), tag["method"].alias("method"), tag["context"].alias("context"))


@query("""SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1""")
def exact_api_document(t):
    """The first document in order that holds the item."""
    return retrieval.containment(t("benchmark"), t("documents")).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS kind, lang || '.' || source AS path, source, coalesce(text, '') AS text FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
r AS (SELECT doc_id, CASE WHEN kind < 3 AND split_part(path, '.', 1) = 'en' THEN 'path' WHEN kind = 1 AND source = 'src1' THEN 'alias' WHEN contains(text, ' the ') THEN 'content' WHEN kind = 3 AND contains(text, 'en') THEN 'content' WHEN kind < 3 AND text <> '' AND contains(text, 'en') THEN 'content' WHEN contains(text, 'src1') THEN 'content'
  WHEN kind < 3 AND text = '' THEN 'content' ELSE 'dropped' END AS reason FROM d) SELECT doc_id, reason FROM r""")
def document_dependency_filter(t):
    """Documents as JSON with a path, aliases and a docstring, or as plain text, by the package that they belong to."""
    d = t("documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    kind, body = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    aliases = F.when(kind == 1, F.array(F.lit("none.of"), F.concat("source", F.lit(".x"))))
    path = F.concat("lang", F.lit("."), "source").alias("path")
    document = F.when(kind < 3, F.to_json(F.struct(path, aliases.alias("aliases"), body.alias("docstring"), F.lit("en").alias("kind")))).otherwise(body)
    found = documents.package_of_document(document, F.array(F.lit("src1"), F.lit("en"), F.lit(" the ")))
    return d.select("doc_id", F.coalesce(found["reason"], F.lit("dropped")).alias("reason"))


@query("""WITH q AS (SELECT conv_id, coalesce(list(text ORDER BY turn) FILTER (role = 'user' AND turn > 1 AND text IS NOT NULL), []) AS generated, coalesce(arg_min(text, turn), '') AS description FROM conversations GROUP BY 1),
p AS (SELECT *, list_filter(generated, lambda x: contains(lower(x), 'th')) AS passing FROM q)
SELECT conv_id, CASE WHEN len(passing) > 0 THEN 'filtered' WHEN len(generated) > 0 THEN 'unfiltered' ELSE 'description' END AS chosen,
  md5(array_to_string(CASE WHEN len(passing) > 0 THEN passing WHEN len(generated) > 0 THEN generated ELSE [description] END, chr(10))) AS queries FROM p""")
def query_selection(t):
    """Later questions of a conversation stand for generated queries, its beginning for the description; those pass that mention a target."""
    question = F.when((F.col("role") == "user") & (F.col("turn") > 1) & F.col("text").isNotNull(), F.struct("turn", "text"))
    own = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(question))["text"].alias("generated"), F.coalesce(F.min_by("text", "turn"), F.lit("")).alias("description"))
    found = dispatch.select_queries(F.col("generated"), F.filter("generated", lambda x: F.contains(F.lower(x), F.lit("th"))), F.col("description"))
    return own.select("conv_id", found["chosen"].alias("chosen"), F.md5(F.array_join(found["queries"], "\n")).alias("queries"))


@query(f"""WITH {_OVERLAP}, sp AS (SELECT source, doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents WHERE source IS NOT NULL),
heads AS (SELECT source AS package, sum(len(w)) AS tokens, list_slice(flatten(list(w ORDER BY doc_id)), 1, 400) AS head FROM sp WHERE len(w) > 0 GROUP BY 1),
tasks AS (SELECT item_id AS task, CASE item_id % 4 WHEN 0 THEN 'cached' WHEN 1 THEN 'retrieved' WHEN 2 THEN 'corpus' END AS way, 'src' || (item_id % 3) AS a, 'src' || (item_id % 5) AS b, text FROM benchmark),
want AS (SELECT DISTINCT task, unnest([a, b]) AS package FROM tasks WHERE way = 'corpus'), shares AS (SELECT task, package, head, floor(tokens * 400 / sum(tokens) OVER (PARTITION BY task))::INT AS quota FROM want JOIN heads USING (package)),
corpus AS (SELECT task, string_agg(array_to_string(list_slice(head, 1, quota), ' '), chr(10) ORDER BY package) AS context FROM shares GROUP BY 1),
near AS (SELECT item_id AS task, string_agg(d.text, chr(10) ORDER BY rank) AS context FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 2 AND item_id % 3 <> 0 GROUP BY 1)
SELECT task, CASE WHEN way IS NULL THEN 'error' WHEN way = 'retrieved' AND n.context IS NULL THEN 'locked' ELSE 'success' END AS status,
md5(coalesce(CASE way WHEN 'cached' THEN CASE WHEN task % 8 = 0 THEN array_to_string(list_slice(list_filter(string_split_regex(t.text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''), 1, 400), ' ') END WHEN 'retrieved' THEN n.context WHEN 'corpus' THEN c.context END, '')) AS context
FROM tasks t LEFT JOIN near n USING (task) LEFT JOIN corpus c USING (task)""")
def context_status(t):
    """Contexts of the benchmark's items: cached for every eighth, the two nearest documents (locked for every third), or all documents of
    two sources within 400 tokens."""
    items, docs = t("benchmark"), t("documents")
    way = F.element_at(F.array(F.lit(contexts.CACHED), F.lit(contexts.RETRIEVED), F.lit(contexts.CORPUS), F.lit(None)), (F.col("item_id") % 4).cast("int") + 1)
    packages = F.array(*[F.concat(F.lit("src"), (F.col("item_id") % n).cast("string")) for n in (3, 5)])
    tasks = items.select(F.col("item_id").alias("task"), way.alias("way"), F.lit("").alias("context"), packages.alias("packages"))
    cached = items.filter("item_id % 8 = 0").select(F.col("item_id").alias("task"), F.col("text").alias("context"))
    chosen = ranked(t, 2).filter("item_id % 3 <> 0").select("item_id", "doc_id", "rank")
    near = docs.select("doc_id", "text").join(broadcast_if_small(chosen, known=2 * items.count()), "doc_id").groupBy(F.col("item_id").alias("task")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "text")))["text"], "\n").alias("context"))
    heads = contexts.package_heads(docs.filter("source IS NOT NULL"), "source", "doc_id", "text", 400)
    found = contexts.acquire(tasks, cached, near, heads, 400)
    return found.select("task", "status", F.md5("context").alias("context"))


@query("""WITH s AS (SELECT lang, source, md5(lang || '_' || source) AS hash, count(*) AS n FROM documents GROUP BY ALL) SELECT hash, n::BIGINT AS n FROM s WHERE source NOT IN ('src1', 'src2')""")
def build_collections(t):
    """Keyed collections by dependency set; those already built are skipped."""
    s = t("documents").groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("hash", F.md5(F.concat_ws("_", "lang", "source")))
    built = s.filter(F.col("source").isin("src1", "src2")).select("hash")
    return s.join(built, "hash", "left_anti").select("hash", "n")


@query(f"""WITH {_OVERLAP}, g AS (SELECT item_id, string_agg(text, chr(10) ORDER BY rank) AS c FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1),
x AS (SELECT b.item_id, array_to_string(list_slice(list_filter(string_split_regex(c, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''), 1, 200), ' ') AS context FROM benchmark b LEFT JOIN g USING (item_id)),
s AS (SELECT item_id, CASE WHEN item_id % 11 = 5 THEN 'locked' WHEN coalesce(context, '') = '' THEN 'error' ELSE 'success' END AS status, context FROM x)
SELECT status, count(*)::BIGINT AS tasks, count(*) FILTER (status = 'success')::BIGINT AS answered, coalesce(sum(length('Context:' || chr(10) || context || chr(10) || 'Question: ' || b.text)) FILTER (status = 'success'), 0)::BIGINT AS answer_chars FROM s JOIN benchmark b USING (item_id) GROUP BY 1""")
def two_stage_pipeline(t):
    """Contexts of all items with their status, then prompts and answers of those that have one (the echoing generator), by status."""
    from tessera.operators import plugins

    items = t("benchmark").select("item_id", F.col("text").alias("question"))
    contexts = items.join(broadcast_if_small(pack_context_budget(t), known=t("benchmark").count()), "item_id", "left")
    status = F.when(F.col("item_id") % 11 == 5, "locked").when(F.coalesce("context", F.lit("")) == "", "error").otherwise("success")
    ready = contexts.select("item_id", status.alias("status"), plugins.prompt("answer", "v1")(F.col("question"), F.col("context")).alias("prompt"))
    answers = ready.filter("status = 'success'").select("item_id", plugins.generate(F.col("prompt")).alias("answer"))
    joined = ready.select("item_id", "status").join(answers, "item_id", "left")
    return joined.groupBy("status").agg(F.count("*").alias("tasks"), F.count("answer").alias("answered"), F.coalesce(F.sum(F.length("answer").cast("long")), F.lit(0)).alias("answer_chars"))
