"""Token queries: chunking, labels, truncation, budgets, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text, tokens
from tessera.operators import packing, variants
from tessera.operators.bounded import spread
from tessera.plans.base import query
from tessera.sources import longcontext

WORDS = "w AS (SELECT doc_id, lang, source, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents)"


def words(t):
    return spread(t("documents").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", text.words(F.col("text")).alias("w"))


def _joined(column):
    return F.md5(F.array_join(column, " "))


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, w, unnest(range(0, len(w), 128)) AS s FROM w) SELECT doc_id, (s // 128)::INT AS chunk, md5(array_to_string(list_slice(w, s + 1, s + 128), ' ')) AS digest, least(128, len(w) - s)::BIGINT AS n FROM c""")
def chunk_fixed(t):
    c = words(t).select("doc_id", F.posexplode(tokens.chunks(F.col("w"), 128)).alias("chunk", "part"))
    return c.select("doc_id", "chunk", _joined(F.col("part")).alias("digest"), F.size("part").cast("long").alias("n"))


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, lang, source, w, unnest(range(0, len(w), 126)) AS s FROM w) SELECT doc_id, (s // 126)::INT AS chunk, md5(lang || ' ' || source || ' ' || array_to_string(list_slice(w, s + 1, s + 126), ' ')) AS digest FROM c""")
def chunk_prefixed(t):
    c = words(t).select("doc_id", F.posexplode(tokens.prefixed_chunks(F.array("lang", "source"), F.col("w"), 128)).alias("chunk", "part"))
    return c.select("doc_id", "chunk", _joined(F.col("part")).alias("digest"))


@query(f"""WITH {WORDS} SELECT doc_id, list_append(list_slice(list_transform(w, lambda x: length(x)), 2, len(w)), -1) AS labels FROM w WHERE len(w) > 0""")
def shift_labels(t):
    ids = F.transform("w", lambda x: F.length(x))
    return words(t).filter(F.size("w") > 0).select("doc_id", tokens.next_token_labels(ids, F.lit(-1)).alias("labels"))


@query(f"""WITH {WORDS}, i AS (SELECT doc_id, list_transform(w, lambda x: length(x)) AS v, len(w) // 2 AS a FROM w WHERE len(w) > 0)
SELECT doc_id, list_append(list_slice(list_concat(list_transform(list_slice(v, 1, a), lambda x: -100), list_slice(v, a + 1, len(v))), 2, len(v)), 0) AS labels FROM i""")
def qa_labels(t):
    ids = F.transform("w", lambda x: F.length(x))
    return words(t).filter(F.size("w") > 0).select("doc_id", tokens.answer_labels(ids, F.expr("size(w) div 2"), F.lit(0)).alias("labels"))


@query(f"""WITH {WORDS}, i AS (SELECT doc_id, list_transform(w, lambda x: length(x)) AS v FROM w WHERE len(w) > 0), c AS (SELECT doc_id, CASE WHEN v[-1] = 3 THEN v ELSE list_append(v, 3) END AS v, coalesce(list_position(v, 5), 0) AS p FROM i)
SELECT doc_id, list_concat(list_transform(list_slice(v, 1, p), lambda x: -100), list_slice(v, p + 1, len(v))) AS labels FROM c""")
def fim_labels(t):
    ids = F.transform("w", lambda x: F.length(x))
    return words(t).filter(F.size("w") > 0).select("doc_id", ids.alias("ids")).select("doc_id", tokens.middle_labels(F.col("ids"), F.lit(5), F.lit(3)).alias("labels"))


@query(f"""WITH {WORDS} SELECT doc_id, md5(array_to_string(CASE WHEN len(w) > 100 THEN list_slice(w, len(w) - 99, len(w)) ELSE w END, ' ')) AS last, md5(array_to_string(list_slice(w, 1, 100), ' ')) AS first,
 md5(array_to_string(CASE WHEN len(w) > 200 THEN list_concat(list_slice(w, 1, 128), list_slice(w, len(w) - 71, len(w))) ELSE w END, ' ')) AS both FROM w""")
def truncate_head_tail(t):
    w = F.col("w")
    return words(t).select("doc_id", _joined(tokens.keep_last(w, 100)).alias("last"), _joined(tokens.keep_first(w, 100)).alias("first"), _joined(tokens.head_and_tail(w, 128, 200)).alias("both"))


@query("""WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS v FROM conversations GROUP BY 1), m AS (SELECT *, max(len(v)) OVER (PARTITION BY conv_id % 10) AS size FROM c)
SELECT conv_id, list_resize(v, size, 0) AS padded_right, list_concat(list_resize([]::BIGINT[], size - len(v), 0), v) AS padded_left FROM m""")
def batch_padding(t):
    """Padded to the longest of the batch (conv_id mod 10), right and left."""
    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n"))))["n"].alias("v"))
    batch = F.pmod("conv_id", F.lit(10))
    longest = c.groupBy(batch.alias("batch")).agg(F.max(F.size("v")).alias("size"))
    m = c.withColumn("batch", batch).join(F.broadcast(longest), "batch")  # ten rows
    zero = F.lit(0).cast("long")
    return m.select("conv_id", tokens.padded(F.col("v"), F.col("size"), zero).alias("padded_right"), tokens.padded(F.col("v"), F.col("size"), zero, left=True).alias("padded_left"))


@query("""SELECT doc_id, CASE WHEN sum(n_chars) OVER (PARTITION BY source) > 0 THEN floor(n_chars * 8000 / (sum(n_chars) OVER (PARTITION BY source))::DOUBLE)::BIGINT ELSE 0 END AS quota FROM documents""")
def proportional_budget(t):
    return packing.share_budget(t("documents").select("doc_id", "source", "n_chars"), "source", "n_chars", 8000).select("doc_id", F.col("quota").cast("long").alias("quota"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS place, floor(count(*) OVER (PARTITION BY source, lang) * 10 / (count(*) OVER (PARTITION BY source))::DOUBLE) AS quota FROM documents) SELECT doc_id, place::INT AS place FROM r WHERE place <= quota""")
def budget_by_document_count(t):
    return packing.share_by_count(t("documents").select("doc_id", "source", "lang"), "source", "lang", ["doc_id"], 10).select("doc_id", "place")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) ELSE length(text) // 4 END::BIGINT AS n FROM documents""")
def token_counts(t):
    """White-space count, and the fallback of a quarter of the characters."""
    n = F.when(F.col("doc_id") % 2 == 0, F.size(text.words(F.col("text")))).otherwise(F.expr("length(text) div 4"))
    return t("documents").select("doc_id", n.cast("long").alias("n"))


@query("""SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) <= 500""")
def skip_overlong(t):
    return t("documents").filter(F.size(text.words(F.col("text"))) <= 500).select("doc_id")


_PASSKEY = """k AS (SELECT doc_id, text || ' ' || s || ' ' || text AS context, s FROM (SELECT doc_id, text, 'The pass key is ' || (doc_id * 7919 % 100000) || '. Remember it. ' || (doc_id * 7919 % 100000) || ' is the pass key.' AS s FROM documents WHERE text IS NOT NULL)),
m AS (SELECT *, strpos(context, s) - 1 AS i, greatest(0, floor((2000 - len(list_filter(string_split_regex(context, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))) / 19))::INT AS n FROM k),
e AS (SELECT doc_id, substr(context, 1, i) || repeat('The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again. ', floor(i / length(context) * n)::INT) || s || ' '
  || repeat('The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again. ', n - floor(i / length(context) * n)::INT) || substr(context, i + length(s) + 2) AS extended FROM m)"""


@query(f"WITH {_PASSKEY} SELECT doc_id, length(extended) AS n_chars, md5(extended) AS digest FROM e")
def passkey_extension(t):
    """Texts with a pass key in their middle, extended by noise to about 2,000 words."""
    docs = spread(t("documents").select("doc_id", "text")).filter("text IS NOT NULL")
    key = (F.col("doc_id") * 7919 % 100000).cast("string")
    context = F.concat("text", F.lit(" "), longcontext.passkey_sentence(key), F.lit(" "), "text")
    found = docs.select("doc_id", longcontext.extended(context, key, 2000).alias("extended"))
    return found.select("doc_id", F.length("extended").alias("n_chars"), F.md5("extended").alias("digest"))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS kind, text, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE kind WHEN 0 THEN 'func_' || doc_id || '(-3)' WHEN 1 THEN substr('What is "' || repeat(doc_id::VARCHAR, 9), 7, 38) WHEN 2 THEN 'Who?' END AS asked, CASE kind WHEN 0 THEN 'func_' || doc_id END AS function,
CASE kind WHEN 2 THEN CASE WHEN w[1] IS NULL OR w[2] IS NULL THEN [w[1], NULL] WHEN w[1] = 'other' THEN [w[1], 'A'] ELSE [w[1], 'B'] END ELSE [w[1]] END AS labels, len(w)::INT AS length FROM d WHERE len(w) >= 3""")
def long_context_tasks(t):
    """Fields of long-context tasks of four data sets, with documents as contexts."""
    docs = spread(t("documents").select("doc_id", "text")).filter(F.size(text.words(F.col("text"))) >= 3)
    kind, first = (F.col("doc_id") % 4).cast("int"), F.element_at(text.words(F.col("text")), 1)
    dataset = F.element_at(F.array(*[F.lit(x) for x in ("code_run", "kv_retrieval", "longbook_choice_eng", "math_calc")]), kind + 1)
    number = F.col("doc_id").cast("string")
    question = F.when(kind == 0, F.concat(F.lit("What does func_"), number, F.lit("(-3) give?"))).when(kind == 1, F.concat(F.lit('What is "'), F.repeat(number, F.lit(9)))).otherwise("Who?")
    tasks = docs.select("doc_id", dataset.alias("dataset"), F.col("text").alias("context"), question.alias("question"), F.array(F.lit("other"), first).alias("options"), F.array(first).alias("answers"))
    return longcontext.shape(tasks).select("doc_id", "asked", "function", "labels", "length")


@query(f"""WITH RECURSIVE {WORDS}, s AS (SELECT source, doc_id, len(w)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY len(w), doc_id) AS place FROM w),
f AS (SELECT source, doc_id, n, place, n AS used, 0::BIGINT AS bin FROM s WHERE place = 1 UNION ALL
SELECT source, doc_id, n, place, CASE WHEN closed THEN n ELSE used + n END, bin + closed::BIGINT FROM (
  SELECT s.source, s.doc_id, s.n, s.place, f.used, f.bin, f.used > 0 AND f.used + s.n > 512 AS closed FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source AND s.place = f.place + 1))
SELECT source, doc_id, n, bin FROM f""")
def first_fit_pack(t):
    """Greedy packing of word counts into blocks of 512 for each source."""
    rows = t("documents").select("source", "doc_id", F.size(text.words(F.col("text"))).alias("n"))
    return packing.pack_first_fit(rows, "source", "doc_id", "n", 512)


@query("""WITH d AS (SELECT conv_id, turn, role, text, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, role, CASE WHEN len(w) > 12 THEN array_to_string(w[1:12], ' ') ELSE text END AS doc, false AS members FROM d""")
def truncate_json_document(t):
    """Documents rebuilt with their text cut to twelve tokens and their members dropped."""
    record = F.to_json(F.struct("role", F.col("text").alias("doc"), F.array("role").alias("members")))
    cut = variants.truncated(t("conversations").select("conv_id", "turn", record.alias("record")), ["conv_id", "turn"], "record", 12)
    return cut.select("conv_id", "turn", F.get_json_object("record", "$.role").alias("role"), F.get_json_object("record", "$.doc").alias("doc"), F.contains("record", F.lit('"members":')).alias("members"))
