"""Further queries: segment refinement, template post-processing, file-name metadata, nested records, configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import pyfuncs, records
from tessera.operators import joins, refine, variants
from tessera.plans.base import query


@query()
def refine_boundaries(t):
    """Boundaries of each sequence moved to the best nearby split of its similarity matrix."""
    rows = t("events").select("user_id", "event_id", "value", (F.col("value") > 100).alias("boundary"))
    return refine.refine_sequences(rows, "user_id", "event_id", "value", "boundary", least=3, measure="modularity")


@query("""WITH c AS (SELECT event_id, event_type AS truth, list_filter(['view', 'click', 'error', 'view or', 'clic'], lambda x: contains(event_type || ' or else', x)) AS m FROM events),
k AS (SELECT event_id, truth, list_filter(m, lambda x: NOT (contains(truth, x) AND x <> truth)) AS m FROM c)
SELECT event_id, CASE WHEN list_contains(m, truth) THEN 1.0::DOUBLE / len(m) ELSE 0.0 END AS score FROM k""")
def class_match(t):
    """Share of the truth among the classes that a prediction names, classes inside the truth's name aside."""
    classes = F.array(*[F.lit(x) for x in ("view", "click", "error", "view or", "clic")])
    return t("events").select("event_id", records.class_score(F.concat("event_type", F.lit(" or else")), F.col("event_type"), classes).alias("score"))


@query("""SELECT conv_id, turn, split_part(text, '.', 1) AS answer FROM conversations WHERE role = 'assistant'""")
def template_postprocess(t):
    """What stands before the template's end marker (here the full stop)."""
    return t("conversations").filter("role = 'assistant'").select("conv_id", "turn", records.before_marker(F.col("text"), ".").alias("answer"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'vace' ELSE 'vscc' END AS kind, CASE WHEN page_id % 3 = 0 THEN 'srccodes' ELSE 'docstring' END AS doc_kind, page_id % 5 = 0 AS banned FROM pages""")
def filename_metadata(t):
    name = F.concat(F.lit("/x/tasks_"), F.when(F.col("page_id") % 2 == 0, "vace").otherwise("vscc"), F.when(F.col("page_id") % 5 == 0, "_BD").otherwise(""), F.when(F.col("page_id") % 3 == 0, "_srccodes").otherwise("_docstring"), F.lit(".json"))
    found = records.file_metadata(name)
    return t("pages").select("page_id", *[found[c].alias(c) for c in ("kind", "doc_kind", "banned")])


@query("""SELECT user_id, list(event_id ORDER BY event_type, event_id) AS ids FROM events GROUP BY 1""")
def flatten_nested(t):
    by_type = t("events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    nested = by_type.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "ids")))["ids"].alias("lists"))
    return nested.select("user_id", F.flatten("lists").alias("ids"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[.!?](\\s|$)'))::BIGINT AS sentences FROM documents""")
def sentence_boundaries(t):
    return t("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[.!?](\s|$)"), F.lit(0))).cast("long").alias("sentences"))


@query("""SELECT user_id, list(event_type || '=' || n ORDER BY event_type) AS kept FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY ALL) GROUP BY 1""")
def config_keys_stripped(t):
    n = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    config = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("config"))
    kept = records.without_keys(F.col("config"), ("error", "signup"))
    return config.select("user_id", F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("kept")).filter(F.size("kept") > 0)


@query("""SELECT p_partkey, 'base/' || lower(p_type) || '/qv_0_' || p_size || '/r' || (p_partkey % 8) AS path FROM part""")
def artifact_paths(t):
    return t("part").select("p_partkey", records.artifact_path("base", F.lower("p_type"), F.array(F.lit("q_proj"), F.lit("v_proj")), F.lit(0), F.col("p_size"), F.col("p_partkey") % 8).alias("path"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND NOT (user_id % 7 = 0) THEN true ELSE false END AS has_error, CASE WHEN user_id % 7 = 0 THEN 'skipped for this python' ELSE 'kept' END AS message FROM events""")
def override_by_python(t):
    skip = F.col("user_id") % 7 == 0
    return t("events").select("event_id", ((F.col("event_type") == "error") & ~skip).alias("has_error"), F.when(skip, "skipped for this python").otherwise("kept").alias("message"))


@query("""SELECT doc_id, lang AS pkg, source AS version, text AS doc FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL""")
def valid_corpus_records(t):
    return records.valid_corpus(t("documents"), ["lang", "source", "text"]).select("doc_id", F.col("lang").alias("pkg"), F.col("source").alias("version"), F.col("text").alias("doc"))


@query("""SELECT conv_id, 'You are a coding assistant.' AS instruction, 'q ' || conv_id AS input, text AS output FROM conversations WHERE role = 'assistant'""")
def fine_tune_records(t):
    """One record for each prediction of a task."""
    gathered = t("conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.collect_list("text").alias("model_output"))
    return gathered.select("conv_id", F.lit("You are a coding assistant.").alias("instruction"), F.concat(F.lit("q "), F.col("conv_id").cast("string")).alias("input"), F.explode("model_output").alias("output"))


@query()
def best_api_match(t):
    """The most similar candidate of the same package by sequence ratio; ties to the first, no similarity no match.

    Each different name of a package is compared once, however many parts have it.
    """
    part = t("part").select("p_partkey", "p_brand", F.coalesce("p_name", F.lit("")).alias("p_name"))
    candidates = t("part").select("p_brand", F.lower("p_type").alias("candidate")).distinct()
    pairs = part.select("p_brand", "p_name").distinct().join(candidates, "p_brand")
    named = joins.best_match(pairs, ["p_brand", "p_name"], pyfuncs.ratio("p_name", "candidate"), ["candidate"])
    found = part.join(named, ["p_brand", "p_name"])
    return joins.best_match(found, ["p_partkey"], F.col("score"), ["candidate"]).select("p_partkey", "candidate", F.round("score", 6).alias("score"))


@query("""SELECT conv_id, (3 + sum(CASE WHEN role IS NULL THEN 0 ELSE 1 + len(list_filter(string_split_regex(role, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) END
  + CASE WHEN text IS NULL THEN 0 ELSE 1 + len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) END))::BIGINT AS tokens FROM conversations GROUP BY 1""")
def nested_token_count(t):
    """White-space tokens over all keys and leaves of a nested record: a conversation with its list of turns."""
    record = F.to_json(F.struct(F.col("conv_id").alias("id"), "turns"))
    whole = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("turns"))
    return variants.nested_tokens(whole.select("conv_id", record.alias("record")), ["conv_id"], "record")


@query("""SELECT conv_id, list(text ORDER BY turn) AS values FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def flatten_deep(t):
    """Texts of a conversation out of nested lists, each turn one level deeper than the one before."""
    turn = F.concat(F.repeat(F.lit("["), F.col("turn").cast("int") % 7), F.to_json(F.array("text")), F.repeat(F.lit("]"), F.col("turn").cast("int") % 7))
    turns = t("conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("nested")))).alias("all"))
    lists = turns.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["nested"]), ","), F.lit("]")).alias("nested"))
    return variants.flattened(lists, ["conv_id"], "nested")


@query("""SELECT event_id, trim(split_part(e, ':', 1), ' "') AS key, trim(split_part(e, ':', 2), ' "') AS value FROM (SELECT event_id, unnest(string_split(trim(props, '{}'), ',')) AS e FROM events WHERE props IS NOT NULL)""")
def variant_entries(t):
    """Members of the events' properties, one a row."""
    return variants.nodes(t("events").select("event_id", "props"), ["event_id"], "props").filter("leaf").select("event_id", "key", "value")


@query("""SELECT l.quality::VARCHAR AS file, round(100 * avg(d.n_chars), 2) AS score, count(*)::BIGINT AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1""")
def score_per_file(t):
    """A result table by result file."""
    rows = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy(F.col("quality").cast("string").alias("file")).agg(F.round(100 * F.avg("n_chars"), 2).alias("score"), F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name WHEN p_size < 30 THEN p_brand ELSE split_part(p_type, ' ', 1) END AS chosen FROM part""")
def prediction_field(t):
    """pred, else answer, else the first of the model's outputs."""
    rows = t("part").select("p_partkey", F.when(F.col("p_size") < 10, F.col("p_name")).alias("pred"), F.when(F.col("p_size") < 30, F.col("p_brand")).alias("answer"), F.split("p_type", " ").alias("model_output"))
    return rows.select("p_partkey", records.prediction(F.col("pred"), F.col("answer"), F.col("model_output")).alias("chosen"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'success' ELSE 'failed' END AS status FROM labels) SELECT doc_id FROM s WHERE status = 'success' OR NOT EXISTS (SELECT 1 FROM s WHERE status = 'success')""")
def successes_or_all(t):
    """Successful rows; all of them where none succeeded."""
    labels = t("labels")
    good = labels.filter("quality = 1")
    return (good if not good.isEmpty() else labels).select("doc_id")


@query("""SELECT p_partkey, len(list_filter([p_name, p_brand, p_type], lambda x: x IS NOT NULL))::BIGINT AS keys FROM part WHERE p_size > 1""")
def records_with_content(t):
    """Records of more than one key."""
    fields = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    rows = t("part").filter("p_size > 1").select("p_partkey", F.size(F.map_filter(fields, lambda k, v: v.isNotNull())).cast("long").alias("keys"))
    return rows.filter("keys > 1")
