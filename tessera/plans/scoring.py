"""Scoring queries: pass rates, matches, F1, and the functions that need Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import metrics, pyfuncs, text, vectors
from tessera.operators import plugins, segmentation
from tessera.operators.bounded import broadcast_if_small, spread
from tessera.plans.base import query


@query("""WITH g AS (SELECT d.source, count(*) AS n, sum(l.quality) AS c FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1), p AS (SELECT source, n, c, k, CASE WHEN n - c < k THEN 1.0::DOUBLE ELSE 1 - (SELECT product((g.n - g.c - i)::DOUBLE / (g.n - i)) FROM range(0, k) AS r(i)) END AS pass FROM g, (VALUES (1), (3), (5)) AS v(k))
SELECT source, k, round(pass, 9) AS pass FROM p""")
def pass_at_k(t):
    """Unbiased pass@k of each group."""
    g = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("c"))
    parts = [g.select("source", F.lit(k).alias("k"), F.round(vectors.pass_at_k(F.col("n"), F.col("c"), k), 9).alias("pass")) for k in (1, 3, 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH f AS (SELECT d.source, list(l.quality = 1 ORDER BY l.doc_id) AS v FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1), p AS (SELECT coalesce(list_position(v, true), 0) AS p FROM f)
SELECT count(*)::BIGINT AS n, count(*) FILTER (p = 1) / count(*)::DOUBLE AS pass1, count(*) FILTER (p BETWEEN 1 AND 3) / count(*)::DOUBLE AS pass3, count(*) FILTER (p > 0) / count(*)::DOUBLE AS any FROM p""")
def cumulative_pass(t):
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    f = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", (F.col("quality") == 1).alias("ok"))))["ok"].alias("v")).select(F.array_position("v", True).alias("p"))
    return f.agg(F.count("*").alias("n"), (F.count_if(F.col("p") == 1) / F.count("*")).alias("pass1"), (F.count_if(F.col("p").between(1, 3)) / F.count("*")).alias("pass3"), (F.count_if(F.col("p") > 0) / F.count("*")).alias("any"))


@query("""SELECT avg((quality = 1)::INT) AS pass1, avg((quality = 1 OR toxic = 1)::INT) AS pass3 FROM labels""")
def pass_overall(t):
    """pass@3 holds whenever pass@1 does."""
    return t("labels").agg(F.avg((F.col("quality") == 1).cast("int")).alias("pass1"), F.avg(((F.col("quality") == 1) | (F.col("toxic") == 1)).cast("int")).alias("pass3"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(CASE WHEN n - i >= 2 THEN value * ((n - i) * (n - i - 1) / 2.0::DOUBLE) / (n * (n - 1) * (n - 2) / 6.0::DOUBLE) ELSE 0 END), 6) AS best FROM r WHERE n >= 3 GROUP BY 1""")
def best_of_k(t):
    """Expected best of three."""
    g = t("events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return g.filter(F.size("v") >= 3).select("user_id", F.round(vectors.best_of_k(F.col("v"), 3), 6).alias("best"))


@query("""WITH r AS (SELECT p_brand, p_type AS prediction, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN split_part(p_type, ' ', 2) WHEN 2 THEN '' ELSE p_name END AS truth FROM part)
SELECT p_brand, count(*) FILTER (trim(prediction) = trim(truth)) AS exact, count(*) FILTER (truth <> '' AND contains(prediction, truth)) AS partial, count(*) AS n FROM r GROUP BY 1""")
def exact_and_partial(t):
    """Predictions that are the truth, and those that contain it where it isn't empty, by brand."""
    truth = F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).when(F.col("p_partkey") % 4 == 1, F.coalesce(F.try_element_at(F.split("p_type", " "), F.lit(2)), F.lit(""))).when(F.col("p_partkey") % 4 == 2, "").otherwise(F.col("p_name"))
    rows = t("part").select("p_brand", F.col("p_type").alias("prediction"), truth.alias("truth"))
    exact, partial = F.trim("prediction") == F.trim("truth"), (F.col("truth") != "") & F.contains("prediction", "truth")
    return rows.groupBy("p_brand").agg(F.count_if(exact).alias("exact"), F.count_if(partial).alias("partial"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT item_id, list_filter(string_split_regex(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS w FROM benchmark),
x AS (SELECT item_id, w, count(*) AS c FROM (SELECT item_id, unnest(w) AS w FROM n) GROUP BY ALL), common AS (SELECT a.item_id AS a, b.item_id AS b, sum(least(a.c, b.c)) AS m FROM x a JOIN x b ON a.w = b.w AND a.item_id < b.item_id GROUP BY ALL)
SELECT a, b, round(2 * m / (len(p.w) + len(q.w))::DOUBLE, 9) AS f1 FROM common JOIN n p ON p.item_id = a JOIN n q ON q.item_id = b""")
def token_f1(t):
    """F1 of token multisets of pairs of items that share a token: equi-join on the token, least counts summed."""
    n = t("benchmark").select("item_id", F.split(text.normalize_answer(F.col("text")), " ").alias("w"))
    x = n.select("item_id", F.size("w").alias("n"), F.explode("w").alias("w")).groupBy("item_id", "n", "w").agg(F.count("*").alias("c"))
    a = x.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "w", F.col("c").alias("ca"))
    b = x.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "w", F.col("c").alias("cb"))
    m = a.join(broadcast_if_small(b), "w").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.sum(F.least("ca", "cb")).alias("m"))
    return m.select("a", "b", F.round(2 * F.col("m") / (F.col("na") + F.col("nb")), 9).alias("f1"))


def _pairs(t):
    c = t("conversations")
    a = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("u"), F.col("text").alias("a"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("u"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "u"])


def _code(t):
    """Code around each event: a valid form, one with an f-string, and a broken one."""
    kind = (F.col("event_id") % 3).cast("int")
    code = F.when(kind == 0, F.concat(F.lit("import numpy as np\nfrom os import path\ndef f(x: int) -> int:\n    return np."), "event_type", F.lit("(x)\n"))).when(kind == 1, F.concat(F.lit("y = f'{x}'\nz: int = "), F.col("user_id").cast("string"))).otherwise("def broken(:")
    return spread(t("events").select("event_id", "event_type", code.alias("code")))


@query()
def ratio_match(t):
    return _pairs(t).select("conv_id", "u", F.round(pyfuncs.ratio("a", "b"), 6).alias("ratio"))


@query()
def rouge_l(t):
    return _pairs(t).select("conv_id", "u", F.round(pyfuncs.rouge("b", "a"), 6).alias("rouge"))


@query()
def segmented_scores(t):
    """Replies against questions, both without spaces, cut into words again by a lexicon of the documents."""
    whole = spread(_pairs(t)).select("conv_id", "u", *[F.regexp_replace(c, r"\s+", "").alias(c) for c in ("a", "b")])
    pairs = segmentation.segmented(whole, ["a", "b"], segmentation.lexicon(t("documents"), "text"))
    rouge = pyfuncs.rouge(F.array_join("b", " "), F.array_join("a", " "))
    return pairs.select("conv_id", "u", F.round(metrics.multiset_f1(F.col("b"), F.col("a")), 6).alias("f1"), F.round(rouge, 6).alias("rouge"))


@query()
def fuzzy_first_line(t):
    return _pairs(t).select("conv_id", "u", pyfuncs.fuzzy("b", "a").alias("score"))


@query()
def ast_imports(t):
    return _code(t).select("event_id", pyfuncs.imports("code").alias("imports"), pyfuncs.resolved("code", F.concat(F.lit("np."), "event_type")).alias("api"))


@query()
def code_checks(t):
    return _code(t).select("event_id", pyfuncs.fstring("code").alias("fstring"), pyfuncs.valid("code").alias("valid"), pyfuncs.names("code").alias("names"), pyfuncs.bare("code").alias("bare"))


@query()
def prefix_scores(t):
    rows = _code(t).withColumn("truth", F.concat(F.lit("return np."), "event_type"))
    return rows.select("event_id", F.round(pyfuncs.ism("code", "truth"), 6).alias("ism"), F.round(pyfuncs.pm("code", "truth"), 6).alias("pm"))


@query()
def json_repair(t):
    """Responses cut off at different places, fenced or with trailing commas."""
    item = F.concat(F.lit('{"path": "a.'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    raw = F.element_at(
        F.array(F.concat(F.lit("```json\n["), item, F.lit(", "), item, F.lit("]\n```")), F.concat(F.lit("["), item, F.lit(', {"path": "cu')), F.concat(F.lit("["), item, F.lit(",]")), F.concat(F.lit("["), item, F.lit(","))),
        F.col("event_id").cast("int") % 4 + 1,
    )
    return spread(t("events").select("event_id", raw.alias("raw"))).select("event_id", pyfuncs.queries_of("raw").alias("queries"))


@query()
def embedding_plugin(t):
    return t("benchmark").select("item_id", plugins.embed(F.col("text")).alias("embedding"))


@query()
def repair_loop(t):
    """Check, fix and check again, three rounds at most; only failing rows are touched."""
    return plugins.repair_rounds(_code(t).drop("event_type"), "code", 3, lambda code, errors: F.replace(code, F.lit("def broken(:"), F.lit("def mended(): pass"))).select("event_id", "code", F.size("errors").alias("n_errors"), "rounds")
