"""Vector queries: exact search, means, surprisal, similarity matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as vf
from tessera.operators import vectors, windows
from tessera.plans.base import query

_TOP = """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.query_id, d.vec_id, {} AS score FROM q JOIN embeddings d ON q.query_id <> d.vec_id)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5"""


def _search(t, measure):
    e = t("embeddings").select("vec_id", "embedding")
    asked = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.top_k(asked, e, 5, measure).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(_TOP.format("list_dot_product(q.e::DOUBLE[], d.embedding::DOUBLE[])"))
def vector_topk_dot(t):
    """The stated queries (every fiftieth vector) against all rows."""
    return _search(t, "dot")


@query(_TOP.format("list_cosine_similarity(q.e::DOUBLE[], d.embedding::DOUBLE[])"))
def vector_topk_cosine(t):
    return _search(t, "cosine")


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), g AS (SELECT label, pos, round(avg(v), 6) AS v FROM x GROUP BY ALL) SELECT label, list(v ORDER BY pos) AS vector FROM g GROUP BY label""")
def uniform_vector_mean(t):
    return vectors.tensor_mean(t("embeddings").select("label", "embedding"), "label")


@query("""WITH x AS (SELECT label, 1.0 / (1 + vec_id % 3) AS w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), g AS (SELECT label, pos, round(sum(w::DOUBLE * v), 6) AS v FROM x GROUP BY ALL) SELECT label, list(v ORDER BY pos) AS vector FROM g GROUP BY label""")
def weighted_vector_sum(t):
    rows = t("embeddings").select("label", "embedding", (F.lit(1.0) / (1 + F.col("vec_id") % 3)).alias("w"))
    return vectors.tensor_mean(rows, "label", weight="w")


@query("""SELECT vec_id, round(ln(list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x)))) - embedding[(vec_id % 64 + 1)::INT]::DOUBLE, 9) AS surprisal FROM embeddings""")
def token_surprisal(t):
    label = (F.col("vec_id") % 64).cast("int")
    return t("embeddings").select("vec_id", F.round(vf.surprisal(F.col("embedding").cast("array<double>"), label), 9).alias("surprisal"))


@query("""SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 9) AS distance FROM embeddings""")
def cosine_distance(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", F.round(1 - vf.cosine(e, F.reverse(e)), 9).alias("distance"))


_MATRIX = """m AS (SELECT (user_id % 24)::BIGINT AS i, (event_id % 24)::BIGINT AS j, sum(value) AS w FROM events GROUP BY ALL),
a AS (SELECT x.i, x.j, (x.w + y.w) / 2 AS w FROM m x JOIN m y ON x.i = y.j AND x.j = y.i)"""


def matrix(t):
    m = t("events").groupBy((F.col("user_id") % 24).alias("i"), (F.col("event_id") % 24).alias("j")).agg(F.sum("value").alias("w"))
    back = m.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("w2"))
    return m.join(back, ["i", "j"]).select("i", "j", ((F.col("w") + F.col("w2")) / 2).alias("w"))


@query(f"""WITH {_MATRIX}, t AS (SELECT unnest(range(1, 24)) AS t), s AS (SELECT t, coalesce(sum(w) FILTER (i < t AND j < t), 0) AS a_in, coalesce(sum(w) FILTER (i >= t AND j >= t), 0) AS b_in, coalesce(sum(w) FILTER (i < t), 0) AS a_vol, coalesce(sum(w) FILTER (i >= t), 0) AS b_vol, coalesce(sum(w) FILTER (i < t AND j >= t), 0) AS cut,
 count(*) FILTER ((i < t) = (j < t)) AS n_intra, count(*) FILTER (i < t AND j >= t) AS n_cut, sum(w) AS total FROM a, t GROUP BY t)
SELECT t, round(((a_in - a_vol * a_vol / total) + (b_in - b_vol * b_vol / total)) / (2 * total), 9) AS modularity, round(least(cut / greatest(a_vol, 1e-15), cut / greatest(b_vol, 1e-15)), 9) AS conductance, round(((a_in + b_in) / nullif(n_intra, 0)) / nullif(cut / nullif(n_cut, 0), 0), 9) AS intra_inter FROM s""")
def split_scan(t):
    """Modularity, conductance and intra/inter similarity of every split."""
    m = vectors.split_measures(matrix(t), 24)
    return m.select("t", *[F.round(c, 9).alias(c) for c in ("modularity", "conductance", "intra_inter")])


@query()
def best_splits(t):
    m = vectors.split_measures(matrix(t), 24)
    found = [vectors.best_split(m, name).select(F.lit(name).alias("measure"), "t") for name in vectors.MEASURES]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH g AS (SELECT label, count(*) AS n, count(*) FILTER (vec_id % 5 = 0) AS c FROM embeddings GROUP BY 1) SELECT label, 'e' || label || '_' || n AS name, n::BIGINT AS n, c::BIGINT AS cached, n <> c AS stale FROM g""")
def embedding_cache_staleness(t):
    """A cache is used only if it has as many vectors as there are documents."""
    g = t("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % 5 == 0).alias("cached"))
    return g.select("label", F.concat(F.lit("e"), F.col("label").cast("string"), F.lit("_"), F.col("n").cast("string")).alias("name"), "n", "cached", (F.col("n") != F.col("cached")).alias("stale"))


@query("""SELECT lang, lang || '_' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS id, CASE WHEN trim(text) = '' THEN ' ' ELSE text END AS document FROM documents""")
def collection_rows(t):
    """Keyed rows of a collection: name_index; a blank document becomes one space."""
    placed = windows.ordinal(t("documents").select("doc_id", "lang", "text"), ["doc_id"], within=("lang",))
    return placed.select("lang", F.concat_ws("_", "lang", F.col("ordinal").cast("string")).alias("id"), F.when(F.trim("text") == "", " ").otherwise(F.col("text")).alias("document"))


@query("""SELECT md5(i.text || '|hash|all|5') AS key, i.item_id FROM benchmark i WHERE item_id % 3 <> 0""")
def query_cache_misses(t):
    """Cache keys from query, embedder, collection and n; those that aren't there yet."""
    key = F.md5(F.concat_ws("|", "text", F.lit("hash"), F.lit("all"), F.lit("5")))
    asked = t("benchmark").select("item_id", key.alias("key"))
    return asked.join(asked.filter("item_id % 3 = 0").select("key"), "key", "left_anti").select("key", "item_id")
