"""Window-like queries: thresholds, segments, budgets, shards.  Events stand for token surprisals (user_id = sequence)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import documents, windows
from tessera.operators.bounded import broadcast_if_small
from tessera.plans.base import query
from tessera.streaming import memory

POS = "p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)"


def positions(t):
    return t("events").withColumn("pos", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))


@query("""WITH b AS (SELECT event_id, coalesce(value > 1.0 * stddev_samp(value) OVER w + avg(value) OVER w, false) AS boundary FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)) SELECT event_id, boundary FROM b""")
def surprise_boundaries(t):
    return windows.adaptive_threshold(t("events"), "user_id", "event_id", "value", 16, 1.0).select("event_id", "boundary")


@query(f"""WITH {POS}, c AS (SELECT *, pos // 8 AS chunk FROM p), l AS (SELECT a.user_id, a.chunk, CASE WHEN count(b.value) > 1 THEN 1.0 * stddev_samp(b.value) + avg(b.value) END AS lim
  FROM (SELECT DISTINCT user_id, chunk FROM c) a LEFT JOIN c b ON a.user_id = b.user_id AND b.chunk < a.chunk AND b.chunk >= a.chunk - 4 GROUP BY ALL)
SELECT event_id, coalesce(value > lim, false) AS boundary FROM c JOIN l ON c.user_id = l.user_id AND c.chunk = l.chunk""")
def chunk_boundaries(t):
    """One threshold a chunk of 8 positions, from the 32 before it."""
    return windows.chunk_threshold(positions(t), "user_id", "pos", "value", 8, 32, 1.0).select("event_id", "boundary")


@query("""SELECT event_id, sum((value > 100)::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS segment FROM events""")
def segments_from_boundaries(t):
    return windows.islands(t("events").withColumn("boundary", F.col("value") > 100), "user_id", "event_id").select("event_id", "segment")


@query(f"""WITH RECURSIVE {POS}, f AS (SELECT user_id, pos, 1 AS run, 0 AS segment FROM p WHERE pos = 0 UNION ALL
SELECT user_id, pos, CASE WHEN cut THEN 1 ELSE run + 1 END, segment + cut::INT FROM (
  SELECT p.user_id, p.pos, f.run, f.segment, (p.value > 60 AND f.run >= 4) OR f.run >= 16 AS cut FROM f JOIN p ON p.user_id = f.user_id AND p.pos = f.pos + 1))
SELECT user_id, min(pos)::INT AS begin, count(*)::INT AS length FROM f GROUP BY user_id, segment""")
def bounded_segments(t):
    """Segments of 4 to 16 positions."""
    return windows.bounded_segments(t("events").withColumn("boundary", F.col("value") > 60), "user_id", "event_id", 4, 16)


@query(f"""WITH {POS} SELECT user_id, pos // 16 AS block, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM p GROUP BY ALL""")
def uniform_blocks(t):
    return positions(t).groupBy("user_id", F.expr("pos div 16").alias("block")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"""WITH {POS}, r AS (SELECT *, pos // 16 AS block, row_number() OVER (PARTITION BY user_id, pos // 16 ORDER BY value DESC, event_id) AS rank FROM p)
SELECT user_id, block, list(event_id ORDER BY rank) AS representatives, round(avg(value), 9) AS mean FROM r WHERE rank <= 4 GROUP BY ALL""")
def block_representatives(t):
    """The four strongest positions of each block, and their mean."""
    blocks = positions(t).withColumn("block", F.expr("pos div 16"))
    rank = F.row_number().over(Window.partitionBy("user_id", "block").orderBy(F.desc("value"), "event_id"))
    top = blocks.withColumn("rank", rank).filter("rank <= 4")
    return top.groupBy("user_id", "block").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id")))["event_id"].alias("representatives"), F.round(F.avg("value"), 9).alias("mean"))


@query("""WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS upto FROM documents)
SELECT source, doc_id, n_chars FROM r WHERE upto <= 20000 OR (upto - n_chars < 20000 AND abs(20000 - upto) < abs(20000 - (upto - n_chars)))""")
def budgeted_blocks(t):
    docs = t("documents").select("source", "doc_id", "n_chars")
    return windows.within_budget(docs, "source", [F.desc("n_chars"), "doc_id"], "n_chars", 20000).select("source", "doc_id", "n_chars")


@query("""WITH r AS (SELECT user_id, event_id, value, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) SELECT user_id, event_id FROM r WHERE round(b, 6) < 300""")
def lru_evict(t):
    evicted = windows.evict_least_recent(t("events").select("user_id", "event_id", "ts", F.col("value").cast("decimal(18,6)").alias("value")), "user_id", ["ts", "event_id"], "value", 300)
    return evicted.select("user_id", "event_id")


@query("""WITH b AS (SELECT label AS g, vec_id AS block, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings), sel AS (SELECT * FROM b WHERE rank <= 5), n AS (SELECT count(*) AS n FROM embeddings),
near AS (SELECT g, rank, 0 AS side, block + 1 AS neighbour FROM sel UNION ALL SELECT g, rank, 1, block - 1 FROM sel),
f AS (SELECT g, neighbour, min((rank, side)) AS first_at FROM near, n WHERE neighbour >= 0 AND neighbour < n.n AND NOT EXISTS (SELECT 1 FROM sel s WHERE s.g = near.g AND s.block = near.neighbour) GROUP BY ALL)
SELECT g, neighbour, place FROM (SELECT g, neighbour, row_number() OVER (PARTITION BY g ORDER BY first_at)::INT AS place FROM f) WHERE place <= 4""")
def neighbour_buffer(t):
    e = t("embeddings")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.element_at("embedding", 1)), "vec_id"))
    selected = e.select(F.col("label").alias("g"), F.col("vec_id").alias("block"), rank.alias("rank")).filter("rank <= 5").withColumn("n_blocks", F.lit(e.count()))
    return windows.neighbours(selected, "g", "block", "rank", "n_blocks", 4)


@query("""WITH a AS (SELECT user_id, event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, round(m, 6) AS mean FROM a WHERE n = 10""")
def moving_average(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)
    rows = t("events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.count("*").over(w).alias("n"))
    return rows.filter("n = 10").drop("n")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def first_wins_argmax(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("""WITH c AS (SELECT user_id, event_type || '-epoch' || (event_id % 7) AS name, event_id % 7 AS epoch, event_id FROM events)
SELECT user_id, name FROM (SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY (epoch = 4) DESC, epoch DESC, event_id) AS r FROM c) WHERE r = 1""")
def best_checkpoint(t):
    """A checkpoint of epoch 4 if there is one, else of the highest epoch, the first of equals."""
    c = t("events").select("user_id", "event_id", F.concat("event_type", F.lit("-epoch"), F.col("event_id") % 7).alias("name"))
    epoch = F.regexp_extract("name", r"epoch([0-9]+)", 1).cast("int")
    return c.groupBy("user_id").agg(F.max_by("name", F.struct((epoch == 4).alias("a"), epoch.alias("b"), (-F.col("event_id")).alias("c"))).alias("name"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS ordinal, ((row_number() OVER (ORDER BY doc_id) - 1) % 4)::INT AS rank FROM documents")
def shard_interleaved(t):
    return windows.ordinal(t("documents").select("doc_id"), ["doc_id"]).withColumn("rank", F.pmod("ordinal", F.lit(4)).cast("int"))


@query("SELECT doc_id, (ntile(7) OVER (ORDER BY doc_id) - 1)::INT AS rank FROM documents")
def shard_contiguous(t):
    docs = t("documents").select("doc_id")
    return windows.ordinal(docs, ["doc_id"]).select("doc_id", windows.contiguous_shard(F.col("ordinal"), docs.count(), 7).alias("rank"))


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, (i // (n // 7))::INT AS fold FROM o WHERE i // (n // 7) < 7""")
def shard_kfold(t):
    docs = t("documents").select("doc_id")
    size = max(1, docs.count() // 7)
    return windows.ordinal(docs, ["doc_id"]).select("doc_id", F.expr(f"ordinal div {size}").cast("int").alias("fold")).filter("fold < 7")


_SHUFFLED = "SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id || ':42'), 1, 13))::BIGINT, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents"


@query(f"""WITH s AS ({_SHUFFLED}), p AS (SELECT doc_id, place FROM s UNION ALL SELECT doc_id, place + n FROM s WHERE place < (7 - n % 7) % 7)
SELECT doc_id, place::BIGINT AS place, (place % 7)::INT AS rank FROM p""")
def shard_shuffled(t):
    """Seeded shuffle, then strides of seven ranks; the first rows pad the last round."""
    return windows.shuffled_stride(t("documents").select("doc_id"), "doc_id", 42, 7)


@query(f"SELECT doc_id, place::BIGINT AS place, (place % 7)::INT AS rank FROM ({_SHUFFLED}) WHERE place < n // 7 * 7")
def shard_shuffled_whole(t):
    """The same without the rows that don't fill a round."""
    return windows.shuffled_stride(t("documents").select("doc_id"), "doc_id", 42, 7, drop_last=True)


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) WHERE r <= floor(n * 0.3)""")
def prefix_sample(t):
    """The first 30 % of each (pkg, version), a sampling operator."""
    docs = t("documents").select("doc_id", "lang", "source")
    sizes = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    placed = windows.ordinal(docs, ["doc_id"], within=("lang", "source")).join(broadcast_if_small(sizes), ["lang", "source"])
    return placed.filter("ordinal < floor(n * 0.3)").select("doc_id", "lang")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE lang NOT IN ('de', 'es')) WHERE r <= 3""")
def exclude_and_take(t):
    """Excluded packages go, then the first three of each source (top-k)."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return t("documents").filter(~F.col("lang").isin("de", "es")).select("doc_id", "source", rank.alias("r")).filter("r <= 3").drop("r")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 100 AND i < 300""")
def slice_by_ordinal(t):
    """The half-open slice [100, 300) of the order."""
    return windows.ordinal(t("documents").select("doc_id"), ["doc_id"]).filter("ordinal >= 100 AND ordinal < 300").select("doc_id")


@query("""SELECT text, lang, min(doc_id) AS doc_id FROM documents GROUP BY text, lang""")
def first_wins_dedup(t):
    return t("documents").groupBy("text", "lang").agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT event_type, user_id % 7 AS kind, min(event_id) AS event_id, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def canonical_json_dedup(t):
    """Objects that differ in the order of their keys only are one, the first of them."""
    kind = (F.col("user_id") % 7).alias("kind")
    one, other = F.to_json(F.struct("event_type", kind)), F.concat(F.lit("{ "), F.substring(F.to_json(F.struct(kind, "event_type")), 2, 1 << 20))
    rows = t("events").select("event_id", F.when(F.col("event_id") % 2 == 0, one).otherwise(other).alias("json"))
    first = rows.groupBy(documents.canonical(F.col("json")).alias("json")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))
    return first.select(F.get_json_object("json", "$.event_type").alias("event_type"), F.get_json_object("json", "$.kind").cast("long").alias("kind"), "event_id", "n")


@query("""SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id""")
def last_wins_dedup(t):
    return t("conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("""WITH q AS (SELECT conv_id, turn, trim(text) AS q, role AS api FROM conversations WHERE trim(text) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY q, api ORDER BY conv_id, turn) AS n FROM q) SELECT conv_id || '_' || turn AS id, q AS query, api FROM r WHERE n = 1""")
def query_dedup(t):
    """Global dedup by (query, target); blank queries go and the first one wins."""
    q = t("conversations").select("conv_id", "turn", F.trim("text").alias("query"), F.col("role").alias("api")).filter("query <> ''")
    first = q.groupBy("query", "api").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    return first.select(F.concat_ws("_", "at.conv_id", "at.turn").alias("id"), "query", "api")


@query("""SELECT conv_id, turn FROM conversations WHERE turn >= 3 AND NOT contains(lower(text), 'the')""")
def item_dedup_quirk(t):
    """The first three of each item go, and any that mention a word."""
    return t("conversations").filter("turn >= 3").filter(~F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn")


@query("""SELECT event_id, 'error_' || CASE WHEN row_number() OVER (ORDER BY event_id) > 9999 THEN (row_number() OVER (ORDER BY event_id))::VARCHAR ELSE lpad((row_number() OVER (ORDER BY event_id))::VARCHAR, 4, '0') END AS error_id FROM events WHERE event_type = 'error'""")
def sequential_error_ids(t):
    """error_0001 ... in traversal order; numbers of five digits keep them all."""
    rows = windows.ordinal(t("events").filter("event_type = 'error'").select("event_id"), ["event_id"])
    number = (F.col("ordinal") + 1).cast("string")
    return rows.select("event_id", F.concat(F.lit("error_"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("error_id"))


@query()
def memory_steps(t):
    """Each label's vectors as blocks in the order of vec_id, eight a step; the last one of a step asks."""
    e = t("embeddings").filter("label IS NOT NULL").select(F.col("label").cast("long").alias("seq"), "vec_id", F.col("embedding").cast("array<double>").alias("rep"))
    placed = windows.ordinal(e, ["vec_id"], within=("seq",)).withColumn("step", F.expr("ordinal div 8"))
    block = F.struct("vec_id", F.expr("CAST(40 + vec_id * 7 % 60 AS INT)").alias("size"), "rep")
    steps = placed.groupBy("seq", "step").agg(F.array_sort(F.collect_list(block)).alias("all"))
    given = steps.select("seq", "step", F.transform("all", lambda b: b.dropFields("vec_id")).alias("blocks"), F.element_at("all", -1)["rep"].alias("query"))
    return memory.remember(given, memory.Budget(cap=600, buffer=250, cache=1500))
