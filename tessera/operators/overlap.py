"""The best documents of very many items by token overlap, from an inverted index with bounds (rare tokens first, MaxScore's idea).

A document whose rarest token in common with an item is the item's j-th rarest shares at most nq - j + 1 of its nq tokens, which bounds
its similarity by its size: common / (nq + nd - common).  So once ``best`` documents of an item are known, the least of
their similarities says, for each of its tokens, up to which size a document found by that token first can still be
among the best; for frequent tokens these are few small documents.  Postings are keyed by token and size class (powers of two), and a class beyond
the limit isn't touched.

1. Postings (token, document, size) of the tokens that items hold, and how often each is there.
2. Seeds: for each token its SEEDS * best smallest documents.  Their exact similarities give each item's bar.
3. Tokens meet the classes within their limits; documents that are subsets of an item (their similarity has a bonus) are found by their
   own rarest token, as all tokens of theirs are the item's.
4. Candidates are scored exactly on whole token sets.

Nothing is collected; limits never drop a pair that can rank, whatever the order of equal similarities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import working, written

SEEDS, SLACK = 4, 1e-6


def _class(size: Column) -> Column:
    """The power of two that ``size`` (1 at least) lies in."""
    return F.floor(F.log2(size.cast("double"))).cast("int")


def similarity(common: Column, nq: Column, nd: Column) -> Column:
    """Jaccard, and 0.3 more (to 1 at most) where one set holds the other."""
    return F.least(F.lit(1.0), common / (nq + nd - common) + F.when(common == F.least(nq, nd), 0.3).otherwise(0.0))


def best_overlaps(asked: DataFrame, own: DataFrame, item: str, doc: str, best: int) -> DataFrame:
    """(item, doc, similarity) of all pairs that can be among the ``best`` of their item, from (item, q) and (doc, d), arrays of distinct tokens."""
    with working(asked.sparkSession) as keep:
        items = written(asked.filter(F.size("q") > 0).select(item, "q", F.size("q").alias("nq")))
        docs = written(own.filter(F.size("d") > 0).select(doc, "d", F.size("d").alias("nd")))
        wanted = items.select(F.explode("q").alias("token")).distinct()
        postings = written(docs.select(doc, "nd", _class(F.col("nd")).alias("class"), F.explode("d").alias("token")).join(wanted, "token", "left_semi"))
        often = written(postings.groupBy("token").agg(F.count("*").alias("n")))

        def scored(pairs: DataFrame) -> DataFrame:
            both = pairs.join(items, item).join(docs, doc)
            return both.select(item, doc, similarity(F.size(F.array_intersect("q", "d")), F.col("nq"), F.col("nd")).alias("similarity"))

        rarity = F.row_number().over(Window.partitionBy(item).orderBy("n", "token"))
        terms = written(items.select(item, "nq", F.explode("q").alias("token")).join(often, "token").select(item, "nq", "token", rarity.alias("j")))
        smallest = F.row_number().over(Window.partitionBy("token").orderBy("nd", doc))
        seeds = postings.withColumn("at", smallest).filter(F.col("at") <= SEEDS * best).select("token", doc)
        first = written(scored(terms.join(seeds, "token").select(item, doc).distinct()))
        ranked = first.withColumn("at", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("similarity")))).filter(F.col("at") <= best)
        bar = ranked.groupBy(item).agg(F.count("*").alias("held"), F.min("similarity").alias("bar")).filter(F.col("held") == best).select(item, (F.col("bar") - SLACK).alias("bar"))

        # an item's rarest token in the index stands for all before it: those that are in no document cost nothing
        most = F.col("nq") - F.col("j") + 1
        # without a bonus: most / (nq + nd - most) >= bar; the rarest token's documents may hold the whole item
        room = F.when(F.col("j") == 1, F.greatest(F.lit(1e-9), F.col("bar") - 0.3)).otherwise(F.col("bar"))
        limit = F.when(F.col("bar").isNull() | (room <= 0), F.lit(2**40)).otherwise(F.least(F.lit(2.0**40), F.floor(most / room - F.col("nq") + most))).cast("long")
        limited = terms.join(bar, item, "left").select(item, "token", limit.alias("limit")).filter("limit > 0")
        classes = limited.withColumn("class", F.explode(F.sequence(F.lit(0), F.least(F.lit(31), _class(F.col("limit"))))))
        sizes = postings.groupBy("token", "class").agg(F.count("*").alias("n"))
        found = classes.join(sizes.select("token", "class"), ["token", "class"]).join(postings, ["token", "class"]).filter(F.col("nd") <= F.col("limit")).select(item, doc)

        told = postings.join(often, "token").groupBy(doc, "nd").agg(F.count("*").alias("known"), F.min(F.struct("n", "token")).alias("rarest")).filter(F.col("known") == F.col("nd"))
        inside = told.select(doc, F.col("rarest.token").alias("token")).join(terms.select(item, "token"), "token").select(item, doc)
        candidates = found.unionByName(inside).distinct()
        done = written(scored(candidates).filter("similarity > 0"))
        keep.append(done)
    return done
