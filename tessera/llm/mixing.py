"""Mixing sources to target weights by Poisson replication (operator 5).

A source's rate is budget * weight / its bytes: how often each of its documents should appear on average.  A document's number of
copies is a Poisson variable of that mean, got by inverting the distribution at a uniform number hashed from doc_id, the text
and the seed, so it depends on nothing else and can be made again.  Copies are exploded and shuffled globally: their
place follows from the hash ``mix_key`` of (doc_id, text, seed, copy), by which partitions are dealt and sorted inside.

Rates above MAX_RATE are drawn as a sum of several equal draws (Poisson variables add up), so no rate is too large.
Source sizes come from partial sums; the table of rates has a row per source and is broadcast only if it has no more than
BROADCAST_SOURCES rows, else it is joined by source and a salt, so a source that holds a third of the rows is spread.

Edge cases: null source is a source of its own; null or empty text has no bytes and is mixed like others; a source
without bytes, or a target without a weight for a source, has rate 1 and 0; repeated rows (same doc_id and text) get the same
number of copies and the same keys; null doc_id hashes as the word null, so its rows differ by their texts; null text hashes as the empty one; an empty table gives no rows; other columns pass through, and
added columns get underscores in front where their names are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column_names

MAX_RATE = 256.0
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, budget: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """source, rate: by ``weights`` (shares of the budget), else each source's share is its bytes to the power ``exponent``.

    The budget in bytes is that of the whole input where none is given.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("bytes"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(exponent)))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weighted = sizes.withColumn("weight", F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)).cast("double"))
    totals = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("bytes").alias("all_bytes"))
    row = totals.first()
    if not row["all_weight"]:
        return weighted.select("source", F.when(F.col("bytes") > 0, 0.0).otherwise(1.0).alias("rate"))
    whole = float(row["all_bytes"]) if budget is None else float(budget)
    return weighted.select("source", F.when(F.col("bytes") > 0, F.lit(whole) * (F.col("weight") / F.lit(row["all_weight"])) / F.col("bytes")).otherwise(1.0).alias("rate"))


def _distribution(table: DataFrame) -> DataFrame:
    """Adds draws and cdf: the cumulated probabilities of 0, 1, 2 ... copies, for one of ``draws`` equal draws."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)).cast("int")
    split = table.withColumn("draws", draws).withColumn("mean", F.col("rate") / F.col("draws"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int"))
    first = F.exp(-F.col("mean"))
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.array_append(state["cdf"], F.element_at(state["cdf"], -1) + p).alias("cdf"))

    return split.select("source", "rate", "draws", F.aggregate(steps, start, add)["cdf"].alias("cdf"))


def replicate(docs: DataFrame, table: DataFrame, seed: int = 42, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each copy: the columns of ``docs`` and n_copies, copy (from 0), mix_key; in global random order."""
    copies, copy, key, salt, own, rate, draws, cdf, u, name = column_names(docs, "n_copies", "copy", "mix_key", "salt", "mix_source", "rate", "draws", "cdf", "mix_u", "mix_name")
    ready = _distribution(table).select(F.col("source").alias(own), F.col("rate").alias(rate), F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    docs_named = docs.withColumn(name, F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    if ready.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs_named.join(F.broadcast(ready), F.col(source).eqNullSafe(F.col(own)))
    else:
        spread = ready.withColumn(f"_{salt}", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs_named.withColumn(salt, F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, F.col(source).eqNullSafe(F.col(own)) & (F.col(salt) == F.col(f"_{salt}")))
    prefix = F.concat(F.col(name), F.lit(f":{seed}:"))
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col(draws) - 1),
        F.lit(0),
        lambda n, draw: n + F.size(F.filter(cdf, lambda c: c <= uniform(F.concat(prefix, draw.cast("string"))))),
    )
    # with one draw the number is worked out once and not for each step of the distribution
    single = F.size(F.filter(cdf, lambda c: c <= F.col(u)))
    counted = joined.withColumn(u, uniform(F.concat(prefix, F.lit("0")))).withColumn(copies, F.when(F.col(draws) == 1, single).otherwise(drawn))
    kept = [F.col(c) for c in docs.columns]
    exploded = counted.filter(F.col(copies) > 0).select(*kept, F.col(name), F.col(copies), F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(copy))
    keyed = exploded.withColumn(key, F.md5(F.concat(F.col(name), F.lit(f":{seed}:copy:"), F.col(copy).cast("string")))).drop(name)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, F.col(key)).sortWithinPartitions(key)
