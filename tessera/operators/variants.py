"""Nested JSON of any depth in the JVM: parsed once, exploded level by level, rebuilt from its entries.

Rows are keyed by ``keys``, which tell one document from another.  What isn't JSON, or names a key of an object twice, parses to null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.tables import working, written


def is_container(v: Column) -> Column:
    """Whether a variant is an object or an array."""
    kind = F.schema_of_variant(v)
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def nodes(documents: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, path, key, leaf, value): every value inside the documents, below the outermost.

    ``path`` has the place among its siblings of each value on the way (in an object places go by the order of keys), ``key`` its name
    in an object; ``value`` is a leaf's text, null for JSON's null.  A document that is a leaf itself has one node with an empty path.
    """
    spark = documents.sparkSession
    with working(spark) as keep:
        now = written(documents.select(*keys, F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(json).alias("_v")).filter("_v IS NOT NULL"))
        levels = [now.filter(~is_container(F.col("_v")))]
        while True:
            inside = now.filter(is_container(F.col("_v"))).withColumnRenamed("key", "_name")
            each = inside.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
            now = written(each.select(*keys, F.array_append("path", F.col("pos")).alias("path"), "key", F.col("value").alias("_v")))
            if now.isEmpty():
                break
            levels.append(now)
        whole = reduce(DataFrame.unionByName, levels)
        leaf = ~is_container(F.col("_v"))
        done = written(whole.select(*keys, "path", "key", leaf.alias("leaf"), F.when(leaf, F.variant_get("_v", "$", "string")).alias("value")))
        keep.append(done)
    return done


def nested_tokens(documents: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, tokens): white-space tokens of all keys and leaves of each document; what isn't JSON counts as a text, null as none."""
    count = lambda c: F.coalesce(F.size(text.words(c)), F.lit(0))
    own = F.coalesce(count(F.col("key")), F.lit(0)) * F.col("key").isNotNull().cast("int") + F.coalesce(count(F.col("value")), F.lit(0)) * F.col("value").isNotNull().cast("int")
    sums = nodes(documents, keys, json).groupBy(*keys).agg(F.sum(own).alias("_sum"))
    named = sums.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_sum")
    plain = F.when(F.col(json).isNull(), 0).when(F.try_parse_json(json).isNull(), count(F.col(json))).otherwise(0)
    joined = documents.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]), "left")
    return joined.select(*keys, F.coalesce("_sum", plain).cast("long").alias("tokens"))


def flattened(documents: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, values): the leaves of each document in order, however deep; null leaves stay as nulls."""
    leaves = nodes(documents, keys, json).filter("leaf").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("_all"))
    return leaves.select(*keys, F.transform("_all", lambda x: x["value"]).alias("values"))


def truncated(documents: DataFrame, keys: list[str], json: str, tokens: int, cut: str = "doc", drop: tuple[str, ...] = ("members",)) -> DataFrame:
    """(keys, json): objects rebuilt without the members ``drop`` and with the text ``cut`` ended after so many tokens; what is no object goes."""
    objects = documents.select(*keys, F.try_parse_json(json).alias("_v")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    empty = objects.filter(F.schema_of_variant("_v") == "OBJECT<>").select(*keys, F.lit("{}").alias(json))
    each = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    words = text.words(F.variant_get("value", "$", "string"))
    is_text = (F.col("key") == cut) & (F.schema_of_variant("value") == "STRING")
    shorter = F.when(is_text & (F.size(words) > tokens), F.array_join(F.slice(words, 1, tokens), " ").cast("variant")).otherwise(F.col("value"))
    kept = each.withColumn("_kept", ~F.col("key").isin(list(drop)))
    entries = kept.groupBy(*keys).agg(F.collect_list(F.when(F.col("_kept"), F.struct("key", shorter.alias("value")))).alias("_entries"))
    return entries.select(*keys, F.to_json(F.map_from_entries("_entries")).alias(json)).unionByName(empty)
