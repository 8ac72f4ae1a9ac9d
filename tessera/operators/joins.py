"""Joins of records: resume, allow-lists, outer merges, first and last wins, best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.windows import ordinal


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as when later records overwrite earlier ones."""
    return first_wins(rows, keys, [F.desc(c) for c in order])


def with_first_match(left: DataFrame, right: DataFrame, key: str, order: list, missing: str = "missing") -> DataFrame:
    """Left outer join to the first right row of each key; ``missing`` tells rows without one."""
    one = first_wins(right, [key], order).withColumn("_found", F.lit(True))
    return left.join(one, key, "left").withColumn(missing, F.col("_found").isNull()).drop("_found")


def resume(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a result."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def composite_key(item: str = "original_item_id", index: str = "query_index", fallback: str = "id") -> list[Column]:
    """(item, index), or (fallback, 0) where they are missing."""
    return [F.coalesce(F.col(item), F.col(fallback)).cast("string").alias("key_item"), F.coalesce(F.when(F.col(item).isNotNull(), F.col(index)), F.lit(0)).alias("key_index")]


def append_missing(rows: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Rows, and those baseline rows whose key isn't there."""
    return rows.unionByName(baseline.join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_lists(first: DataFrame, second: DataFrame, key: str, values: str) -> DataFrame:
    """Full outer join that concatenates list columns, the first side's ahead."""
    a, b = first.select(key, F.col(values).alias("_a")), second.select(key, F.col(values).alias("_b"))
    none = F.array().cast(first.schema[values].dataType)
    return a.join(b, key, "full").select(key, F.concat(F.coalesce("_a", none), F.coalesce("_b", none)).alias(values))


def overwrite_field(rows: DataFrame, lookup: DataFrame, key: str, field: str) -> DataFrame:
    """The field replaced where the lookup has the key."""
    new = lookup.select(key, F.col(field).alias("_new"))
    return rows.join(new, key, "left").withColumn(field, F.coalesce("_new", field)).drop("_new")


def best_match(pairs: DataFrame, keys: list[str], score: Column, order: list) -> DataFrame:
    """The pair with the greatest score of each key, ties to the first; scores of zero match nothing."""
    scored = pairs.withColumn("score", score).filter("score > 0")
    return first_wins(scored, keys, [F.desc("score"), *order])


def zip_by_position(left: DataFrame, right: DataFrame, left_order: list, right_order: list, group: list[str]) -> DataFrame:
    """Rows joined by their position within a group; positions are numbered part by part, so no task holds a group."""
    numbered = [ordinal(side, order, within=tuple(group)).withColumn("position", (F.col("ordinal") + 1).cast("int")).drop("ordinal") for side, order in ((left, left_order), (right, right_order))]
    return numbered[0].join(numbered[1], [*group, "position"])
