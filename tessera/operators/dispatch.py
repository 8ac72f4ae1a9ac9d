"""Which way a task's context is got, filters in their order, and what caches need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.bounded import broadcast_if_small

#: Ways to a context: documents fixed beforehand, rounds over several queries, one query's nearest, none where the collection is locked.
FIXED, ROUNDS, NEAREST, LOCKED = "fixed", "rounds", "nearest", "locked"


def way(n_queries: Column, has_fixed: Column, locked: Column) -> Column:
    """The way of a task; null where it has neither queries nor fixed documents."""
    return F.when(locked, LOCKED).when(has_fixed, FIXED).when(n_queries > 1, ROUNDS).when(n_queries == 1, NEAREST)


def dispatch(tasks: DataFrame, ways: dict[str, DataFrame]) -> DataFrame:
    """(task, way, place, doc): each task's rows from the plan of its way; one row without a document where there are none.

    ``tasks``: task and way; ``ways``: by name the (task, place, doc) of all tasks, of which each plan keeps its own.
    """
    found = None
    for name, plan in ways.items():
        own = plan.join(broadcast_if_small(tasks.filter(F.col("way") == name).select("task")), "task", "left_semi").select("task", "place", "doc")
        found = own if found is None else found.unionByName(own)
    return tasks.join(found, "task", "left").select("task", "way", "place", "doc")


def ordered_filters(rows: DataFrame, key: str, done: DataFrame | None = None, banned: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Rows not done yet, not banned, and wanted, in that order; null keys are kept by the first two and never wanted."""
    for other, how in ((done, "left_anti"), (banned, "left_anti"), (wanted, "left_semi")):
        if other is not None:
            rows = rows.join(broadcast_if_small(other.select(key).distinct()), key, how)
    return rows


def select_queries(generated: Column, passing: Column, description: Column) -> Column:
    """struct(chosen, queries): the generated queries that pass, or all of them where none does, or else the description alone."""
    filled = lambda queries: F.coalesce(F.size(queries) > 0, F.lit(False))
    chosen = F.when(filled(passing), "filtered").when(filled(generated), "unfiltered").otherwise("description")
    queries = F.when(filled(passing), passing).when(filled(generated), generated).otherwise(F.array(description))
    return F.struct(chosen.alias("chosen"), queries.alias("queries"))


def with_target_api(queries: Column, packages: Column) -> Column:
    """Of an array of structs (query, target_api) those whose package is among ``packages`` and isn't the language itself.

    Nothing is kept if the first one names no API; everything is, if there are no packages to compare with.
    """
    package = lambda q: F.element_at(F.split(q["target_api"], r"\."), 1)
    kept = F.filter(queries, lambda q: F.coalesce(q["target_api"] != "", F.lit(False)) & F.array_contains(packages, package(q)) & (package(q) != "python"))
    named = F.try_element_at(queries, F.lit(1))["target_api"].isNotNull()
    return F.when(~F.coalesce(named, F.lit(False)), F.slice(queries, 1, 0)).when(F.size(packages) <= 0, queries).otherwise(kept)


def cached_or_computed(cache: DataFrame, wanted: DataFrame, key: list[str], compute) -> DataFrame:
    """The cache's rows for ``wanted`` keys whose ``n`` is as wanted, and what ``compute`` makes of the others, with ``cached``."""
    fresh = cache.join(wanted.select(*key, "n"), [*key, "n"], "left_semi").withColumn("cached", F.lit(True))
    return fresh.unionByName(compute(wanted.join(fresh.select(*key), key, "left_anti")).withColumn("cached", F.lit(False)))


def truncation_position(text: Column, most: int, step: int = 10_000) -> Column:
    """Characters to read, in steps, until there are ``most`` white-space tokens, each step counted by itself; at most a step beyond the text."""
    steps = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / step).cast("int"))

    def read(state: Column, k: Column) -> Column:
        piece = F.substring(text, k * step + 1, F.lit(step))
        tokens = F.size(F.filter(F.split(piece, r"\s+"), lambda w: w != ""))
        more = state["tokens"] < most
        return F.struct(F.when(more, state["tokens"] + tokens).otherwise(state["tokens"]).alias("tokens"), F.when(more, (k + 1) * step).otherwise(state["at"]).alias("at"))

    start = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("at"))
    return F.when(F.length(text) > 0, F.aggregate(steps, start, read)["at"]).otherwise(F.lit(0))


def random_splits(sequence: Column, length: Column, n: int = 10, seed: int = 0) -> Column:
    """Sorted distinct places of ``n`` draws below the last token, and the first place, made again from the sequence's name and the seed."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.pmod(F.xxhash64(sequence, k, F.lit(seed)), F.greatest(length - 1, F.lit(1))).cast("int"))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), draws)))
