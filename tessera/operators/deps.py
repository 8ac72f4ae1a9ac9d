"""Dependency maps: package -> versions, as MAP<STRING, ARRAY<STRING>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.bounded import dealt


def dependency_maps(edges: DataFrame, task: str = "task", pkg: str = "pkg", version: str = "version") -> DataFrame:
    """(task, dependency): edges gathered to sorted maps, duplicates once."""
    pairs = edges.groupBy(task, pkg).agg(F.array_sort(F.collect_set(version)).alias("versions"))
    return pairs.groupBy(task).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(pkg), F.col("versions"))))).alias("dependency"))


def explode_dependencies(tasks: DataFrame, dependency: str = "dependency") -> DataFrame:
    """A row per (pkg, version); null maps, lists and versions vanish."""
    others = [c for c in tasks.columns if c != dependency]
    pairs = tasks.select(*others, F.explode(dependency).alias("pkg", "versions"))
    return pairs.select(*others, "pkg", F.explode("versions").alias("version")).filter("version IS NOT NULL")


def cap_dependencies(edges: DataFrame, cap: int | None, order: list[str], exempt: str = "python", task: str = "task", pkg: str = "pkg") -> DataFrame:
    """The first ``cap`` packages of each task that aren't ``exempt``; exempt ones ride along until the cap is hit.

    None keeps all, 0 none.
    """
    if cap is None:
        return edges
    counted = (F.col(pkg) != exempt).cast("int")
    before = F.coalesce(F.sum(counted).over(Window.partitionBy(task).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return edges.withColumn("_before", before).filter(F.col("_before") < cap).drop("_before")


def combine_dependencies(target: DataFrame, source: DataFrame, task: str = "task", pkg: str = "pkg", version: str = "version") -> DataFrame:
    """(task, pkg, versions, missing_in_target): union of both sides' versions, sorted; a source package without target is flagged."""
    sides = target.select(task, pkg, version, F.lit(1).alias("t")).unionByName(source.select(task, pkg, version, F.lit(0).alias("t")))
    return sides.groupBy(task, pkg).agg(F.array_sort(F.collect_set(version)).alias("versions"), (F.max("t") == 0).alias("missing_in_target"))


def mask_dependencies(edges: DataFrame, allowed: DataFrame, task: str = "task", pkg: str = "pkg", known: int | None = None) -> DataFrame:
    """Edges of tasks by their allow-list (task, packages); tasks without a list stay whole, an empty list empties them.

    ``known`` is an upper bound of the rows of ``edges``, which are counted without it; the more there are, the more partitions join.
    """
    rows = edges.count() if known is None else known
    joined = dealt(edges, task, rows).join(dealt(allowed.select(task, "packages"), task, rows), task, "left")
    return joined.filter(F.col("packages").isNull() | F.array_contains("packages", F.col(pkg))).drop("packages")


def environment_key(pairs: Column) -> Column:
    """pkg and version glued, sorted, joined by underscores; ``pairs`` is an array of structs (pkg, version)."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["pkg"], p["version"])), "_")


def dependency_hash(pairs: Column) -> Column:
    """MD5 of the sorted pkg_version strings joined by underscores."""
    return F.md5(F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat_ws("_", p["pkg"], p["version"])), "_"))


def closest_versions(versions: DataFrame, n: int, compat: bool = False) -> DataFrame:
    """For each (pkg, version) its ``n`` nearest other versions.  Unparsable ones are farthest (``compat``: nearest)."""
    from tessera.functions.versions import version_distance, version_parts

    a, b = versions.select("pkg", "version").alias("a"), versions.select("pkg", F.col("version").alias("other")).alias("b")
    far = F.lit(0.0) if compat else F.lit(float("inf"))
    pairs = a.join(b, "pkg").filter("version <> other").withColumn("distance", F.coalesce(version_distance(version_parts(F.col("version")), version_parts(F.col("other"))), far))
    rank = F.row_number().over(Window.partitionBy("pkg", "version").orderBy("distance", "other"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= n)


def by_strategy(versions: DataFrame, name: str, n: int = 3, compat: bool = False) -> DataFrame:
    """(pkg, version, other): the other versions that a strategy picks for each; ``closest_n`` takes the ``n`` nearest, predicates any."""
    from tessera.functions.versions import version_strategy

    if name == "closest_n":
        return closest_versions(versions, n, compat).select("pkg", "version", "other")
    pairs = versions.select("pkg", "version").join(versions.select("pkg", F.col("version").alias("other")), "pkg").filter("version <> other")
    return pairs.filter(version_strategy(name)(F.col("version"), F.col("other")))


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Each pair of a text and a part that it contains, once; texts are short (names, tags): all their substrings that are as long as some
    part are joined by equality, so no text meets a part that it doesn't hold."""
    lengths = sorted(r[0] for r in parts.select(F.length(part)).filter(F.length(part) > 0).distinct().collect())
    if not lengths:
        return texts.join(parts, F.lit(False))
    begins = lambda n: F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.array_distinct(F.concat(*[F.transform(begins(n), lambda k, n=n: F.substring(F.col(text), k, F.lit(n))) for n in lengths]))
    return texts.withColumn(part, F.explode(pieces)).join(parts, part)
