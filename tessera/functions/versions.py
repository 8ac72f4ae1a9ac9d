"""Version strings as number arrays, their distance, and selection strategies by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_parts(version: Column) -> Column:
    """Dotted integers as array<int>; null if a part isn't a number."""
    parts = F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))
    return F.when(F.exists(parts, lambda p: p.isNull()), None).otherwise(parts)


def version_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of number arrays, the shorter padded with zeros; null if either is null."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d * d))


def same_minor(a: Column, b: Column) -> Column:
    """Equal first two parts; versions of one part never match."""
    x, y = version_parts(a), version_parts(b)
    return F.coalesce((F.size(x) >= 2) & (F.size(y) >= 2) & (F.slice(x, 1, 2) == F.slice(y, 1, 2)), F.lit(False))


#: Strategy name -> predicate (wanted, available); ``closest_n`` is an operator of its own, other names mean equality.
STRATEGIES = {"same_minor": same_minor, "all": lambda a, b: F.lit(True), "exact": lambda a, b: a == b}


def version_strategy(name: str):
    return STRATEGIES.get(name, STRATEGIES["exact"])
