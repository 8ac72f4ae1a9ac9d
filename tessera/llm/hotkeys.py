"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot, so that there are at most HOT of them; keys with few rows never are.
HOT, LEAST_ROWS = 1_000, 1_000


def join_values(rows: DataFrame, values: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``values`` (one row a key; ``count``: the key's number of rows), nulls being equal.

    The hot keys' values, HOT rows at most, are broadcast, so that hot rows stay where they are; the others meet by a shuffle.
    ``count`` is dropped.  Both are read more than once, so they should be stored.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    busy = F.col(count) > max(LEAST_ROWS, total // HOT)
    others = [c for c in values.columns if c not in keys and c != count]

    def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        named = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *([] if how == "left_anti" else others))
        on = [left[k].eqNullSafe(named[f"_key_{k}"]) for k in keys]
        return left.join(F.broadcast(named) if right is hot else named, on, how).drop(*[f"_key_{k}" for k in keys])

    hot = values.filter(busy)
    light = join(join(rows, hot, "left_anti"), values.filter(~busy))
    return join(rows, hot).unionByName(light)
