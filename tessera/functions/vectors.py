"""Vector arithmetic on arrays, in double precision, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def surprisal(logits: Column, label: Column) -> Column:
    """-ln softmax(logits)[label], by log-sum-exp; the label counts from 0."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return top + F.log(total) - F.element_at(logits, label + 1)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; 1 if fewer than k fail."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * (n - c - i) / (n - i))
    return F.when(n - c < k, 1.0).otherwise(1.0 - miss)


def best_of_k(scores: Column, k: int) -> Column:
    """Expected best of k of the scores: sum of C(n-i, k-1) s_i / C(n, k), scores falling; null with fewer than k."""
    down, n = F.reverse(F.array_sort(scores)), F.size(scores)
    # weight of place i (from 1): k / n for the first, each next times (n-i-k+1+1) / (n-i)
    start = F.struct(F.lit(0.0).alias("sum"), (F.lit(float(k)) / n).alias("w"), F.lit(1).alias("i"))

    def step(acc: Column, s: Column) -> Column:
        ahead = n - acc["i"]
        return F.struct((acc["sum"] + acc["w"] * s).alias("sum"), F.when(ahead > 0, acc["w"] * (ahead - (k - 1)) / ahead).otherwise(0.0).alias("w"), (acc["i"] + 1).alias("i"))

    return F.when(n >= k, F.aggregate(down, start, step, lambda acc: acc["sum"]))
