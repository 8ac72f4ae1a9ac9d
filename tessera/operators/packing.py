"""Packing of sequences and documents into blocks and budgets."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.bounded import broadcast_if_small
from tessera.operators.scans import numbered_parts


def first_fit(sizes: list[int], block: int) -> list[int]:
    """Bin of each item of one list when items go, the smallest first, into the first bin with room; larger ones get bins of their own.

    Ascending sizes make the first bin with room the newest one or none, so bins close for good and the walk is linear.
    """
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    bins, used, at = [0] * len(sizes), 0, 0
    for i in order:
        if used and used + sizes[i] > block:
            at, used = at + 1, 0
        bins[i] = at
        used += sizes[i]
    return bins


def pack_first_fit(rows: DataFrame, group: str, item: str, size: str, block: int) -> DataFrame:
    """(group, item, size, bin) as by ``first_fit`` over each group, ties by item, null sizes being none.

    The state is what the newest bin holds (a full one counts as ``block``), and chunks of a group are composed (``scans``): no task holds
    a whole group.
    """

    def step(used, n):
        begins = (used == 0) | (used + n > block)
        return np.where(begins, n, used + n).clip(max=block), begins & (n > 0)

    narrow = rows.select(group, item, F.coalesce(size, F.lit(0)).cast("long").alias(size))
    parts = numbered_parts(narrow, group, [size, item], size, step, block + 1)
    return parts.select(group, item, size, F.greatest("part", F.lit(0)).alias("bin"))


def share_budget(rows: DataFrame, group: str, size: str, budget: int) -> DataFrame:
    """Adds ``quota``: the budget by share of the group's tokens, rounded down.  Sums are made part by part, so no task holds a group."""
    totals = rows.groupBy(F.col(group).alias("_group")).agg(F.sum(size).alias("_total"))
    joined = rows.join(broadcast_if_small(totals), F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("quota", F.when(F.col("_total") > 0, F.floor(F.col(size) * F.lit(budget) / F.col("_total"))).otherwise(F.lit(0))).drop("_group", "_total")


def share_by_count(rows: DataFrame, task: str, group: str, order: list[str], budget: int) -> DataFrame:
    """Rows within their group's quota, which goes by the group's number of documents in the task.

    A quota is no more than the budget, so ``budget`` rows of a group at most are ranked after partial limits; groups are counted part by part.
    """
    place = F.row_number().over(Window.partitionBy(task, group).orderBy(*order))
    counts = rows.groupBy(F.col(task).alias("_task"), F.col(group).alias("_group")).agg(F.count("*").alias("_own"))
    totals = counts.groupBy(F.col("_task").alias("_whole")).agg(F.sum("_own").alias("_all"))
    quotas = counts.join(broadcast_if_small(totals), F.col("_task").eqNullSafe(F.col("_whole"))).select("_task", "_group", F.floor(F.col("_own") * F.lit(budget) / F.col("_all")).alias("quota"))
    first = rows.withColumn("place", place).filter(F.col("place") <= budget)
    named = F.col(task).eqNullSafe(F.col("_task")) & F.col(group).eqNullSafe(F.col("_group"))
    return first.join(broadcast_if_small(quotas), named).filter("place <= quota").drop("_task", "_group")


#: Fixed value: rounds after which filling ends, whatever is left.
ROUNDS = 99


def progressive_fill(first: list[list[tuple[int, int]]], rest: list[list[tuple[int, int]]], budget: int, most_rounds: int | None = ROUNDS) -> list[int]:
    """Documents chosen for one task.  ``first``: per query the (doc, tokens) of phase one; ``rest``: its ranked candidates.

    Phase one fills query by query, skips what is chosen, and stops a query at the first that doesn't fit.  Phase two goes round the
    queries' candidates without the picks of phase one: one head of each query; a head that doesn't fit stays and ends the round; it
    ends when a round adds nothing, or after ``most_rounds`` (None: never).  A document in the queues of two queries is
    taken, and charged, twice: contexts are put together by query.
    """
    chosen, used, had = [], 0, set()
    for query in first:
        for doc, tokens in query:
            if doc in had:
                continue
            if used + tokens > budget:
                break
            chosen.append(doc)
            had.add(doc)
            used += tokens
    queues = [[(d, n) for d, n in query if d not in had] for query in rest]
    heads = [0] * len(queues)
    for _ in range(most_rounds) if most_rounds is not None else count():
        added = False
        for q, queue in enumerate(queues):
            if heads[q] >= len(queue):
                continue
            doc, tokens = queue[heads[q]]
            if used + tokens > budget:
                break
            heads[q] += 1
            chosen.append(doc)
            used += tokens
            added = True
        if not added or used >= budget:
            break
    return chosen


def fill_tasks(candidates: DataFrame, budget: int) -> DataFrame:
    """(task, place, doc) by ``progressive_fill``; candidates have task, phase, query, rank, doc, tokens and are already ranked and cut to top-n."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["query", "rank", "doc"], kind="stable")
        queries = sorted(pdf["query"].unique())
        sides: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for phase, query, doc, tokens in zip(pdf["phase"], pdf["query"], pdf["doc"], pdf["tokens"]):
            sides.setdefault((phase, query), []).append((int(doc), int(tokens)))
        docs = progressive_fill(*[[sides.get((phase, q), []) for q in queries] for phase in (1, 2)], budget)
        return pd.DataFrame({"task": pdf["task"].iloc[0], "place": range(1, len(docs) + 1), "doc": docs}).astype({"place": "int64", "doc": "int64"})

    return candidates.groupBy("task").applyInPandas(run, "task long, place long, doc long")

