"""Contexts of tasks by three ways: cached question-answer contexts, retrieval, or all documents of the task's packages within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.bounded import broadcast_if_small

CACHED, RETRIEVED, CORPUS = "cached", "retrieved", "corpus"
SUCCESS, LOCKED, ERROR = "success", "locked", "error"


def head(body: Column, tokens: Column | int) -> Column:
    """The first white-space tokens, joined by spaces."""
    return F.array_join(F.slice(text.words(body), 1, tokens if isinstance(tokens, Column) else F.lit(tokens)), " ")


def package_heads(docs: DataFrame, package: str, order: str, body: str, budget: int) -> DataFrame:
    """(package, tokens, head): each package's number of tokens, and the first ``budget`` of them, documents in order; null is no package.

    A document that isn't blank has a token, so ``budget`` documents of a package at most are ranked (after partial limits) and gathered.
    """
    sized = docs.select(F.col(package).alias("package"), F.col(order).alias("_order"), head(F.col(body), budget).alias("_body"), F.size(text.words(F.col(body))).alias("_n")).filter("_n > 0")
    totals = sized.groupBy("package").agg(F.sum("_n").alias("tokens"))
    first = sized.withColumn("_at", F.row_number().over(Window.partitionBy("package").orderBy("_order"))).filter(F.col("_at") <= budget)
    upto = F.sum("_n").over(Window.partitionBy("package").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    needed = first.withColumn("_before", F.coalesce(upto, F.lit(0))).filter(F.col("_before") < budget)
    whole = needed.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_at", "_body")))["_body"], " ").alias("_whole"))
    return totals.join(whole, "package").select("package", "tokens", head(F.col("_whole"), budget).alias("head"))


def corpus_contexts(tasks: DataFrame, heads: DataFrame, budget: int) -> DataFrame:
    """(task, context): of each of a task's packages its share of the budget by tokens, rounded down, in the order of names, a line each."""
    wanted = tasks.select("task", F.explode(F.array_distinct("packages")).alias("package")).join(broadcast_if_small(heads), "package")
    total = F.sum("tokens").over(Window.partitionBy("task"))
    quota = F.least(F.col("tokens"), F.floor(F.col("tokens") * F.lit(budget) / total)).cast("int")
    cut = wanted.withColumn("_quota", quota).select("task", F.struct("package", head(F.col("head"), F.col("_quota")).alias("body")).alias("part"))
    return cut.groupBy("task").agg(F.array_join(F.array_sort(F.collect_list("part"))["body"], "\n").alias("context"))


def acquire(tasks: DataFrame, cached: DataFrame, retrieved: DataFrame, heads: DataFrame, budget: int) -> DataFrame:
    """(task, status, context) of each of ``tasks`` (task, way, context, packages).

    A task that has a context keeps it.  Cached contexts are cut to the budget and empty where there is none; a retrieved context that is null
    tells that its collection is locked; a task without a known way is an error.  ``cached`` and ``retrieved`` are (task, context), one row a task.
    """
    open_ = tasks.filter((F.coalesce("context", F.lit("")) == "") & (F.col("way") == CORPUS))
    whole = corpus_contexts(open_.select("task", "packages"), heads, budget)
    joined = tasks
    for name, side in ((CACHED, cached), (RETRIEVED, retrieved), (CORPUS, whole)):
        joined = joined.join(side.select("task", F.col("context").alias(f"_{name}")), "task", "left")
    has = F.coalesce("context", F.lit("")) != ""
    way = F.coalesce("way", F.lit(""))
    status = F.when(has | way.isin(CACHED, CORPUS), SUCCESS).when(way == RETRIEVED, F.when(F.col(f"_{RETRIEVED}").isNull(), LOCKED).otherwise(SUCCESS)).otherwise(ERROR)
    found = F.when(has, F.col("context")).when(way == CACHED, head(F.col(f"_{CACHED}"), budget)).when(way == RETRIEVED, F.col(f"_{RETRIEVED}")).when(way == CORPUS, F.col(f"_{CORPUS}"))
    return joined.select("task", status.alias("status"), F.coalesce(found, F.lit("")).alias("context"))
