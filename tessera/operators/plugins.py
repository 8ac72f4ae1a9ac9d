"""Registries of pluggable parts: embedder, generator, checker, prompts; unknown names raise ValueError."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDING_SIZE = 64


def _hash_embed(texts: pd.Series) -> pd.Series:
    """Deterministic hashing embedder: signed counts of words, normalised; a blank text counts as one space."""
    import math
    from zlib import crc32

    def one(text: str | None) -> list[float]:
        vector = [0.0] * EMBEDDING_SIZE
        for word in (text or "").split() or [" "]:
            h = crc32(word.encode("utf-8", "surrogatepass"))
            vector[h % EMBEDDING_SIZE] += 1.0 if h >> 16 & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in vector)) or 1.0
        return [x / norm for x in vector]

    return texts.map(one)


EMBEDDERS: dict[str, Callable[[pd.Series], pd.Series]] = {"hash": _hash_embed}
GENERATORS: dict[str, Callable[[pd.Series], pd.Series]] = {"echo": lambda prompts: prompts.fillna("")}


def _syntax_errors(code: str | None) -> list[str]:
    try:
        ast.parse(code or "")
    except (SyntaxError, ValueError) as e:
        return [f"syntax: {getattr(e, 'msg', None) or e}"]
    return []


CHECKERS: dict[str, Callable[[pd.Series], pd.Series]] = {"syntax": lambda codes: codes.map(_syntax_errors)}

#: Prompts by (task, version), as functions of columns.
PROMPTS: dict[tuple[str, str], Callable[..., Column]] = {
    ("report", "v1"): lambda kind, k: F.concat(F.lit("Task "), kind, F.lit(": use k="), k, F.lit(".")),
    ("answer", "v1"): lambda question, context: F.concat(F.lit("Context:\n"), context, F.lit("\nQuestion: "), question),
}


def _named(table: dict, name, what: str):
    if name not in table:
        raise ValueError(f"unknown {what}: {name}")
    return table[name]


def prompt(task: str, version: str) -> Callable[..., Column]:
    return _named(PROMPTS, (task, version), "prompt")


def embed(column: Column, name: str = "hash") -> Column:
    return F.pandas_udf(_named(EMBEDDERS, name, "embedder"), T.ArrayType(T.FloatType()))(column)


def generate(column: Column, name: str = "echo") -> Column:
    return F.pandas_udf(_named(GENERATORS, name, "generator"), T.StringType())(column)


def check(column: Column, name: str = "syntax") -> Column:
    return F.pandas_udf(_named(CHECKERS, name, "checker"), T.ArrayType(T.StringType()))(column)


def repair_rounds(tasks: DataFrame, code: str, rounds: int, fix: Callable[[Column, Column], Column], checker: str = "syntax", stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Check, fix what fails, check again, ``rounds`` times at most; adds ``errors`` and ``rounds``.

    The plan is unrolled: each round touches rows with errors only.  ``stored`` may cut the lineage in between.
    """
    now = tasks.withColumn("errors", check(F.col(code), checker)).withColumn("rounds", F.lit(0))
    for _ in range(rounds):
        failing = F.size("errors") > 0
        now = stored(now.withColumn(code, F.when(failing, fix(F.col(code), F.col("errors"))).otherwise(F.col(code))).withColumn("rounds", F.col("rounds") + failing.cast("int")))
        now = now.withColumn("errors", F.when(F.size("errors") > 0, check(F.col(code), checker)).otherwise(F.col("errors")))
    return now
