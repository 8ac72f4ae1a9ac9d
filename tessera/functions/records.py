"""Functions on records: class scores, file names, configuration, nested JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def class_score(prediction: Column, truth: Column, classes: Column) -> Column:
    """1 / (classes named) if the truth is among them, else 0; classes that are part of the truth's name don't count."""
    named = F.filter(classes, lambda c: F.contains(prediction, c))
    kept = F.filter(named, lambda c: ~(F.contains(truth, c) & (c != truth)))
    return F.when(F.array_contains(kept, truth), 1.0 / F.nullif(F.size(kept), F.lit(0))).otherwise(0.0)


def prediction(pred: Column, answer: Column, outputs: Column) -> Column:
    """A record's prediction: pred, else answer, else the first output; null if there is none of them."""
    return F.coalesce(pred, answer, F.try_element_at(outputs, F.lit(1)))


def before_marker(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, 1)


def file_metadata(path: Column) -> Column:
    """struct(kind, doc_kind, banned) from the parts of a file's name."""
    parts = F.split(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[a-z]+$", ""), "_")
    kind = F.when(F.array_contains(parts, "vace"), "vace").when(F.array_contains(parts, "vscc"), "vscc")
    doc = F.when(F.array_contains(parts, "srccodes"), "srccodes").when(F.array_contains(parts, "docstring"), "docstring")
    return F.struct(kind.alias("kind"), doc.alias("doc_kind"), F.array_contains(parts, "BD").alias("banned"))


def without_keys(config: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(config, lambda k, v: ~k.isin(*keys))


def artifact_path(base: str, model: Column, modules: Column, first_layer: Column, last_layer: Column, rank: Column) -> Column:
    """base/model/<first letters of the modules>_<layers>/r<rank>."""
    short = F.array_join(F.transform(modules, lambda m: F.substring(m, 1, 1)), "")
    return F.concat_ws("/", F.lit(base), model, F.concat_ws("_", short, first_layer.cast("string"), last_layer.cast("string")), F.concat(F.lit("r"), rank.cast("string")))


def valid_corpus(rows: DataFrame, needed: list[str]) -> DataFrame:
    for name in needed:
        rows = rows.filter(F.col(name).isNotNull())
    return rows


def count_tokens(value) -> int:
    """White-space tokens of all keys and leaves of a decoded value."""
    if isinstance(value, dict):
        return sum(len(str(k).split()) + count_tokens(v) for k, v in value.items())
    if isinstance(value, list):
        return sum(map(count_tokens, value))
    return 0 if value is None else len(str(value).split())


def _count(text: str | None) -> int:
    try:
        return count_tokens(json.loads(text)) if text else 0
    except ValueError:
        return len((text or "").split())


nested_tokens = F.pandas_udf(lambda s: s.map(_count).astype("int64") if len(s) else pd.Series([], dtype="int64"), T.LongType())
