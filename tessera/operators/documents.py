"""Rules on documents that are JSON texts: which package one belongs to, and when two are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _head(path: Column) -> Column:
    return F.substring_index(path, ".", 1)


def package_of_document(document: Column, packages: Column) -> Column:
    """struct(reason, package) of a document among ``packages``; null if it belongs to none.

    An object belongs to the package that its ``path`` begins with, else to that of the first of its ``aliases`` that begins with one, else to
    the least package that its ``docstring``, its ``content`` or else its whole text holds; what is no object to the least package that
    its text holds.
    """
    v = F.try_parse_json(document)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    known = lambda name: F.array_contains(packages, name)
    path = _head(F.try_variant_get(v, "$.path", "string"))
    aliases = F.filter(F.try_variant_get(v, "$.aliases", "array<string>"), lambda a: F.coalesce(known(_head(a)), F.lit(False)))
    filled = lambda name: F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    body = F.when(is_object, F.coalesce(filled("docstring"), filled("content"), document)).otherwise(document)
    held = F.array_min(F.filter(packages, lambda p: F.contains(body, p)))
    found = lambda reason, package: F.struct(F.lit(reason).alias("reason"), package.alias("package"))
    return (
        F.when(is_object & known(path), found("path", path))
        .when(is_object & (F.size(aliases) > 0), found("alias", _head(F.get(aliases, F.lit(0)))))
        .when(held.isNotNull(), found("content", held))
    )


def canonical(json: Column) -> Column:
    """A text that JSON values share if they differ in the order of keys and in white space only; other texts stay as they are."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json)
