"""Parsing of checker and test-run output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a line of a checker's output as noise.
NOISE = ("hint:", "note:", "see http")


def checker_lines(log: Column, code: Column) -> Column:
    """``file:line: error: message`` lines as ``Line n: source`` and ``Error: message``; lines beyond the code show nothing."""
    pattern = F.lit(r"(?m)^[^:\n]+:([0-9]+): error: ([^\n]*)$")
    numbers, messages = F.regexp_extract_all(log, pattern, F.lit(1)), F.regexp_extract_all(log, pattern, F.lit(2))
    source = F.split(code, "\n")

    def line(n: Column, message: Column) -> Column:
        return F.concat(F.lit("Line "), n, F.lit(": "), F.coalesce(F.try_element_at(source, n.cast("int")), F.lit("")), F.lit("\nError: "), message)

    return F.zip_with(numbers, messages, line)


def without_noise(log: Column) -> Column:
    """Lines without hints, notes and links; "No errors found" if none is left."""
    kept = F.filter(F.split(log, "\n"), lambda x: ~(F.contains(F.lower(x), F.lit(NOISE[0])) | F.contains(F.lower(x), F.lit(NOISE[1])) | F.contains(F.lower(x), F.lit(NOISE[2]))))
    text = F.array_join(kept, "\n")
    return F.when(F.trim(text) == "", "No errors found").otherwise(text)


def diagnostic_text(message: Column, line0: Column, code: Column) -> Column:
    """A zero-based diagnostic as ``Line n: source`` and ``Error: message``."""
    source = F.coalesce(F.try_element_at(F.split(code, "\n"), line0 + 1), F.lit(""))
    return F.concat(F.lit("Line "), (line0 + 1).cast("string"), F.lit(": "), source, F.lit("\nError: "), message)


def unittest_summary(log: Column) -> Column:
    """struct(ran, failures, errors, ok) from ``Ran n tests`` and ``FAILED (failures=a, errors=b)``."""

    def number(pattern: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(log, pattern, 1), F.lit("")).cast("int"), F.lit(0))

    failed = F.contains(log, F.lit("FAILED ("))
    return F.struct(
        number(r"Ran ([0-9]+) tests?").alias("ran"), number(r"FAILED \([^)]*failures=([0-9]+)").alias("failures"), number(r"FAILED \([^)]*errors=([0-9]+)").alias("errors"), (~failed).alias("ok")
    )


def _called(line: Column) -> Column:
    """The dotted name before the first bracket that has one before it; null if none has."""
    before = F.split(line, r"\(")
    names = F.transform(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))), lambda p: F.regexp_replace(F.regexp_extract(F.rtrim(p), r"[A-Za-z0-9_.]+$", 0), "^[0-9.]+", ""))
    return F.get(F.filter(names, lambda n: n != ""), F.lit(0))


def error_api(message: Column) -> Column:
    """struct(api, owner, kind, module) of a checker's message; all null if none of the known forms fits."""

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(message, pattern, group)

    def found(api: Column, owner: Column, kind: str, module: Column) -> Column:
        return F.struct(api.alias("api"), owner.alias("owner"), F.lit(kind).alias("kind"), module.alias("module"))

    none, text = F.lit(None).cast("string"), F.lit("f-string")
    # fixed values: the checker's messages
    attribute = r'Cannot access attribute "([^"]+)" for class "([^"]+)"'
    method = r'Cannot call method "([^"]+)" on type "([^"]+)"'
    missing = r'Import "([^"]+)" could not be resolved'
    member = r'"([^"]+)" is not a known attribute of module "([^"]+)"'
    parameter = r'No parameter named "([^"]+)"'
    called = _called(part(r"Line [0-9]+: ([^\n]*)", 1))
    is_fstring = F.contains(message, F.lit("Format strings are only supported in Python 3.6 and greater")) & F.regexp_like(message, F.lit(r"f[\"'].*?[\"']"))
    return (
        F.when(is_fstring, found(text, F.lit("string"), "syntax", none))
        .when(F.regexp_like(message, F.lit(attribute)), found(part(attribute, 1), part(attribute, 2), "attribute", none))
        .when(F.regexp_like(message, F.lit(method)), found(part(method, 1), part(method, 2), "method", none))
        .when(F.regexp_like(message, F.lit(missing)), found(part(missing, 1), part(missing, 1), "import", part(missing, 1)))
        .when(F.regexp_like(message, F.lit(member)), found(part(member, 1), part(member, 2), "module_attribute", part(member, 2)))
        .when(F.regexp_like(message, F.lit(parameter)) & called.isNotNull(), found(part(parameter, 1), called, "parameter", none))
    )


def objects_in(text: Column) -> Column:
    """Brace groups, with one level of nesting."""
    return F.regexp_extract_all(text, F.lit(r"\{(?:[^{}]|\{[^{}]*\})*\}"), F.lit(0))
