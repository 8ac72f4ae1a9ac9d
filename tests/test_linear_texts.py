"""Text functions whose work must grow with the text and not with its square."""

import time

from pyspark.sql import functions as F

from tessera.functions import text


def plain(code):
    """Line by line: the first non-blank line's indent off each line that begins with it."""
    if code is None:
        return None
    lines = code.split("\n")
    first = next((x for x in lines if x.strip(" \t\n\r\f\v")), "")
    indent = first[: len(first) - len(first.lstrip(" \t"))]
    return "\n".join(x.removeprefix(indent) for x in lines)


def test_indents_line_by_line(spark):
    codes = ["  a\n  b\n c\n    d", "\n \n\t x\n\t y\n x\n", "a\n  b", "", " ", "  \n ", "\n\n", "\r\n  a\r\n  b", " \x0b a\n b", "  a\n\n\n  \n   b\n  ", "  a\n  b", None, "  é\n  ß", "  a\n  \n"]
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, c string")
    found = {r["i"]: r["n"] for r in rows.select("i", text.normalize_indentation(F.col("c")).alias("n")).collect()}
    assert found == {i: plain(c) for i, c in enumerate(codes)}


def test_indents_of_many_lines(spark):
    code = F.repeat(F.lit("  x = 1\n"), 40_000)
    begun = time.time()
    assert spark.range(1).select(F.length(text.normalize_indentation(F.concat(code, F.substring(F.col("id").cast("string"), 1, 1))))).first()[0] == 40_000 * 6 + 1
    assert time.time() - begun < 20
