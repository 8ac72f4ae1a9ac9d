"""Cleaners and normalisers on texts with odd ends, odd beginnings or nothing in them."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans import catalog

WHITE = " \t\n\r\f\v"
ENDS = ["a \u2028", "a \x85", "a\n\u2029", "a \n", "a\r\n ", " \x0b a \x0c", "\u3000 a \u3000", "verch v", "", " ", None]


def test_white_space_before_a_line_separator_stays(spark):
    """A dollar sign also matches before a last line separator, where nothing may be taken off."""
    rows = spark.createDataFrame(list(enumerate(ENDS)), "i int, c string")
    cleaned = text.clean_final_code(F.concat(F.lit("so: <finalcode>"), "c", F.lit("</finalcode> done")))
    found = {r["i"]: (r["s"], r["f"]) for r in rows.select("i", text.squeeze(F.col("c")).alias("s"), cleaned.alias("f")).collect()}
    assert found == {i: (c if c is None else c.strip(WHITE),) * 2 for i, c in enumerate(ENDS)}


def test_squeeze_of_long_blanks(spark):
    long = F.concat(F.lit("a"), F.repeat(F.lit(" "), 400_000), F.substring(F.col("id").cast("string"), 1, 1))
    begun = time.time()
    assert spark.range(1).select(F.length(text.squeeze(long))).first()[0] == 400_002
    assert time.time() - begun < 20


def held_against_sql(spark, folder, name, texts):
    """The query's rows and its SQL's over documents of these texts, each under twelve ids."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(12 * i + k, c) for i, c in enumerate(texts) for k in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r["digest"] for r in catalog.queries()[name](spark, str(folder)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        return found, dict(con.execute(f"SELECT doc_id, digest FROM ({catalog.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", ["wrapper_first", "basic", "loose", "lora", "errorfix", "review"])
def test_marks_around_nothing(spark, tmp_path, name):
    found, expected = held_against_sql(spark, tmp_path, f"clean_output_{name}", [None, "", "a b", "a\u2028", "### b", "<end> b"])
    assert found == expected


def test_indents_before_white_space(spark, tmp_path):
    texts = [None, "", " ", "\t", "\n", " \n ", " a", "\ta\n\tb", "\n a", "  a\n  b\n c", "a\n  b\n\n", "\r\n a", "\u3000a", "\x0b a", "a\n\n  \n"]
    found, expected = held_against_sql(spark, tmp_path, "normalize_indents", texts)
    assert found == expected
