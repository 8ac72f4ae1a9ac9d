"""Contexts by way, shares of the budget, and what becomes of tasks without a way."""

from tessera.operators import contexts


def test_acquire(spark):
    docs = spark.createDataFrame([("a", 1, "one two"), ("a", 2, " "), ("a", 3, "three four  five six"), ("b", 1, "x y z"), ("c", 1, None), (None, 1, "null package")], "p string, d int, t string")
    heads = contexts.package_heads(docs, "p", "d", "t", 5)
    assert {r["package"]: (r["tokens"], r["head"]) for r in heads.collect()} == {"a": (6, "one two three four five"), "b": (3, "x y z")}
    tasks = spark.createDataFrame(
        [(1, "corpus", "", ["b", "a", "a", "zzz"]), (2, "corpus", None, ["zzz"]), (3, "cached", None, None), (4, "cached", "", None), (5, "retrieved", "", None), (6, "retrieved", "", None), (7, None, "", None), (8, "retrieved", "kept", None), (9, "odd", "", [])],
        "task int, way string, context string, packages array<string>",
    )
    cached = spark.createDataFrame([(3, "a b c d e f g")], "task int, context string")
    retrieved = spark.createDataFrame([(5, "found"), (6, None)], "task int, context string")
    found = {r["task"]: (r["status"], r["context"]) for r in contexts.acquire(tasks, cached, retrieved, heads, 5).collect()}
    assert found == {
        1: ("success", "one two three\nx"),  # 6 and 3 of 9 tokens: 3 and 1 of 5
        2: ("success", ""),
        3: ("success", "a b c d e"),
        4: ("success", ""),
        5: ("success", "found"),
        6: ("locked", ""),
        7: ("error", ""),
        8: ("success", "kept"),
        9: ("error", ""),
    }


def test_a_small_package_isnt_stretched(spark):
    docs = spark.createDataFrame([("a", 1, "one two"), ("b", 1, "x")], "p string, d int, t string")
    tasks = spark.createDataFrame([(1, ["a", "b"])], "task int, packages array<string>")
    whole = contexts.corpus_contexts(tasks, contexts.package_heads(docs, "p", "d", "t", 100), 100)
    assert whole.first()["context"] == "one two\nx"
