"""Nested JSON against decoded values."""

import json
import random

from tessera.functions.records import count_tokens
from tessera.operators import variants

r = random.Random(8)


def value(depth):
    kind = r.randrange(7 if depth else 5)
    if kind < 5:
        return r.choice(["", "two words", "é \t 中 x", 3, -0.5, True, None])
    return [value(depth - 1) for _ in range(r.randint(0, 4))] if kind == 5 else {f"k {i}" if i % 2 else f"k{i}": value(depth - 1) for i in range(r.randint(0, 4))}


def leaves(v):
    if isinstance(v, (list, dict)):
        return [x for y in ((v[k] for k in sorted(v)) if isinstance(v, dict) else v) for x in leaves(y)]
    return [v]


def test_nested_documents(spark):
    values = {i: value(5) for i in range(300)} | {1000: [[[[[[[[[["deep"]]]]]]]]]], 1001: [], 1002: {}, 1003: "leaf of its own", 1004: None}
    rows = [(i, json.dumps(v)) for i, v in values.items()] + [(2000, "no json at all"), (2001, None), (2002, '{"a":')]
    docs = spark.createDataFrame(rows, "id long, j string")
    tokens = {x["id"]: x["tokens"] for x in variants.nested_tokens(docs, ["id"], "j").collect()}
    assert tokens == {i: count_tokens(v) for i, v in values.items()} | {2000: 4, 2001: 0, 2002: 1}
    flat = {x["id"]: x["values"] for x in variants.flattened(docs, ["id"], "j").collect()}
    as_text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    lists = {i: [as_text(x) for x in leaves(v)] for i, v in values.items() if not isinstance(v, dict) and leaves(v)}
    assert {i: flat[i] for i in lists} == lists and sorted(flat) == sorted(i for i, v in values.items() if leaves(v))


def test_truncated_documents(spark):
    docs = [(1, '{"doc": "a b  c d", "members": [1], "x": {"y": [null]}}'), (2, '{"doc": "a  b"}'), (3, '{"members": []}'), (4, '{"doc": 5}'), (5, "[1]"), (6, "text"), (7, None), (8, "{}")]
    found = variants.truncated(spark.createDataFrame(docs, "id long, j string"), ["id"], "j", 3)
    assert {x["id"]: json.loads(x["j"]) for x in found.collect()} == {1: {"doc": "a b c", "x": {"y": [None]}}, 2: {"doc": "a  b"}, 3: {}, 4: {"doc": 5}, 8: {}}
