"""Concatenated JSON by byte ranges against the plain decoder, and writes that are whole or not there."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import jsonsource


def texts(seed, n=200):
    """Objects whose strings look like the ends and beginnings of objects."""
    r = random.Random(seed)
    tricky = ["}{", '}{"a":1}{', "{}", "}{}{}", '"', "\\", '\\"}{', "é中😀", "}\n{", "", " } { ", ', ":": 1, ']

    def value(depth):
        kind = r.randrange(6 if depth else 4)
        if kind < 3:
            return "".join(r.choices(tricky, k=r.randint(0, 6)))
        if kind == 3:
            return r.choice([1, -2.5e-3, True, None])
        return [value(depth - 1) for _ in range(r.randint(0, 3))] if kind == 4 else {r.choice(tricky): value(depth - 1) for _ in range(r.randint(0, 3))}

    return [json.dumps({f"k{i}": value(3) for i in range(r.randint(0, 3))}, ensure_ascii=r.random() < 0.5) for _ in range(n)]


def plain(text):
    decoder, at, out = json.JSONDecoder(), 0, []
    while at < len(text.rstrip()):
        while text[at] in " \n\t":
            at += 1
        _, end = decoder.raw_decode(text, at)
        out.append(text[at:end])
        at = end
    return out


@pytest.mark.parametrize("between", ["", " ", "\n\n \t"])
@pytest.mark.parametrize("size", [7, 64, 1000])
def test_ranges_equal_the_plain_decoder(tmp_path, between, size):
    text = between.join(texts(size)) + between
    path = f"{tmp_path}/x.json"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    reader = jsonsource._Reader({"path": path, "rangebytes": str(size)})
    parts = reader.partitions()
    assert len(parts) == -(-len(text.encode()) // size)
    found = [row for part in parts for row in reader.read(part)]
    assert [v for _, _, v in found] == plain(text)
    assert [b for _, b, _ in found] == sorted(b for _, b, _ in found)


def test_through_spark(spark, tmp_path):
    jsonsource.register(spark)
    os.makedirs(f"{tmp_path}/in")
    for name in ("a", "b"):
        with open(f"{tmp_path}/in/{name}.json", "w", encoding="utf-8") as f:
            f.write("".join(texts(name)))
    open(f"{tmp_path}/in/empty.json", "w").close()
    rows = spark.read.format("concatenated_json").option("rangeBytes", 5000).load(f"{tmp_path}/in")
    assert rows.rdd.getNumPartitions() > 4
    assert [r["value"] for r in rows.orderBy("file", "begin").collect()] == texts("a") + texts("b")


@pytest.mark.parametrize("text", ['{"a": 1} x {"b": 2}', '{"a": ', "[1]", '{"a": 1}{"b"}'])
def test_anything_else_fails(tmp_path, text):
    with open(f"{tmp_path}/x", "w") as f:
        f.write(text)
    reader = jsonsource._Reader({"path": f"{tmp_path}/x"})
    with pytest.raises(ValueError):
        [row for part in reader.partitions() for row in reader.read(part)]


def test_log_is_whole_or_not_there(spark, tmp_path):
    jsonsource.register(spark)
    path = f"{tmp_path}/log"
    lines = spark.range(100, numPartitions=4).select(F.to_json(F.struct("id")).alias("value"))
    lines.write.format("json_log").mode("append").save(path)
    assert spark.read.json(path).count() == 100
    spoiled = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.lit("two\nlines")).otherwise(F.lit("{}")).alias("value"))
    with pytest.raises(Exception, match="line"):
        spoiled.write.format("json_log").mode("append").save(path)
    assert spark.read.json(path).count() == 100 and not [f for f in os.listdir(path) if "staging" in f]
    lines.write.format("json_log").mode("append").save(path)
    assert spark.read.json(path).count() == 200
    lines.limit(5).write.format("json_log").mode("overwrite").save(path)
    assert spark.read.json(path).count() == 5
