"""The best path through a lattice against all paths, and a lexicon's numbers."""

import math
import random

from pyspark.sql import functions as F

from tessera.functions import metrics, pyfuncs
from tessera.operators import segmentation


def all_paths(piece):
    if not piece:
        yield []
    for k in range(1, len(piece) + 1):
        for rest in all_paths(piece[k:]):
            yield [piece[:k], *rest]


def test_best_path_equals_all_paths():
    r = random.Random(5)
    for _ in range(150):
        counts = {"".join(r.choices("abc", k=r.randint(1, 4))): r.randint(1, 30) for _ in range(8)}
        lattice, piece = segmentation.Lattice(counts), "".join(r.choices("abcd", k=r.randint(1, 9)))
        total = sum(counts.values())
        cost = lambda w: math.log(counts[w] / total) if w in counts else math.log(0.5 / total) if len(w) == 1 else -math.inf
        most = max(sum(map(cost, p)) for p in all_paths(piece))
        found = lattice.cut(piece)
        assert "".join(found) == piece and math.isclose(sum(map(cost, found)), most)


def test_segmented_columns_in_metrics(spark):
    corpus = spark.createDataFrame([("我们 喜欢 学习 中文",), ("我们 学习",), ("喜欢 中 文",), (None,)], "t string")
    counts = segmentation.lexicon(corpus, "t")
    assert counts["我们"] == 2 and counts["中文"] == 1 and segmentation.lexicon(corpus, "t", 2) == {"喜欢": 2, "学习": 2}
    cut = segmentation.segmenter(counts)
    rows = spark.createDataFrame([("我们喜欢学习", "我们学习"), ("", "中文"), (None, "x")], "p string, t string").select(cut("p").alias("p"), cut("t").alias("t"))
    found = rows.select("p", metrics.multiset_f1(F.col("p"), F.col("t")).alias("f"), pyfuncs.rouge(F.array_join("p", " "), F.array_join("t", " ")).alias("r")).collect()
    assert found[0]["p"] == ["我们", "喜欢", "学习"] and math.isclose(found[0]["f"], 0.8) and math.isclose(found[0]["r"], 0.8)
    assert [r["p"] for r in found[1:]] == [[], []] and [r["f"] for r in found[1:]] == [0.0, 0.0]


def test_segmented_in_parts(spark, monkeypatch):
    """The words are those of the column function, whatever a worker holds at a time."""
    monkeypatch.setattr(segmentation, "CHARACTERS", 5)
    counts = {"ab": 3, "c": 2, "abc": 1}
    rows = spark.createDataFrame([(i, "abcab" * (i % 4), None if i % 5 == 0 else "cc d" * i) for i in range(40)], "i int, a string, b string").coalesce(1)
    cut = segmentation.segmenter(counts)
    assert sorted(segmentation.segmented(rows, ["a", "b"], counts).collect()) == sorted(rows.select("i", cut("a").alias("a"), cut("b").alias("b")).collect())
