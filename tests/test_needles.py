"""Needles by minimizers against plain search."""

import random

import numpy as np

from tessera.operators import needles, retrieval


def test_contained_texts_share_all_minimizers():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choices("abé ", k=r.randint(0, 300)))
        begin = r.randint(0, len(text))
        part = text[begin : begin + r.randint(0, 120)]
        assert np.isin(needles.minimizers(part), needles.minimizers(text)).all()
        assert len(needles.minimizers(part)) > 0 or len(part.encode()) < needles.LEAST


def test_many_needles_equal_plain_search(spark, monkeypatch):
    r = random.Random(3)
    words = [f"word{k}" for k in range(60)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 80)))) for i in range(150)] + [(900, None), (None, "word1 word2")]
    docs += [(1000 + i, "the same boilerplate line that many documents have " + str(i % 3)) for i in range(60)]
    items = [(i, d[1][(b := r.randint(0, 200)) : b + r.randint(1, 90)]) for i, d in enumerate(r.choices([d for d in docs if d[1]], k=120))]
    items += [(500, "the same boilerplate line that many documents have"), (501, "nowhere to be found in any of the documents"), (502, ""), (503, None), (504, "word1"), (None, "word2 word3 and so on and so forth")]
    expected = sorted((i, d) for i, n in items if n and i is not None for d, t in docs if t and d is not None and n in t)
    asked, texts = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for bound in (20_000, 30):
        monkeypatch.setattr(retrieval, "NEEDLES", bound)
        assert sorted(tuple(x) for x in retrieval.containment(asked, texts).select("item_id", "doc_id").collect()) == expected
