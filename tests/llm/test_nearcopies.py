"""Near copies against brute force over all pairs, and the rows that the pipeline's stage keeps of repeated and null doc_id."""

import math
import random

import numpy as np
import pytest

from tessera.llm import nearcopies

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard_groups(texts):
    sets = [set(nearcopies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    return root


def texts_at_the_edge():
    """Originals with copies around similarity 0.8, shared passages and short texts."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, texts = [word() for _ in range(60)], []
    for k in range(60):
        own = [word() for _ in range(rng.choice([5, 6, 8, 9, 20, 60, 150, 400]))] + (passage if k % 3 == 0 else [])
        texts.append(" ".join(own))
        for changes in (1, 2, 3, 4, len(own) // 60, len(own) // 45, len(own) // 35):
            copy = list(own)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: len(copy) - rng.randrange(2)]))
    return texts + ["", "  ", None, "a b", "A B", "a b c"]


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    return corpus_pipeline.drop_near_duplicates(spark, docs, "")


@pytest.mark.parametrize("block, often, broadcast", [(512, 8, 200_000), (3, 1, 0)])
def test_groups_against_all_pairs(spark, monkeypatch, block, often, broadcast):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "OFTEN", often)
    monkeypatch.setattr(nearcopies, "BROADCAST_ROWS", broadcast)
    texts = texts_at_the_edge()
    root = jaccard_groups(texts)
    kept = sorted(r["doc_id"] for r in run(spark, list(enumerate(texts))).collect())
    assert kept == [k for k, r in enumerate(root) if r == k] and len(kept) < len(texts)


def test_shingles_are_those_of_the_words():
    """As many distinct ones, and as many shared ones, as by sets of strings."""
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcAB\u00c9") for _ in range(rng.randrange(40))] for _ in range(2))
        plain = [{" ".join(w).encode().lower() for w in (zip(*(t[i:] for i in range(5))) if len(t) >= 5 else [t] if t else [])} for t in (a, b)]
        own = [set(nearcopies.shingles(" ".join(t)).tolist()) for t in (a, b)]
        assert [len(x) for x in own] == [len(x) for x in plain] and len(own[0] & own[1]) == len(plain[0] & plain[1])


def test_radius_of_linked_texts():
    """Distances at similarity 0.8 stay within the radius with room to spare, those of unrelated texts outside it."""
    rng = np.random.default_rng(9)
    near, far = [], []
    for n in (9, 18, 90, 900):
        for _ in range(150):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            b[: n // 9] = rng.integers(0, 2**63, n // 9).astype(np.uint64)  # 8/9 shared: Jaccard 0.8
            c = rng.integers(0, 2**63, n).astype(np.uint64)
            fa, fb, fc = map(nearcopies.fingerprint, (a, b, c))
            near.append(int(np.bitwise_count(fa ^ fb).sum()))
            far.append(int(np.bitwise_count(fa ^ fc).sum()))
    assert max(near) <= nearcopies.RADIUS < min(far)


def differing(a, b, both):
    """How likely a majority bit differs between sets of a and b shingles that share ``both``, ties counting as no majority."""
    chance = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]
    over = lambda own, n, t: sum(p for k, p in enumerate(own) if 2 * k - n > t)
    total = 0.0
    for k, p in enumerate(chance(both)):
        one, other = over(chance(a - both), a - both, both - 2 * k), over(chance(b - both), b - both, both - 2 * k)
        total += p * (one * (1 - other) + (1 - one) * other)
    return total


def test_radius_is_proven_over_all_sizes():
    worst = max(differing(a, b, c) for b in range(1, 41) for a in range(nearcopies.SMALL + 1, b + 1) for c in range(a + 1) if 5 * c >= 4 * (a + b - c))
    assert worst < 0.1612 and differing(4, 5, 4) == 0.1875
    n = nearcopies.BITS
    assert sum(math.comb(n, k) * worst**k * (1 - worst) ** (n - k) for k in range(nearcopies.RADIUS + 1, n + 1)) < 1e-17


def test_nested_texts_are_never_lost(spark):
    """Thousands of texts against their beginnings at a similarity of exactly 0.8: 4 of 5, 8 of 10 and 12 of 15 shingles."""
    rng = random.Random(17)
    texts = ["w60997 w113512 w108915 w169629 w148402 w179316 w191264 w198805 w156313"] + [" ".join(f"w{rng.randrange(200_000)}" for _ in range((9, 14, 19)[k % 3])) for k in range(6000)]
    cut = lambda t: " ".join(t.split()[: len(t.split()) - (len(t.split()) - 4) // 5])
    rows = [(2 * k + side, cut(t) if side else t) for k, t in enumerate(texts) for side in (0, 1)]
    assert sorted(r["doc_id"] for r in run(spark, rows).collect()) == [2 * k for k in range(len(texts))]


def test_close_copies_are_found_by_fingerprints(spark, monkeypatch):
    """Copies of a changed word in 600 are filed under bit blocks of their fingerprints: no shingle is needed to find them."""
    monkeypatch.setattr(nearcopies, "prefix", lambda found, common: found[:0])
    rng = random.Random(19)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(50_000)}" for _ in range(600)]
        for side in range(3):
            rows.append((3 * k + side, " ".join(words)))
            words[rng.randrange(600)] = f"new{k}"
    assert sorted(r["doc_id"] for r in run(spark, rows).collect()) == [3 * k for k in range(40)]


def test_prefix_order_puts_common_last():
    found = nearcopies.shingles(" ".join(f"w{i}" for i in range(54)))
    common = found[:45]
    assert set(found[45:].tolist()) <= set(nearcopies.prefix(found, common).tolist())
    assert np.array_equal(nearcopies.prefix(found, common[:0]), found[:11])


def long_text(seed):
    return " ".join(f"x{seed}y{i}" for i in range(40))


def test_repeated_and_null_doc_id(spark):
    a, b, c, d, e = map(long_text, range(5))
    rows = [(1, a), (1, a), (1, b), (2, b), (None, b), (None, c), (None, c), (None, d), (3, d), (None, e)]
    kept = sorted(((r["doc_id"], r["text"]) for r in run(spark, rows).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, c), (3, d), (None, e)], key=str)


def test_empty_table(spark):
    assert run(spark, []).collect() == []


def test_clashing_and_extra_columns(spark):
    rows = [(k, long_text(k // 2), f"x{k}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy string")
    for name in ("name_id", "name_copy", "kept", "n", "node", "group_id", "first"):
        docs = docs.withColumn(name, docs["copy"])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["copy"], r["group_id"]) for r in out.collect()) == [(0, "x0", "x0"), (2, "x2", "x2"), (4, "x4", "x4")]
