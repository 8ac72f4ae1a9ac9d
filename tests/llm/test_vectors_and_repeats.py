"""Hard negatives, repeated substrings and vector codes against plain versions, on edge rows and on skewed tables."""

import random
import re

import numpy as np
import pytest

from tessera.llm import hamerly, recompress, vafile

VECTORS = "vec_id long, label int, embedding array<float>, extra string"


def vector_rows(seed=3, n=500, d=16, equal=0):
    r = np.random.default_rng(seed)
    rows = [(i, i % 3, [float(x) for x in r.normal(size=d).astype(np.float32)], "x") for i in range(n)]
    rows += [(n + i, 1, rows[7][2], "x") for i in range(equal)]
    odd = [None, [], [1.0, None] * (d // 2), [float("nan")] * d, [float("inf")] * d, [1.0] * (d - 1), [0.0] * d, [1e30] * d]
    rows += [(10_000 + 100 * i, 1, v, "x") for i, v in enumerate(odd)]
    return rows + [(None, 1, [0.5] * d, "x"), (20_000, None, [0.5] * d, "x"), (None, None, None, None), rows[100], rows[100], (200, 2, [9.0] * d, "y")]


def usable(v, d, largest):
    return v is not None and len(v) == d and all(x is not None and np.isfinite(x) and abs(x) < largest for x in v)


def plain_negatives(rows, d, every, positives, negatives):
    once = {}
    for i, label, v, _ in rows:
        if i is not None and label is not None and usable(v, d, vafile.LARGEST / 256):
            row = (label, [int(np.floor(256 * x)) for x in v])
            once[i] = min(once.get(i, row), row)
    ids = sorted(once)
    out = []
    for a in (i for i in ids if i % every == 0):
        score = sorted(((-sum(x * y for x, y in zip(once[a][1], once[b][1])), b) for b in ids if b != a))
        for s, p in [x for x in score if once[x[1]][0] == once[a][0]][:positives]:
            found = [(a, p, b, -s, -t) for t, b in score if once[b][0] != once[a][0] and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(*x[:2], k + 1, *x[2:]) for k, x in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("equal", [0, 700])
def test_hard_negatives(spark, monkeypatch, equal):
    """Over several blocks on both sides; with most rows holding one vector."""
    monkeypatch.setattr(vafile, "ANCHORS", 4)
    monkeypatch.setattr(vafile, "ROWS", 100)
    rows = vector_rows(equal=equal)
    found = vafile.mine(spark.createDataFrame(rows, VECTORS), every=50, positives=5, negatives=10)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows, 16, 50, 5, 10)
    assert vafile.mine(spark.createDataFrame([], VECTORS)).collect() == []


def test_cells_bound_every_score():
    r = np.random.default_rng(1)
    x = r.integers(-300, 300, size=(500, 8))
    x[0] = 100_000
    cells = vafile.Cells(x[1:200], x.min(axis=0), x.max(axis=0))
    codes = [np.ascontiguousarray(c) for c in cells.codes(x).T.astype(np.intp)]
    for a in x[:20]:
        low, high = cells.bounds(a, codes)
        assert (low <= x @ a).all() and (x @ a <= high).all()
    assert np.median((high - low)[1:]) < 0.2 * np.abs(x[1:] @ a).max()  # they tell something


def plain_codes(rows, d, parts=8, entries=16, rounds=6):
    kept = [(i, label, [int(np.floor(4096 * x)) for x in v]) for i, label, v, _ in rows if usable(v, d, hamerly.LARGEST / 4096)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in kept], dtype=np.int64)
    cuts = [slice(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    books = [x[:entries, c].copy() for c in cuts]
    for k in range(rounds + 1):
        distance = [((x[:, None, c] - b[None]) ** 2).sum(axis=2) for c, b in zip(cuts, books)]
        codes = [t.argmin(axis=1) for t in distance]
        for p in range(parts) if k < rounds else []:
            for e in set(codes[p].tolist()):
                rows_of = x[codes[p] == e][:, cuts[p]]
                books[p][e] = [int(s) // len(rows_of) for s in rows_of.sum(axis=0)]
    error = sum(t.min(axis=1) for t in distance)
    return kept, np.stack(codes, axis=1).tolist(), error.tolist(), books


@pytest.mark.parametrize("d, n", [(16, 500), (19, 300), (16, 5), (3, 60)])
def test_hamerly_equals_plain_rounds(spark, d, n):
    rows = vector_rows(seed=d, n=n, d=d) if n > 100 else [(i % 40, i % 3, [float(x) for x in np.random.default_rng(i).integers(-3, 3, d) / 4096], "x") for i in range(n)]
    made = hamerly.Compressor()
    found = hamerly.label_errors(made.compress(spark.createDataFrame(rows, VECTORS))).collect()
    kept, codes, error, books = plain_codes(rows, d)
    assert all(np.array_equal(a, b) for a, b in zip(made.books, books))
    total = {}
    for r, e in zip(kept, error):
        total[r[1]] = total.get(r[1], 0) + e
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found), key=key) == sorted(((r[0], c, e, total[r[1]]) for r, c, e in zip(kept, codes, error)), key=key)
    if n == 500:
        assert made.scans[-1] < made.scans[0]  # bounds spare scans


def test_codes_of_an_empty_table(spark):
    made = hamerly.Compressor()
    assert hamerly.label_errors(made.compress(spark.createDataFrame([(1, 1, None, "x")], VECTORS))).collect() == []
    assert len(made.seal()) == 64


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(rows, window=20):
    """(doc_id, n_words, n_removed, kept) of each row."""
    named = sorted({(i is None, i or 0, __import__("hashlib").md5((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    seen, told = set(), {}
    for none, i, _, text in named:
        found = SPACE.findall(text)
        gone = set()
        for at in range(len(found) - window + 1):
            key = tuple(found[at : at + window])
            if key in seen:
                gone |= set(range(at, at + window))
            seen.add(key)
        told[None if none else i, text] = (len(found), len(gone), " ".join(w for k, w in enumerate(found) if k not in gone))
    return sorted(((i, *told[i, t or ""]) for i, t in rows), key=repr)


def found_repeats(spark, rows):
    out = recompress.deduplicate(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string"))
    got = out.collect()
    for r in got:
        assert sum(s["end"] - s["begin"] for s in r["removed"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr)


def test_repeats_on_few_words(spark):
    """Texts of few different words, so that runs, periods and repeats of every length are there."""
    r = random.Random(6)
    rows = []
    for i in range(400):
        words = r.choices(["a", "b", "ç", "dd"][: r.randint(1, 4)], k=r.randint(0, 120))
        rows.append((i, r.choice([" ", "\t", " \n\x0b"]).join(words)))
    period = ["x y z " * 30, "y z x " * 25, "q " * 300, "q " * 19, "q " * 20]
    rows += [(1000 + i, t) for i, t in enumerate(period)]
    assert found_repeats(spark, rows) == plain_repeats(rows)


def test_repeats_in_long_texts_and_copies(spark):
    r = random.Random(7)
    new = lambda n: " ".join(str(r.random()) for _ in range(n))
    passage, document = new(60), new(200)
    rows = [(i, f"{new(r.randint(0, 40))} {passage} {new(30)}") for i in range(60)]
    rows += [(100 + i, document) for i in range(50)] + [(300 + i, document.replace(document.split()[k := 20 + 3 * i], "other")) for i in range(30)]
    rows += [(None, document), (None, None), (7, None), (8, ""), (9, " \t\r\n\x0b\x0c"), (400, "nbsp is no space " * 30), (401, "one"), (2, passage), (2, passage), (2, new(50)), (500, new(30_000) + " " + passage), (501, "w" * 300_000 + " " + passage)]
    rows += [(600, "short text"), (601, "short text"), (602, "short text")]
    assert found_repeats(spark, rows) == plain_repeats(rows)
    assert recompress.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(8)
    for letters in (1, 2, 3, 50, 10**6):
        names = recompress.mix(r.integers(0, letters, 5000).astype(np.uint64), 1)
        names[3000:3400] = names[100:500]
        text = np.sort(r.integers(0, 9, 5000))
        begin, name, where = recompress.anchors(names, text)
        by = {}
        for b, n, w in zip(begin.tolist(), name.tolist(), where.tolist()):
            by.setdefault(tuple(names[b : b + 20].tolist()), set()).add((n, w // (2 * recompress.ROUNDS + 1) - b))
        assert all(len(x) == 1 for x in by.values())
        if letters > 50:
            assert len(set(where.tolist())) < len(begin) / 4
    assert len(recompress.anchors(names[:19], text[:19] * 0)[0]) == 0
