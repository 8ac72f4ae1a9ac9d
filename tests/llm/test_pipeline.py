"""The pipeline's stages on the smallest tables, each against a plain version over the rows it was given."""

import hashlib
import math
import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tessera.llm import bpe, langid  # noqa: E402
from tessera.llm.common import scope, shared_dir, stored  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def poisson(doc_id, text, rate):
    u = int(hashlib.md5(f"{doc_id}:{hashlib.md5(text.encode()).hexdigest()}:42:0".encode()).hexdigest()[:13], 16) / 2**52
    p = total = math.exp(-rate)
    n = 0
    while total <= u:
        n += 1
        p *= rate / n
        total += p
    return n


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, given = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    outputs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outputs.append(docs.collect())
        assert k == 4 or docs.columns == columns

    parser = langid.CrossParser(langid.sample(spark.read.parquet(f"{DATA}/documents.parquet")))
    names, scores = parser.predict([r["text"] for r in given.values()])
    kept = {i for i, name, score in zip(given, names, scores) if name != "und" and score >= corpus_pipeline.LEAST_SCORE}
    assert {r["doc_id"] for r in outputs[0]} == kept

    judged = {r["doc_id"] for r in outputs[1]}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i for i in kept if i in labels and labels[i]["quality"] == 1 and not labels[i]["toxic"]]
    assert judged <= kept and sum(i in judged for i in good) >= 0.95 * len(good)

    ids = sorted(judged)
    words = [(given[i]["text"] or "").encode().lower().split() for i in ids]
    sets = [set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    root = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert sorted(r["doc_id"] for r in outputs[2]) == [i for at, i in enumerate(ids) if root[at] == at]

    size = {}
    for r in outputs[2]:
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"].encode())
    weight = {s: math.sqrt(n) for s, n in size.items()}
    rate = {s: sum(size.values()) * weight[s] / sum(weight.values()) / size[s] for s in size}
    assert sorted(r["doc_id"] for r in outputs[3]) == sorted(r["doc_id"] for r in outputs[2] for _ in range(poisson(r["doc_id"], r["text"], rate[r["source"]])))

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    assert sorted(r["doc_id"] for r in outputs[4]) == sorted(r["doc_id"] for r in outputs[3])
    for r in outputs[4]:
        assert r["round_trip"] and r["token_ids"] == library.encode_ordinary(given[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["token_ids"])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the old house by the river was sold last year and nobody knows who lives there now because its owner never came back".split()


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and null or repeated doc_id."""
    rows = [(k, " ".join(WORDS[k % 7 :] + [f"number {k}"] * (k % 3)), "en", f"s{k % 2}", 9) for k in range(30)]
    rows += [(100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \t", "en", "s1", 2), (103, "12 !!", "en", "s0", 5), (None, "the row of its own that carries no number at all but now and then some words", None, None, None), (None, None, None, None, None)]
    return rows + [rows[0], rows[0], (0, "another text under the same number " * 3, "en", "s0", 1), (104, " ".join(WORDS * 3000), "en", "s1", 1)]


@pytest.mark.parametrize("number", range(5))
def test_stages_on_edge_rows(spark, tmp_path, number):
    """Every stage with clashing names, and on an empty table; what each keeps is said in its docstring."""
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(103, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(edge_rows(), COLUMNS)
    for name in ("lang_pred", "score", "perplexity", "threshold", "kept", "chunk", "token_ids", "decoded", "n_copies", "copy", "mix_key", "rate", "node", "group_id", "name_id"):
        docs = docs.withColumn(name, docs["source"])
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert number == 4 or out.columns == docs.columns
    texts = [r["text"] for r in rows] if number < 4 else []
    assert all(r["score"] == r["source"] for r in rows if number < 4)
    if name == "language_id":
        assert len(rows) == sum(any(c.isalpha() for c in t or "") for _, t, *_ in edge_rows())
    elif name == "quality":
        assert not any((t or "").strip() == "" for t in texts) and sum(t.startswith(tuple(WORDS[:7])) for t in texts) >= 20
    elif name == "simhash":
        assert sum((t or "").strip() == "" for t in texts) == 1 and texts.count(edge_rows()[0][1]) == 1
        assert sum(r["doc_id"] is None and r["text"] is not None for r in rows) == 1 and any("another text" in (t or "") for t in texts)
    elif name == "mixing":
        repeats = [r for r in rows if r["doc_id"] == 0 and "another" not in r["text"]]
        assert len(repeats) % 3 == 0 and {r["doc_id"] for r in rows} <= {i for i, *_ in edge_rows()}
    else:
        assert len(rows) == len(edge_rows()) and all(r["round_trip"] for r in rows)
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_run_leaves_no_folder(spark, monkeypatch):
    def folders():
        return set(os.listdir(shared_dir(spark).removeprefix("file:")))

    before = folders()
    with scope():
        found = corpus_pipeline.run(spark, DATA)
        assert len(folders() - before) == 1  # what the last stage's plan reads
        assert found.count() > 0
    assert folders() <= before

    def fails(spark, docs, sf_dir):
        stored(docs).count()
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[3], ("fails", fails), corpus_pipeline.STAGES[4]])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, DATA)
    assert folders() <= before
