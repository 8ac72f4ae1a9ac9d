"""Quirks, invariants and plain-Python models."""

import itertools
import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import diagnostics, jsonfix, pyfuncs, text, tokens, vectors, versions
from tessera.operators import deps, dispatch, packing, plugins, retrieval, windows
from tessera.sources import files, longcontext, outputs
from tessera.streaming import events


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def test_cleaners(spark):
    df = one(spark, "x <start>```python\na = 1\n```<end> tail")
    row = df.select(*[f(F.col("v")).alias(n) for n, f in text.CLEANERS.items()]).first()
    assert row["basic"] == row["loose"] == row["lora"] == row["errorfix"] == "\na = 1\n" and row["py_wrapper_first"] == "a = 1"
    assert one(spark, "a <end> b <start>c").select(text.clean_basic(F.col("v"))).first()[0] == ""
    assert one(spark, None).select(text.clean_basic(F.col("v"))).first()[0] is None
    with pytest.raises(ValueError):
        text.cleaner("nothing")


def test_packages(spark):
    assert one(spark, "seaborn.heatmap").select(text.api_package(F.col("v")), text.api_package(F.col("v"), compat=True)).first()[:] == ("seaborn", "sns")
    assert one(spark, "matplotlib.pyplot.plot").select(text.api_package(F.col("v"), use_aliases=False)).first()[0] == "matplotlib"


def test_versions(spark):
    df = spark.createDataFrame([("p", v) for v in ("1.0", "1.0.1", "x", "2")], "pkg string, version string")
    near = {r["other"]: r["rank"] for r in deps.closest_versions(df, 3).filter("version = '1.0'").collect()}
    assert near["1.0.1"] == 1 and near["x"] == 3
    assert {r["other"]: r["rank"] for r in deps.closest_versions(df, 3, compat=True).filter("version = '1.0'").collect()}["x"] == 1
    assert one(spark, "1").select(versions.same_minor(F.col("v"), F.col("v"))).first()[0] is False


def test_cap_edges(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(["python", "a", "b", "python", "c"])], "task int, ord int, pkg string")
    assert [r["pkg"] for r in deps.cap_dependencies(df, 2, ["ord"]).orderBy("ord").collect()] == ["python", "a", "b"]
    assert deps.cap_dependencies(df, 0, ["ord"]).count() == 0 and deps.cap_dependencies(df, None, ["ord"]).count() == 5


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.integers(1, 9))
def test_contiguous_shards_cover(n, world):
    size, rest = divmod(n, world)
    sizes = [size + (r < rest) for r in range(world)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_contiguous_shard_equals_ntile(spark):
    for n, w in itertools.product((1, 7, 10, 24), (1, 3, 7)):
        rows = windows.ordinal(spark.range(n).withColumnRenamed("id", "k"), ["k"])
        got = [r[0] for r in rows.orderBy("k").select(windows.contiguous_shard(F.col("ordinal"), n, w)).collect()]
        size, rest = divmod(n, w)
        assert got == [r for r in range(w) for _ in range(size + (r < rest))]


def test_bounded_segments_model(spark):
    r = random.Random(1)
    for _ in range(3):
        flags = [r.random() < 0.3 for _ in range(80)]
        df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "s int, p int, boundary boolean")
        got = [(x["begin"], x["length"]) for x in windows.bounded_segments(df, "s", "p", 4, 9).orderBy("begin").collect()]
        lengths, run = [], 0
        for f in flags:
            if (f and run >= 4) or run >= 9:
                lengths.append(run)
                run = 0
            run += 1
        lengths.append(run)
        assert got == list(zip(itertools.accumulate([0, *lengths[:-1]]), lengths))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=30))
def test_first_fit_model(sizes):
    block, bins, own = 512, [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        place = next((b for b, room in enumerate(bins) if room >= sizes[i]), None)
        if place is None:
            place = len(bins)
            bins.append(block)
        bins[place] -= sizes[i]
        own[i] = place
    assert packing.first_fit(sizes, block) == [own[i] for i in range(len(sizes))]


def test_progressive_fill_rules():
    assert packing.progressive_fill([[(1, 5)], [(1, 5), (2, 9)]], [[(1, 5), (3, 4)], [(4, 2)]], 10) == [1, 3]
    assert packing.progressive_fill([[(1, 5), (2, 6)], [(3, 5)]], [[], []], 10) == [1, 3]
    assert packing.progressive_fill([[], []], [[(1, 3), (2, 3)], [(1, 3)]], 10) == [1, 1, 2]


def test_tokens(spark):
    df = spark.createDataFrame([(list(range(10)),), ([],)], "t array<int>")
    parts = df.select(tokens.chunks(F.col("t"), 4)).collect()
    assert [x[0] for x in parts] == [[[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]], []]
    assert [r[0] for r in df.select(tokens.keep_last(F.col("t"), 3)).collect()] == [[7, 8, 9], []]
    assert df.select(tokens.next_token_labels(F.col("t"), F.lit(-1))).first()[0] == [*range(1, 10), -1]
    with pytest.raises(Exception, match="prefix leaves no room"):
        df.select(tokens.prefixed_chunks(F.array(F.lit(1), F.lit(2)), F.col("t"), 2)).collect()


def test_pass_at_k_and_best_of_k(spark):
    for n, c, k in itertools.product((5, 9), (0, 2, 5), (1, 3)):
        expected = 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
        got = spark.createDataFrame([(n, c)], "n int, c int").select(vectors.pass_at_k(F.col("n"), F.col("c"), k)).first()[0]
        assert got == pytest.approx(expected)
    scores = [3.0, 1.0, 4.0, 1.5, 9.0]
    best = sum(max(x) for x in itertools.combinations(scores, 3)) / math.comb(5, 3)
    assert one(spark, scores, "array<double>").select(vectors.best_of_k(F.col("v"), 3)).first()[0] == pytest.approx(best)


def test_json_repair():
    whole = [{"path": "a", "description": "b"}, {"path": "c"}]
    assert jsonfix.repair(f"```json\n{json.dumps(whole)}\n```") == whole
    text = json.dumps(whole)
    assert [jsonfix.repair(text[:-n])[1:] for n in (8, 7, 3, 2, 1)] == [[{"path": ""}], [{"path": None}], [{"path": "c"}], [{"path": "c"}], [{"path": "c"}]]
    assert jsonfix.completed('{"a": [1, {"b": "x\\"') == {"a": [1, {"b": 'x"'}]} and jsonfix.completed('{"a": 1, ') == {"a": 1} and jsonfix.completed("{a") is None
    assert jsonfix.repair("[{'a': 1}, ]") == [{"a": 1}] and jsonfix.repair('[{"a": 1}') == [{"a": 1}]
    assert jsonfix.repair('text {"a": "}"} {b') == [{"a": "}"}] and jsonfix.repair(None) == []
    assert jsonfix.extract_queries('["x", {"description": "x"}, {"b": 1, "a": 2}, {"a": 2, "b": 1}]') == ['{"description": "x"}', '{"a": 2, "b": 1}']


def test_python_functions():
    assert pyfuncs.rouge_l("a b c d", "a c d e") == pytest.approx(0.75) and pyfuncs.rouge_l("", "a") == 0
    assert pyfuncs.resolve_api("import numpy as np", "np.linalg.norm") == "numpy.linalg.norm"
    assert pyfuncs.has_fstring("f'{x}'") and not pyfuncs.has_fstring("'x'") and not pyfuncs.has_fstring("def (")
    assert pyfuncs.identifier_prefix("foobar = 1", "foobaz") == pytest.approx(5 / 6)
    assert pyfuncs.without_annotations("def f(a: int) -> int:\n    x: int = 1\n    return x") == "def f(a):\n    x = 1\n    return x"
    assert not pyfuncs.is_valid("def (") and pyfuncs.is_valid("")
    assert pyfuncs.fuzzy_first_line("# no\nabc", "abd") == 0.67


def test_plugins(spark):
    for call in (lambda: plugins.prompt("report", "v9"), lambda: plugins.embed(F.lit("x"), "none"), lambda: plugins.generate(F.lit("x"), "none"), lambda: plugins.check(F.lit("x"), "none")):
        with pytest.raises(ValueError):
            call()
    assert one(spark, "def (").select(F.size(plugins.check(F.col("v")))).first()[0] == 1
    vector = one(spark, "").select(plugins.embed(F.col("v"))).first()[0]
    assert len(vector) == plugins.EMBEDDING_SIZE and sum(x * x for x in vector) == pytest.approx(1)


def test_diagnostics(spark):
    df = one(spark, "hint: x\nNote: y")
    assert df.select(diagnostics.without_noise(F.col("v"))).first()[0] == "No errors found"
    assert one(spark, "a\nb").select(diagnostics.diagnostic_text(F.lit("m"), F.lit(7), F.col("v"))).first()[0] == "Line 8: \nError: m"


def test_files(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"id": "1", "answer": "x"}\n\nnot json\n{"id": "2"}\n')
    rows, bad = files.read_jsonl_tolerant(spark, str(lines), "id STRING, answer STRING")
    assert sorted(r["id"] for r in rows.collect()) == ["1", "2"] and [r[0] for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(lines), "id STRING").collect()
    array = tmp_path / "b.json"
    array.write_text('[{"id": "1"}, {"id": "2"}]')
    assert files.read_json_by_name(spark, str(array), "id STRING").count() == 2 == files.read_json_by_name(spark, str(lines), "id STRING").count()
    files.json_to_jsonl(spark, str(array), str(tmp_path / "c"), "id STRING")
    assert files.read_jsonl(spark, str(tmp_path / "c"), "id STRING").count() == 2
    (tmp_path / "d.txt").write_text('{"a": {"b": 1}}{"c": "}"}\n {"d": 2} {"cut')
    assert [r["value"] for r in files.read_concatenated_json(spark, str(tmp_path / "d.txt")).orderBy("ordinal").collect()] == ['{"a": {"b": 1}}', '{"c": "}"}', '{"d": 2}']
    corpus = spark.createDataFrame([("p", "1.0", "l1"), ("q", "2.0", "l2")], "pkg string, version string, value string")
    files.write_corpus(corpus, str(tmp_path / "corpus"))
    pruned = files.read_corpus(spark, str(tmp_path / "corpus")).filter("pkg = 'p'")
    assert [r["value"] for r in pruned.collect()] == ["l1"] and "PartitionFilters: [isnotnull(pkg" in pruned._jdf.queryExecution().toString()
    log = str(tmp_path / "log")
    assert files.append_results(rows, log, "id").count() == 2
    files.append_results(rows, log, "id")
    assert spark.read.parquet(log).count() == 2
    corpus.write.parquet(str(tmp_path / "r0"))
    corpus.withColumn("value", F.lit("new")).filter("pkg = 'p'").write.parquet(str(tmp_path / "r1"))
    assert {r["pkg"]: r["value"] for r in files.merge_ranks(spark, [str(tmp_path / "r0"), str(tmp_path / "r1")], "pkg").collect()} == {"p": "new", "q": "l2"}
    assert [r[0] for r in files.package_manifest(corpus).collect()] == ["p:1.0", "q:2.0"]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.log").write_text("Ran 5 tests in 1s\nOK")
    (tmp_path / "logs" / "y.log").write_text("Ran")
    assert files.matching_logs(spark, str(tmp_path / "logs"), "Ran [0-9]+ tests") == 1


def test_long_context(spark):
    rows = [
        ("longbook_choice_eng", "a b c", "q", ["x", "y", "z", "w"], ["y"]),
        ("code_run", "", "print(g(1)) func_10(-3) func_2(4)?", None, ["4"]),
        ("math_find", "[1]", "The second largest of the list?", None, ["1"]),
        ("kv_retrieval", "{}", '\nKey: "' + "k" * 36 + '" ?', None, ["v"]),
        ("code_debug", "x", "q", ["a", "b", "c", "d"], ["a", "A"]),
        ("longdialogue_qa_eng", "x", "q", None, ["n"]),
        ("other", "x", "q", None, ["n"]),
    ]
    df = spark.createDataFrame(rows, "dataset string, context string, question string, options array<string>, answers array<string>")
    got = {r["dataset"]: r for r in longcontext.shape(df).collect()}
    assert (got["longbook_choice_eng"]["labels"], got["longbook_choice_eng"]["length"], got["longbook_choice_eng"]["choices"]) == (["y", "B"], 3, ["x", "y", "z", "w"])
    assert (got["code_run"]["asked"], got["code_run"]["function"]) == ("func_10(-3)", "func_10") and got["code_debug"]["labels"] == ["a", "A"]
    assert got["math_find"]["asked"] == "What is the second largest in the following list?" and got["kv_retrieval"]["asked"] == '"' + "k" * 36 + '"'
    assert got["longdialogue_qa_eng"]["asked"] is None and got["other"]["asked"] == "q" and got["other"]["labels"] == ["n"]


def test_containment(spark, monkeypatch):
    items = spark.createDataFrame([(1, "at sat"), (2, "é"), (3, ""), (4, None), (5, "at sat"), (6, "zz")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "cat satisfied"), (11, "caf\u00e9 at sat"), (12, None), (13, "")], "doc_id long, text string")
    for needles in (20_000, 2):
        monkeypatch.setattr(retrieval, "NEEDLES", needles)
        assert sorted(map(tuple, retrieval.containment(items, docs).collect())) == [(1, 10), (1, 11), (2, 11), (5, 10), (5, 11)]


def test_best_of_overlaps(spark):
    rng = random.Random(3)
    text_of = lambda: " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 9)))
    items = spark.createDataFrame([(i, text_of()) for i in range(8)], "item_id long, text string")
    docs = spark.createDataFrame([(i, text_of()) for i in range(300)], "doc_id long, text string").repartition(5)
    ranked = [retrieval.top(retrieval.token_overlap(items, docs, best=best), "item_id", F.round("similarity", 9), "doc_id", 4).select("item_id", "doc_id", "rank") for best in (None, 4)]
    assert sorted(map(tuple, ranked[0].collect())) == sorted(map(tuple, ranked[1].collect()))


@pytest.mark.parametrize("measure", ["dot", "cosine"])
def test_top_k_by_blocks(spark, monkeypatch, measure):
    from tessera.operators import vectors as search

    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)], "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id")
    held = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in search.top_k(queries, rows, 5, measure).collect())
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "ROW_BLOCK", 60)
    assert held == sorted((r["query_id"], r["rank"], r["vec_id"]) for r in search.top_k(queries, rows, 5, measure).collect())


def test_ordinal_with_outlying_and_null_keys(spark):
    rows = spark.createDataFrame([(k,) for k in [*range(500), 10**15, None, -5]], "k long")
    got = [r["k"] for r in windows.ordinal(rows, ["k"], part_rows=50, least_parts=4).orderBy("ordinal").collect()]
    assert got == [None, -5, *range(500), 10**15]


def test_rounds():
    fill = packing.progressive_fill
    assert fill([[(1, 5)], [(1, 5), (2, 9)]], [[(1, 5), (3, 2), (4, 2)], [(3, 2), (5, 1)]], 20) == [1, 2, 3, 3, 4]
    assert len(fill([], [[(k, 1) for k in range(500)]], 1000)) == 99 and len(fill([], [[(k, 1) for k in range(500)]], 1000, None)) == 500


def test_dispatch_is_its_ways(spark):
    """The whole against each way by itself, and rounds against the fold over plain lists."""
    from tessera.plans import catalog, dispatching

    data = "/root/testdata/sf0.001"
    t = lambda name: spark.read.parquet(f"{data}/{name}.parquet")
    whole = {}
    for r in catalog.queries()["dispatch_contexts"](spark, data).collect():
        whole.setdefault((r["task"], r["way"]), []).append((r["place"], r["doc"]))
    sides = {}
    for r in dispatching.fill_candidates(t, 12).orderBy("query", "rank", "doc").collect():
        sides.setdefault(r["task"], {}).setdefault((r["phase"], r["query"]), []).append((r["doc"], r["tokens"]))
    assert {way for _, way in whole} == {"fixed", "rounds", "nearest", "locked"}
    for (task, way), rows in whole.items():
        if way == "locked":
            assert rows == [(None, None)]
        elif way == "rounds":
            own = sides[task]
            queries = sorted({q for _, q in own})
            docs = packing.progressive_fill(*[[own.get((phase, q), []) for q in queries] for phase in (1, 2)], 2000)
            assert [d for _, d in sorted(rows, key=lambda r: r[0])] == docs
        else:
            assert [p for p, _ in sorted(rows)] == list(range(1, len(rows) + 1))


def test_contexts_of_filling_by_rounds(spark):
    """Contexts against a plain fold over the candidates; picks of phase one stay candidates of phase two."""
    from tessera.plans import catalog, retrieval

    data = "/root/testdata/sf0.001"
    t = lambda name: spark.read.parquet(f"{data}/{name}.parquet")
    texts = {r["doc_id"]: (r["text"] or "").split()[:300] for r in t("documents").collect()}
    sides, phases = {}, {}
    for r in retrieval.fill_candidates(t, 12, 300).orderBy("query", "rank", "doc").collect():
        sides.setdefault(r["task"], {}).setdefault((r["phase"], r["query"]), []).append((r["doc"], r["tokens"]))
        phases.setdefault((r["query"], r["doc"]), set()).add(r["phase"])
        assert r["tokens"] == len(texts[r["doc"]]) > 0
    assert {1, 2} in phases.values()
    expected = {}
    for task, own in sides.items():
        queries = sorted({q for _, q in own})
        docs = packing.progressive_fill(*[[own.get((phase, q), []) for q in queries] for phase in (1, 2)], 2000)
        if docs:
            expected[task] = (len(docs), "\n".join(" ".join(texts[d]) for d in docs))
    got = {r["task"]: (r["n_docs"], r["context"]) for r in catalog.queries()["progressive_contexts"](spark, data).collect()}
    assert got == expected
    # a hit that doesn't fit stays at the head of its query's candidates and ends each round there
    assert packing.progressive_fill([[(1, 9), (2, 5)]], [[(2, 5), (3, 1)]], 10) == [1]
    assert packing.progressive_fill([[(1, 9), (2, 5)], []], [[(2, 5), (3, 1)], [(4, 1)]], 10) == [1]


def test_metrics(spark):
    from tessera.functions import metrics

    with pytest.raises(ValueError):
        metrics.metric_of("none of these")
    assert metrics.metric_of("qasper_e") is metrics.metric_of("qasper") and metrics.metric_of("passkey__long") is metrics.metric_of("passkey")
    for name in metrics.BY_DATASET:
        row = spark.createDataFrame([("Paragraph 3 is the A answer: 3", "Paragraph 3", ["Paragraph 3", "x"])], "p string, t string, c array<string>")
        value = row.select(metrics.score(F.lit(name), F.col("p"), F.col("t"), F.col("c"), [name])).first()[0]
        assert value is None if name == "pg19" else 0 <= value <= 1


def test_target_api_quirks(spark):
    kind = "q array<struct<query:string,target_api:string>>, p array<string>"
    a, b, c = ("1", "numpy.sum"), ("2", "python.len"), ("3", "torch.nn")
    rows = [([a, b, c], ["numpy", "python"]), ([("0", None), a], ["numpy"]), ([a, c], []), ([], ["numpy"]), ([a, ("4", ""), ("5", None)], ["numpy"])]
    got = [[x["query"] for x in r[0]] for r in spark.createDataFrame(rows, kind).select(dispatch.with_target_api(F.col("q"), F.col("p"))).collect()]
    assert got == [["1"], [], ["1", "3"], [], ["1"]]


def test_versioned_outputs(spark, tmp_path):
    name = outputs.base_name("Edit", "hub/model-7b", "docstring", None, 8000, cards={"r": 4}, most_dependencies=10)
    assert name == "edit_docstring_8000_model-7b_r4_maxdep10"
    rows = spark.createDataFrame([(1, "x")], "id long, answer string")
    first, second = (outputs.write_versioned(rows, str(tmp_path), name, {"b": 1, "a": 2}) for _ in range(2))
    assert second[0] == f"{tmp_path}/{name}_1.jsonl" and spark.read.json(second[0]).count() == 1
    assert spark.read.text(first[1]).first()[0] == '{"a": 2, "b": 1}' and outputs.versioned(spark, str(tmp_path), name, new=False)[0] == first[0]


def test_streaming(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "a", 1.0, "{}") for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    for k in range(2):  # the second run finds nothing new
        events.log_results(events.first_seen(stream), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 50
    query = events.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == 50
    static = df.withColumn("ts", F.col("ts").cast("timestamp"))
    assert events.sessions(static).agg(F.sum("n")).first()[0] == 50


def table_of_subsequences(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=150), st.text("abcé ", max_size=150))
def test_common_subsequence_equals_the_table(a, b):
    expected = table_of_subsequences(a, b)
    assert pyfuncs.common_subsequence(a, b) == expected
    x, y = a.split(), b.split()
    if x and y:
        lcs = table_of_subsequences(x, y)
        p, r = lcs / len(x), lcs / len(y)
        assert pyfuncs.rouge_l(a, b) == pytest.approx(2 * p * r / (p + r) if lcs else 0.0)


def test_common_subsequence_of_long_texts():
    import time

    r = random.Random(4)
    a, b = ([f"w{r.randrange(3000)}" for _ in range(20_000)] for _ in range(2))
    began = time.perf_counter()
    assert 0 < pyfuncs.common_subsequence(a, b) < 20_000
    assert time.perf_counter() - began < 5
