"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, kdshard, langid, maintext, mixing, multiindex, quality, rabit, simhash
from tessera.llm.op2_chat import digests

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EN = "the cat and the dog went to the house and they were happy with it. "
DE = "der Hund und die Katze gingen zu dem Haus und sie waren sehr froh damit. "


def documents(spark, rows=None):
    if rows is None:
        rows = [(i, (EN if i % 2 else DE) * (1 + i % 3), "en" if i % 2 else "de", f"s{i % 3}", None) for i in range(40)]
        rows += [(100, None, "en", None, None), (101, "", None, "s0", 0), (102, " \t\n", "en", "s1", 3), (103, "12 !! 34", "de", "s1", 8), (None, EN, "en", "s2", None), (None, None, None, None, None)]
        rows += [(104, EN * 3000, "en", "s1", None), (5, EN * 3, "en", "s2", None), (5, EN * 3, "en", "s2", None)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


def test_bpe_edges(spark):
    docs = clashing(documents(spark), "token_ids", "decoded")
    back = bpe.decode(bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, ids_col="_token_ids")
    rows = back.collect()
    assert len(rows) == docs.count() and "_decoded" in back.columns
    assert all(r["_decoded"] == (r["text"] or "") and r["token_ids"] == "x" for r in rows)
    assert all(r["_token_ids"] == [] for r in rows if not r["text"])
    once = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, decoded_col="decoded")
    assert once.filter("_decoded <> coalesce(text, '')").count() == 0
    assert bpe.encode(documents(spark, []), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([10**6],)], "token_ids array<int>"), VOCABULARY).collect()


def test_bpe_equals_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(VOCABULARY)
    encoder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r, tokens = random.Random(3), list(ranks)
    for _ in range(3000):
        text = b"".join(r.choice(tokens) for _ in range(r.randint(0, 9))).decode("utf-8", "ignore") + "".join(r.choices("ab é中\n1!😀 ", k=r.randint(0, 9)))
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text) and decoder.decode(ids) == text
    small = bpe.Encoder(ranks, public_tokenizers.PATTERN, moves=2000, pieces=50)  # tables that begin anew inside one piece
    for long in ("z" * 5000, "".join(r.choices("abcdefghij", k=100_000))):
        assert encoder.encode(long) == small.encode(long) == library.encode_ordinary(long)


def test_bpe_time_grows_with_a_pieces_length():
    """One word of a million letters takes seconds; its ids are those of the library, which is quick where merges are few."""
    import time

    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(VOCABULARY)
    word = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.perf_counter()
    ids = bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(word)
    assert time.perf_counter() - began < 60
    assert ids == tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(word)


def test_streaming_decoder_in_portions():
    r, decoder = random.Random(4), bpe.Decoder({bytes((i,)): i for i in range(256)})
    for _ in range(3000):
        data = bytes(r.choice((r.randrange(256), r.choice(b"\xe2\x82\xac\xf0\x9f\x98\x80\xc3\xa9a\xed\xa0\xf4"))) for _ in range(r.randint(0, 9)))
        text, at, decoder.pending = "", 0, b""
        while at < len(data):
            end = at + r.randint(1, 4)
            text, at = text + decoder.feed(data[at:end]), end
        assert text + decoder.close() == decoder.decode(data) == data.decode("utf-8", "replace")


def test_utf8_automaton():
    r = random.Random(4)
    for _ in range(3000):
        data = bytes(r.choice((r.randrange(256), r.choice(b"\xe2\x82\xac\xf0\x9f\x98\x80\xc3\xa9a"))) for _ in range(r.randint(0, 8)))
        text, left = bpe.utf8_step(b"", data)
        assert text + ("�" if left else "") == data.decode("utf-8", "replace")
        whole, pending = "", b""
        for byte in data:
            part, pending = bpe.utf8_step(pending, bytes((byte,)))
            whole += part
        assert (whole, pending) == (text, left)


def test_language_edges(spark):
    docs = clashing(documents(spark), "score")
    found = langid.identify(docs, langid.sample(docs))
    rows = found.collect()
    assert len(rows) == docs.count() and {"lang_pred", "_score", "score"} <= set(found.columns)
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["_score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == ("en" if "the" in r["text"] else "de") and 0 <= r["_score"] <= 1
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(documents(spark, []), langid.sample(documents(spark, []))).count() == 0


def greedy_phrases(parser, train, text):
    """The parse by substring search."""
    known, probe = ("".join(chr(0x100 + c) for c in parser.fold(t).tolist()) for t in (train, text))
    n = at = 0
    while at < len(probe):
        end = at
        while end < len(probe) and probe[at : end + 1] in known:
            end += 1
        n, at = n + 1, max(end, at + 1)
    return n


@pytest.mark.parametrize("table, block", [(8_000_000, 1024), (8_000_000, 7), (10, 16)])
def test_phrases_are_a_greedy_parse(monkeypatch, table, block):
    """Whole texts, across any blocks, with tables of moves and with keys."""
    monkeypatch.setattr(langid, "TABLE", table)
    monkeypatch.setattr(langid, "BLOCK", block)
    r = random.Random(5)
    train = {"x": "".join(r.choices("abc ", k=300)), "y": "".join(r.choices("abd ", k=100))}
    parser = langid.CrossParser(train)
    for _ in range(100):
        probe = "".join(r.choices("abcde .", weights=(9, 9, 9, 9, 1, 2, 2), k=r.randint(1, 3000 if table > 10 else 300)))
        counts, sizes = parser.phrases([None, probe, ""])
        assert not sizes[1] or counts[1].tolist() == [greedy_phrases(parser, train[k], probe) for k in "xy"]
        costs = {k: greedy_phrases(parser, train[k], probe) * math.log(1 + len(parser.fold(train[k]))) for k in "xy"}
        if sizes[1]:
            (name,), (score,) = parser.predict([probe])
            assert name == min(costs, key=lambda k: (costs[k], k)) and score == pytest.approx(1 - min(costs.values()) / max(costs.values()))


def test_language_of_unequal_samples():
    """A language with a fiftieth of the other's sample still wins its own texts: phrases are weighed by the samples' lengths."""
    r = random.Random(15)
    words = {k: ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(150)] for k, letters in (("long", "aeioubdgklmnrst"), ("short", "aeiouybdgklmnpt"))}
    text = lambda k, n: " ".join(r.choices(words[k], k=n))
    parser = langid.CrossParser({"long": text("long", 6000), "short": text("short", 120)})
    for k in words:
        assert sum(name == k for name in parser.predict([text(k, 60) for _ in range(100)])[0]) >= 95


def test_language_sample_is_bounded(spark):
    one = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(one, f"wort {i} " * 50, "de") for i in range(3000)] + [(i, "word " * 100, "en") for i in range(2000)] + [(9000 + i, "x" * 20_000, "long") for i in range(9)]
    texts = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(texts.pop("long")) == {" ", "x"}  # its rows are all long: learnt from their beginnings
    assert set(texts) == {"de", "en"} and all(len(t) <= langid.SAMPLE_CHARS for t in texts.values())
    assert texts["de"].strip() in {t.strip() for _, t, _ in rows}  # one row of a repeated doc_id, whole


def test_quality_edges(spark):
    junk = [(i, "%%% $$$ ### " * 9, "en", "s", None) for i in range(200, 220)]
    docs = clashing(documents(spark).unionByName(spark.createDataFrame(junk, DOCS)), "chunk", "kept")
    labels = spark.createDataFrame([*[(i, 1, 0) for i in range(40)], *[(i, 0, 0) for i in range(200, 215)], (None, 1, 0), (0, 1, None)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels)
    rows = found.collect()
    assert len(rows) == docs.count() and found.columns[: len(docs.columns)] == docs.columns
    for r in rows:
        if not (r["text"] or "").split():
            assert r["perplexity"] is None and r["_kept"] is False
        elif r["doc_id"] is not None and r["doc_id"] >= 200:
            assert not r["_kept"]
        elif "the" in r["text"]:
            assert r["_kept"]
    untrained = quality.classify(documents(spark), labels.limit(0)).collect()
    assert all(r["kept"] and r["perplexity"] is None for r in untrained)
    assert quality.classify(documents(spark, []), labels).count() == 0


def plain_kneser_ney(padded, trained, kinds):
    """P(last letter | the others) by dictionaries, from the texts numbered in ``trained``."""
    n = quality.ORDER
    level = {k: {} for k in range(1, n + 1)}
    for i in trained:
        for g in (padded[i][at : at + n] for at in range(len(padded[i]) - n + 1)):
            level[n][g] = level[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        for g in level[k + 1]:
            level[k][g[1:]] = level[k].get(g[1:], 0) + 1

    def discount(k, c):
        return (0, *quality._discounts(*[sum(v == i for v in level[k].values()) for i in (1, 2, 3, 4)]))[min(c, 3)]

    def probability(g):
        k = len(g)
        context = {h: c for h, c in level[k].items() if h[:-1] == g[:-1]}
        total = sum(context.values())
        below = probability(g[1:]) if k > 1 else 1 / kinds
        if not total:
            return below
        own = context.get(g, 0)
        return (max(0.0, own - discount(k, own)) + sum(discount(k, c) for c in context.values()) * below) / total

    return probability


def test_kneser_ney_by_brute_force(spark, monkeypatch):
    """Perplexities, thresholds and decisions against a dictionary version with a model for each fold."""
    monkeypatch.setattr(quality, "LEAST_TRUSTED", 5)
    r = random.Random(6)
    texts = ["".join(r.choices("abcd ", weights=(5, 3, 1, 1, 2), k=r.randint(30, 90))) for _ in range(22)] + ["dddd cccc"]
    langs = ["x"] * 14 + ["y"] * 4 + [None] * 5
    trusted = set(range(0, 16))
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(20, 0, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(docs, labels).collect()}
    n = quality.ORDER
    padded = [" " * (n - 1) + " ".join(t.split()) for t in texts]
    kinds = len({g for t in padded for g in t[n - 1 :]}) + 1
    of = {i: zlib.crc32(str(i).encode()) % 2 for i in trusted}
    assert set(of.values()) == {0, 1}
    models = [plain_kneser_ney(padded, [i for i in trusted if of[i] == k], kinds) for k in (0, 1)]
    expected = {}
    for i, t in enumerate(padded):
        grams = [t[at : at + n] for at in range(len(t) - n + 1)]
        logs = [-sum(math.log(m(g)) for g in grams) / len(grams) for m in models]
        expected[i] = math.exp(logs[1 - of[i]] if i in trusted else sum(logs) / 2)
        assert got[i]["perplexity"] == pytest.approx(expected[i], rel=1e-4)
    for group in ("x", "y", None):
        own = [math.log(expected[i]) for i in trusted if langs[i] == group] if group == "x" else [math.log(expected[i]) for i in trusted]
        cut = math.exp(np.quantile(own, quality.QUANTILE))
        for i, k in enumerate(langs):
            if k == group:
                assert got[i]["threshold"] == pytest.approx(cut, rel=2e-3)
                assert got[i]["kept"] == (expected[i] <= cut) or abs(math.log(expected[i] / cut)) < 2e-3


def test_numbers_of_ngrams_do_not_depend_on_the_order_of_texts():
    import pyarrow as pa

    texts = ["ab cd", "", "xy", None, "abc abd", "zz top"]
    named = []
    for order in (texts, texts[::-1]):
        grams = quality.Grams(pa.array(order, pa.string()))
        named.append(grams.names(np.flatnonzero(grams.used)).to_pylist())
    assert named[0] == named[1] == sorted(set(named[0]))


def test_model_of_one_fold_stands_in(spark):
    docs = spark.createDataFrame([(i, f"some words here {i}") for i in range(6)], "doc_id long, text string")
    one = next(i for i in range(6) if zlib.crc32(str(i).encode()) % 2)
    scored = quality.score(docs, spark.createDataFrame([(one,)], "doc_id long")).collect()
    assert all(r["perplexity"] > 1 for r in scored)


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a < b & [x] &lt; &amp; </s>[INST]"), (1, 1, "assistant", None), (1, 2, "user", "tail\n"), (2, 0, None, None), (None, None, "assistant", "x"), (None, 1, "assistant", "x"), (3, 0, "assistant", "é😀" * 2000), (3, 0, "assistant", "é😀" * 2000)]
    turns = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "example", "formatted")
    examples = chat.expand(turns)
    got = {r["conv_id"]: r for r in digests(examples).collect()}
    by = {}
    for c, _, role, text in rows:
        by.setdefault(c, []).append((role or "", text or ""))
    for c, own in by.items():
        r = got[c]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.expand(turns.limit(0)).count() == 0
    assert examples.filter("conv_id = 1").count() == 2


def test_mixing_edges(spark):
    docs = clashing(documents(spark), "rate", "cdf", "copy")
    table = mixing.rates(docs, weights={"s0": 3.0, "s1": 1.0}, budget=10_000.0)
    mixed = mixing.replicate(docs, table)
    rows = mixed.collect()
    again = mixing.replicate(docs.repartition(7), table).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert not [r for r in rows if r["source"] == "s2"] and {"n_copies", "_copy", "mix_key"} <= set(mixed.columns)
    for r in rows:
        assert 0 <= r["_copy"] < r["n_copies"]
    empty = documents(spark, [])
    assert mixing.replicate(empty, mixing.rates(empty)).count() == 0
    many = spark.createDataFrame([(i, "x" * 10, "en", "a" if i % 2 else "b", 10) for i in range(4000)], DOCS)
    counted = {r["source"]: r["n"] for r in mixing.replicate(many, spark.createDataFrame([("a", 0.5), ("b", 700.0)], "source string, rate double")).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert counted["a"] == pytest.approx(1000, rel=0.1) and counted["b"] == pytest.approx(1_400_000, rel=0.01)


def test_mixing_spreads_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i}", "en", "s", 1) for i in range(2000)], DOCS)
    mixed = mixing.replicate(docs, spark.createDataFrame([("s", 1.0)], "source string, rate double"))
    sizes = [r["n"] for r in mixed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes) and sum(sizes) == pytest.approx(2000, rel=0.1)


def test_mixing_large_sources_join(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    docs = documents(spark)
    salted = mixing.replicate(docs, mixing.rates(docs)).collect()
    monkeypatch.undo()
    assert sorted(map(str, salted)) == sorted(map(str, mixing.replicate(docs, mixing.rates(docs)).collect()))


def test_shard_edges(spark):
    docs = clashing(documents(spark), "size", "shard", "node")
    rows = kdshard.assign(docs, leaves=8).collect()
    assert len(rows) == docs.count()
    for shard in {r["shard"] for r in rows}:
        own = [r for r in rows if r["shard"] == shard]
        assert 0 <= shard < 8 and sorted(r["slot"] for r in own) == list(range(len(own)))
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id < 5 OR doc_id >= 100").collect()}
    for r in rows:
        if r["doc_id"] in texts:
            data = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    assert kdshard.assign(documents(spark, []), leaves=8).count() == 0
    assert kdshard.assign(documents(spark), target_bytes=50_000).agg(F.countDistinct("shard")).first()[0] > 2


def test_shard_balance_with_a_hot_group(spark):
    r = random.Random(8)
    rows = [(i, "same text again", "en", "s", None) for i in range(3000)] + [(3000 + i, "w" * r.randint(1, 40), "en", "s", None) for i in range(6000)]
    sizes = [x["b"] for x in kdshard.assign(spark.createDataFrame(rows, DOCS), leaves=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.15 * min(sizes)


def test_shards_are_those_of_a_plain_tree(spark, monkeypatch):
    """Every row's shard against a k-d tree over sorted lists, in several dimensions, with equal texts under different metadata."""
    monkeypatch.setattr(kdshard, "TOLERANCE", 0.0)
    monkeypatch.setattr(kdshard, "SPLIT", 0.5)
    r = random.Random(18)
    texts = [" ".join(r.choices(["a", "bb", "ccc", "dddd"], k=r.randint(1, 30))) for _ in range(150)]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None]), f"s{r.randrange(6)}", r.choice([None, r.randrange(500)])) for i in range(300)]
    found = {x["doc_id"]: x["shard"] for x in kdshard.assign(spark.createDataFrame(rows, DOCS), leaves=7).collect()}
    crc = {t: zlib.crc32(t.encode()) for t in texts}
    rank = {None: 0} | {w: k for names in (["de", "en"], [f"s{k}" for k in range(6)]) for k, w in enumerate(names, 1)}
    value = {}
    for _, text, lang, source, n in rows:
        own = (rank[source], rank[lang], 0 if n is None else n + 1, len(text) + 1)
        value[text] = tuple(map(min, value.get(text, own), own))
    whole = [max(1, max(v[k] for v in value.values()) - min(v[k] for v in value.values())) for k in range(4)]
    expected = {}

    def split(node, leaves, first):
        if leaves == 1 or not node:
            expected.update({row[0]: first for row in node})
            return
        widths = [(max(value[x[1]][k] for x in node) - min(value[x[1]][k] for x in node)) / whole[k] for k in range(4)]
        k = widths.index(max(widths))
        key = lambda x: (value[x[1]][k], crc[x[1]])
        total = sum(len(x[1]) + 1 for x in node)
        target, before = total * (leaves // 2) // leaves, 0
        for one in sorted({key(x) for x in node}):
            size = sum(len(x[1]) + 1 for x in node if key(x) == one)
            if before + size >= target:
                break
            before += size
        assert size <= kdshard.SPLIT * total  # no key is cut inside here
        after = abs(before + size - target) < abs(before - target)
        left = [x for x in node if key(x) < one or after and key(x) == one]
        split(left, leaves // 2, first)
        split([x for x in node if x not in left], leaves - leaves // 2, first + leaves // 2)

    split(rows, 7, 0)
    assert found == expected and len(set(found.values())) == 7


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("hub", [256, 2])
def test_components_by_brute_force(spark, monkeypatch, hub):
    """Chains, stars around least, greatest and middle nodes, loops and repeated links, with hubs and without."""
    from tessera.llm import components

    monkeypatch.setattr(components, "HUB", hub)
    r = random.Random(20)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(99, k) for k in range(60, 90)] + [(220, k) for k in range(200, 240)] + [(5, 5), (1, 0), (-7, 300), (300, -7)]
    edges += [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(45)]
    r.shuffle(edges)
    root = {n: n for e in edges for n in e}
    for _ in range(len(edges)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in root.items() if n != c or any(c == root[m] and m != n for m in root)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_fingerprint(text):
    """64 bits by counting them one by one, words by their definition."""
    import re

    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_by_definition():
    r = random.Random(19)
    for _ in range(150):
        text = "".join(r.choices("abAB\u00c9\u00e9\u0130\u00a0\u2003 \t\n\x0b\x1c\u4e2d", k=r.randrange(60)))
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_edges_and_brute_force(spark):
    r = random.Random(9)
    base = [" ".join(r.choices(EN.split() + DE.split(), k=60)) for _ in range(6)]
    texts = [None, "", " \n", "one", "one two", "ONE Two", *base, *base[:2]]
    for b in base:
        for _ in range(6):
            words = b.split()
            words[r.randrange(60)] = r.choice("xyz")
            texts.append(" ".join(words))
    texts.append(EN * 2000)
    docs = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, "alone in this " * 9)], "doc_id long, text string"), "fp", "component_id")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    fps = [plain_fingerprint(t) for t in texts]
    expected = brute_components(len(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {x["doc_id"]: x["fp"] & (2**64 - 1) for x in rows if x["doc_id"] is not None} == dict(enumerate(fps))
    got = {x["doc_id"]: x["component_id"] for x in rows if x["doc_id"] is not None}
    assert [got[i] for i in range(len(texts))] == expected
    assert sorted((x["component_id"] is None) for x in rows if x["doc_id"] is None) == [False, True]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_blocks_lose_nothing(spark, monkeypatch):
    """One large group of near fingerprints, dealt over many small blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    r = random.Random(10)
    center = r.getrandbits(64)
    fps = list({center ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (2**64 - 1) for _ in range(150)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        root[find(e["a"])] = find(e["b"])
    expected = brute_components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert all((find(signed[a]) == find(signed[b])) == (expected[a] == expected[b]) for a in range(len(fps)) for b in range(a))


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=120, dimension=16):
    g = np.random.default_rng(11)
    rows = [(i, g.standard_normal(dimension).astype(float).tolist(), i % 3) for i in range(n)]
    rows += [(n + i, (np.array(rows[i % 5][1]) + 0.02 * g.standard_normal(dimension)).tolist(), rows[i % 5][2]) for i in range(40)]
    rows += [(500, None, 1), (501, [0.0] * dimension, 1), (502, [float("nan")] * dimension, 1), (503, [None] + [1.0] * (dimension - 1), 1), (504, [float("inf")] * dimension, 1), (505, rows[0][1], None), (506, [1.0, 2.0], 0), (507, [], 0)]
    rows += [(520, rows[0][1], 0), (540, rows[0][1], 0), (0, rows[0][1], 0), (0, rows[0][1], None), (0, None, 0)]
    return rows


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(rabit, "BLOCK", 16)
    rows = vectors(spark)
    got = {r["vec_id"]: r for r in rabit.near_duplicates(clashing(spark.createDataFrame(rows, VECTORS), "code", "n_links")).collect()}
    own = {i: (np.array(v, dtype=np.float32).astype(float), k) for i, v, k in rows if v and len(v) == 16 and k is not None and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(own)
    cosine = lambda a, b: own[a][1] == own[b][1] and own[a][0] @ own[b][0] / np.linalg.norm(own[a][0]) / np.linalg.norm(own[b][0]) >= 0.93
    roots = brute_components(len(ids), lambda a, b: cosine(ids[a], ids[b]))
    for at, i in enumerate(ids):
        assert got[i]["n_links"] == sum(cosine(i, j) for j in ids if j != i)
        assert got[i]["component_id"] == ids[roots[at]] and got[i]["kept"] == (ids[roots[at]] == i)
    for i in (500, 501, 502, 503, 504, 505, 506, 507):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert rabit.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_code_bounds_hold():
    """Estimates are those of plain products, are unbiased over rotations' signs, and their bounds leave out no pair at the threshold."""
    g = np.random.default_rng(12)
    for dimension in (5, 64, 100):
        x = g.standard_normal((300, dimension))
        x[150:] = x[:150] + 0.35 * g.standard_normal((150, dimension)) * g.random((150, 1))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = rabit.Codes.of(x)
        turned = x @ rabit.rotation(dimension)
        signs = np.where(turned >= 0, 1, -1) / np.sqrt(dimension)
        rounded = codes.least[:, None] + codes.step[:, None] * np.rint((turned - codes.least[:, None]) / codes.step[:, None])
        assert codes.estimates(codes) == pytest.approx(signs @ rounded.T, abs=1e-9)
        assert codes.factor == pytest.approx((signs * turned).sum(axis=1)) and codes.lack == pytest.approx(np.linalg.norm(turned - rounded, axis=1))
        maybe = codes.allowed(codes, 0.93)
        assert maybe[(x @ x.T) >= 0.93].all()
        assert dimension < 64 or maybe.mean() < 0.1
        if dimension == 64:
            assert abs((codes.estimates(codes) / codes.factor[:, None] - x @ x.T)[~np.eye(300, dtype=bool)].mean()) < 0.01


def test_embedding_links_of_a_hot_group(spark, monkeypatch):
    """A third of the rows are one vector, another third near copies of it: counts include copies, which are never paired one by one."""
    monkeypatch.setattr(rabit, "BLOCK", 32)
    g = np.random.default_rng(17)
    base = g.standard_normal(64)
    rows = [(i, base.tolist(), "x") for i in range(200)] + [(200 + i, (base + 0.02 * g.standard_normal(64)).tolist(), "x") for i in range(200)] + [(400 + i, g.standard_normal(64).tolist(), "x" if i % 2 else "y") for i in range(200)]
    got = {r["vec_id"]: r for r in rabit.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert all((got[i]["n_links"], got[i]["component_id"]) == (399, 0) for i in range(400)) and all(got[i]["n_links"] == 0 for i in range(400, 600))


def test_nearest_neighbours(spark):
    rows = vectors(spark)
    got = multiindex.search(clashing(spark.createDataFrame(rows, VECTORS), "rank", "score"), k=5, every=20, share=1.0).collect()
    own = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    asked = [i for i in own if i % 20 == 0]
    assert {r["query_id"] for r in got} == set(asked)
    for q in asked:
        expected = sorted((-float((own[q] * v).sum()), i) for i, v in own.items() if i != q)[:5]
        found = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [v for _, v, _ in found] == [i for _, i in expected]
        assert [s for _, _, s in found] == pytest.approx([-s for s, _ in expected])
    assert multiindex.search(spark.createDataFrame([], VECTORS)).count() == 0


def test_multi_sequence_order():
    g = np.random.default_rng(13)
    first, second, counts = g.standard_normal(9), g.standard_normal(7), g.integers(0, 4, (9, 7))
    cells = multiindex.visited(first, second, counts, counts.sum())
    sums = [first[i] + second[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == len(set(cells)) == (counts > 0).sum()


@pytest.mark.parametrize("n, every", [(400, 4), (2500, 25), (9000, 200)])
def test_recall_on_random_vectors(spark, n, every):
    """0.9 and more against brute force at every size, with no vector looked at without its cell being visited."""
    g = np.random.default_rng(14)
    x = g.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = multiindex.search(df, k=20, every=every).collect()
    hits, x = 0, x.astype(np.float32).astype(float)
    for q in range(0, n, every):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits / (20 * len(range(0, n, every))) >= 0.9


PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def labeller():
    return maintext.trained()


def test_main_text_edges(spark, labeller):
    article = "<article><h1>Head &amp; title</h1><p>One <b>bo</b>ld.<br><p>Two\n\n three&nbsp;x</article>"
    page = f"<html><head><title>t</title><script>var a='</p><p>no';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav><div class=ad>Buy this now.</div>{article}<footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", page + "<scr"), (1, "u", page), (5, "u", "plain < text"), (6, "u", page.replace("One", "One " * 20_000))]
    found = maintext.extract(clashing(spark.createDataFrame(rows, PAGES), "text"), labeller=labeller)
    got = [(r["page_id"], r["_text"], r["text"]) for r in found.collect()]
    want = "Head & title One bold. Two three x"
    assert [t for i, t, _ in got if i in (1, 4)] == [want] * 3 and all(x == "x" for _, _, x in got)
    assert [t for i, t, _ in got if i in (2, 3)] == ["", ""]
    assert next(t for i, t, _ in got if i == 6).count("One") == 20_000
    assert maintext.extract(spark.createDataFrame([], PAGES), labeller=labeller).count() == 0


def test_labeller_on_pages_it_has_not_seen(labeller):
    from tessera.llm.blocklstm import Pages

    pages = [maintext.generated(10**8 + k) for k in range(120)]
    likely = labeller.probabilities(Pages([b for b, _ in pages])) >= 0.5
    assert (likely == np.concatenate([x for _, x in pages]).astype(bool)).mean() > 0.98


def test_lstm_gradients_by_differences():
    from tessera.llm.blocklstm import BlockLabeller, Pages

    made = [maintext.generated(k) for k in (1, 2)]
    p, y = Pages([b for b, _ in made]), np.concatenate([x for _, x in made]).astype(float)
    model = BlockLabeller(3)
    _, g = model._gradients(p, y)
    for key in model.w:
        flat = np.argsort(-np.abs(g[key]), axis=None)[:2]
        for at in flat:
            spot = np.unravel_index(at, g[key].shape)
            before, model.w[key][spot] = model.w[key][spot], model.w[key][spot] + 1e-5
            up = model._gradients(p, y)[0]
            model.w[key][spot] = before - 1e-5
            down = model._gradients(p, y)[0]
            model.w[key][spot] = before
            assert g[key][spot] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_every_language_is_learnt(spark):
    """As many languages as there are labels, whatever their number."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[k % 26]}{letters[k // 26]} " * 20, f"l{k}") for k in range(600) for i in range(4 * k, 4 * k + 4)]
    assert set(langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == {f"l{k}" for k in range(600)}


def test_shard_dimensions_keep_their_order(spark):
    """More words than any bound, numbers of any size and sign: places ascend as the values do, null first."""
    words = [(f"w{k:05d}" if k % 50 else None, x) for k, x in zip(range(12_000), [None, float("nan"), -1e300, -5.5, 0.0, 3e9, 3e9 + 1, 1e18, float("inf")] * 2000)]
    rows = spark.createDataFrame(words, "m0 string, m1 double")
    found = kdshard._value(kdshard._value(rows, "m0", "v0"), "m1", "v1").collect()
    assert len(found) == 12_000
    for m, v in (("m0", "v0"), ("m1", "v1")):
        known = sorted((r[m], r[v]) for r in found if r[m] is not None and r[m] == r[m])
        assert all(r[v] == 0 for r in found if r[m] is None or r[m] != r[m])
        assert [v for _, v in known] == sorted(v for _, v in known) and known[0][1] >= 1 and known[-1][1] <= kdshard.PLACES
    assert len({r["v0"] for r in found}) == 1 + len({r["m0"] for r in found} - {None})
    whole = spark.createDataFrame([(-3,), (7,), (2**31,), (None,)], "m long")
    assert sorted(r["v"] for r in kdshard._value(whole, "m", "v").collect()) == [0, 1, 10, 2**31 - 2]
