"""Retrieval: token overlap by an inverted join, API matching, fixed documents, context packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import needles
from tessera.operators.bounded import spread
from tessera.operators.overlap import best_overlaps


#: Postings (token, item) that may be held by every worker; more of them are joined by shuffle.
POSTINGS = 200_000
#: Hits of tokens in postings that a worker counts at a time, and rows of its results.
HITS, LEAVING = 1_000_000, 50_000


def token_overlap(items: DataFrame, docs: DataFrame, item: str = "item_id", doc: str = "doc_id", body: str = "text", best: int | None = None) -> DataFrame:
    """(item, doc, similarity): Jaccard of token sets plus 0.3 if one holds the other, for pairs that share a token.

    The postings of the stated items are small (checked): they go to the workers, and a document's matches are counted
    where it is read, so that only pairs leave.  Beyond that bound documents' tokens meet the postings by an equi-join.
    With ``best`` the pairs may be only those that can be among the ``best`` of their item, smaller documents first among equals:
    each task then leaves that many rows an item, and beyond the bound an index with bounds is asked (``overlap``), so that frequent
    tokens aren't joined whole.
    """
    asked = items.select(F.col(item).cast("long").alias(item), text.token_set(F.col(body)).alias("q"))
    postings = asked.select(item, F.size("q").alias("nq"), F.explode("q").alias("token"))
    own = spread(docs.select(doc, body)).select(F.col(doc).cast("long").alias(doc), text.token_set(F.col(body)).alias("d"))
    held = postings.limit(POSTINGS + 1).collect()
    if len(held) <= POSTINGS:
        pairs = _counted_in_place(own, held, item, doc, best)
    elif best is not None:
        return best_overlaps(asked, own, item, doc, best)
    else:
        tokens = own.select(doc, F.size("d").alias("nd"), F.explode("d").alias("token"))
        pairs = tokens.join(postings, "token").groupBy(item, doc, "nq", "nd").agg(F.count("*").alias("common"))
    jaccard = F.col("common") / (F.col("nq") + F.col("nd") - F.col("common"))
    bonus = F.when(F.col("common") == F.least("nq", "nd"), 0.3).otherwise(0.0)
    return pairs.select(item, doc, F.least(F.lit(1.0), jaccard + bonus).alias("similarity"))


def _contenders(item: np.ndarray, doc: np.ndarray, similarity: np.ndarray, best: int) -> np.ndarray:
    """Places of the pairs that rank among the ``best`` of their item, by similarity to nine places and then the smaller document."""
    order = np.lexsort((doc, -np.floor(similarity * 1e9 + 0.5), item))
    begin = np.flatnonzero(np.r_[True, item[order][1:] != item[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
    return order[rank < best]


def _counted_in_place(own: DataFrame, held: list, item: str, doc: str, best: int | None) -> DataFrame:
    """(item, doc, nq, nd, common) by looking up each document's tokens in the postings.

    Postings are one array, each token's beside each other.  A few documents at a time are counted in a table of documents by items, HITS
    numbers at most; with ``best`` a task's contenders are all that stays, and what leaves at its end.
    """
    ids = np.array(sorted({r[item] for r in held}), dtype=np.int64)
    place = {i: k for k, i in enumerate(ids.tolist())}
    sizes = np.zeros(len(ids), dtype=np.int64)
    by_token: dict[str, list[int]] = {}
    for r in held:
        sizes[place[r[item]]] = r["nq"]
        by_token.setdefault(r["token"], []).append(place[r[item]])
    names, length = list(by_token), np.array([len(at) for at in by_token.values()], dtype=np.int64)
    flat, begin = np.array([k for at in by_token.values() for k in at], dtype=np.int32), np.cumsum(length) - length

    def counted(tokens: pa.ListArray, known: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the document, place of the item, tokens of the document, tokens in common), part by part."""
        own_size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
        found = pc.fill_null(pc.index_in(tokens.flatten(), known), -1).to_numpy()
        row = np.repeat(np.arange(len(own_size)), own_size)[found >= 0]
        token = found[found >= 0]
        hits = np.cumsum(np.bincount(row, weights=length[token], minlength=len(own_size)).astype(np.int64) + len(ids))
        at = 0
        while at < len(own_size):
            end = max(at + 1, int(np.searchsorted(hits, (hits[at - 1] if at else 0) + HITS, side="right")))
            low, high = np.searchsorted(row, [at, end])
            mine, n = token[low:high], length[token[low:high]]
            places = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            table = np.bincount(np.repeat(row[low:high] - at, n) * len(ids) + flat[places], minlength=(end - at) * len(ids))
            pair = np.flatnonzero(table)
            yield at + pair // len(ids), pair % len(ids), own_size[at + pair // len(ids)], table[pair]
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        batch_of = lambda at, name, size, common: pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(name), pa.array(sizes[at]), pa.array(size), pa.array(common)], names=[item, doc, "nq", "nd", "common"])
        kept = None
        for batch in batches:
            if not len(ids):
                continue
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, at, size, common in counted(batch.column(1), known):
                part = (at, doc_ids[row], size, common)
                if best is None:
                    if len(at):
                        yield batch_of(*part)
                    continue
                at, name, size, common = part if kept is None else [np.concatenate(c) for c in zip(kept, part)]
                union = sizes[at] + size - common
                similarity = np.minimum(1.0, common / union + np.where(common == np.minimum(sizes[at], size), 0.3, 0.0))
                first = _contenders(at, name, similarity, best)
                kept = at[first], name[first], size[first], common[first]
        for begin_ in range(0, len(kept[0]) if kept is not None else 0, LEAVING):
            yield batch_of(*[c[begin_ : begin_ + LEAVING] for c in kept])

    return own.mapInArrow(run, f"{item} long, {doc} long, nq long, nd long, common long")


#: Needles that are looked for at a time; more of them go in further passes.
NEEDLES = 20_000


def _finder(needles: list[tuple[int, str]]):
    """A function from a text to the ids of the needles it holds: all at once where the automaton is installed."""
    try:
        from ahocorasick import Automaton
    except ImportError:
        return lambda text: sorted({i for i, needle in needles if needle in text})
    machine, ids = Automaton(), {}
    for i, needle in needles:
        ids.setdefault(needle, []).append(i)
    for needle, own in ids.items():
        machine.add_word(needle, own)
    machine.make_automaton()
    return lambda text: sorted({i for _, own in machine.iter(text) for i in own})


def containment(items: DataFrame, docs: DataFrame, item: str = "item_id", doc: str = "doc_id", needle: str = "text", body: str = "text") -> DataFrame:
    """(item, doc) for every document whose body holds the item's text as it is, wherever it begins or ends.

    Up to NEEDLES items go to the workers, which read a document once for all of them.  More are looked up by an equi-join on
    minimizers (``needles``), but for those too short to have any, which go in blocks.  Null and empty needles and bodies hold nothing.
    """
    asked = items.filter((F.length(needle) > 0) & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(needle).alias("needle"))
    own = spread(docs.select(doc, body)).select(F.col(doc).cast("long").alias(doc), F.col(body).alias("body")).filter(f"body IS NOT NULL AND {doc} IS NOT NULL")
    found, n = None, asked.count()
    if n > NEEDLES:
        long = F.octet_length("needle") >= needles.LEAST
        found = needles.held(asked.filter(long), own, "i", doc, "needle", "body").withColumnRenamed("i", item)
        asked = asked.filter(~long)
        n = asked.count()
        if not n:
            return found
    blocks = max(1, -(-n // NEEDLES))
    for block in range(blocks):
        held = [(r["i"], r["needle"]) for r in asked.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()]

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            holds = _finder(held) if held else lambda text: []
            for batch in batches:
                names, hits = batch.column(0).to_pylist(), [holds(text.as_py()) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array([i for own in hits for i in own], pa.int64()), pa.array([n for n, own in zip(names, hits) for _ in own], pa.int64())], names=[item, doc])

        part = own.mapInArrow(run, f"{item} long, {doc} long")
        found = part if found is None else found.unionByName(part)
    return found


def top(scored: DataFrame, group: str, score: Column, tie: str, k: int) -> DataFrame:
    """The k best of each group with ``rank``; partial limits come before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def pack_context(ranked: DataFrame, group: str, body: str, most: int) -> DataFrame:
    """(group, context): documents in rank order, one a line, cut to the first ``most`` white-space tokens."""
    gathered = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(body).alias("b"))))["b"].alias("bodies"))
    return gathered.select(group, F.array_join(F.slice(text.words(F.array_join("bodies", "\n")), 1, most), " ").alias("context"))


def first_seen(ranked: DataFrame, task: str, doc: str, order: list[str]) -> DataFrame:
    """Each task's documents once, at their first place in the order of queries and ranks."""
    return ranked.groupBy(task, doc).agg(F.min(F.struct(*order)).alias("first"))


def relevance(path: Column, description: Column, package: Column, targets: Column, strict: bool = False) -> Column:
    """struct(relevant, reason): by the path's package, then (not strict) by mention in the description, then by the package field; no targets keep all."""
    by_path = F.array_contains(targets, text.normalize_package(text.api_package(path)))
    mentioned = F.exists(targets, lambda p: F.contains(F.lower(description), p)) if not strict else F.lit(False)
    by_field = F.array_contains(targets, text.normalize_package(package))
    reason = (
        F.when(F.size(targets) == 0, "no_target")
        .when(F.coalesce(by_path, F.lit(False)), "path")
        .when(F.coalesce(mentioned, F.lit(False)), "description")
        .when(F.coalesce(by_field, F.lit(False)), "package")
        .otherwise("none")
    )
    return F.struct((reason != "none").alias("relevant"), reason.alias("reason"))


def document_match(query: Column, path: Column, aliases: Column, doc: Column) -> Column:
    """struct(exact, score): 1 for the path, an alias, or either after path rules; else the token similarity to path and first sentence."""
    exact = (path == query) | F.array_contains(aliases, query) | (text.map_corpus_path(path) == text.normalize_api_path(query)) | F.exists(aliases, lambda a: text.map_corpus_path(a) == text.normalize_api_path(query))
    both = F.concat_ws(" ", path, text.first_sentence(doc))
    return F.struct(exact.alias("exact"), F.when(exact, 1.0).otherwise(text.overlap_similarity(text.token_set(query), text.token_set(both))).alias("score"))


def retrieval_method(exact: Column, matched: Column, context: Column, skip_exact: bool = True) -> Column:
    """struct(method, context): exact matches can have their context left out, as later stages reject empty ones."""
    method = F.when(exact, "exact_api_match").when(matched, "rag_string_match").otherwise("rag_fallback")
    return F.struct(method.alias("method"), F.when(exact & F.lit(skip_exact), "").otherwise(context).alias("context"))
