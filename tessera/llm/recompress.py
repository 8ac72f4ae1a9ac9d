"""Substring dedup by recompression (operator 12).

A text is a sequence of words.  Rounds of recompression rewrite it: in a run round every maximal run of one symbol becomes a
symbol, in a pair round every neighbouring (a, b) with a of the left and b of the right class does.  Names and classes are hashes
of what a symbol stands for, so they are the same in all documents without a table of names.  Equal stretches of words therefore are rewritten
alike but for their ends: the first and the last run, a first symbol of the right class and a last one of the left class may belong
to symbols that reach outside.  What is left after these are taken off depends on the stretch alone; for each window of WINDOW words
its *anchor* is the longest symbol inside at the last level at which something is left (then by name, then the first).  Equal windows have
equal anchors at equal places, and neighbouring windows mostly share one: there are some six times fewer anchors than windows.

1. Rows of one text are one document, the first by doc_id; the others' windows all start earlier.
2. Anchors go to a table with a hash of their *block*, the words of all windows that share the anchor.  Spark counts names; an
   anchor that occurs once holds no repeat and goes.  Of blocks that occur more than once all but the first are repeats as a whole.
3. Only a name with different blocks (the edges of repeats) needs a look at windows: those of each first block are hashed to 128 bits
   and compared, which verifies them.
4. Words covered by a window that starts earlier elsewhere are removed.

Equal windows are always found.  Unequal ones would count as equal only at a collision of 64 bits among the different blocks of one name, or of
128 bits among windows.  No group of equal names, blocks or windows is gathered: they are counted and joined, hot ones by broadcast.

Edge cases: null texts have no words; texts of fewer than WINDOW words lose none; null doc_ids come last; rows with one doc_id and different texts
are documents ordered by a hash of the text; rows with one doc_id and one text are one document, and each gets its result.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, in_arrow, scope, stored
from tessera.llm.hotkeys import join_values

WINDOW = 20
#: In each round pairs are named; in those of RUN_ROUNDS runs before (a run round costs a symbol at both ends of a window).
#: At this level there are 6.1 windows an anchor; two rounds more give 3.2, as fewer symbols inside a window leave less to choose from.
ROUNDS, RUN_ROUNDS = 4, (0,)
#: Bytes of texts (one at least) that are parsed together.
TOGETHER = 1 << 20
PRIME = 2**31 - 1

_U = np.uint64
_FACTORS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


def mix(a: np.ndarray, b: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of pairs of numbers, not symmetric."""
    x = (a ^ _U(seed * 0x632BE59BD9B4E019 & 2**64 - 1)) * _FACTORS[0]
    x ^= x >> _U(29)
    x = (x + np.asarray(b, dtype=_U)) * _FACTORS[1]
    x ^= x >> _U(32)
    x *= _FACTORS[2]
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of a base and of its inverse, modulo 2^64 or PRIME, as far as needed."""

    def __init__(self, base: int, modulus: int):
        self.modulus, self.base, self.inverse = modulus, base, pow(base, -1, modulus)
        self.up, self.down = self._table(base, 1), self._table(self.inverse, 1)

    def _table(self, base: int, size: int) -> np.ndarray:
        kind = _U if self.modulus == 2**64 else np.int64
        out = np.ones(1, dtype=kind)
        while len(out) < size:
            more = out * kind(pow(base, len(out), self.modulus))
            out = np.concatenate([out, more if kind is _U else more % self.modulus])
        return out

    def need(self, size: int) -> None:
        if len(self.up) < size:
            self.up, self.down = self._table(self.base, size), self._table(self.inverse, size)


_powers = [_Powers(0xD1342543DE82EF95, 2**64), _Powers(1_103_515_245, PRIME)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of texts (bytes, and where each text begins, with the end): the text's number and two 64-bit hashes."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U), np.zeros(0, dtype=_U)
    inside = ~_SPACE[data]
    first, last = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    first[offsets], last[offsets] = True, True
    begin = np.flatnonzero(inside & (first[:n] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (last[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    hashes = []
    for powers in _powers:
        powers.need(n + 1)
        total = np.zeros(n + 1, dtype=powers.up.dtype)
        if powers.modulus == 2**64:
            np.cumsum((data.astype(_U) + _U(1)) * powers.up[:n], out=total[1:])
            hashes.append((total[end] - total[begin]) * powers.down[begin])
        else:  # sums of 2^22 terms below 2^39 fit, then the rest modulo PRIME goes on
            for at in range(0, n, 1 << 22):
                part = data[at : at + (1 << 22)]
                total[at + 1 : at + 1 + len(part)] = (np.cumsum((part.astype(np.int64) + 1) * powers.up[at : at + len(part)]) + total[at]) % PRIME
            hashes.append(((total[end] - total[begin]) % PRIME * powers.down[begin] % PRIME).astype(_U))
    length = (end - begin).astype(_U)
    text = np.searchsorted(offsets, begin, side="right") - 1
    return text, mix(hashes[0], hashes[1] ^ (length << _U(32)), 1), mix(hashes[1] ^ (length << _U(32)), hashes[0], 2)


class Parse:
    """A level of the rewriting: symbols' names, where they begin (in words), and the other way round."""

    def __init__(self, names: np.ndarray, begin: np.ndarray, text: np.ndarray, size: int):
        self.names, self.text, self.size = names, text, size
        self.begin = np.append(begin, size)
        self.at = np.zeros(size + 1, dtype=np.int64)
        self.at[self.begin] = np.arange(len(self.begin))

    def joined(self, head: np.ndarray, names: np.ndarray) -> Parse:
        return Parse(names, self.begin[:-1][head], self.text[head], self.size)

    def runs(self, left: np.ndarray, right: np.ndarray) -> tuple[Parse, np.ndarray, np.ndarray]:
        """Runs named, and the stretches [left, right) without their first and last run."""
        n = len(self.names)
        head = np.ones(n, dtype=bool)
        head[1:] = (self.names[1:] != self.names[:-1]) | (self.text[1:] != self.text[:-1])
        where = np.flatnonzero(head)
        length = np.diff(where, append=n)
        names = self.names[where]
        long = length > 1
        names[long] = mix(names[long], length[long], 3)
        out, run = self.joined(where, names), np.cumsum(head) - 1
        return out, out.begin[run[self.at[left]] + 1], out.begin[run[self.at[right] - 1]]

    def pairs(self, left: np.ndarray, right: np.ndarray, level: int) -> tuple[Parse, np.ndarray, np.ndarray]:
        """Pairs named, and the stretches without a first symbol of the right class and a last one of the left."""
        of_right = mix(self.names, level, 4) >> _U(63) == 1
        second = np.zeros(len(self.names), dtype=bool)
        second[1:] = ~of_right[:-1] & of_right[1:] & (self.text[1:] == self.text[:-1])
        where = np.flatnonzero(~second)
        names = self.names[where]
        paired = np.append(second[1:], False)[where]
        names[paired] = mix(names[paired], self.names[where[paired] + 1], 5)
        first, last = self.at[left], self.at[right] - 1
        return self.joined(where, names), self.begin[first + of_right[first]], self.begin[last + of_right[last]]

    def anchors(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The longest symbol (then by name, then the first) of each stretch."""
        key = np.minimum(np.diff(self.begin), 255).astype(_U) << _U(56) | self.names >> _U(8)
        best, end = self.at[left], self.at[right]
        now, more = best.copy(), np.arange(len(left))
        while True:
            now[more] += 1
            more = more[now[more] < end[more]]
            if not len(more):
                return best
            better = more[key[now[more]] > key[best[more]]]
            best[better] = now[better]


def anchors(names: np.ndarray, text: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of words (their hashes, and their text's number): where it begins, its anchor's name, and which occurrence that is."""
    n = len(names)
    begin = np.arange(max(0, n - window + 1))
    begin = begin[text[begin] == text[begin + window - 1]]
    name, where = np.zeros(len(begin), dtype=_U), np.zeros(len(begin), dtype=np.int64)
    parse, open_, left, right = Parse(names, np.arange(n), text, n), np.arange(len(begin)), begin, begin + window

    def settle(which: np.ndarray, level: int) -> None:
        found = parse.anchors(left[which], right[which])
        name[open_[which]] = mix(parse.names[found], level, 6)
        where[open_[which]] = parse.begin[found] * (2 * ROUNDS + 1) + level

    for step in range(2 * ROUNDS):
        if not len(open_):
            break
        if step % 2 == 0 and step // 2 not in RUN_ROUNDS:
            continue
        after, to_left, to_right = parse.runs(left, right) if step % 2 == 0 else parse.pairs(left, right, step)
        done = to_left >= to_right
        settle(np.flatnonzero(done), step)
        parse, open_, left, right = after, open_[~done], to_left[~done], to_right[~done]
    if len(open_):
        settle(np.arange(len(open_)), 2 * ROUNDS)
    return begin, name, where


class Stretches:
    """Hashes of stretches of words, by doubling."""

    def __init__(self, names: np.ndarray, seed: int):
        self.levels, self.seed = [names], seed

    def of(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A hash of the words [begin, begin + length), lengths of at least 1."""
        highest = int(length.max(initial=1)).bit_length()
        while len(self.levels) < highest:
            half = 1 << (len(self.levels) - 1)
            now = self.levels[-1]
            self.levels.append(mix(now[:-half], now[half:], self.seed) if len(now) > half else now[:0])
        out, at = mix(length.astype(_U), 0, self.seed + 1), begin.copy()
        for k in range(highest):
            has = np.flatnonzero(length >> k & 1)
            out[has] = mix(out[has], self.levels[k][at[has]], self.seed + 2)
            at[has] += 1 << k
        return out


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their texts' bytes and offsets, of TOGETHER bytes at most where a text isn't longer."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            text = batch.column("text").slice(at)
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            take = max(1, int(np.searchsorted(offsets - offsets[0], TOGETHER, side="right")) - 1)
            take = min(take, batch.num_rows - at)
            offsets = offsets[: take + 1]
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
            yield batch.slice(at, take), data, offsets - offsets[0]
            at += take


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers (ascending)."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.append(starts[:1], starts[cut + 1]), np.append(starts[cut], starts[-1:])


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in _together(batches):
        text, names, _ = words(data, offsets)
        begin, name, where = anchors(names, text)
        if not len(begin):
            continue
        new = np.ones(len(begin), dtype=bool)
        new[1:] = (where[1:] != where[:-1]) | (begin[1:] != begin[:-1] + 1) | (text[begin[1:]] != text[begin[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(begin) - 1)
        block = Stretches(names, 7).of(begin[first], begin[last] - begin[first] + WINDOW)
        own = text[begin[first]]
        zero = np.searchsorted(text, own)  # where the text's words begin
        number = rows.column("doc").to_numpy()[own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(name[first].view(np.int64)), pa.array(block.view(np.int64)), pa.array(number), pa.array((begin[first] - zero).astype(np.int32)), pa.array((begin[last] - zero).astype(np.int32))],
            names=["name", "block", "doc", "first", "last"],
        )


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last of each entry of a list column of (first, last) structs."""
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = column.flatten()
    return row, flat.field("first").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("last").to_numpy(zero_copy_only=False).astype(np.int64)


def _hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of ``spans`` with 128-bit hashes."""
    for rows, data, offsets in _together(batches):
        text, names, others = words(data, offsets)
        row, first, last = _spans(rows.column("spans"))
        n = last - first + 1
        start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        row = np.repeat(row, n)
        place = np.searchsorted(text, row) + start
        size = np.full(len(place), WINDOW)
        low, high = Stretches(names, 10).of(place, size), Stretches(others, 20).of(place, size)
        yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(rows.column("doc").to_numpy()[row]), pa.array(start.astype(np.int32))], names=["low", "high", "doc", "first"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words covered by windows that start in ``spans``, and which words these were."""
    for batch in batches:
        row, first, last = _spans(batch.column("spans"))
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        kept, total, removed, spans = [], [], [], []
        for r, text in enumerate(batch.column("text").to_pylist()):
            found = text.encode().split()
            gone = np.zeros(len(found) + 1, dtype=np.int64)
            if cuts[r] < cuts[r + 1]:
                np.add.at(gone, first[cuts[r] : cuts[r + 1]], 1)
                np.add.at(gone, np.minimum(last[cuts[r] : cuts[r + 1]] + WINDOW, len(found)), -1)
                where = np.flatnonzero(np.cumsum(gone)[:-1] > 0)
                begin, end = _ranges(where)
                spans.append([{"begin": b, "end": e + 1} for b, e in zip(begin.tolist(), end.tolist())])
                out = np.ones(len(found), dtype=bool)
                out[where] = False
                found = [found[i] for i in np.flatnonzero(out).tolist()]
                removed.append(len(where))
            else:
                spans.append([])
                removed.append(0)
            total.append(len(found) + removed[-1])
            kept.append(b" ".join(found).decode())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc", "doc_id", "repeats", "copies")), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct({"begin": pa.int32(), "end": pa.int32()})))],
            names=["doc", "doc_id", "repeats", "copies", "n_words", "n_removed", "kept", "removed"],
        )


def _later(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows that are equal in ``keys`` all but the first by (doc, first); and the first ones with single rows."""
    firsts = stored(rows.groupBy(*keys).agg(F.min(F.struct("doc", "first")).alias("least"), F.count("*").alias("n")))
    again = join_values(rows, firsts.filter("n > 1"), keys, "n")
    return again.filter((F.col("doc") != F.col("least.doc")) | (F.col("first") != F.col("least.first"))).drop("least"), firsts


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by spaces), removed (spans of word numbers) of each row of ``docs`` (doc_id, text)."""
    with scope() as own:
        return own.keep(_deduplicated(docs))


def _deduplicated(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.md5("text").alias("digest")
    each = texts.groupBy("doc_id", digest).agg(F.count("*").alias("repeats"))
    named = stored(each.orderBy(F.asc_nulls_last("doc_id"), "digest").withColumn("doc", F.monotonically_increasing_id()))  # ascends over the sorted parts
    firsts = stored(named.groupBy("digest").agg(F.min("doc").alias("doc"), F.count("*").alias("copies")))
    first = named.join(firsts, ["digest", "doc"]).withColumnsRenamed({"doc_id": "own_id", "digest": "own_digest"})
    mine = texts.withColumn("digest", digest).join(first, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")))
    unique = stored(mine.select("doc", "doc_id", "repeats", "copies", "text", "digest").dropDuplicates(["doc"]) if _repeats(named) else mine.select("doc", "doc_id", "repeats", "copies", "text"))

    found = stored(unique.select("doc", "text").transform(in_arrow, _find_anchors, "name long, block long, doc long, first int, last int"))
    counts = stored(found.groupBy("name").agg(F.count("*").alias("n"), F.min("block").alias("one"), F.max("block").alias("other")).filter("n > 1").select("name", "n", (F.col("one") != F.col("other")).alias("differs")))
    shared = stored(join_values(found, counts, ["name"], "n"))
    forget(found, counts)
    again, blocks = _later(shared, ["name", "block"])
    whole = stored(again.select("doc", "first", "last"))
    edges = shared.filter("differs").join(blocks.select("name", "block", "least.*"), ["name", "block", "doc", "first"], "left_semi")
    looked = edges.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    looked = stored(looked)
    forget(shared, blocks)
    windows = stored(unique.select("doc", "text").join(looked, "doc").transform(in_arrow, _hash_windows, "low long, high long, doc long, first int"))
    forget(looked)
    starts, least = _later(windows, ["low", "high"])
    starts = stored(starts.select("doc", "first", F.col("first").alias("last")))
    forget(windows, least)
    repeats = whole.unionByName(starts)
    spans = repeats.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    kinds = "doc long, doc_id long, repeats long, copies long, n_words long, n_removed long, kept string, removed array<struct<begin:int,end:int>>"
    told = stored(unique.join(spans, "doc", "left").transform(in_arrow, _remove, kinds))
    forget(unique, whole, starts)

    columns = ["doc_id", "n_words", "n_removed", "kept", "removed"]
    short = F.col("n_words") < WINDOW
    values = stored(told.filter("copies > 1").select(F.col("doc").alias("first"), "copies", "n_words", F.when(short, F.col("kept")).otherwise("").alias("kept")))
    copied = named.join(firsts.filter("copies > 1").select("digest", F.col("doc").alias("first")), "digest").filter("doc <> first")
    gone = join_values(stored(copied.select("doc_id", "repeats", "first")), values, ["first"], "copies")
    every = F.when(short, F.array().cast("array<struct<begin:int,end:int>>")).otherwise(F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end"))))
    gone = gone.select("doc_id", "repeats", "n_words", F.when(short, F.lit(0)).otherwise(F.col("n_words")).cast("long").alias("n_removed"), "kept", every.alias("removed"))
    rows = told.select("doc_id", "repeats", *columns[1:]).unionByName(gone)
    return stored(rows.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(columns))


def _repeats(named: DataFrame) -> bool:
    """Whether a row of the documents is there more than once."""
    return bool(named.agg(F.max("repeats") > 1).first()[0])
