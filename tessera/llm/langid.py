"""Language identification by cross-parsing entropy (operator 10).

For each language a suffix automaton is built from a bounded sample of labelled text.  A text is parsed greedily with
each automaton: the longest match with the sample is one phrase, then the next begins.  The fewer phrases a text needs, the closer it is
to the language; since matches get longer with the logarithm of what they are looked for in, phrases count that logarithm of the
sample's length (the cross-entropy estimate, but for the text's own length).  The least wins, ties going to the smaller language
name.  Letters are folded to lower case, everything else counts as one space, runs of spaces as one.

A greedy parse is a walk through the automaton that restarts at the root when a letter can't follow.  numpy follows it for many
blocks of text in step, each from the root; where a text has several blocks, the walk that comes out of one goes on into the next until
it meets the walk that began there, and the difference is put right.  So texts of any length are parsed whole, phrases across blocks
included.

``score`` is 1 - least / runner-up (0: a tie, near 1: much closer than any other; 1 where one language only was learnt).

Bounds of what is learnt, by language: whole rows of ROW_CHARS characters at most, one from each of SAMPLE_ROWS hash classes of doc_id, in
order of their hashes as long as SAMPLE_CHARS aren't exceeded.  So the same rows are learnt whatever the partitioning; nothing else
goes to the driver, and the samples alone go to the executors.  Of a language whose rows are all longer, the rows with the least
hashes are learnt from their first ROW_CHARS characters.

An automaton's moves are a table of its states by its own sample's letters, others being one class; where that would exceed TABLE
entries the moves are sorted keys instead.

Edge cases: null text or one without a letter is ``und`` with score 0; rows with null lang, and repeated rows, are
predicted like others (null lang isn't learnt); with nothing to learn from, each text is ``und``; an empty table gives
no rows.  lang, source and doc_id take no part in a prediction.  Other columns pass through, and added columns get
underscores in front where their names are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import column_names, in_arrow, worker_tables

SAMPLE_ROWS, SAMPLE_CHARS, ROW_CHARS = 40, 40_000, 10_000
#: Characters that are followed in step, and entries of a table of moves.
BLOCK, TABLE = 1_024, 8_000_000
UNKNOWN = "und"


def learnable(doc_id: str = "doc_id", lang: str = "lang") -> Column:
    """The training fold: lang is there and crc32(doc_id as text) mod 4 is not 2."""
    return F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2)


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, str]:
    """Training text by language, within the bounds above; one row of each of SAMPLE_ROWS hash classes, by partial minima."""
    key = F.xxhash64(F.col(doc_id).cast("string"))
    long = (F.length(text) > ROW_CHARS).alias("long")
    fold = docs.filter(learnable(doc_id, lang) & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), key.alias("key"), long, F.substring(text, 1, ROW_CHARS).alias("text"))
    of_class = F.pmod(F.col("key").bitwiseAND(0xFFFFF), F.lit(SAMPLE_ROWS)).alias("class")
    least = fold.groupBy("lang", of_class).agg(F.min(F.struct("long", "key")).alias("least")).select("lang", "least.*").collect()
    short = {r["lang"] for r in least if not r["long"]}
    least = [r for r in least if not r["long"] or r["lang"] not in short]
    if not least:
        return {}
    # texts of the picked rows only; where a doc_id is repeated, the least of its texts
    wanted = fold.filter(F.col("key").isin([r["key"] for r in least]) & (~F.col("long") | ~F.col("lang").isin(sorted(short))))
    rows = wanted.groupBy("lang", "key").agg(F.min("text").alias("text")).collect()
    picked = {(r["lang"], r["key"]) for r in least}
    texts: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["key"])):
        longer = f"{texts.get(row['lang'], '')} {row['text']}"
        if (row["lang"], row["key"]) in picked and len(longer) <= SAMPLE_CHARS:
            texts[row["lang"]] = longer
    return texts


class SuffixAutomaton:
    """States and moves of the suffix automaton of a sequence of classes."""

    def __init__(self, sequence: list[int]):
        self.moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sequence:
            new = len(self.moves)
            self.moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in self.moves[at]:
                self.moves[at][c] = new
                at = link[at]
            if at >= 0:
                to = self.moves[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    copy = len(self.moves)
                    self.moves.append(dict(self.moves[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    link[to] = link[new] = copy
                    while at >= 0 and self.moves[at].get(c) == to:
                        self.moves[at][c] = copy
                        at = link[at]
            last = new


class Walker:
    """Greedy parses with the automaton of one sample.  A place is a state times the number of letter classes."""

    def __init__(self, text: np.ndarray):
        """``text``: classes of the sample's letters, common to all languages."""
        known = np.unique(text)
        self.own = np.zeros(0x10000 if known.max(initial=0) < 0x10000 else int(known.max()) + 1, dtype=np.int32)  # 0: not in the sample
        self.own[known] = np.arange(1, len(known) + 1)
        self.size, self.length = len(known) + 1, len(text)
        moves = SuffixAutomaton(self.own[text].tolist()).moves
        self.root = np.ones(self.size, dtype=np.int64)
        for c, to in moves[0].items():
            self.root[c] = to * self.size * 2 + 1
        self.table, self.kind = None, np.int64
        if len(moves) * self.size <= TABLE:
            self.kind = np.int32
            table = np.tile(self.root.astype(np.int32), (len(moves), 1))
            for state, out in enumerate(moves[1:], 1):
                for c, to in out.items():
                    table[state, c] = to * self.size * 2
            self.table = table.reshape(-1)
            self.view = memoryview(self.table)
        else:
            pairs = sorted((state * self.size + c, to * self.size * 2) for state, out in enumerate(moves[1:], 1) for c, to in out.items())
            self.keys = np.array([k for k, _ in pairs], dtype=np.int64)
            self.targets = np.array([to for _, to in pairs], dtype=np.int64)

    def moves(self, places: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """2 * the next place + (1 where a phrase begins)."""
        if self.table is not None:
            return self.table.take(places + letters)
        wanted = places + letters
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (places > 0), self.targets[at], self.root[letters])

    def _move(self, place: int, letter: int) -> int:
        if self.table is not None:
            return self.view[place + letter]
        return int(self.moves(np.array([place]), np.array([letter]))[0])

    def joined(self, place: int, end: int, letters: np.ndarray) -> tuple[int, int]:
        """How many more phrases begin in a block, and where it ends, if the walk enters it at ``place`` and not at the root (where it would end at ``end``)."""
        more, other = 0, 0
        for letter in chain.from_iterable(letters[at : at + 32].tolist() for at in range(0, len(letters), 32)):  # they soon meet
            move, own = self._move(place, letter), self._move(other, letter)
            more += (move & 1) - (own & 1)
            place, other = move >> 1, own >> 1
            if place == other:
                return more, end
        return more, place


class CrossParser:
    """Tables that count the phrases of texts for each language of ``texts``."""

    def __init__(self, texts: dict[str, str]):
        letters = sorted({c for text in texts.values() for c in text.lower() if c.isalpha()})
        self.unseen = len(letters) + 1
        classes = np.zeros(0x110000, dtype=np.uint16 if self.unseen < 0x10000 else np.int32)
        classes[[c for c in range(0x110000) if chr(c).isalpha()]] = self.unseen
        for number, letter in enumerate(letters, 1):
            classes[ord(letter)] = number
            if len(upper := letter.upper()) == 1:
                classes[ord(upper)] = number
        self.classes = classes
        folded = {lang: self.fold(text) for lang, text in texts.items()}
        self.languages = sorted(lang for lang, text in folded.items() if text.any())
        self.walkers = [Walker(folded[lang]) for lang in self.languages]
        self.weights = np.array([np.log(1 + w.length) for w in self.walkers])

    def fold(self, text: str) -> np.ndarray:
        """Classes of a text: 0 for a run of anything but letters."""
        found = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = np.ones(len(found), dtype=bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        return found[keep]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [text, language] and folded lengths; length 0 for texts without a letter."""
        folded = [self.fold(text) if text else np.zeros(0, self.classes.dtype) for text in texts]
        sizes = np.array([len(x) if x.any() else 0 for x in folded], dtype=np.int64)
        owner, start, length, base = [], [], [], 0
        for i, x in enumerate(folded):
            if sizes[i]:
                for at in range(0, len(x), BLOCK):
                    owner.append(i)
                    start.append(base + at)
                    length.append(min(BLOCK, len(x) - at))
            base += len(x)
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not owner:
            return counts, sizes
        stream = np.concatenate(folded)
        order = np.argsort(-np.array(length), kind="stable")
        owners, starts, lengths = np.array(owner), np.array(start)[order], np.array(length)[order]
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()  # blocks longer than each step
        later = np.flatnonzero(owners[1:] == owners[:-1]) + 1  # blocks that go on with a text
        walks = [(walker, np.zeros(len(order), dtype=walker.kind), np.zeros(len(order), dtype=np.int32)) for walker in self.walkers]
        for step, n in enumerate(active):
            letters = stream.take(starts[:n] + step)
            for walker, places, begun in walks:
                move = walker.moves(places[:n], walker.own.take(letters))
                begun[:n] += move & 1
                places[:n] = move >> 1
        for k, (walker, places, begun) in enumerate(walks):
            counted, ends = np.empty_like(begun), np.empty_like(places)
            counted[order], ends[order] = begun, places
            for b in later.tolist():
                letters = walker.own.take(stream[start[b] : start[b] + length[b]])
                more, ends[b] = walker.joined(int(ends[b - 1]), int(ends[b]), letters)
                counted[b] += more
            counts[:, k] = np.bincount(owners, weights=counted, minlength=len(texts))
        return counts, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        counts, sizes = self.phrases(texts)
        names, scores = [], []
        for row, size in zip(counts * self.weights, sizes):
            if not size or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(row.argmin())
            others = np.delete(row, best)
            names.append(self.languages[best])
            scores.append(1.0 - float(row[best]) / float(others.min()) if len(others) else 1.0)
        return names, scores


#: Characters that are parsed at a time in a worker.
BATCH_CHARS = 2_000_000


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def identify(docs: DataFrame, texts: dict[str, str], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language of ``text_col`` and its score; narrow, no shuffle."""
    lang_name, score_name = column_names(docs, lang_out, score_out)
    at, key = docs.columns.index(text_col), hash(tuple(sorted(texts.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = worker_tables(("langid", key), lambda: CrossParser(texts))
        for batch in batches:
            whole = batch.column(at).to_pylist()
            for begin, end in _groups(whole):
                names, scores = parser.predict(whole[begin:end])
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang_name, score_name])

    return docs.transform(in_arrow, run, T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())]), keeps=True)
