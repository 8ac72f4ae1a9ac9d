"""Words of texts without spaces: the most likely path through a lattice of lexicon entries, the lexicon being counted from a corpus.

A stretch between white space is cut where the sum of its words' log probabilities is greatest.  A word's probability is its share of
the corpus; a single character that is no entry has half an occurrence, so every text has a path.  Of equal paths the one whose last
word is longest counts, and so on to the front.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import words

#: Entries of a lexicon, the most frequent ones, and characters that one may have.
ENTRIES, LONGEST = 50_000, 24
#: Characters of texts whose words a worker holds at a time.
CHARACTERS = 500_000


def lexicon(texts: DataFrame, body: str, entries: int = ENTRIES) -> dict[str, int]:
    """The most frequent words of a corpus (white space apart) with their numbers, ties by word; it goes to the workers, so it is bounded."""
    each = texts.select(F.explode(words(F.col(body))).alias("word")).filter(F.length("word") <= LONGEST)
    best = each.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(entries)
    return {r["word"]: r["n"] for r in best.collect()}


class Lattice:
    """Log probabilities of a lexicon, and the best path through a text."""

    def __init__(self, counts: dict[str, int]):
        total = max(1, sum(counts.values()))
        self.cost = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(0.5 / total)
        self.longest = max(map(len, counts), default=1)

    def cut(self, text: str | None) -> list[str]:
        return [w for piece in (text or "").split() for w in self._path(piece)]

    def _path(self, piece: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(piece) + 1):
            top, at = -math.inf, end - 1
            for begin in range(max(0, end - self.longest), end):  # the longest word first, so that it wins a tie
                cost = self.cost.get(piece[begin:end], self.unknown if begin == end - 1 else None)
                if cost is not None and best[begin] + cost > top:
                    top, at = best[begin] + cost, begin
            best.append(top)
            back.append(at)
        out, end = [], len(piece)
        while end:
            out.append(piece[back[end] : end])
            end = back[end]
        return out[::-1]


def segmenter(counts: dict[str, int]) -> Callable[[Column], Column]:
    """A function from a text column to an array of words.  As a Python function it can't stand inside a lambda function's arguments: cut the
    columns first, then score them (``metrics.multiset_f1``, ``pyfuncs.rouge``)."""
    lattice = Lattice(counts)

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lattice.cut)

    return F.pandas_udf(cut, T.ArrayType(T.StringType()))


def segmented(rows: DataFrame, columns: list[str], counts: dict[str, int]) -> DataFrame:
    """``rows`` with the text ``columns`` cut to arrays of words, as by ``segmenter``; a worker holds the words of a few texts at a time."""
    lattice = Lattice(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lambda column: pa.array((lattice.cut(x.as_py()) for x in column), pa.list_(pa.string()))
        for batch in batches:
            upto, at = np.cumsum(sum(pc.fill_null(pc.utf8_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in columns)), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHARACTERS, side="right")))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([cut(c) if n in columns else c for n, c in zip(part.schema.names, part.columns)], names=part.schema.names)
                at = end

    fields = [T.StructField(f.name, T.ArrayType(T.StringType())) if f.name in columns else f for f in rows.schema.fields]
    return rows.mapInArrow(run, T.StructType(fields))
