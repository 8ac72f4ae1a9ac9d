"""Vector code compression by Hamerly's variant of Lloyd's rounds over whole numbers (operator 13).

Vectors become whole numbers, floor(scale * x), and are cut into equal consecutive parts; each part position has a codebook.  A row
keeps for each of its parts the index of the nearest entry, one upper bound of the distance to it and one lower bound of the
distance to the second nearest.  When entries have moved, the upper bound grows by its own entry's move and the lower one shrinks by the largest
move of the others; only where the upper bound isn't strictly below the lower one (or half the way from its entry to the next one) is the
distance to its own entry computed, and only where that fails as well are all entries scanned, in whole numbers, ties to the
lower index.  Bounds are rounded outwards, so a strict inequality leaves no room for a tie and the codes are those of plain rounds.

A round is one pass over the stored rows without a shuffle: each task writes its rows with their new bounds and, at the end, its sums by
part and entry, of which Spark makes the totals; codebooks (parts x entries) are all that goes to the driver.

Edge cases: vectors that are null or hold null or non-finite components are dropped, and so are those with a component of LARGEST or more after
scaling, whose squares don't fit, and those of another length than the most common one (the shorter, if there are two; empty ones have parts without
components and error 0).  A length that the parts don't divide is cut at floor(p * length / parts).  Repeated rows are
rows of their own.  Codebooks start with the rows of the smallest vec_ids, nulls last, then by vector; with fewer rows than entries the
codebook is shorter.  Null labels are one label.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, in_arrow, scope, stored
from tessera.llm.hotkeys import join_values

LARGEST = 2**28
#: Relative room for rounding in the bounds, far above that of single precision.
ROOM = 1e-6

Books = list[np.ndarray]


def whole_numbers(embedding: str, scale: int, largest: int) -> tuple[Column, Column]:
    """Whether all components are finite and below ``largest`` when scaled, and the vector as floor(scale * x)."""
    c = F.col(embedding).cast("array<double>")
    fits = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < largest / scale))
    return fits, F.transform(c, lambda x: F.floor(x * scale).cast("int"))


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """[row, entry]: squared Euclidean distances."""
    out = np.zeros((len(x), len(book)), dtype=np.int64)
    for at in range(x.shape[1]):
        out += (x[:, at, None] - book[None, :, at]) ** 2
    return out


class Moves:
    """What a round needs to know of a part's codebook: its entries, how far they have moved, and the way to the nearest other one."""

    def __init__(self, book: np.ndarray, before: np.ndarray | None):
        self.book = book
        n = len(book)
        self.moved = np.zeros(n) if before is None else np.sqrt(((book - before) ** 2).sum(axis=1)) * (1 + ROOM)
        others = np.where(np.eye(n, dtype=bool), -np.inf, self.moved[None, :]).max(axis=1, initial=0)
        self.others = others
        apart = np.sqrt(_distances(book, book).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - ROOM)


def assign(x: np.ndarray, moves: Moves, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New codes, upper and lower bounds of the parts ``x``, and how many were scanned; without codes all are."""
    book = moves.book
    if code is None:
        code, upper, lower = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf), np.zeros(len(x))
        scan = np.arange(len(x))
    else:
        code = code.astype(np.int64)
        upper = (upper.astype(np.float64) + moves.moved[code]) * (1 + ROOM)
        lower = (lower.astype(np.float64) - moves.others[code]) * (1 - ROOM)
        bound = np.maximum(lower, moves.half[code])
        open_ = np.flatnonzero(~(upper < bound))
        upper[open_] = np.sqrt(((x[open_] - book[code[open_]]) ** 2).sum(axis=1)) * (1 + ROOM)
        scan = open_[~(upper[open_] < bound[open_])]
    if len(scan):
        found = _distances(x[scan], book)
        nearest = found.argmin(axis=1)
        code[scan] = nearest
        upper[scan] = np.sqrt(found[np.arange(len(scan)), nearest]) * (1 + ROOM)
        found[np.arange(len(scan)), nearest] = np.iinfo(np.int64).max
        lower[scan] = np.sqrt(found.min(axis=1)) * (1 - ROOM) if len(book) > 1 else np.inf
    return code, upper, lower, len(scan)


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1)))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class Compressor:
    """Codebooks and codes of a table's vectors; ``scans`` has the number of parts scanned in each pass."""

    def __init__(self, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096):
        self.parts, self.entries, self.rounds, self.scale = parts, entries, rounds, scale
        self.books: Books = []
        self.scans: list[int] = []

    def _cuts(self, size: int) -> list[slice]:
        return [slice(p * size // self.parts, (p + 1) * size // self.parts) for p in range(self.parts)]

    def _pass(self, state: DataFrame, before: Books | None, first: bool, kind: str, size: int) -> DataFrame:
        """The rows with new codes and bounds, and each task's sums as rows with ``part``; part -1 counts scans."""
        moves = [Moves(book, before[p] if before else None) for p, book in enumerate(self.books)]
        cuts, parts = self._cuts(size), self.parts
        widest = max(c.stop - c.start for c in cuts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = [np.zeros(len(m.book), dtype=np.int64) for m in moves]
            sums = [np.zeros((len(m.book), widest), dtype=np.int64) for m in moves]
            scans, schema = 0, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                whole = _matrix(batch.column("v"), batch.num_rows).astype(np.int64)
                old = [None, None, None] if first else [_matrix(batch.column(c), batch.num_rows) for c in ("code", "upper", "lower")]
                code, upper, lower = np.zeros((len(whole), parts), dtype=np.int16), np.zeros((len(whole), parts), dtype=np.float32), np.zeros((len(whole), parts), dtype=np.float32)
                for p, cut in enumerate(cuts):
                    x = whole[:, cut]
                    a, code_upper, code_lower, scanned = assign(x, moves[p], *[None if first else o[:, p] for o in old])
                    code[:, p], upper[:, p], lower[:, p] = a, code_upper, code_lower
                    scans += scanned
                    n[p] += np.bincount(a, minlength=len(n[p]))
                    np.add.at(sums[p][:, : x.shape[1]], a, x)
                nothing = [pa.nulls(len(whole), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), _lists(code), _lists(upper), _lists(lower), *nothing], names=_NAMES)
                schema = out.schema
                yield out
            if schema is not None:
                tally = [(p, e, int(n[p][e]), sums[p][e].tolist()) for p in range(parts) for e in range(len(n[p])) if n[p][e]] + [(-1, -1, scans, [])]
                columns = [pa.nulls(len(tally), f.type) for f in list(schema)[:6]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, f.type) for c, f in zip(zip(*tally), list(schema)[6:])]], names=_NAMES)

        columns = ["vec_id", "label", "v"] + ([] if first else ["code", "upper", "lower"])
        rows = state if first else state.filter("part IS NULL")
        return stored(rows.select(columns).transform(in_arrow, run, f"vec_id long, label {kind}, v array<int>, code array<short>, upper array<float>, lower array<float>, part int, entry int, n long, sums array<long>"))

    def _moved(self, state: DataFrame, size: int) -> Books:
        """Entries at the floor of their parts' means; unused ones stay."""
        cuts = self._cuts(size)
        widest = max(c.stop - c.start for c in cuts)
        totals = state.filter("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(widest)]).alias("sums"))
        books = [b.copy() for b in self.books]
        for r in totals.collect():
            if r["part"] < 0:
                self.scans.append(r["n"])
            else:
                width = books[r["part"]].shape[1]
                books[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"][:width]]
        return books

    def compress(self, vectors: DataFrame) -> DataFrame:
        """vec_id, label, code (a list of indexes by part), error of each row that takes part in ``vectors`` (vec_id, label, embedding)."""
        with scope() as own:
            return own.keep(self._compressed(vectors))

    def _compressed(self, vectors: DataFrame) -> DataFrame:
        kind = vectors.schema["label"].dataType.simpleString()
        fits, whole = whole_numbers("embedding", self.scale, LARGEST)
        rows = stored(vectors.filter(fits).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("v")))
        common = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
        if common is None:
            return stored(rows.select("vec_id", "label", F.lit(None).cast("array<short>").alias("code"), F.lit(None).cast("long").alias("error")))
        size = common["size"]
        start = np.array([r["v"] for r in rows.filter(F.size("v") == size).orderBy(F.asc_nulls_last("vec_id"), "v").limit(self.entries).collect()], dtype=np.int64).reshape(-1, size)
        cuts = self._cuts(size)
        self.books, self.scans = [start[:, cut].copy() for cut in cuts], []
        state, before = rows.filter(F.size("v") == size), None
        for k in range(self.rounds + 1):
            passed = self._pass(state, before, k == 0, kind, size)
            forget(rows if k == 0 else state)
            state = passed
            if k < self.rounds:
                before, self.books = self.books, self._moved(state, size)
        books = self.books

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, code = (_matrix(batch.column(c), batch.num_rows).astype(np.int64) for c in ("v", "code"))
                    error = sum(((x[:, cut] - books[p][code[:, p]]) ** 2).sum(axis=1) for p, cut in enumerate(cuts))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("code"), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

        return stored(state.filter("part IS NULL").select("vec_id", "label", "v", "code").transform(in_arrow, measure, f"vec_id long, label {kind}, code array<short>, error long"))

    def seal(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.reshape(-1).tolist()).encode()).hexdigest()


_NAMES = ["vec_id", "label", "v", "code", "upper", "lower", "part", "entry", "n", "sums"]


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over its label."""
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    return join_values(coded, sums, ["label"], "n")
