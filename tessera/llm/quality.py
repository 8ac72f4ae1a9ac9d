"""Quality classifier by an interpolated modified Kneser-Ney model (operator 1).

The model is over characters (order ORDER): a document is a sequence of code points, lower-cased letters apart from
upper-case ones, white space as one space, with spaces before it.  It is trained on all trusted rows; nothing is sampled.

1. Documents are dealt to chunks by a hash; each chunk's worker counts its n-grams with array lookups and emits each distinct
   one once, with its number in the chunk and how often trusted rows hold it, by fold.
2. The counts are summed by n-gram over the whole cluster, lower orders as continuation counts, discounts D1, D2, D3+
   from the counts of counts of each order; from the letters up, joins by an n-gram's context and by its shorter n-gram, all
   hash-partitioned, give the interpolated probability of every n-gram that any document holds.
3. The log-probabilities go back to the chunks that asked for them, and each chunk's worker adds them up along its texts.

What moves is proportional to chunks times their distinct n-grams and to the texts, which are dealt to chunks
compressed; no n-gram table is broadcast and no task holds more than a chunk of about CHUNK_CHARS characters, or one document.

Cross-fitting: trusted rows fall into two folds by a hash of doc_id, and each fold has a model of its own.  A trusted row's
perplexity is that of the other fold's model, which hasn't counted it; all other rows get the geometric mean of both.  (Where
one fold has no row, its model stands in for the other.)

A document is kept if its perplexity is at most the QUANTILE of its language's trusted rows.  Languages with fewer than LEAST_TRUSTED
trusted rows use the quantile over all languages; without trusted rows at all there is no model, and everything is kept with null
perplexity.  Quantiles are exact over logarithms rounded to three decimals.

Edge cases: null or empty text, or only white space, has no character to score: perplexity null, kept false; null lang is a
language of its own; repeated rows are scored and counted one by one; null label joins nothing; an empty table gives no rows;
other columns pass through; added columns get underscores in front where their names are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import column_names, forget, in_arrow, lean, small_batches, stored

ORDER, PAD, FOLDS = 5, 0x20, ("a", "b")
CHUNK_CHARS, LEAST_CHUNKS = 12_000_000, 16
QUANTILE, LEAST_TRUSTED = 0.995, 50
BROADCAST_LANGUAGES = 10_000
#: Entries of a lookup table; where letters are so many that it would be larger, n-grams are numbered by sorting.
TABLE = 16_000_000
#: Places that are widened at a time.
STEP = 500_000


def code_points(text: str | None) -> np.ndarray:
    """Code points of a text after ORDER - 1 spaces, white space as single spaces; empty if there is nothing else."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint32)
    return np.frombuffer((chr(PAD) * (ORDER - 1) + " ".join(words)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Grams:
    """Numbers of the n-grams of some texts, order by order from (number of the first letters, last letter).

    Those that texts hold (``used``) are in the order of their code points whatever the order of the texts; between them are some
    that only reach from one text into the next.  Arrays over all places hold four bytes a place at most; wider ones are made for
    STEP places at a time.
    """

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        room = (pc.sum(pc.utf8_length(texts)).as_py() or 0) + ORDER * len(texts)
        ids, lengths, at = np.empty(room, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64), 0
        for row, text in enumerate(texts):
            points = code_points(text.as_py())
            if not len(points):
                points = np.full(ORDER - 1, PAD, np.uint32)
            ids[at : at + len(points)] = points
            lengths[row] = len(points)
            at += len(points)
        ids = ids[:at]
        self.letters = self._replace(ids, lambda begin, end: ids[begin:end])
        size = self.size = max(1, len(self.letters))
        ids = ids.view(np.int32)
        letters = ids.astype(np.uint16 if size < 65_536 else np.int32)
        ends = np.cumsum(lengths)
        self.begins, self.ends = ends - lengths, ends - ORDER + 1  # n-grams of each text by place
        self.tables = []
        for n in range(2, ORDER + 1):
            ids = ids[: len(ids) - 1] if len(ids) else ids
            self.tables.append(self._replace(ids, lambda begin, end: ids[begin:end].astype(np.int64) * size + letters[begin + n - 1 : end + n - 1]))
        self.ids = ids
        self.used = np.zeros(len(self.tables[-1]), dtype=bool)
        for begin, end in zip(self.begins.tolist(), self.ends.tolist()):
            self.used[ids[begin : max(begin, end)]] = True

    @staticmethod
    def _replace(ids: np.ndarray, values) -> np.ndarray:
        """The distinct values in order; ``ids`` gets each place's number among them.  ``values(begin, end)`` reads old ids only there."""
        spans = [(at, min(at + STEP, len(ids))) for at in range(0, len(ids), STEP)]
        top = max((int(values(*span).max()) for span in spans), default=-1) + 1
        if top > TABLE:
            found = np.unique(np.concatenate([np.unique(values(*span)) for span in spans]))
            for begin, end in spans:
                ids[begin:end] = np.searchsorted(found, values(begin, end))
            return found
        present = np.zeros(top, dtype=bool)
        for span in spans:
            present[values(*span)] = True
        found = np.flatnonzero(present)
        dense = np.zeros(top, dtype=np.int32)
        dense[found] = np.arange(len(found), dtype=np.int32)
        for begin, end in spans:
            ids[begin:end] = dense[values(begin, end)]
        return found

    def counts(self, wanted: np.ndarray) -> np.ndarray:
        """How often the wanted texts hold each n-gram."""
        total, held, size = np.zeros(len(self.used), dtype=np.int64), [], 0
        for row in np.flatnonzero(wanted & (self.ends > self.begins)):
            held.append(self.ids[self.begins[row] : self.ends[row]])
            size += len(held[-1])
            if size > STEP:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, size = [], 0
        return total + np.bincount(np.concatenate(held), minlength=len(total)) if held else total

    def names(self, wanted: np.ndarray) -> pa.Array:
        """The n-grams of the numbers ``wanted``."""
        rows = np.empty((len(wanted), ORDER), dtype=np.uint32)
        ids = wanted
        for n in range(ORDER, 1, -1):
            pairs = self.tables[n - 2][ids]
            rows[:, n - 1] = self.letters[pairs % self.size]
            ids = pairs // self.size
        rows[:, 0] = self.letters[ids]
        data = rows.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        width = 1 + (rows >= 0x80).astype(np.int32) + (rows >= 0x800) + (rows >= 0x10000)
        offsets = np.concatenate([[0], np.cumsum(width.sum(axis=1))]).astype(np.int32)
        return pa.StringArray.from_buffers(len(wanted), pa.py_buffer(offsets), pa.py_buffer(data))

    def sums(self, values: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of its n-grams' values, of the one of ``values`` that is chosen for it, and their number."""
        n = np.maximum(self.ends - self.begins, 0)
        total = [float(values[k][self.ids[begin : begin + size]].sum()) for begin, size, k in zip(self.begins.tolist(), n.tolist(), chosen.tolist())]
        return np.array(total), n


def _packed(docs: DataFrame, chunk: str) -> DataFrame:
    """(chunk, packed): the rows of ``docs`` by chunk, as compressed Arrow streams of one batch each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(chunk).to_numpy()
            order = np.argsort(numbers, kind="stable")
            kept, at = np.unique(numbers[order], return_index=True)
            blobs = []
            for begin, end in zip(at, [*at[1:], len(order)]):
                sink = pa.BufferOutputStream()
                rows = batch.drop_columns([chunk]).take(pa.array(order[begin:end]))
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
                    writer.write_batch(rows)
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "packed"])

    return docs.transform(in_arrow, pack, "chunk int, packed binary")


def _unpacked(packed: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(blob.as_buffer()).read_all() for blob in packed.column("packed")])


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; where a count is nil, halves and wholes stand in."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k - 0.05, max(0.05, k - (k + 1) * y * more / less)) for k, less, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def probabilities(grams: DataFrame) -> DataFrame:
    """gram, log_a, log_b (natural) from (gram, a, b): interpolated modified Kneser-Ney for each fold's counts, from the letters up.

    Each order has a row for each of its n-grams that ends an n-gram of the next, so only the highest is as large as ``grams``,
    and each is stored, for the next one's counts, its contexts and the census to be read from it.
    """
    levels = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many letters stand before it
        counted = [F.count_if(F.col(f) > 0).alias(f) for f in FOLDS]
        levels[k] = stored(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*counted))
    figures = [x for f in FOLDS for x in (*[F.count_if(F.col(f) == i).alias(f"{f}{i}") for i in (1, 2, 3, 4)], F.count_if(F.col(f) > 0).alias(f"{f}_kinds"), F.sum(f).alias(f"{f}_total"))]
    census = None
    for k, level in levels.items():
        row = level.agg(F.lit(k).alias("k"), F.count("*").alias("kinds"), *figures)
        census = row if census is None else census.unionByName(row)
    facts = {r["k"]: r for r in census.collect()}
    cut = {(k, f): _discounts(*[facts[k][f"{f}{i}"] for i in (1, 2, 3, 4)]) for k in levels for f in FOLDS}

    def discount(k: int, f: str) -> Column:
        d1, d2, d3 = cut[k, f]
        return F.when(F.col(f) <= 0, 0.0).when(F.col(f) == 1, d1).when(F.col(f) == 2, d2).otherwise(d3)

    letters = []
    for f in FOLDS:
        d1, d2, d3 = cut[1, f]
        total, kinds = facts[1][f"{f}_total"] or 0, facts[1][f"{f}_kinds"]
        free = d1 * facts[1][f"{f}1"] + d2 * facts[1][f"{f}2"] + d3 * (kinds - facts[1][f"{f}1"] - facts[1][f"{f}2"]) if total else 1.0
        own = F.greatest(F.lit(0.0), F.col(f) - discount(1, f))
        letters.append(((own + free / (facts[1]["kinds"] + 1)) / float(max(1, total))).alias(f"p_{f}"))
    below = levels[1].select("gram", *letters)
    for k in range(2, ORDER + 1):
        stats = [x for f in FOLDS for x in (F.sum(f).alias(f"all_{f}"), F.sum(discount(k, f)).alias(f"free_{f}"))]
        context = levels[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(*stats)
        shorter = below.withColumnRenamed("gram", "shorter")
        joined = levels[k].withColumns({"context": F.substring("gram", 1, k - 1), "shorter": F.substring("gram", 2, k - 1)}).join(context, "context").join(shorter, "shorter")
        mixed = [
            F.when(F.col(f"all_{f}") > 0, (F.greatest(F.lit(0.0), F.col(f) - discount(k, f)) + F.col(f"free_{f}") * F.col(f"p_{f}")) / F.col(f"all_{f}")).otherwise(F.col(f"p_{f}")).alias(f"p_{f}")
            for f in FOLDS
        ]
        below = joined.select("gram", *mixed)
    trained = [f for f in FOLDS if facts[ORDER][f"{f}_total"]]
    return below.select("gram", *[F.log(f"p_{f if f in trained else trained[0]}").cast("float").alias(f"log_{f}") for f in FOLDS])


def fold(doc_id: Column) -> Column:
    """0 or 1: the fold of a trusted row."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 2).cast("int")


def score(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = True, name: str = "perplexity") -> DataFrame:
    """``docs`` with the perplexity of their text under the models of the trusted rows; ``trusted`` has their ``doc_id``.

    ``with_text=False`` leaves the text out of what comes back.
    """
    chunk, out = column_names(docs, "chunk", name)
    chars = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    chunks = max(LEAST_CHUNKS, -(-chars // CHUNK_CHARS))
    dealt = F.pmod(F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col(doc_id).cast("string"))), F.lit(chunks)).cast("int")
    packed = _packed(docs.withColumn(chunk, dealt), chunk)
    names = trusted.select(F.col(doc_id).cast("string").alias("name"), fold(F.col(doc_id)).alias("fold")).filter("name IS NOT NULL").distinct()
    marked = names.select(F.pmod(F.xxhash64("name"), F.lit(chunks)).cast("int").alias("chunk"), "name", "fold")

    def folds(rows: pa.Table, right: pa.Table) -> np.ndarray:
        """Of each row 0 or 1, or 2 where it isn't trusted."""
        known = dict(zip(right.column("name").to_pylist(), right.column("fold").to_pylist()))
        return np.array([2 if i is None else known.get(str(i), 2) for i in rows.column(doc_id).to_pylist()], dtype=np.int64)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("chunk", pa.int32()), ("number", pa.int32()), ("gram", pa.string()), *[(f, pa.int64()) for f in FOLDS]])
        if not left.num_rows:
            return schema.empty_table()
        with lean():
            rows = _unpacked(left)
            of = folds(rows, right)
            grams = Grams(rows.column(text))
            used = np.flatnonzero(grams.used)
            n = [pa.array(grams.counts(of == k)[used]) for k in range(2)]
            numbers = np.arange(len(used), dtype=np.int32)
            chunk_of = np.full(len(used), left.column("chunk")[0].as_py(), np.int32)
            return pa.table([pa.array(chunk_of), pa.array(numbers), grams.names(used), *n], schema=schema)

    small_batches(docs.sparkSession)
    asked = stored(packed.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(count, "chunk int, number int, gram string, a long, b long"))
    grams = stored(asked.groupBy("gram").agg(*[F.sum(f).alias(f) for f in FOLDS]))
    fields = [f for f in docs.schema.fields if with_text or f.name != text]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])
    if not grams.filter("a > 0 OR b > 0").limit(1).count():
        forget(asked, grams)
        return docs.select(*[f.name for f in fields], F.lit(None).cast("double").alias(out))
    answers = stored(asked.join(probabilities(grams), "gram").select("chunk", "number", "log_a", "log_b"))
    forget(asked, grams)
    told = answers.select("chunk", "number", "log_a", "log_b", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("fold"))
    told = told.unionByName(marked.select("chunk", F.lit(None).cast("int").alias("number"), F.lit(None).cast("float").alias("log_a"), F.lit(None).cast("float").alias("log_b"), "name", "fold"))

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: [] for f in schema.fields})
        with lean():
            rows = _unpacked(left)
            marks = right.column("name").is_valid()
            of = folds(rows, right.filter(marks))
            grams, known = Grams(rows.column(text)), right.filter(pc.invert(marks))
            logs = np.zeros((3, len(grams.used)), dtype=np.float32)
            at = np.flatnonzero(grams.used)[known.column("number").to_numpy()]
            for k, f in enumerate(FOLDS):  # a fold's rows are scored by the other one's model
                logs[1 - k, at] = known.column(f"log_{f}").to_numpy()
            logs[2] = (logs[0] + logs[1]) / 2
            total, n = grams.sums(list(logs), of)
            result = [float(np.exp(-t / k)) if k else None for t, k in zip(total.tolist(), n.tolist())]
            return rows.select([f.name for f in fields]).append_column(out, pa.array(result, pa.float64()))

    return packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(add, schema)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", with_text: bool = True) -> DataFrame:
    """``docs`` with perplexity, threshold and kept.  ``labels`` (doc_id, quality, toxic) tells the trusted rows (1, not toxic)."""
    ppl, limit, kept, own, of, most = column_names(docs, "perplexity", "threshold", "kept", "label_id", "limit_lang", "limit_value")
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(own)).agg(F.min("quality").alias("_quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("_toxic"))
    trusted = known.filter("_quality = 1 AND _toxic = 0").select(own)
    scored = stored(score(docs, trusted.withColumnRenamed(own, doc_id), text, doc_id, with_text, ppl))
    rows = scored.filter(F.col(ppl).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.round(F.log(ppl), 3).alias("_log"))
    seen = rows.join(trusted, F.col("_id") == F.col(own))
    quantile = F.percentile("_log", F.lit(QUANTILE)).alias(most)
    overall = seen.agg(quantile).first()[0]
    limits = seen.groupBy(F.col("_lang").alias(of)).agg(quantile, F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_TRUSTED).drop("_n")
    few = limits.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    joined = scored.join(F.broadcast(limits) if few else limits, F.col(lang).eqNullSafe(F.col(of)), "left")
    chosen = joined.withColumn(most, F.coalesce(most, F.lit(overall).cast("double"))).withColumn(limit, F.exp(most))
    decision = F.coalesce(F.round(F.log(ppl), 3) <= F.col(most), F.lit(False)) if overall is not None else F.lit(True)
    return chosen.withColumn(kept, decision).drop(of, most)
