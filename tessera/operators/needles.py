"""Which texts hold which needles, for very many needles: an equi-join on minimizers, then verification.

Every GRAM consecutive bytes of a text have a hash; of each WINDOW consecutive ones the least is a minimizer.  A text that holds a needle has
the needle's windows among its own, so it has all minimizers of the needle's windows.  A needle is filed under the one of them that the fewest
texts have; texts that have it are candidates, and those are searched.  Texts are read once, whatever the number of needles.
Needles that are shorter than a window are for the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.bounded import spread
from tessera.tables import working, written

GRAM, WINDOW = 8, 24
#: Bytes that a needle has at least.
LEAST = GRAM + WINDOW - 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def minimizers(text: str) -> np.ndarray:
    """Distinct minimizers of a text; none if it is shorter than a window."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64)
    n = len(data) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        grams = grams << np.uint64(8) | data[k : k + n]
    grams = grams * _FACTOR
    grams ^= grams >> np.uint64(32)
    grams *= _FACTOR
    least, width = grams, 1
    while width < WINDOW:  # minima of doubling widths
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return np.unique(least).view(np.int64)


def _with_minimizers(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, gram) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [minimizers(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.concatenate(found))], names=[key, "gram"])

    return rows.select(key, body).mapInArrow(run, f"{key} long, gram long")


def held(items: DataFrame, docs: DataFrame, item: str, doc: str, needle: str, body: str) -> DataFrame:
    """(item, doc): documents whose body holds the item's needle; needles have LEAST bytes or more, ids are longs that aren't null."""
    with working(items.sparkSession) as keep:
        asked, texts = written(items.select(item, needle)), spread(docs.select(doc, body))
        grams = written(_with_minimizers(asked, item, needle))
        wanted = grams.select("gram").distinct()
        known = written(_with_minimizers(texts, doc, body).join(wanted, "gram", "left_semi"))
        often = known.groupBy("gram").agg(F.count("*").alias("n"))
        rarest = grams.join(often, "gram", "left").groupBy(item).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).select(item, "least.gram")
        pairs = rarest.join(known, "gram").select(item, doc)
        done = written(pairs.join(asked, item).join(texts, doc).filter(F.contains(body, F.col(needle))).select(item, doc).distinct())
        keep.append(done)
    return done
