"""Folds with few states over sequences of any length, by composing chunks' functions.

A fold whose state is a number below ``states`` turns a chunk of a sequence into a function from the state before it to the state after
it, with the number of marks it sets on the way.  Such functions compose associatively: chunks are composed FAN at a time, level by
level, until one function a sequence is left; then states go down the levels again, and each chunk is walked once more from the state in
which it really begins.  No task sees more than a chunk or FAN functions, however long a sequence is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import ordinal
from tessera.tables import working, written

CHUNK, FAN = 4_096, 64

#: (states before, items) -> (states after, whether the items begin new parts), on arrays; items broadcast against states.
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _composed(functions: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    after, marks = functions[0]
    for other, more in functions[1:]:
        after, marks = other[after], marks + more[after]
    return after, marks


def _pieces(ordinals: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks among sorted rows begin, and their lengths, longest first."""
    begin = np.flatnonzero(ordinals % chunk == 0)
    length = np.diff(begin, append=len(ordinals))
    order = np.argsort(-length, kind="stable")
    return begin[order], length[order]


def _walk(items: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, step: Step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All chunks at once, place by place: their last states, their marks, and for a single state a chunk the marks at each item."""
    marks, each = np.zeros(state.shape, dtype=np.int64), np.zeros(len(items), dtype=np.int64)
    for t in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -t, side="left"))  # chunks that have a t-th item
        at = begin[:n] + t
        item = items[at] if state.ndim == 1 else items[at, None]
        state[:n], begins = step(state[:n], item)
        marks[:n] += begins
        if state.ndim == 1:
            each[at] = marks[:n]
    return state, marks, each


def numbered_parts(rows: DataFrame, group: str, order: list[str], item: str, step: Step, states: int, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``rows`` with ``ordinal`` (from 0 in ``order``) and ``part``: how many of the items up to it, less one, begin a part, by ``step`` from state 0.

    Chunks are dealt to units of about ``chunk`` rows, so that short sequences are walked many at a time.
    """
    spark = rows.sparkSession
    with working(spark) as keep:
        numbered = ordinal(rows, order, within=(group,)).withColumn("_chunk", F.floor(F.col("ordinal") / chunk))
        units = max(1, -(-rows.count() // chunk))
        placed = written(numbered.withColumn("_unit", F.pmod(F.xxhash64(group, "_chunk"), F.lit(units)).cast("int")))
        kind, columns = placed.schema[group].dataType.simpleString(), placed.columns
        function = f"{group} {kind}, _chunk long, after array<int>, marks array<long>"
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)

        def as_functions(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([group, "ordinal"])
            begin, length = _pieces(pdf["ordinal"].to_numpy(), chunk)
            after, marks, _ = _walk(pdf[item].to_numpy(), begin, length, np.tile(np.arange(states), (len(begin), 1)), step)
            return pd.DataFrame({group: pdf[group].to_numpy()[begin], "_chunk": pdf["_chunk"].to_numpy()[begin], "after": after.tolist(), "marks": marks.tolist()})

        def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_chunk")
            after, marks = _composed([(np.array(a), np.array(m)) for a, m in zip(pdf["after"], pdf["marks"])])
            return pd.DataFrame({group: [key[0]], "_chunk": [key[1]], "after": [after.tolist()], "marks": [marks.tolist()]})

        def descend(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_chunk")
            state, before, out = int(pdf["state"].iloc[0]), int(pdf["before"].iloc[0]), []
            for at, after, marks in zip(pdf["_chunk"], pdf["after"], pdf["marks"]):
                out.append((key[0], at, state, before))
                before, state = before + int(marks[state]), int(after[state])
            return pd.DataFrame(out, columns=[group, "_chunk", "state", "before"])

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([group, "ordinal"])
            begin, length = _pieces(pdf["ordinal"].to_numpy(), chunk)
            _, _, each = _walk(pdf[item].to_numpy(), begin, length, pdf["state"].to_numpy()[begin].astype(np.int64), step)
            pdf["part"] = pdf["before"].to_numpy() + each - 1
            return pdf[[*columns, "part"]]

        long = placed.filter("_chunk > 0").select(F.col(group).alias("_group")).distinct()
        levels = [written(placed.select(group, "_chunk", "_unit", "ordinal", item).join(long, F.col(group).eqNullSafe(F.col("_group")), "left_semi").groupBy("_unit").applyInPandas(as_functions, function))]
        while (levels[-1].agg(F.max("_chunk")).first()[0] or 0) > 0:
            below = levels[-1].select(group, F.col("_chunk").alias("_below"), "after", "marks", F.floor(F.col("_below") / fan).alias("_chunk"))
            grouped = below.withColumnsRenamed({"_chunk": "_up", "_below": "_chunk"}).groupBy(group, F.col("_up"))
            levels.append(written(grouped.applyInPandas(compose, function)))
        begins = levels[-1].select(group, "_chunk", F.lit(0).alias("state"), F.lit(0).cast("long").alias("before"))
        entry = f"{group} {kind}, _chunk long, state int, before long"
        for level in reversed(levels[:-1]):
            above = begins.select(F.col(group).alias("_group"), F.col("_chunk").alias("_up"), "state", "before")
            joined = level.join(above, F.col(group).eqNullSafe(F.col("_group")) & (F.floor(F.col("_chunk") / fan) == F.col("_up"))).drop("_group")
            begins = joined.groupBy(group, "_up").applyInPandas(descend, entry)
        if len(levels) > 1:
            begins = begins.select(F.col(group).alias("_group"), F.col("_chunk").alias("_at"), "state", "before")
            ready = placed.join(begins, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_chunk") == F.col("_at")), "left").drop("_group", "_at").fillna(0, ["state", "before"])
        else:  # every sequence is one chunk
            ready = placed.withColumns({"state": F.lit(0), "before": F.lit(0).cast("long")})
        done = written(ready.groupBy("_unit").applyInPandas(finish, f"{fields}, part long"))
        keep.append(done)
    return done.drop("_chunk", "_unit")
