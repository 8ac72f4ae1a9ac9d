"""Boundary refinement: each boundary moves to the best split of the similarity of the positions around it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _measures(sums: np.ndarray, t: int) -> dict[str, float]:
    """Measures of the split at t, from the sums of all similarities up to each pair of positions."""
    n, inside, total = len(sums), sums[t - 1, t - 1] if t else 0.0, sums[-1, -1]
    cut = sums[t - 1, -1] - inside if t else 0.0
    after = total - inside - 2 * cut
    one, two = inside + cut, after + cut
    intra = (inside + after) / max(1, t * t + (n - t) ** 2)
    inter = cut / max(1, t * (n - t))
    return {
        "modularity": ((inside - one * one / total) + (after - two * two / total)) / (2 * total) if total else 0.0,
        "conductance": -min(cut / max(one, 1e-15), cut / max(two, 1e-15)),
        "intra_inter_sim": intra / inter if inter > 1e-12 else 0.0,
    }


def refine(values: np.ndarray, boundaries: list[int], least: int, measure: str) -> list[int]:
    """Refined boundaries.  Each is searched half a segment to either side, after the refined one before it; the first best wins.

    Similarity of two positions is exp(-|difference| / spread).
    """
    spread = values.std() or 1.0
    out, before = [], 0
    ends = [*boundaries, len(values)]
    for k, b in enumerate(boundaries):
        low, high = before, min(len(values), b + (ends[k + 1] - b) // 2 + 1)
        begin = max(before + least, b - (b - before) // 2)
        part = values[low:high]
        sums = np.exp(-np.abs(part[:, None] - part[None, :]) / spread).cumsum(axis=0).cumsum(axis=1)
        options = range(begin, min(high, b + (ends[k + 1] - b) // 2 + 1))
        best = max(options, key=lambda t: (round(_measures(sums, t - low)[measure], 12), -t), default=b)
        out.append(best)
        before = best
    return out


def refine_sequences(rows: DataFrame, seq: str, pos: str, value: str, boundary: str, least: int, measure: str) -> DataFrame:
    """(seq, k, before, after) for each boundary; a sequence is one group, since each boundary depends on the one before."""
    if measure not in ("modularity", "conductance", "intra_inter_sim"):
        raise ValueError(f"unknown measure: {measure}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        at = [i for i, b in enumerate(pdf[boundary]) if b and i]
        moved = refine(pdf[value].to_numpy(dtype=float), at, least, measure)
        return pd.DataFrame({"seq": [pdf[seq].iloc[0]] * len(at), "k": range(len(at)), "before": at, "after": moved}).astype("int64")

    return rows.groupBy(seq).applyInPandas(run, "seq long, k long, before long, after long")
