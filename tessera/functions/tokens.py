"""Token arrays: chunks, labels, padding, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunks(tokens: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` tokens, the last one shorter; none for an empty array."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - 1), F.lit(size)), lambda i: i < F.size(tokens))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(size)))


def prefixed_chunks(prefix: Column, tokens: Column, block: int) -> Column:
    """Chunks of ``block`` tokens, each beginning with the prefix; a prefix that leaves no room raises an error."""
    room = F.lit(block) - F.size(prefix)
    checked = F.when(room <= 0, F.raise_error(F.lit("prefix leaves no room"))).otherwise(room)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - 1), F.greatest(F.lit(1), checked)), lambda i: i < F.size(tokens))
    return F.transform(starts, lambda i: F.concat(prefix, F.slice(tokens, i + 1, F.greatest(F.lit(1), room))))


def next_token_labels(ids: Column, pad: Column) -> Column:
    """Each token's label is the next one; the last gets the pad."""
    return F.concat(F.slice(ids, F.lit(2), F.greatest(F.lit(0), F.size(ids))), F.array(pad))


def keep_last(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) > n, F.slice(tokens, -n, n)).otherwise(tokens)


def keep_first(tokens: Column, n: Column | int) -> Column:
    return F.slice(tokens, F.lit(1), F.lit(n) if isinstance(n, int) else n)


def head_and_tail(tokens: Column, head: int, most: int) -> Column:
    """The first ``head`` and the last ``most - head`` tokens of what is longer than ``most``."""
    return F.when(F.size(tokens) > most, F.concat(F.slice(tokens, 1, head), F.slice(tokens, -(most - head), most - head))).otherwise(tokens)


def answer_labels(ids: Column, answer_at: Column, end: Column) -> Column:
    """-100 before the answer, shifted by one, the end token last."""
    masked = F.transform(ids, lambda v, i: F.when(i < answer_at, F.lit(-100)).otherwise(v))
    return F.concat(F.slice(masked, F.lit(2), F.greatest(F.lit(0), F.size(ids))), F.array(end))


def middle_labels(ids: Column, middle: Column, end: Column) -> Column:
    """-100 up to the first middle marker; the end token is appended where it isn't there."""
    closed = F.when(F.element_at(ids, -1) == end, ids).otherwise(F.concat(ids, F.array(end)))
    at = F.array_position(ids, middle)
    return F.transform(closed, lambda v, i: F.when(i < at, F.lit(-100)).otherwise(v))


def padded(ids: Column, size: Column, pad: Column, left: bool = False) -> Column:
    fill = F.array_repeat(pad, (size - F.size(ids)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)
