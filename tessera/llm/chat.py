"""Chat formatting by prefix-target expansion (operator 2, DataFrame functions only).

Each assistant turn becomes an example of its own: all turns before it are context, and only its reply is trainable.
A conversation that ends with other turns gets one more example without a trainable part, so that no turn is lost.
A turn is written ``<s>[ROLE]role[/ROLE]text</s>``; in roles and texts ``&``, ``<`` and ``[`` become ``&amp;``, ``&lt;`` and
``&#91;``, so nothing that a user writes reads as a control string, and the way back is exact.
``loss_start`` and ``loss_end`` (code points, from 0, end excluded) bound the trainable reply inside ``formatted``.

A conversation is brought together by its id (one example holds it anyway); from there on there is no shuffle.
Examples repeat their context, so the output grows with the square of a conversation's turns: that is the format.

Edge cases: null role or text counts as empty; rows with null conv_id form one conversation; turns go by number (null
first), equal numbers by role, then text; repeated rows are turns of their own; an empty table gives no rows; columns
other than the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
OPEN, ROLE_END, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), target_turn (null without a trainable part), formatted, loss_start, loss_end."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), text.alias("text")))).alias("turns"))
    pieces = grouped.select(
        "conv_id",
        "turns",
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    targets = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (F.element_at("turns", i + 1)["role"] == TRAINED_ROLE) | (i == F.size("turns") - 1))
    examples = pieces.select("conv_id", "turns", "heads", "bodies", F.posexplode(targets).alias("example", "at"))
    written = F.zip_with(F.slice("heads", 1, F.col("at")), F.slice("bodies", 1, F.col("at")), lambda h, b: F.concat(h, b, F.lit(CLOSE)))
    target = F.element_at("turns", F.col("at") + 1)
    trained = target["role"] == TRAINED_ROLE
    spread = examples.select(
        "conv_id",
        "example",
        F.when(trained, target["turn"]).alias("target_turn"),
        trained.alias("trained"),
        F.concat(F.array_join(written, ""), F.element_at("heads", F.col("at") + 1)).alias("prompt"),
        F.element_at("bodies", F.col("at") + 1).alias("reply"),
    )
    start = F.length("prompt").cast("long")
    return spread.select(
        "conv_id",
        "example",
        "target_turn",
        F.concat("prompt", "reply", F.lit(CLOSE)).alias("formatted"),
        start.alias("loss_start"),
        (start + F.when(F.col("trained"), F.length("reply")).otherwise(0)).alias("loss_end"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted example, read back: array of (role, text)."""
    parts = F.slice(F.split(formatted, r"<s>\[ROLE\]"), 2, F.length(formatted))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, ROLE_END, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, ROLE_END) + F.lit(len(ROLE_END)), F.length(p) - F.instr(p, ROLE_END) - F.lit(len(ROLE_END) + len(CLOSE) - 1))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of a formatted example, read back."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), (end - start).cast("int")))
