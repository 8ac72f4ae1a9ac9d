"""The corpus pipeline: language ID, quality, near-duplicates, mixing, tokens.  Each stage's Parquet is the next one's docs.

A stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of ``documents``.
Rows leave where a stage decides so: texts without letters, long texts between two languages, texts above their language's perplexity threshold,
all but one row of each near-duplicate group.  Mixing repeats or leaves out documents by their source's rate.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixing, nearcopies, quality
from tessera.llm.common import column_names, forget, scope, stored, table

#: Below this score the two closest languages are nearly even; fewer than about 50 phrases, or LEAST_LETTERS, can't tell 2 %.
LEAST_SCORE, LEAST_LETTERS = 0.02, 250
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of the last stage's tables: its workers share the executors with what the JVM holds after the stages before.
MOVES, PIECES = 150_000, 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters, but not long ones that are as close to another language; short ones tie by chance and stay."""
    lang, score = column_names(docs, "lang_pred", "score")
    known = langid.identify(docs, langid.sample(docs))
    told = (F.col(score) >= LEAST_SCORE) | (F.length(F.regexp_replace("text", r"\P{L}+", "")) < LEAST_LETTERS)
    return known.filter((F.col(lang) != langid.UNKNOWN) & told).select(docs.columns)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose perplexity is within their language's threshold: null, empty and blank texts have none and go; repeated rows stay
    or go together; names of the operator that are taken get underscores in front."""
    _, _, kept = column_names(docs, "perplexity", "threshold", "kept")
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.filter(F.col(kept)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, Jaccard 0.8): of the least doc_id, nulls last, then by hash of the text."""
    rows = nearcopies.groups(docs).groupBy("group_id", "doc_id", "copy").agg(F.count("*").alias("n"))
    first = rows.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy", "n")).alias("first"))
    kept = stored(first.select("first.doc_id", "first.copy", "first.n"))
    gone = nearcopies.without_names(rows.select("doc_id", "copy"), kept)
    repeats = kept.filter("n > 1").select("doc_id", "copy")
    once = nearcopies.with_names(docs, stored(gone.unionByName(repeats)), "left_anti")
    repeated = nearcopies.with_names(docs, repeats, "left_semi")
    least = repeated.groupBy("doc_id", F.xxhash64("text").alias("_copy")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return once.select(docs.columns).unionByName(least.select("_row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that a source's share is the square root of its bytes: null texts weigh nothing, null sources are one source, rows
    with one doc_id and text are drawn alike."""
    return mixing.replicate(docs, mixing.rates(docs, exponent=0.5), seed=42).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens, round_trip (the ids decode to the text) of each row: null texts have no tokens; other columns go."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, decoded_col="decoded", moves=MOVES, pieces=PIECES)
    return coded.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("quality", judge_quality),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL can't express the models and automata of the stages; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, by way of Parquet in the shared folder, which goes when the next stage's is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    with scope() as whole:
        for _, stage in STAGES[:-1]:
            with scope() as own:  # what the stage stores goes with it
                docs = own.keep(stored(stage(spark, docs, sf_dir)))
            if before is not None:
                forget(before)
            before = docs
        whole.keep(docs)
        return STAGES[-1][1](spark, docs, sf_dir)
