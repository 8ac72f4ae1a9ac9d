"""Metrics by the name of a data set: (prediction, truth, classes) -> score from 0 to 1."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import pyfuncs, records, text

Metric = Callable[[Column, Column, Column], Column]


def multiset_f1(prediction: Column, truth: Column) -> Column:
    """F1 of two token arrays, tokens counted as often as they occur."""
    common = F.aggregate(F.array_distinct(prediction), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(prediction, lambda x: x == w)), F.size(F.filter(truth, lambda x: x == w))))
    return F.when(common > 0, 2 * common / (F.size(prediction) + F.size(truth))).otherwise(0.0)


def answer_f1(prediction: Column, truth: Column, classes: Column) -> Column:
    tokens = lambda c: F.filter(F.split(text.normalize_answer(c), " "), lambda w: w != "")
    return multiset_f1(tokens(prediction), tokens(truth))


#: Word segmenters by language, functions from a text column to an array of words by built-in functions (columns are cut beforehand by
#: others, see ``operators/segmentation.py``); without one, characters are words.
SEGMENTERS: dict[str, Callable[[Column], Column]] = {}


def segmented(column: Column, language: str) -> Column:
    return SEGMENTERS.get(language, lambda c: F.filter(F.split(c, ""), lambda w: w != ""))(column)


def segmented_f1(prediction: Column, truth: Column, classes: Column) -> Column:
    words = lambda c: F.filter(F.transform(segmented(c, "zh"), lambda w: text.normalize_zh_answer(w)), lambda w: w != "")
    return multiset_f1(words(prediction), words(truth))


def segmented_rouge(prediction: Column, truth: Column, classes: Column) -> Column:
    words = lambda c: F.array_join(segmented(c, "zh"), " ")
    return pyfuncs.rouge(words(prediction), words(truth))


def paragraph_score(word: str) -> Metric:
    """The share of the numbers in the prediction that are the truth's paragraph."""

    def score(prediction: Column, truth: Column, classes: Column) -> Column:
        numbers = F.regexp_extract_all(prediction, F.lit("([0-9]+)"), F.lit(1))
        hits = F.size(F.filter(numbers, lambda n: n == text.paragraph_id(truth, word)))
        return F.when(F.size(numbers) > 0, hits / F.size(numbers)).otherwise(0.0)

    return score


def first_number_is(prediction: Column, truth: Column, classes: Column) -> Column:
    """Whether the first run of digits is the truth."""
    return (F.regexp_extract(prediction, "([0-9]+)", 1) == truth).cast("double")


def among_words(prediction: Column, truth: Column, classes: Column) -> Column:
    """Whether the truth is one of the prediction's words, punctuation and the like being blanks."""
    return F.array_contains(text.words(F.regexp_replace(prediction, "[" + re.escape("\n:\"'.,?!{}") + "]", " ")), truth).cast("double")


def choice(prediction: Column, truth: Column, classes: Column) -> Column:
    """Whether the first letter that names an option is the truth."""
    return (F.regexp_extract(prediction, r"\b([A-D])\b", 1) == truth).cast("double")


def contained(prediction: Column, truth: Column, classes: Column) -> Column:
    return F.contains(prediction, truth).cast("double")


def nothing(prediction: Column, truth: Column, classes: Column) -> Column:
    return F.lit(None).cast("double")


def _pair(f: Callable[[Column, Column], Column]) -> Metric:
    return lambda prediction, truth, classes: f(prediction, truth)


METRICS: dict[str, Metric] = {
    "answer_f1": answer_f1,
    "segmented_f1": segmented_f1,
    "rouge": _pair(pyfuncs.rouge),
    "segmented_rouge": segmented_rouge,
    "classes": records.class_score,
    "paragraph_en": paragraph_score("Paragraph "),
    "paragraph_zh": paragraph_score("段落"),
    "count": _pair(text.number_score),
    "code": _pair(pyfuncs.fuzzy),
    "key": among_words,
    "first_number": first_number_is,
    "choice": choice,
    "contained": contained,
    "none": nothing,
}

#: The metric of each data set; names of your own are added.
BY_DATASET = {
    "narrativeqa": "answer_f1",
    "qasper": "answer_f1",
    "multifieldqa_en": "answer_f1",
    "multifieldqa_zh": "segmented_f1",
    "hotpotqa": "answer_f1",
    "2wikimqa": "answer_f1",
    "musique": "answer_f1",
    "dureader": "segmented_rouge",
    "gov_report": "rouge",
    "qmsum": "rouge",
    "multi_news": "rouge",
    "vcsum": "segmented_rouge",
    "trec": "classes",
    "triviaqa": "answer_f1",
    "samsum": "rouge",
    "lsht": "classes",
    "passage_retrieval_en": "paragraph_en",
    "passage_count": "count",
    "passage_retrieval_zh": "paragraph_zh",
    "lcc": "code",
    "repobench-p": "code",
    "narrativeqa-full": "answer_f1",
    "longbook_qa_eng": "answer_f1",
    "longbook_qa_chn": "segmented_f1",
    "longbook_sum_eng": "rouge",
    "kv_retrieval": "key",
    "kv_retrieval_prefix": "key",
    "kv_retrieval_both": "key",
    "passkey": "first_number",
    "number_string": "first_number",
    "code_run": "first_number",
    "math_find": "first_number",
    "math_calc": "first_number",
    "code_debug": "choice",
    "longbook_choice_eng": "choice",
    "longdialogue_qa_eng": "contained",
    "pg19": "none",
}


def metric_of(dataset: str) -> Metric:
    """The metric of a data set; endings that tell a length variant don't count.  Unknown names raise ValueError."""
    name = dataset.replace("__long", "")
    name = name if name in BY_DATASET else name.removesuffix("_e")
    if name not in BY_DATASET:
        raise ValueError(f"no metric for data set: {dataset}")
    return METRICS[BY_DATASET[name]]


def score(dataset: Column, prediction: Column, truth: Column, classes: Column, datasets: list[str]) -> Column:
    """The score by the row's data set, one of ``datasets``."""
    found = F.lit(None).cast("double")
    for name in datasets:
        found = F.when(dataset == name, metric_of(name)(prediction, truth, classes).cast("double")).otherwise(found)
    return found
