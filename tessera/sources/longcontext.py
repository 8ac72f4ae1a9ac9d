"""Shaping of long-context tasks: field extraction by data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import words

#: Letters of multiple-choice options, what a code question's call and a list question's number look like, where a key
#: stands in its question, and the data sets by what is taken from them.
LETTERS = ("A", "B", "C", "D")
CALL, NUMBER = r"func_[0-9]+\(-?[0-9]+\)", r"The .+ of"
KEY_AT, KEY_SIZE = 7, 38
CHOICE = ("code_debug", "longbook_choice_eng")
WITHOUT_QUESTION = ("code_debug", "code_debug_qa", "longdialogue_qa_eng", "longbook_sum_eng", "math_calc")


def function_call(question: Column) -> Column:
    """The first call that a code question asks about; null if there is none."""
    return F.nullif(F.regexp_extract(question, CALL, 0), F.lit(""))


def list_question(question: Column) -> Column:
    """What is asked of a list of numbers; null if the question names none."""
    found = F.regexp_extract(question, NUMBER, 0)
    named = F.lower(F.regexp_replace(found, " of$", ""))
    return F.when(found != "", F.concat(F.lit("What is "), named, F.lit(" in the following list?")))


def answer_letter(options: Column, answer: Column) -> Column:
    """The letter of the option that is the answer; null if none is."""
    at = F.array_position(options, answer)
    return F.when(at > 0, F.try_element_at(F.array(*[F.lit(x) for x in LETTERS]), at.cast("int")))


def answers_of(dataset: Column, options: Column, answers: Column) -> Column:
    """Answers as a list; of multiple choices the text and its letter, unless both are given."""
    one = F.element_at(answers, 1)
    chosen = F.when((F.size(answers) == 2) & F.element_at(answers, 2).isin(*LETTERS), answers).when(F.size(answers) == 1, F.array(one, answer_letter(options, one)))
    return F.when(dataset.isin(*CHOICE), chosen).otherwise(answers)


#: What a pass key stands in, and what is put around it.
PASSKEY = "The pass key is {}. Remember it. {} is the pass key."
NOISE = "The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again. "


def passkey_sentence(passkey: Column) -> Column:
    before, between, after = PASSKEY.split("{}")
    return F.concat(F.lit(before), passkey, F.lit(between), passkey, F.lit(after))


def extended(context: Column, passkey: Column, length: int) -> Column:
    """The context with noise on both sides of its pass key's sentence, so that it has about ``length`` words.

    Whole noises only; before the sentence as large a share of them as of the context stands there.  A context that is long enough, or
    doesn't hold the sentence, stays as it is (but for a space after the sentence, which there is in any case).
    """
    sentence, noise_words = passkey_sentence(passkey), len(NOISE.split())
    at = F.position(sentence, context) - 1
    missing = F.greatest(F.lit(0), F.floor((F.lit(length) - F.size(words(context))) / noise_words)).cast("int")
    before = F.floor(at / F.length(context) * missing).cast("int")
    rest = F.substring(context, at + F.length(sentence) + 2, F.length(context))
    whole = F.concat(F.substring(context, F.lit(1), at), F.repeat(F.lit(NOISE), before), sentence, F.lit(" "), F.repeat(F.lit(NOISE), missing - before), rest)
    return F.when(at >= 0, whole).otherwise(context)


def shape(tasks: DataFrame) -> DataFrame:
    """Adds ``asked``, ``function``, ``choices``, ``labels`` and ``length`` to (dataset, context, question, options, answers).

    ``asked``: the call of a code question, the number asked of a list, the key to look up, else the question where the data set has one.
    """
    dataset, question = F.col("dataset"), F.col("question")
    asked = (
        F.when(dataset == "code_run", function_call(question))
        .when(dataset == "math_find", list_question(question))
        .when(dataset == "kv_retrieval", F.substring(question, KEY_AT, KEY_SIZE))
        .when(~dataset.isin(*WITHOUT_QUESTION), question)
    )
    function = F.when(dataset == "code_run", F.substring_index(function_call(question), "(", 1))
    choices = F.when(dataset.isin(*CHOICE), F.slice("options", 1, len(LETTERS)))
    return tasks.withColumns({"asked": asked, "function": function, "choices": choices, "labels": answers_of(dataset, F.col("options"), F.col("answers")), "length": F.size(words(F.col("context")))})
