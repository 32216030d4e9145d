"""Extractive summaries as one column expression."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fixed
from .text import SPACES, text_or_empty, word_count

TARGET_WORDS = 55
SLACK_WORDS = 10
SENTENCES_READ = 10


def sentences(c: Column | str) -> Column:
    return F.split(text_or_empty(c), r"\. ")


def sentence_score(low: Column, n_words: Column, position: Column) -> Column:
    """Position, length and keyword score of a lower-cased sentence."""
    score = (F.lit(SENTENCES_READ) - position) * F.lit(0.1)
    score = score + (
        F.when(n_words.between(10, 30), F.lit(0.5)).when(n_words.between(5, 50), F.lit(0.2)).otherwise(F.lit(0.0))
    )
    for keyword in fixed.SUMMARY_KEYWORDS:
        score = score + F.when(F.contains(low, F.lit(keyword)), F.lit(0.3)).otherwise(F.lit(0.0))
    return score


def ranked_sentences(c: Column | str) -> Column:
    """The first ten sentences as structs, best score first, earlier one on a tie."""
    read = F.transform(
        F.slice(sentences(c), 1, SENTENCES_READ),
        lambda s: F.struct(s.alias("sentence"), F.lower(s).alias("low"), word_count(s).alias("words")),
    )
    scored = F.transform(
        read,
        lambda x, i: F.struct(
            (-sentence_score(x["low"], x["words"], i)).alias("minus_score"),
            i.alias("position"),
            x["words"].alias("words"),
            x["sentence"].alias("sentence"),
        ),
    )
    return F.sort_array(scored)


def extractive_summary(c: Column | str) -> Column:
    """Take sentences in score order while they fit in 65 words; stop at 55."""
    start = F.struct(
        F.lit(0).alias("total"),
        F.array().cast("array<string>").alias("picked"),
    )

    def step(acc, s):
        fits = (acc["total"] < TARGET_WORDS) & (acc["total"] + s["words"] <= TARGET_WORDS + SLACK_WORDS)
        return F.when(
            fits,
            F.struct(
                (acc["total"] + s["words"]).alias("total"),
                F.concat(acc["picked"], F.array(s["sentence"])).alias("picked"),
            ),
        ).otherwise(acc)

    return F.aggregate(ranked_sentences(c), start, step, lambda acc: F.array_join(acc["picked"], " "))


def trim_words(c: Column | str, longest: int = 65, keep: int = 60) -> Column:
    """Cut a longer text to ``keep`` words and mark the cut."""
    ws = F.filter(F.split(text_or_empty(c), SPACES), lambda w: w != "")
    return F.when(
        F.size(ws) > longest, F.concat(F.array_join(F.slice(ws, 1, keep), " "), F.lit("..."))
    ).otherwise(text_or_empty(c))


def leading_text(c: Column | str, n: int = 300) -> Column:
    """First ``n`` characters, marked when cut: used when a summary cannot be made."""
    text = text_or_empty(c)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
