"""Quality rules with a robust multivariate outlier test (DataFrame functions only).

Base statistics are exact counts over the whole text.  Documents passing the
base rules are then judged by Mahalanobis distance from a minimum-covariance-
determinant estimate of their language and source: the mean and covariance of
the three quarters of documents lying closest, found by concentration steps.

Scale: the text is read once, and only a narrow row of numbers per document is
kept.  A step is one join with a small table of estimates and one aggregation
with map-side combine into sums per (group, distance bin), so a group holding
a third of all rows is never together in one task.

Edge cases: a null or blank text has zero counts and fails the base rules; null
language and source form groups of their own; a small group leans on the
estimate of its language (``PRIOR`` pseudo-documents) and on the whole table's;
variances have floors, so a statistic that is constant in a group rejects
nobody for a small deviation; repeated rows are judged each; an empty table
gives no rows; further columns are ignored.
"""
from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswork.functions.text import bind

from .common import landed, words

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Share of a group that the estimate rests on.
CORE = 0.75
#: Concentration steps.
STEPS = 4
#: Weight, in documents, of the wider estimate that a group's own is blended with.
PRIOR = 50.0
#: Chi-square with five degrees of freedom: a share of 1.5e-7 of normal documents lies beyond.
CUTOFF = 40.0
#: What makes the covariance of the closest three quarters consistent at a normal
#: distribution in five dimensions: 0.75 / P(chi2_7 <= 6.63).
CONSISTENCY = 1.41
#: Statistics judged, with the least standard deviation assumed for each.
FLOORS = {"x0": 0.35, "x1": 0.12, "x2": 0.02, "x3": 0.12, "x4": 0.12}
#: Parts that a group's documents are dealt into for joins.
SALTS = 32
#: Bins per unit of ln(1 + squared distance).
BINS = 64


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words lying in a window whose hash occurs twice or more.

    Sorted (hash, place) pairs put equal windows side by side; covered words
    are counted from the sorted places.  Linearithmic in the text's length.
    """
    def places(pairs):
        twin = F.filter(pairs, lambda x, i: (
            F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False))))
        return F.sort_array(F.transform(twin, lambda x: x["i"]))

    def covered(at):
        steps = F.transform(at, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return bind(bind(pairs, places), covered)


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Exact counts of each whole text, with the columns in ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(*keep, text.alias("_text"), words(F.col("text")).alias("_words"))
    counted = split.select(
        *keep, "_text", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
        F.filter(F.split("_text", "\n"), lambda s: F.length(F.btrim(s, F.lit("\t\x0b\x0c\r "))) > 0).alias("_lines"))
    h = F.col("_h")
    spans = F.sequence(F.lit(0), F.size(h) - WINDOW)
    windows = counted.select(
        "*", F.when(F.size(h) >= WINDOW, F.transform(spans, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("_windows"))
    w = F.col("_windows")
    return windows.select(
        *keep, "n_words", "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(repeated_words(w)).cast("long").alias("n_repeat_words"))


def _transformed() -> list[Column]:
    """Counts on scales where ordinary documents are roughly normal."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return [F.log1p(n).alias("x0"), F.log(chars / n).alias("x1"), F.sqrt(F.col("n_symbols") / chars).alias("x2"),
            F.sqrt(F.col("n_dup_lines") / lines).alias("x3"), F.sqrt(F.col("n_repeat_words") / n).alias("x4")]


_DIMS = list(FLOORS)
_PAIRS = list(combinations_with_replacement(_DIMS, 2))
_MOMENTS = ["n", *[f"s_{a}" for a in _DIMS], *[f"s_{a}_{b}" for a, b in _PAIRS]]


def _moment_sums() -> list[Column]:
    return [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(a).alias(f"s_{a}") for a in _DIMS],
            *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in _PAIRS]]


def _blended(groups: DataFrame) -> DataFrame:
    """Moments of each group per document, leaning on its language's and these on the whole table's."""
    whole = groups.agg(*[F.sum(c).alias(f"w_{c}") for c in _MOMENTS])
    by_lang = groups.groupBy("g_lang").agg(*[F.sum(c).alias(f"l_{c}") for c in _MOMENTS])
    joined = groups.join(by_lang, "g_lang").join(F.broadcast(whole))  # one row

    def mean(c: str) -> Column:
        upper = F.col(f"w_{c}") / F.col("w_n")
        middle = (F.col(f"l_{c}") + PRIOR * upper) / (F.col("l_n") + PRIOR)
        return (F.col(c) + PRIOR * middle) / (F.col("n") + PRIOR)

    return joined.select("g_lang", "g_source", *[mean(c).alias(c) for c in _MOMENTS[1:]])


def _factored(moments: DataFrame) -> DataFrame:
    """Means and the Cholesky factor of the covariance of each group."""
    out = moments.select("g_lang", "g_source", *[F.col(f"s_{a}").alias(f"m_{a}") for a in _DIMS], *[
        (CONSISTENCY * (F.col(f"s_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}"))
         + (FLOORS[a] ** 2 if a == b else 0.0)).alias(f"c_{a}_{b}") for a, b in _PAIRS])
    for j, a in enumerate(_DIMS):
        inner = sum((F.col(f"l_{a}_{k}") ** 2 for k in _DIMS[:j]), F.lit(0.0))
        out = out.withColumn(f"l_{a}_{a}", F.sqrt(F.greatest(F.col(f"c_{a}_{a}") - inner, F.lit(FLOORS[a] ** 2 / 100))))
        below = {}
        for b in _DIMS[j + 1:]:
            inner = sum((F.col(f"l_{b}_{k}") * F.col(f"l_{a}_{k}") for k in _DIMS[:j]), F.lit(0.0))
            below[f"l_{b}_{a}"] = (F.col(f"c_{a}_{b}") - inner) / F.col(f"l_{a}_{a}")
        out = out.withColumns(below) if below else out
    return out.select("g_lang", "g_source", *[f"m_{a}" for a in _DIMS], *[f"l_{b}_{a}" for a, b in _PAIRS])


def _salted(groups: DataFrame) -> DataFrame:
    """A row per group and salt, so that a group's documents meet theirs in many tasks."""
    return groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _with_distance(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    out = rows.join(_salted(factors), ["g_lang", "g_source", "salt"], "left")
    for j, a in enumerate(_DIMS):
        inner = sum((F.col(f"l_{a}_{k}") * F.col(f"z_{k}") for k in _DIMS[:j]), F.lit(0.0))
        out = out.withColumn(f"z_{a}", (F.col(a) - F.col(f"m_{a}") - inner) / F.col(f"l_{a}_{a}"))
    return out.select(*rows.columns, sum((F.col(f"z_{a}") ** 2 for a in _DIMS), F.lit(0.0)).alias("distance2"))


def _core_sums(rows: DataFrame) -> DataFrame:
    """Moment sums over the bins of distance that hold the closest ``CORE`` of each group."""
    binned = rows.groupBy("g_lang", "g_source", F.floor(F.log1p("distance2") * BINS).alias("bin")).agg(*_moment_sums())
    group = Window.partitionBy("g_lang", "g_source")
    ranked = binned.select("*", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("all"))
    core = ranked.filter(F.col("upto") - F.col("n") < CORE * F.col("all"))
    return core.groupBy("g_lang", "g_source").agg(*[F.sum(c).alias(c) for c in _MOMENTS])


def robust_factors(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate of each (language, source).

    The first core is the closest to the group's medians, taken on a grid of
    1/64 so that the exact median needs bounded state; each concentration step
    then lowers the determinant of the core's covariance.  Each step's estimates
    (a row per group) are written, so that plans do not nest.
    """
    grid = [F.percentile(F.round(F.col(a) * 64) / 64, 0.5).alias(f"m_{a}") for a in _DIMS]
    medians = rows.groupBy("g_lang", "g_source").agg(*grid)
    start = rows.join(_salted(medians), ["g_lang", "g_source", "salt"]).select(*rows.columns, sum(
        (((F.col(a) - F.col(f"m_{a}")) / FLOORS[a]) ** 2 for a in _DIMS), F.lit(0.0)).alias("distance2"))
    factors = landed(_factored(_blended(_core_sums(start))), "quality-rules-step")
    for _ in range(STEPS):
        factors = landed(_factored(_blended(_core_sums(_with_distance(rows, factors)))), "quality-rules-step")
    return factors


def quality_rules(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Base counts, ``base_failed``, ``distance2`` and ``kept`` of every document."""
    named = docs.select(F.col(id_col), F.col("text"), F.coalesce("lang", F.lit("")).alias("g_lang"),
                        F.coalesce("source", F.lit("")).alias("g_source"))
    counts = base_statistics(named, id_col, "g_lang", "g_source")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = landed(counts.select("*", failed.alias("base_failed"), *_transformed(),
                                F.pmod(F.xxhash64(id_col, "n_words"), F.lit(SALTS)).cast("int").alias("salt")), "quality-rules")
    factors = robust_factors(rows.filter(~F.col("base_failed")).select("g_lang", "g_source", "salt", *_DIMS))
    judged = _with_distance(rows, factors)
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2",
        (~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True))).alias("kept"))
