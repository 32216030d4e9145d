"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: density and clustering of words from a lexicon, how
often such a word stands near a second-person pronoun, share of capitals, rates
of punctuation, symbols and obfuscated words.  The lexicon is learnt: words of
which far more toxic than clean training texts hold one.

Trained on at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of
their id; one in five of them fits the calibration only.  Every text is scored
whole.  Scale: the labelled sample is small and is broadcast (bounded by
``TRAIN_ROWS``); lexicon counts are combined before the shuffle; scoring is a
map followed by the trees' own column expressions.

Edge cases: null and blank texts have all features 0 and are scored as any
other; a document with several labels counts as toxic if one says so; rows
without a label or id do not train; with no labelled rows or one class only,
every score is that class's share; repeated rows are scored alike; an empty
table gives no rows; further columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import held_out, landed, strings, worker_slot, words

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
#: A lexicon word is in at least so many toxic training texts, and in a share of them this many times that of clean ones.
LEAST_TEXTS, LEAST_RATIO, LEXICON_WORDS = 5, 6.0, 1000
#: Lengths of the word beginnings that can enter the lexicon; there they end in a star.
BEGINNINGS = (4, 5, 6)
#: Characters on either side of a lexicon word in which a pronoun counts as near.
NEAR_CHARS = 30
#: Second-person pronouns of some languages.
PRONOUNS = ("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer "
            "tú ti tus usted ustedes vosotros vuestro").split()
#: Letters that digits and signs stand for.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
FEATURES = ("log_words", "density", "log_hits", "clustering", "near_you", "capitals", "capital_words", "exclamations", "punctuation",
            "symbols", "digits", "obfuscated", "obfuscated_hits")
_STRIP = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_PRONOUN = re.compile(r"(?<!\w)(?:" + "|".join(PRONOUNS) + r")(?!\w)")
_CAPITALS = re.compile(r"\b[A-Z]{3,}\b")
_OBFUSCATED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$*!#%&._-]++[^\W\d_]++)++")
_CLASSES = np.zeros(256, np.uint8)
for _code, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b"!", b".,;:?'\"()-", b"#*$%&|<>@^~_+=[]{}/\\"), start=1):
    _CLASSES[list(_chars)] = _code


@lru_cache(maxsize=2)
def _automaton(lexicon: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in lexicon:
        bare = w.rstrip("*")
        # A beginning that is a whole entry too is the wider of the two.
        found.add_word(bare, (len(bare), bare + "*" in lexicon))
    if lexicon:
        found.make_automaton()
    return found


@lru_cache(maxsize=2)
def _entries(lexicon: tuple[str, ...]) -> frozenset[str]:
    return frozenset(lexicon)


def features(text: str | None, lexicon: tuple[str, ...]) -> list[float]:
    text = text or ""
    lower = text.lower()
    n = max(1, len(text.split()))
    places, near = [], 0
    if lexicon:
        for end, (size, beginning) in _automaton(lexicon).iter(lower):
            start = end - size + 1
            if start and lower[start - 1].isalnum() or not beginning and end + 1 < len(lower) and lower[end + 1].isalnum():
                continue
            if places and places[-1] == start:
                continue
            places.append(start)
            near += bool(_PRONOUN.search(lower, max(0, start - NEAR_CHARS), end + 1 + NEAR_CHARS))
    gaps = np.diff(places) if len(places) > 1 else np.array([])
    kinds = np.bincount(_CLASSES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=7)
    size = max(1, len(text))
    hidden = _OBFUSCATED.findall(lower)
    known = _entries(lexicon)

    def listed(w: str) -> bool:
        return w in known or any(w[:k] + "*" in known for k in BEGINNINGS)

    plain = sum(listed(w.translate(LOOKALIKES)) or listed(re.sub(r"[\W\d_]", "", w)) for w in hidden)
    return [float(np.log1p(len(text.split()))), len(places) / n, float(np.log1p(len(places))), float((gaps < 200).sum()) / n, near / n,
            kinds[2] / max(1, kinds[1] + kinds[2]), len(_CAPITALS.findall(text)) / n, kinds[4] / n, kinds[5] / size, kinds[6] / size,
            kinds[3] / size, len(hidden) / n, plain / n]


def with_features(rows: DataFrame, lexicon: tuple[str, ...], *keep: str, within: str | None = None) -> DataFrame:
    """(keep..., x): the features of ``text``, a column of ``rows`` or a field of the kept struct ``within``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worker_slot("toxicity")
            texts = batch.column(within).field("text") if within else batch.column("text")
            found = [features(t, lexicon) for t in strings(texts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "x"])

    schema = StructType([*[rows.schema[c] for c in keep], StructField("x", ArrayType(DoubleType()))])
    return rows.select(*keep, *([] if within else ["text"])).mapInArrow(run, schema)


def learn_lexicon(train: DataFrame) -> tuple[str, ...]:
    """Words telling toxic from clean texts of (text, toxic)."""
    whole = F.array_distinct(F.transform(words(F.lower("text")), lambda w: F.regexp_replace(w, _STRIP, "")))
    begun = F.array_distinct(F.flatten(F.transform("whole", lambda w: F.transform(
        F.filter(F.array(*map(F.lit, BEGINNINGS)), lambda k: F.length(w) >= k), lambda k: F.concat(F.substr(w, F.lit(1), k), F.lit("*"))))))
    train = train.select("toxic", whole.alias("whole")).select("toxic", F.concat("whole", begun).alias("entries"))
    n = train.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = (n["t"] or 0), n["n"] - (n["t"] or 0)
    counted = train.select("toxic", F.explode("entries").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    ratio = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    least = max(LEAST_TEXTS, toxic // 200)
    kept = counted.filter((F.col("t") >= least) & (ratio >= LEAST_RATIO) & (F.length("word") > 2))
    return tuple(sorted(r["word"] for r in kept.orderBy(F.desc(ratio), "word").limit(LEXICON_WORDS).select("word").collect()))


class Model:
    """Lexicon, trees and calibration; without trees every score is ``share``."""

    def __init__(self, lexicon: tuple[str, ...], trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, docs: DataFrame, *keep: str) -> DataFrame:
        """(keep..., _score) of every row."""
        if self.trees is None:
            return docs.select(*keep, F.lit(self.share).alias("_score"))
        # The kept columns travel in one, whatever their names.
        kept = docs.select(F.struct(*keep).alias("kept"), *([] if "text" in keep else ["text"]))
        rows = with_features(kept, self.lexicon, "kept", within="kept" if "text" in keep else None)
        raw = self.trees.transform(rows.select("kept", array_to_vector("x").alias("features")))
        probed = raw.select("kept", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        score = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
        return self.calibration.transform(probed).select(F.col("kept"), score.alias("value")).select(
            *[F.col("kept")[c].alias(c) for c in keep], F.col("value").alias("_score"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """Learn from labelled documents that are not held out."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    once = usable.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    sample = once.orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_ROWS)
    chosen = docs.select(id_col, "text").join(F.broadcast(sample), id_col).select("text", "toxic", F.xxhash64(id_col).alias("h"))
    train = landed(chosen, "toxicity-train")
    n = train.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not n["n"] or n["t"] in (0, n["n"]):
        return Model((), None, None, float(n["t"] or 0) / max(1, n["n"]))
    fold = F.pmod(F.col("h"), F.lit(5))
    lexicon = learn_lexicon(train.filter(fold != 0))
    rows = landed(with_features(train, lexicon, "toxic", "h").withColumn("fold", fold), "toxicity-features")
    vectors = rows.select(array_to_vector("x").alias("features"), F.col("toxic").cast("double").alias("label"), "fold")
    trees = GBTClassifier(maxDepth=3, maxIter=16, stepSize=0.25, minInstancesPerNode=8, seed=7).fit(vectors.filter("fold <> 0"))
    judged = trees.transform(vectors.filter("fold = 0")).select(F.get(vector_to_array("probability"), F.lit(1)).alias("p"), "label")
    if judged.isEmpty():
        judged = trees.transform(vectors).select(F.get(vector_to_array("probability"), F.lit(1)).alias("p"), "label")
    calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(judged)
    return Model(lexicon, trees, calibration, float(n["t"]) / n["n"])


def toxicity_query(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    scored = fit(docs, labels, id_col).score(docs, id_col)
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those predicted toxic; learns from ``labels`` of ``docs`` themselves."""
    return fit(docs, labels, id_col).score(docs, *docs.columns).filter(F.col("_score") < THRESHOLD).select(*docs.columns)
