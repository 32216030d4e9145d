"""Language identification by nearest clustered centroid.

A text is a TF-IDF vector of hashed character n-grams of its letters, of unit
length.  The vectors of each language's training texts are clustered, and a
text gets the language of the centroid with the highest cosine.  A cosine below
what nearly all of that cluster's own texts reach marks it as rejected: its
language is then the nearest one, but may be none of those learnt.

Trained on at most ``PER_LANGUAGE`` texts per language, those with the smallest
hash of their id; every text is scored whole.  Scale: the sample is cut by
task and by part of a language, as ids only, before a language meets in one
task; scoring is a map.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is
every text if nothing can be learnt; training texts need a language and an id; very long
texts are counted in slices; repeated rows are scored alike; an empty table
gives no rows; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import held_out, landed, strings
from .ngrams import code_points, hashed_counts, letters

DIMS = 2048
SIZES = (1, 2, 3)
PER_LANGUAGE = 1000
#: Parts of a language that are cut to PER_LANGUAGE before it as a whole is.
PARTS = 64
CLUSTERS = 4
ROUNDS = 12
#: Share of a cluster's own texts that would be rejected.
REJECT = 0.005
#: Sharpness of the score.
SHARPNESS = 25.0
UNKNOWN = "und"


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts of the letters of a text, other characters being gaps; None without a letter."""
    points = code_points((text or "").lower())
    known = letters()[np.minimum(points, 0x10FFFF)]
    if not known.any():
        return None
    points = np.where(known, points, 32)
    # Gaps count once: a gap after a gap goes.
    keep = known.copy()
    keep[1:] |= known[:-1]
    return hashed_counts(np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint32), SIZES, DIMS)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(tf) * idf
    return x / max(float(np.linalg.norm(x)), 1e-12)


def cluster(x: np.ndarray, k: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit rows, and the cosine below which a text is rejected, of each."""
    centres = x.mean(axis=0, keepdims=True)
    while len(centres) < min(k, len(x)):  # next: the row farthest from all so far
        centres = np.vstack([centres, x[(x @ centres.T).max(axis=1).argmin()]])
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    best = x @ centres.T
    near = best.argmax(axis=1)
    floor = np.array([np.quantile(best[near == c, c], REJECT) if (near == c).any() else 1.0 for c in range(len(centres))])
    return centres, floor


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, floors: np.ndarray):
        self.idf, self.floors, self.centres = idf, floors, centres
        self.names = sorted(set(langs))
        self.lang = np.array([self.names.index(x) for x in langs], np.int64)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        tf = counts(text)
        if tf is None or not self.names:
            return UNKNOWN, 0.0, True
        cosine = self.centres @ weighted(tf, self.idf)
        per_lang = np.full(len(self.names), -1.0)
        np.maximum.at(per_lang, self.lang, cosine)
        share = np.exp(SHARPNESS * (per_lang - per_lang.max()))
        best = int(per_lang.argmax())
        at = int(np.where(self.lang == best, cosine, -2.0).argmax())
        return self.names[best], float(share[best] / share.sum()), bool(cosine[at] < self.floors[at])


def fit(docs: DataFrame) -> Model:
    """Learn from (id, text, lang); see the module's text for the sample."""
    # The sample is chosen without texts, in parts of each language first; its texts are fetched afterwards.
    rows = docs.filter("lang is not null and id is not null").select("lang", "id", F.xxhash64("id").alias("h"))
    parts = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h", "id")
    whole = Window.partitionBy("lang").orderBy("h", "id")
    for window in (parts, whole):
        rows = rows.withColumn("at", F.row_number().over(window)).filter(F.col("at") <= PER_LANGUAGE).drop("at")
    chosen = rows.select("id", "lang").distinct()
    sample = docs.select("id", "lang", "text").join(F.broadcast(chosen), ["id", "lang"])  # at most PER_LANGUAGE per language

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, x.astype(np.float32)) for text, lang in zip(strings(batch.column("text")), batch.column("lang").to_pylist())
                     if (x := counts(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()),
                                              pa.array([b for _, b in found], pa.list_(pa.float32()))], names=["lang", "tf"])

    rows = landed(sample.select("text", "lang").repartition(F.col("lang"), F.xxhash64("text") % 8).mapInArrow(
        vectors, "lang string, tf array<float>"), "language-vectors")

    def document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMS), 0
        for batch in batches:
            df, n = df + sum(((x > 0) for x in batch["tf"]), np.zeros(DIMS)), n + len(batch)
        yield pd.DataFrame({"n": [n], "df": [df]})

    parts = rows.select("tf").mapInPandas(document_counts, "n long, df array<double>").collect()  # a row per task of the sample
    n, df = sum(p["n"] for p in parts), sum((np.array(p["df"]) for p in parts), np.zeros(DIMS))
    idf = np.log((1 + n) / (1 + df)) + 0.1

    def clustered(batch: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([weighted(v, idf) for v in sorted(batch["tf"], key=lambda v: v.tobytes())])
        centres, floors = cluster(x)
        return pd.DataFrame({"lang": batch["lang"].iloc[0], "centre": list(centres), "floor": floors})

    found = rows.groupBy("lang").applyInPandas(clustered, "lang string, centre array<double>, floor double").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["centre"]))
    return Model(idf, [r["lang"] for r in found], np.array([r["centre"] for r in found]).reshape(-1, DIMS), np.array([r["floor"] for r in found]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score, rejected) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in strings(batch.column("text"))]
            lang, score, rejected = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[id_col, "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double, rejected boolean")


def language_query(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fit on the rows that are not held out and score all."""
    learn = docs.filter(~F.coalesce(held_out(F.col(id_col)), F.lit(False))).select(F.col(id_col).alias("id"), "text", "lang")
    found = identify(docs, fit(learn), id_col)
    return found.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
