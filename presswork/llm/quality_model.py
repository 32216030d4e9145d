"""A quality classifier learnt from weak labels.

Overlapping heuristic labellers vote good (2), bad (0) or abstain (1) on every
document; most look for one defect and abstain where they see none.  Expectation-maximisation over the counts of vote patterns estimates
how often each labeller votes what on good and on bad documents, without any
gold label; the posterior of a document's pattern is its soft label.  A
logistic scorer over hashed character n-grams learns those soft labels and
judges every text, so it also decides where the labellers abstain.

Statistics cover all documents; the scorer is fitted on at most ``TRAIN_ROWS``
documents, those with the smallest hash of their id and text.  Scale: patterns
are counted with map-side combine, and there are at most 3 ** 8 of them,
whatever the number of documents; scoring is a map.

Edge cases: null and blank texts are voted on as empty ones; repeated rows
count each and are scored alike; if all documents have one pattern the scorer
returns its posterior; an empty table gives no rows; further columns are
ignored; very long texts are counted in slices.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import landed, strings
from .ngrams import code_points, hashed_counts

DIMS = 1024
SIZES = (1, 2, 3)
TRAIN_ROWS = 8_000
ROUNDS = 60
#: Prior belief: a vote against is so many times as likely on a bad document, a vote for on a good one, at least.
LEAST_ODDS = (8.0, 1.25)
STEPS = 300
#: Weight of an abstention as evidence.  Defects exclude one another, so not seeing one kind says little about the others.
ABSTENTION = 0.2
GOOD = 0.5
LABELLERS = ("symbols", "capitals", "exclamations", "bars", "length", "repeated_lines", "compression", "line_ends")
BAD, ABSTAIN, FINE = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
for _code, _chars in enumerate((range(97, 123), range(65, 91), b"#*$%&<>", b"!", b"|"), start=1):
    _KIND[list(_chars)] = _code
_ENDS = tuple(".!?:;…\"'»”")


def votes(text: str | None) -> list[int]:
    """One vote per labeller, from the whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=6)
    n, size = len(text.split()), max(1, len(text))
    lines = [s for s in text.split("\n") if s.strip()]

    def defect(found: bool) -> int:
        return BAD if found else ABSTAIN

    if not n:
        return [ABSTAIN, ABSTAIN, ABSTAIN, ABSTAIN, BAD, ABSTAIN, ABSTAIN, ABSTAIN]
    squeezed = len(zlib.compress(data, 1)) / len(data)
    ended = sum(s.rstrip().endswith(_ENDS) for s in lines) / len(lines)
    return [
        defect(kinds[3] / size >= 0.02),
        defect(kinds[2] / max(1, kinds[1] + kinds[2]) >= 0.2),
        defect(kinds[4] / n >= 0.1),
        defect(kinds[5] / n >= 0.1),
        BAD if n < 4 else FINE if n >= 40 else ABSTAIN,
        defect(len(lines) > 1 and 1 - len(set(lines)) / len(lines) >= 0.4),
        defect(len(data) >= 400 and squeezed <= 0.25),
        FINE if ended >= 0.8 else BAD if ended <= 0.3 else ABSTAIN,
    ]


def pattern(text: str | None) -> int:
    code = 0
    for v in votes(text):
        code = 3 * code + v
    return code


def estimate(patterns: np.ndarray, counts: np.ndarray, least_odds: tuple[float, float] = LEAST_ODDS) -> tuple[float, np.ndarray]:
    """Share of good documents, and table[labeller, class, vote] of vote probabilities, by expectation-maximisation."""
    m = len(LABELLERS)
    cast = np.stack([patterns // 3 ** (m - 1 - k) % 3 for k in range(m)], axis=1)
    # To begin with, one vote against weighs as much as three for a document.
    good = np.where((cast == FINE).sum(axis=1) < 3 * (cast == BAD).sum(axis=1), 0.01, 0.99)
    for _ in range(ROUNDS):
        both = np.stack([counts * (1 - good), counts * good])
        share = (both[1].sum() + 1) / (counts.sum() + 2)
        table = np.stack([[np.bincount(cast[:, k], both[c], 3) + 1.0 for c in (0, 1)] for k in range(m)])
        table /= table.sum(axis=2, keepdims=True)
        # Labellers are better than chance; without this the classes could trade places.
        table[:, 1, BAD] = np.minimum(table[:, 1, BAD], table[:, 0, BAD] / least_odds[0])
        table[:, 0, FINE] = np.minimum(table[:, 0, FINE], table[:, 1, FINE] / least_odds[1])
        good = posterior(patterns, share, table)
    return float(share), table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    m = len(LABELLERS)
    logs = np.stack([np.full(len(patterns), np.log(1 - share)), np.full(len(patterns), np.log(share))])
    for k in range(m):
        vote = patterns // 3 ** (m - 1 - k) % 3
        logs += np.log(table[k][:, vote]) * np.where(vote == ABSTAIN, ABSTENTION, 1.0)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def hashed(text: str | None) -> np.ndarray:
    """Unit vector of hashed n-grams; case and signs are kept."""
    x = np.sqrt(hashed_counts(code_points(text or ""), SIZES, DIMS))
    return (x / max(float(np.linalg.norm(x)), 1e-12)).astype(np.float32)


def fit_linear(x: np.ndarray, soft: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels, by accelerated gradient steps with a little shrinkage."""
    mean = x.mean(axis=0)
    z = x - mean
    w, v, b = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0
    rate = 4.0 / max(float((z * z).sum(axis=1).mean()), 1e-6)
    for t in range(STEPS):
        look = w + t / (t + 3) * (w - v)
        error = 1 / (1 + np.exp(-(z @ look + b))) - soft
        v, w = w, look - rate * (z.T @ error / len(x) + 1e-5 * look)
        b -= 2.0 * float(error.mean())
    return w, b - float(mean @ w)


class Model:
    def __init__(self, share: float, table: np.ndarray, weights: np.ndarray, bias: float):
        self.share, self.table, self.weights, self.bias = share, table, weights, bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(hashed(text) @ self.weights + self.bias, -500, 500))))


def with_patterns(docs: DataFrame, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("h"), pa.array(
                [pattern(t) for t in strings(batch.column("text"))], pa.int32())], names=[id_col, "h", "pattern"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.xxhash64(id_col, "text").alias("h"), "text").mapInArrow(run, f"{id_col} {kind}, h bigint, pattern int")


def fit(docs: DataFrame, voted: DataFrame, id_col: str) -> Model:
    """Learn from the votes on all documents, and the texts of a bounded sample."""
    seen = voted.groupBy("pattern").count().collect()  # at most 3 ** 8 rows
    patterns, counts = np.array([r["pattern"] for r in seen], np.int64), np.array([r["count"] for r in seen], np.float64)
    if not len(patterns):
        return Model(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3), np.zeros(DIMS), 0.0)
    share, table = estimate(patterns, counts)
    sample = voted.select("h", "pattern").distinct().orderBy("h").limit(TRAIN_ROWS)
    chosen = docs.select(F.xxhash64(id_col, "text").alias("h"), "text").join(F.broadcast(sample), "h").dropDuplicates(["h"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("pattern"), pa.array(
                [hashed(t) for t in strings(batch.column("text"))], pa.list_(pa.float32()))], names=["h", "pattern", "x"])

    rows = landed(chosen.select("h", "pattern", "text").mapInArrow(vectors, "h bigint, pattern int, x array<float>"), "quality-sample")

    def train(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("h")
        w, b = fit_linear(np.stack(batch["x"].to_list()).astype(np.float64), posterior(batch["pattern"].to_numpy(np.int64), share, table))
        return pd.DataFrame({"w": [w], "b": [b]})

    # The sample is bounded, so one task fits it.
    found = rows.withColumn("all", F.lit("sample")).groupBy("all").applyInPandas(train, "w array<double>, b double").first()
    return Model(share, table, np.array(found["w"]), found["b"])


def classify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, votes, weak_score, score, predicted): the votes' pattern and posterior, the scorer's value and decision (1: good)."""
    voted = landed(with_patterns(docs, id_col), "quality-votes")
    model = fit(docs, voted, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [(pattern(t), model.score(t)) for t in strings(batch.column("text"))]
            codes, scores = np.array([c for c, _ in judged], np.int64), np.array([s for _, s in judged], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(codes.astype(np.int32)), pa.array(posterior(codes, model.share, model.table)),
                 pa.array(scores), pa.array((scores >= GOOD).astype(np.int32))],
                names=[id_col, "votes", "weak_score", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, votes int, weak_score double, score double, predicted int")
