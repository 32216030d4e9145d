"""Embedding duplicates over all earlier rows, against brute force."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from presswork.operators.dedupe import dedupe
from presswork.operators.near_vectors import CosineSimilar, earlier_matches


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return dot / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def made(n=240, dim=8, seed=3):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.7:
            v = [x + rnd.gauss(0, 0.35) for x in rnd.choice(centres)]
        elif kind < 0.8 and rows:
            v = [3 * x for x in rnd.choice(rows)[2]]
        else:
            v = [rnd.gauss(0, 1) for _ in range(dim)]
        rows.append((i, rnd.choice("ab"), v))
    return rows


ODD = [(900, "a", None), (901, "a", [0.0] * 8), (902, "a", [1.0, None] + [0.0] * 6), (903, "a", [float("nan")] * 8), (904, "b", [1.0] * 3), (905, None, [1.0] * 8),
       (906, "b", [])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, grp string, vec array<double>")


@pytest.mark.parametrize("pivots, block, threshold", [(16, 1024, 0.85), (3, 7, 0.9), (40, 5, 0.4), (1, 1024, 0.99)])
def test_pairs_equal_brute_force(spark, pivots, block, threshold):
    rows = made()
    df = frame(spark, [*rows, *ODD])
    similar = CosineSimilar(df, "id", "vec", "grp", threshold, pivots, block)
    ids = df.select(F.col("id").alias("ord"))
    got = {(r["ord"], r["early_ord"]): r["similarity"] for r in similar(ids, ids).collect()}
    want = {(a[0], b[0]): cosine(a[2], b[2]) for a in rows for b in rows if b[0] < a[0] and a[1] == b[1] and cosine(a[2], b[2]) > threshold}
    assert got.keys() == want.keys() and want
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert similar.pair_bound(ids) == len(want)


def test_dedupe_follows_the_keep_rule(spark):
    rows = made(160)
    df = frame(spark, rows).withColumn("key", F.md5(F.to_json("vec")))
    similar = CosineSimilar(df, "id", "vec", "grp", 0.85, 10, 16)
    got = {r["id"]: r["matched"] for r in dedupe(df, "id", ["key"], reasons=[("same_vector", 1.0)], similar=similar, similar_reason="cosine",
                                                 batch_rows=50, pair_bound=similar.pair_bound).collect()}
    kept = []
    for i, grp, v in rows:
        near = [(-cosine(v, k[2]), k[0]) for k in kept if k[1] == grp and cosine(v, k[2]) > 0.85]
        assert (got[i] is None) == (not near)
        if near:
            assert got[i] == min(near)[1]
        else:
            kept.append((i, grp, v))


def test_a_large_group_of_copies_is_dealt_out(spark):
    rows = [(i, "a", [1.0, 0.001 * (i % 7), 0.0]) for i in range(400)]
    similar = CosineSimilar(frame(spark, rows), "id", "vec", "grp", 0.95, 4, 50)
    ids = frame(spark, rows).select(F.col("id").alias("ord"))
    assert similar.pair_bound(ids) == 400 * 399 / 2
    best = {r["id"]: r["n_matches"] for r in earlier_matches(frame(spark, rows[:20]), "id", "vec", "grp", 0.95).collect()}
    assert best == {i: i for i in range(1, 20)}


def test_empty_tables(spark):
    df = frame(spark, [])
    assert earlier_matches(df, "id", "vec").count() == 0
    assert earlier_matches(frame(spark, ODD[:2]), "id", "vec").count() == 0


def test_a_vector_is_sent_once_to_a_bin_of_many_cells(spark):
    """Spread evenly, a vector looks into most cells; sent to each of them, it moved more than a hundred times."""
    rnd = random.Random(5)
    rows = [(i, "a", [rnd.gauss(0, 1) for _ in range(16)]) for i in range(1500)]
    df = frame(spark, rows)
    similar = CosineSimilar(df, "id", "vec", None, 0.35, 64, 500)
    assert similar.rows.agg(F.sum(F.size("asks"))).first()[0] <= 4 * len(rows)
    found = earlier_matches(df, "id", "vec", threshold=0.7)
    want = {(a[0], b[0]) for a in rows for b in rows[:a[0]] if cosine(a[2], b[2]) > 0.7}
    assert want and {r["id"]: r["n_matches"] for r in found.collect()} == dict(Counter(a for a, _ in want))
