"""Operators 3, 4, 8 and 9: brute force, held-out accuracy, odd rows; the pipeline."""
import math
import random
import time
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from presswork.llm import language_id, quality_model, quality_rules, toxicity
from presswork.llm.common import held_out
from presswork.llm.ngrams import code_points, hashed_counts

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def odd(corpus, spark):
    rows = [*corpus.rows[:8], corpus.rows[0], (None, None, None, None, None), (None, "some words here", None, "s", 3), *corpus.rows[-8:]]
    return rows, corpus.frame(spark, rows)


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_rows(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_counts_in_slices(monkeypatch):
    points = code_points("héllo wörld 😀 " * 40)
    whole = hashed_counts(points, (1, 2, 3), 256)
    assert whole.sum() == sum(len(points) - n + 1 for n in (1, 2, 3))
    monkeypatch.setattr("presswork.llm.ngrams.SLICE", 7)
    assert (hashed_counts(points, (1, 2, 3), 256) == whole).all()


# ------------------------------------------------------------- 3: toxicity

def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity_query(docs, labels).join(labels, "doc_id").collect()
    test = [r for r in got if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert auc([(r["score"], r["toxic"]) for r in test]) > 0.7  # some labels of this table are noise
    assert sum(r["predicted"] > r["toxic"] for r in test) <= 2


def test_toxicity_learns_words_and_beginnings(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        text = " ".join(rnd.choice("sun moon tree river stone cloud".split()) for _ in range(12 if toxic else 14))
        rows.append((i, text + (f" you {rnd.choice(['grubbo', 'zorg'])}{rnd.choice(['', 'abc', 'xyz', 'q'])}" if toxic else ""), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert "grub*" in model.lexicon and not {"sun", "you", "you*"} & set(model.lexicon) - {"you"}
    ask = spark.createDataFrame([(1, "the sun and a tree"), (2, "you zorgnew tree moon sun"), (3, None), (4, "")], "doc_id long, text string")
    score = {r["doc_id"]: r["_score"] for r in model.score(ask, "doc_id").collect()}
    assert score[2] > 0.3 > max(score[1], score[3], score[4])


def test_toxicity_of_odd_rows(spark, corpus):
    rows, docs = odd(corpus, spark)
    docs = docs.selectExpr("doc_id", "text", "lang AS prediction", "source AS features", "n_chars AS x")
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (1, None), (77, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_query(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    nothing = toxicity.without_toxic(docs, labels.limit(0))
    assert nothing.columns == docs.columns and nothing.count() == len(rows)
    assert toxicity.toxicity_query(docs.limit(0), labels).count() == 0


def test_toxicity_of_very_long_words():
    start = time.time()
    for text in ("a" * 1_000_000, "a1" * 300_000, "ab" * 20_000 + "!" * 20_000, "中" * 200_000, "." * 500_000):
        assert len(toxicity.features(text, ("grubbo", "zorg*"))) == len(toxicity.FEATURES)
    assert time.time() - start < 10


# ------------------------------------------------------------- 4: languages

def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in test) >= 0.98 * len(test)
    assert sum(r["rejected"] for r in test) <= 0.1 * len(test)


def test_language_of_odd_rows(spark, corpus):
    rows, docs = odd(corpus, spark)
    got = language_id.language_query(docs.withColumnRenamed("n_chars", "score")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r["score"] <= 1
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.language_query(nothing).collect()} == {"und"}
    assert language_id.language_query(docs.limit(0)).count() == 0


def test_far_text_is_rejected(spark):
    docs = spark.createDataFrame([(i, "the house and the tree of the " + w, "en") for i, w in enumerate("river stone cloud wind rain".split() * 8)],
                                 "id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.predict("the tree and the house of the wind")[0] == "en" and not model.predict("the house and the tree of the rain")[2]
    assert model.predict("жзч щюя жзч")[2]


# ------------------------------------------------------------- 8: quality rules

def slow_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    inside = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(5)}
    lines = [s for s in text.split("\n") if WORDS.search(s)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_rules_equal_brute_force(spark, corpus):
    texts = ["a b c d e " * 3, "#*$%&|<> <<é😀\n#*\n#*\n\x0b\n\n", "w " * 30, "a b c d e f a b c d e g h", "p q\np q \np q\r"]
    rows = [*corpus.rows, *[(2000 + k, t, "en", "s0", None) for k, t in enumerate(texts)], corpus.rows[0], (None, None, None, None, None)]
    docs = corpus.frame(spark, rows).withColumnRenamed("n_chars", "distance2")
    got = sorted(((r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])
                  for r in quality_rules.quality_rules(docs).collect()), key=repr)
    want = []
    for r in rows:
        c = slow_counts(r[1])
        want.append((r[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(want, key=repr)


def test_outliers_go_and_clean_documents_stay(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(40, 200))), "en", f"s{i % 2}") for i in range(300)]
    rows += [(900 + i, " ".join("#*$%&" + word() for _ in range(80)), "en", f"s{i % 2}") for i in range(6)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(300)) and not any(got[900 + i]["kept"] for i in range(6))
    assert not any(got[900 + i]["base_failed"] for i in range(6))


def slow_estimate(x):
    """Concentration steps of one group by numpy, with the operator's blending, floors and bins."""
    floors = np.array(list(quality_rules.FLOORS.values()))
    moments = lambda core: (core.mean(axis=0), core.T @ core / len(core))
    d = (((x - np.median(np.round(x * 64) / 64, axis=0)) / floors) ** 2).sum(axis=1)
    for _ in range(quality_rules.STEPS + 1):
        bins = np.floor(np.log1p(d) * quality_rules.BINS)
        below = np.array([(bins < b).sum() for b in bins])
        mean, square = moments(x[below < quality_rules.CORE * len(x)])
        cov = quality_rules.CONSISTENCY * (square - np.outer(mean, mean)) + np.diag(floors ** 2)
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    return d


def test_distances_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) @ np.diag([0.5, 0.2, 0.05, 0.1, 0.1]) + [5, 1.5, 0.1, 0.1, 0.1]
    x[:10] += 2
    rows = spark.createDataFrame([(i, "en", "s", i % 3, *map(float, v)) for i, v in enumerate(x)],
                                 "i long, g_lang string, g_source string, salt int, x0 double, x1 double, x2 double, x3 double, x4 double")
    factors = quality_rules.robust_factors(rows.drop("i"))
    got = [r["distance2"] for r in quality_rules._with_distance(rows, factors).orderBy("i").collect()]
    assert np.allclose(got, slow_estimate(x), rtol=1e-6)


def test_rules_of_nothing(spark, corpus):
    assert quality_rules.quality_rules(corpus.frame(spark, [])).count() == 0


# ------------------------------------------------------------- 9: quality classifier

def test_labels_are_found_without_gold(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_model.classify(docs).join(labels, "doc_id").collect()
    assert auc([(r["score"], r["quality"]) for r in got]) > 0.95
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)


def test_estimates_recover_accuracies():
    """Labellers of different accuracy, abstaining at random."""
    rng, m = np.random.default_rng(1), len(quality_model.LABELLERS)
    good, right = rng.random(20_000) < 0.8, 0.65 + 0.04 * np.arange(m)
    votes = np.full((len(good), m), quality_model.ABSTAIN)
    for k in range(m):
        cast = np.where(good == (rng.random(len(good)) < right[k]), quality_model.FINE, quality_model.BAD)
        votes[:, k] = np.where(rng.random(len(good)) < 0.3, quality_model.ABSTAIN, cast)
    codes, counts = np.unique(votes @ 3 ** np.arange(m - 1, -1, -1), return_counts=True)
    share, table = quality_model.estimate(codes, counts.astype(float), (2.0, 1.25))
    assert abs(share - 0.8) < 0.05
    shares = table[:, :, quality_model.FINE] / (1 - table[:, :, quality_model.ABSTAIN])
    assert np.allclose(shares[:, 1], right, atol=0.06)


def test_quality_of_odd_rows(spark, corpus):
    rows, docs = odd(corpus, spark)
    got = quality_model.classify(docs.withColumnRenamed("n_chars", "h").withColumnRenamed("lang", "pattern")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    assert quality_model.classify(docs.limit(0)).count() == 0


# ------------------------------------------------------------- the pipeline

@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and result of each stage on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_keep_the_columns_of_documents(stages, spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dtypes
    assert len(stages) == 5
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.dtypes == schema, name


def test_stages_decide(stages):
    def ids(df):
        return {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = stages["line_dedup"]
    assert ids(before) == ids(after)
    text = {r["doc_id"]: r["text"] for r in after.collect()}
    lines = [s for t in text.values() for s in t.split("\n") if WORDS.search(s)]
    assert len({tuple(WORDS.findall(s)) for s in lines}) == len(lines)
    before, after = stages["simhash"]
    assert ids(after) < ids(before) and sum(not t.strip() for t in (r["text"] for r in after.collect())) <= 1
    before, after = stages["suffix_dedup"]
    assert ids(before) == ids(after)
    before, after = stages["packing"]
    assert ids(before) == ids(after)


def test_run_on_an_odd_table(spark, corpus, tmp_path):
    rows, docs = odd(corpus, spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
