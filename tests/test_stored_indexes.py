"""Stored indexes: buckets, keys, term vectors; runs that use them."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from presswork.operators import reports
from presswork.operators.text_index import TextIndex
from presswork.plans.collect import collect_run, save_run
from presswork.schemas import PAGE
from presswork.sinks.buckets import BASE, BucketTable
from presswork.sinks.key_index import KeyIndex
from presswork.sources.pages import drop_seen

RUN = "timestamp'2024-01-01 00:00:00'"


def rows_of(spark, ids):
    return spark.createDataFrame([(i, f"value {i}") for i in ids], "id long, value string")


def table(spark, path):
    return BucketTable(spark, str(path), "id long, value string", ["id"], 8)


# ------------------------------------------------------------- buckets

def test_a_repeated_part_replaces_itself(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().count() == 0
    t.append(rows_of(spark, range(10)), 0)
    t.append(rows_of(spark, range(10, 20)), 1)
    t.append(rows_of(spark, range(10, 15)), 1)
    assert sorted(r["id"] for r in t.read().collect()) == list(range(15))
    assert sorted(r["id"] for r in t.read(without=1).collect()) == list(range(10))
    t.append(rows_of(spark, []), 2)
    assert t.read().count() == 15 and t.parts() == [0, 1, 2]


def test_only_touched_buckets_are_read(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.append(rows_of(spark, range(200)), 0)
    wanted = rows_of(spark, [7])
    read = t.read(wanted)
    assert 0 < len(read.inputFiles()) <= 8
    scan = read._jdf.queryExecution().toString()
    bucket = wanted.select(t.bucket("id")).first()[0]
    assert f"(bucket#" in scan and f"= {bucket})" in scan and "PartitionFilters: [isnotnull(bucket" in scan
    assert {r["id"] for r in read.select("id").collect()} == {r["id"] for r in rows_of(spark, range(200)).filter(t.bucket("id") == bucket).collect()}


def test_compaction_keeps_everything_and_survives_a_crash(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    for part in range(4):
        t.append(rows_of(spark, range(10 * part, 10 * part + 10)), part)
    write = BucketTable._write

    def crash(self, rows, generation, part):
        if part == BASE:
            raise RuntimeError("lost")
        write(self, rows, generation, part)

    monkeypatch.setattr(BucketTable, "_write", crash)
    with pytest.raises(RuntimeError):
        t.compact(before=3)
    monkeypatch.setattr(BucketTable, "_write", write)
    assert t.generation() == 0 and t.read().count() == 40
    old = t.read()
    t.compact(before=3)
    assert t.generation() == 1 and t.parts() == [BASE, 3] and old.count() == 40
    t.append(rows_of(spark, range(30, 36)), 3)      # the last batch again
    t.append(rows_of(spark, [99]), 4)
    t.forget_old()
    assert sorted(r["id"] for r in t.read().collect()) == [*range(36), 99]
    assert t._numbers(t.path, "gen=") == [1]
    t.compact(before=5)
    assert t.parts() == [BASE] and t.read().count() == 37


# ------------------------------------------------------------- keys

def test_unseen_rows_equal_those_of_the_store(spark, tmp_path):
    rnd = random.Random(2)
    stored = spark.createDataFrame([(f"u{rnd.randint(0, 60)}", rnd.choice([None, f"t{i % 9}"])) for i in range(40)], "url string, title_hash string")
    batch = spark.createDataFrame([(i, f"u{i}" if i % 7 else None, f"t{i % 15}") for i in range(70)], "id long, url string, title_hash string")
    index = KeyIndex(spark, str(tmp_path / "k"), 8)
    index.add(stored, 0, ["url", "title_hash"])
    index.add(stored.limit(0), 1, ["url"])
    for key in ("url", "title_hash"):
        want = sorted(r["id"] for r in drop_seen(batch, stored, key).collect())
        assert sorted(r["id"] for r in index.unseen(batch, key).collect()) == want
        assert index.unseen(batch, key, without=0).count() == 70
    # A value of one kind is no value of another.
    assert index.unseen(batch.select("id", F.col("url").alias("title_hash")), "title_hash").count() == 70


# ------------------------------------------------------------- term vectors

def brute_vectors(texts, fitted):
    """Unit vectors of (key, grp, text) by the frequencies of ``fitted``."""
    def terms(text):
        w = text.split()
        return Counter(" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))

    df, n = Counter(), Counter()
    for _, grp, text in fitted:
        n[grp] += 1
        df.update((grp, t) for t in terms(text))
    out = {}
    for key, grp, text in texts:
        w = {t: k * (math.log((1 + n[grp]) / (1 + df[grp, t])) + 1) for t, k in terms(text).items()
             if df[grp, t] <= 0.95 * n[grp] or df[grp, t] < 20}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[key] = (grp, {t: x / norm for t, x in w.items()})
    return out


def test_matches_of_earlier_runs_equal_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    words = [f"word{i}" for i in range(120)] + ["common"] * 40

    def text(like=None):
        if like is None:
            return " ".join(rnd.choice(words) for _ in range(rnd.randint(8, 30)))
        w = like.split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        return " ".join(w)

    first = [(str(i), rnd.choice("ab"), text()) for i in range(40)]
    second = [(f"s{i}", g, text(t) if i % 2 else text()) for i, (_, g, t) in enumerate(first[:20])]
    third = [(f"t{i}", g, text(t)) for i, (_, g, t) in enumerate(first + second)] + [("new", "c", "a group nobody knew")]
    schema = "key string, grp string, text string"
    index = TextIndex(spark, str(tmp_path / "x"), threshold=0.6, buckets=4)
    for part, batch in enumerate((first, second)):
        df = spark.createDataFrame(batch, schema)
        index.fit(df)
        index.add(index.weigh(df), part)
    weighed = index.weigh(spark.createDataFrame(third, schema))

    def want(fitted):
        vectors, stored = brute_vectors(third, fitted), brute_vectors(first + second, fitted)
        best = {}
        for key, (grp, v) in vectors.items():
            near = [(-sum(x * o.get(t, 0) for t, x in v.items()), k) for k, (g, o) in stored.items() if g == grp]
            near = [x for x in near if -x[0] > 0.6]
            if near:
                best[key] = (min(near, key=lambda x: (round(x[0], 9), x[1]))[1], round(-min(near)[0], 6))
        return best

    got = {r["key"]: (r["matched"], round(r["similarity"], 6)) for r in index.matches(weighed).collect()}
    assert got == want(first) and len(got) > 20
    assert index.matches(index.weigh(spark.createDataFrame(second, schema)), without=1).filter("matched LIKE 's%'").count() == 0
    index.rebuild(spark.createDataFrame(first + second, schema))
    got = {r["key"]: (r["matched"], round(r["similarity"], 6)) for r in index.matches(index.weigh(spark.createDataFrame(third, schema))).collect()}
    assert index.version() == 1 and got == want(first + second)


# ------------------------------------------------------------- runs

PROSE = " ".join(f"Sentence number {i} tells the reader about topic {i * 7 % 31} in some detail." for i in range(12))


def page(i, title, body, url=None):
    return (i, url or f"https://x.org/{i}", f"<html><body><h1>{title}</h1><article><p>{body}</p></article></body></html>")


def test_a_second_run_meets_the_first(spark, tmp_path):
    index, texts = KeyIndex(spark, str(tmp_path / "keys"), 4), TextIndex(spark, str(tmp_path / "texts"), buckets=4)
    out, runs = str(tmp_path / "articles"), str(tmp_path / "runs")
    # The same beginning of over 2,000 characters, another end: not the same article.
    opening = " ".join(f"opening{i}" for i in range(300))
    first = [page(1, "The first of the titles", PROSE), page(2, "One more of the titles", opening + " and this is how the one ends."),
             page(3, "A copy of the first under a new title", PROSE.replace("number 3", "numero 3"))]
    ts = F.expr(RUN)

    def run(pages, part):
        made = collect_run(spark.createDataFrame(pages, PAGE), ts, stored=index, text_index=texts, part=part)
        return made, save_run(made, out, part, ts, index, texts, runs)

    one, record = run(first, 0)
    reasons = {r["page_id"]: r["reason"] for r in one.verdicts.collect()}
    assert reasons == {1: None, 2: None, 3: "tfidf_similarity"}
    assert (record["new_articles"], record["duplicates"], record["errors"]) == (2, 1, 0)
    # Within a run a title decides; the repeated run stores the same rows once.
    _, again = run(first, 0)
    assert again["new_articles"] == 2 and spark.read.parquet(out).count() == 2
    second = [page(11, "Quite another of the titles", PROSE.replace("number 5", "numero 5"), "https://x.org/11"),
              page(12, "Known address", "other words " * 60, "https://x.org/1"),
              page(13, "Something else of the titles", " ".join(f"fresh{i}" for i in range(80)))]
    two, record = run(second, 1)
    reasons = {r["page_id"]: (r["reason"], r["similarity"] > 0.85) for r in two.verdicts.collect()}
    assert reasons == {11: ("tfidf_similarity", True), 13: (None, False)}
    assert (record["new_articles"], record["duplicates"]) == (1, 1)
    assert [r["new_articles"] for r in reports.recent_runs(spark.read.parquet(runs)).orderBy("run_id").collect()] == [2, 2, 1]


def test_link_titles_stand_in(spark):
    pages = spark.createDataFrame([(1, "https://x.org/1", f"<html><body><article><p>{PROSE}</p></article></body></html>", "Title of the link")],
                                  "page_id long, url string, html string, link_title string")
    assert collect_run(pages, F.expr(RUN)).articles.first()["title"] == "Title of the link"
