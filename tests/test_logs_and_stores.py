"""Replays, reports, search, stores, the collection run and the streams."""
import datetime as dt
import json
import random
import os

import pytest
from pyspark.sql import functions as F, types as T

from presswork.operators import health, reports, search as srch, windows
from presswork.operators.gram_index import GramIndex, indexed_search
from presswork.plans.collect import collect_run
from presswork.schemas import ARTICLE, FALLBACK_ARTICLE, PAGE, REQUEST, SOURCE_LOG
from presswork.sinks import store
from presswork.sources.pages import drop_seen, from_exchange, read_articles_json, stream_pages, top_rows, with_fallback
from presswork.sources.registry import choose_sources, invalid_sources
from presswork.streaming import ingest, state

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
RUN = "timestamp'2024-01-01 00:00:00'"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def log(spark, rows):
    """rows: (source, second, ok, n)"""
    schema = T.StructType([*SOURCE_LOG.fields, T.StructField("event_id", T.LongType())])
    return spark.createDataFrame([(s, at(t), ok, n, i) for i, (s, t, ok, n) in enumerate(rows)], schema)


def requests(spark, rows):
    schema = T.StructType([*REQUEST.fields, T.StructField("event_id", T.LongType())])
    return spark.createDataFrame([(c, at(t), i) for i, (c, t) in enumerate(rows)], schema)


def test_success_rate(spark):
    rows = [("a", 0, True, 3), ("a", 1, True, 0), ("a", 2, False, 0), ("a", 3, True, 0), ("a", 4, True, 2), ("b", 0, False, 0)]
    got = {r["source"]: r["success_rate"] for r in health.success_rate(log(spark, rows)).collect()}
    assert got == {"a": pytest.approx(0.91225), "b": 1.0}


BREAKER = [(0, False), (10, False), (20, False), (30, False), (40, False), (50, True), (340, True), (341, False), (642, True)]


def test_breaker_golden(spark):
    out = health.breaker_replay(log(spark, [("a", t, ok, 1) for t, ok in BREAKER])).orderBy("ts").collect()
    assert [(r["action"], r["state"], r["failure_count"]) for r in out[4:]] == [
        ("try", "OPEN", 5), ("skip", "OPEN", 5), ("skip", "OPEN", 5), ("try", "OPEN", 6), ("try", "CLOSED", 0)]


ADMIT = [0, 10, 20, 30, 3599, 3600, 3609, 3610]


def test_admission_golden(spark):
    out = health.admission_audit(requests(spark, [("c", t) for t in ADMIT])).orderBy("ts").collect()
    assert [r["admitted"] for r in out] == [True, True, True, False, False, True, False, True]


def test_trailing_requests(spark):
    out = health.trailing_requests(requests(spark, [("c", 0), ("c", 0), ("c", 3599), ("c", 3600), ("d", 5)]))
    got = {(r["client_id"], r["ts"].timestamp() - T0.timestamp()): r["n_trailing"] for r in out.collect()}
    assert got == {("c", 0): 2, ("c", 3599): 3, ("c", 3600): 2, ("d", 5): 1}


def test_history_trim(spark):
    df = spark.range(152).select(F.lit("h").alias("host"), F.col("id").alias("page_id"))
    kept = health.trimmed_history(df)
    assert (kept.count(), kept.agg(F.min("page_id")).first()[0]) == (50, 102)
    assert health.trimmed_history(df.filter("page_id < 100")).count() == 100
    assert health.trimmed_history(df.filter("page_id < 101")).count() == 50


def articles(spark, rows):
    base = {f: None for f in ARTICLE.fieldNames()}
    return spark.createDataFrame([{**base, **r} for r in rows], ARTICLE)


def article(i, **more):
    return {"news_id": f"n{i}", "source": "S", "url": f"https://x.org/{i}", "title": f"Title {i}", "content": "Body",
            "quality_score": 0.5, "content_fingerprint": f"f{i}", "created_at": at(i * 60), **more}


def test_search(spark):
    df = articles(spark, [article(i, title="100% sure" if i == 3 else f"Title {i}") for i in range(10)])
    both = srch.search(df, date_from=F.lit(at(60)), date_to=F.lit(at(180)))
    assert [r["news_id"] for r in both.collect()] == ["n3", "n2", "n1"]
    assert [r["news_id"] for r in srch.search(df, query="1%s_re").collect()] == ["n3"]
    assert srch.search(df, query="TITLE", sources=["S"], quality_min=0.5).count() == 9
    info = srch.page_info(df, limit=4, offset=4).first()
    assert (info["total"], info["has_more"], info["next_offset"]) == (10, True, 8)
    assert srch.page_info(df, limit=6, offset=4).first()["next_offset"] is None
    page = srch.search(df, limit=3, offset=3).collect()
    again = srch.search_after(df, F.lit(at(7 * 60)), "n7", limit=3).collect()
    assert [r["news_id"] for r in page] == [r["news_id"] for r in again] == ["n6", "n5", "n4"]


def test_reports_handle_missing_values(spark):
    df = articles(spark, [article(1), article(2, quality_score=None, source=None, content=None)])
    assert {r["source"]: r["avg_quality"] for r in reports.source_performance(df).collect()} == {"S": 0.5, None: 0.0}
    assert {r["source"] for r in reports.source_share(df).collect()} == {"S", "Unknown"}
    assert reports.length_stats(df).first()["total_length"] == 4
    assert reports.quality_columns(df).first()["poor"] == 1
    assert sum(r["n_articles"] for r in reports.quality_distribution(df).collect()) == 1


def test_seen_and_fallback(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "url string")
    assert sorted(str(r["url"]) for r in drop_seen(df, df.filter("url = 'a'")).collect()) == ["None", "b"]
    spare = spark.createDataFrame([("z",)], "url string")
    assert [r["url"] for r in with_fallback(df.filter("url = 'x'"), spare).collect()] == ["z"]
    assert with_fallback(df, spare).count() == 3


def test_sources(spark):
    assert [s.key for s in choose_sources(["inc42", "nobody"])] == ["inc42"]
    assert len(choose_sources(["nobody"])) == 5
    asked = spark.createDataFrame([(1, ["inc42", "x"]), (2, ["inc42"])], "id int, sources array<string>")
    assert [(r["id"], r["invalid_sources"]) for r in invalid_sources(asked, ["inc42"]).collect()] == [(1, ["x"])]


def test_append_under_unique_keys(spark, tmp_path):
    path = str(tmp_path / "articles")

    def frame(rows):
        return articles(spark, rows).withColumn("ord", F.monotonically_increasing_id()).coalesce(1)

    first = frame([article(1), article(2), article(3, url="https://x.org/1")])
    assert store.append_articles(first, path, "ord").count() == 2
    clash = frame([article(4, url="https://x.org/1"), article(5, news_id="n2"), article(6, content_fingerprint="f1"), article(7)])
    assert [r["news_id"] for r in store.append_articles(clash, path, "ord").collect()] == ["n7"]
    assert store.append_articles(clash, path, "ord").count() == 0
    assert spark.read.parquet(path).count() == 3


def test_exports(spark, tmp_path):
    df = articles(spark, [article(i) for i in range(101)])
    store.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == store.CSV_COLUMNS and back.count() == 101
    for n, codec, suffix in ((101, "gzip", ".json.gz"), (100, "none", ".json")):
        out = str(tmp_path / f"json{n}")
        store.export_json(df.limit(n), out, F.expr(RUN), ["inc42"], compression=codec)
        again = from_exchange(read_articles_json(spark, f"{out}/articles"))
        assert again.count() == n and again.filter("title IS NULL OR url IS NULL OR quality_score IS NULL").isEmpty()
        assert any(f.endswith(suffix) for f in os.listdir(f"{out}/articles"))
        meta = spark.read.json(f"{out}/metadata").first()
        assert meta["total_articles"] == n and meta["quality_distribution"]["fair"] == n
        assert meta["source_breakdown"]["S"] == n
    store.append_status(spark.createDataFrame([("e", "running", "{}", T0)], "execution_id string, status string, details string, updated_at timestamp"), str(tmp_path / "st"))
    store.append_status(spark.createDataFrame([("e", "completed", '{"k": 2}', at(9))], "execution_id string, status string, details string, updated_at timestamp"), str(tmp_path / "st"))
    last = reports.with_details(reports.latest_status(spark.read.parquet(str(tmp_path / "st"))), {"k": "int"}).first()
    assert (last["status"], last["k"]) == ("completed", 2)


def test_fallback_file(spark, tmp_path):
    item = {"news_id": "a", "news_title": "T", "metadata": {"extraction_strategy": "fallback", "quality_score": 0.5}}
    (tmp_path / "f.json").write_text(json.dumps([item], indent=1))
    row = read_articles_json(spark, str(tmp_path / "f.json"), whole_files=True).first()
    assert row["metadata"]["quality_score"] == 0.5 and row["description"] is None
    assert read_articles_json(spark, str(tmp_path / "f.json")).schema == FALLBACK_ARTICLE


PROSE = "This paragraph is long enough to count as prose for the reader. " * 6


def page(i, title, url=None):
    return (i, url or f"https://x.org/{i}", f"<html><body><h1>{title}</h1><article><p>{PROSE}{i}</p></article></body></html>")


PAGES = [page(1, "The first of the titles"), page(2, "The second of the titles"), page(3, "The first of the titles"),
         (4, "https://x.org/4", "<p>short</p>"), page(5, "Another one of the titles", "https://x.org/2")]


def test_batch_run_equals_streamed_run(spark, tmp_path):
    batch = collect_run(spark.createDataFrame(PAGES, PAGE), F.expr(RUN))
    assert sorted(r["url"] for r in batch.articles.collect()) == ["https://x.org/1", "https://x.org/2"]
    assert batch.totals.first().asDict() == {"articles_found": 2, "new_articles": 2, "duplicates": 2, "errors": 0}

    # Url and title copies lie across the batches.
    rows = PAGES
    want = sorted(r["url"] for r in batch.articles.collect())
    landed, out = tmp_path / "landed", str(tmp_path / "out")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, PAGE).coalesce(1).write.mode("append").parquet(str(landed))
    for _ in range(2):      # the second start finds nothing new
        ingest.ingest_pages(stream_pages(spark, str(landed), files_per_batch=1), out, str(tmp_path / "ck"), F.expr(RUN)).awaitTermination()
    got = sorted(r["url"] for r in ingest.stored_batches(spark, out).collect())
    assert got == want


def test_copies_of_stored_articles_are_counted(spark):
    stored = collect_run(spark.createDataFrame(PAGES[:1], PAGE), F.expr(RUN)).articles
    copy = (9, "https://mirror.org/1", PAGES[0][2])
    run = collect_run(spark.createDataFrame([copy], PAGE), F.expr(RUN), stored=stored)
    assert run.totals.first()["duplicates"] == 1 and run.articles.count() == 0
    assert run.verdicts.first()["reason"] == "content_fingerprint_match"


def test_first_rows_of_a_frame_with_a_map(spark):
    df = spark.range(3000).selectExpr("id % 2 AS k", "id", "map('a', id) AS m")
    assert top_rows(df, ["k"], [F.desc("id")], 1200).count() == 2400


def test_streamed_state_equals_batch(spark, tmp_path):
    asked, logged = str(tmp_path / "req"), str(tmp_path / "log")
    requests(spark, [("c", t) for t in ADMIT]).coalesce(1).write.parquet(asked)
    log(spark, [("a", t, ok, 1) for t, ok in BREAKER]).coalesce(1).write.parquet(logged)

    def run(df, name):
        (df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck"))
         .trigger(availableNow=True).start().awaitTermination())
        return spark.read.parquet(str(tmp_path / name)).orderBy("ts").collect()

    admitted = run(state.stream_admissions(spark.readStream.schema(spark.read.parquet(asked).schema).parquet(asked)), "admitted")
    assert [r["admitted"] for r in admitted] == [True, True, True, False, False, True, False, True]
    states = run(state.stream_health(spark.readStream.schema(spark.read.parquet(logged).schema).parquet(logged)), "states")
    assert [(r["action"], r["state"]) for r in states[4:]] == [
        ("try", "OPEN"), ("skip", "OPEN"), ("skip", "OPEN"), ("try", "OPEN"), ("try", "CLOSED")]


def late_by_brute_force(rows, delay):
    newest, out = None, []
    for seq, at_, key in sorted(rows):
        out.append((seq, newest is not None and at_ < newest - delay))
        newest = at_ if newest is None else max(newest, at_)
    return dict(out)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_late_events_do_not_depend_on_batches(spark, tmp_path, batches):
    rnd = random.Random(11)
    rows = [(i, 100 * i - rnd.choice([0, 0, 50, 900]), rnd.randint(0, 25)) for i in range(60)]
    late = late_by_brute_force(rows, 300)
    first = {}
    for seq, _, key in rows:
        if not late[seq]:
            first.setdefault(key, seq)
    landed, out = tmp_path / "landed", str(tmp_path / "out")
    size = -(-len(rows) // batches)
    for k in range(batches):
        part = spark.createDataFrame([(s, at(t), key) for s, t, key in rows[k * size:(k + 1) * size]], "seq long, ts timestamp, key int")
        part.coalesce(1).write.mode("append").parquet(str(landed))
    stream = spark.readStream.schema("seq long, ts timestamp, key int").option("maxFilesPerTrigger", 1).parquet(str(landed))
    for _ in range(2):      # the second start finds nothing new
        ingest.ingest_events(stream, out, str(tmp_path / "ck"), ["key"], "seq", "ts", 300, compact_every=2).awaitTermination()
    got = {kind: sorted(r["seq"] for r in ingest.stored_events(spark, out, "seq long, ts timestamp, key int", kind).collect()) for kind in (False, True)}
    assert got[False] == sorted(first.values()) and got[True] == [s for s in late if late[s]] and len(got[True]) > 3


def test_status_log_folds(spark, tmp_path):
    log = state.StatusLog(spark, str(tmp_path / "log"))
    for part in range(6):
        rows = [(f"e{i}", f"s{part}", "{}", at(part if i % 2 else 10 - part), part) for i in range(5)]
        log.append(spark.createDataFrame(rows, "execution_id string, status string, details string, updated_at timestamp, tie long"), part)
    want = {f"e{i}": "s5" if i % 2 else "s0" for i in range(5)}
    assert {r["execution_id"]: r["status"] for r in log.latest().collect()} == want
    log.fold(before=5)
    assert log.parts() == [-1, 5] and {r["execution_id"]: r["status"] for r in log.latest().collect()} == want
    assert log.latest(spark.createDataFrame([("e1",)], "execution_id string")).filter("execution_id = 'e1'").count() == 1


def test_a_busy_day_spreads_over_ranges(spark):
    """One source with most rows of one day: ranges follow the rows, and totals are those of one pass."""
    rows = [("busy", at(i), i, i % 3 > 0, i % 2) for i in range(400)] + [("quiet", at(50_000 + i), 1000 + i, True, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "source string, ts timestamp, event_id long, ok boolean, n_articles int")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        cut = windows.in_ranges(df, ["source"], [F.asc("event_id")])
        spread = cut.filter("source = 'busy'").groupBy("_range").count().collect()
        assert len(spread) >= 6 and max(r["count"] for r in spread) < 150
        total = windows.running_total(cut, ["source"], [F.asc("event_id")], F.lit(1), "n").collect()
        assert all(r["n"] == (r["event_id"] + 1 if r["source"] == "busy" else r["event_id"] - 999) for r in total)
        rate, got = 1.0, {r["source"]: r["success_rate"] for r in health.success_rate(df).collect()}
        for _, _, _, ok, n in rows[:400]:
            rate = (rate * 0.9 + 0.1 if n else rate * 0.95) if ok else rate
        assert abs(got["busy"] - rate) < 1e-9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_substring_index_equals_the_scan(spark, tmp_path):
    rows = [(f"n{i}", f"Title {i} of Zürich", f"The content number {i * 7} says {'alpha beta' if i % 3 else 'gamma_delta 100%'} 😀 end", "src", 0.9, at(i)) for i in range(40)]
    rows += [("x1", None, "only CONTENT alpha", "src", 0.9, at(99)), ("x2", "ab", None, "src", 0.9, at(98)), ("x3", "", "", "src", 0.9, at(97))]
    df = spark.createDataFrame(rows, "news_id string, title string, content string, source string, quality_score double, created_at timestamp").selectExpr(
        "*", "'' AS ai_summary", "'' AS url", "'' AS image_url")
    index = GramIndex(spark, str(tmp_path / "g"), 4)
    index.add(df.filter("news_id LIKE 'n%'"), 0)
    index.add(df.filter("news_id LIKE 'x%'"), 1)
    for query in ("alpha", "ALPHA b", "zürich", "number 1_ says", "content%beta", "gamma", "ab", "😀 end", "no such words", "%", "a\\b", "content"):
        want = [r["news_id"] for r in srch.search(df, 100, query=query).collect()]
        assert [r["news_id"] for r in indexed_search(df, index, 100, query=query).collect()] == want, query
    assert index.candidates("al") is None and index.candidates("alpha").count() < 30
