"""Registered queries.

``entry`` is the flagship query, ``queries`` has one callable per operator and
``oracle_sql`` the same results in DuckDB SQL.  Every query reads its whole
tables.
"""
from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

import oracle_queries  # noqa: E402
from presswork.functions import (  # noqa: E402
    article_id, best_image, clean_text, confidence, date_part, export_threshold, extractive_summary, fingerprint,
    image_score, is_boilerplate, key_phrases, leading_text, length_in_range, looks_like_date, normalize_text,
    passes_gate, quality_score, quality_tier, ranked_sentences, sentences, similarity_text, summary_prompt,
    title_hash, title_or_link, url_host, url_path, url_scheme, word_count,
)
from presswork.operators import dedupe as dd, health, paragraphs, reports, search as srch, vectors, windows  # noqa: E402
from presswork.operators.extract import (  # noqa: E402
    choose_strategy, extract_articles, extraction_metrics, gate,
)
from presswork.operators.gram_index import GramIndex, indexed_search  # noqa: E402
from presswork.operators.near_vectors import BATCH_ROWS, PAIR_BUDGET, CosineSimilar, earlier_matches  # noqa: E402
from presswork.operators.tfidf import best_stored_match, shared_vectors, tfidf_similar  # noqa: E402
from presswork.plans import views  # noqa: E402
from presswork.plans.collect import article_rows, union_sources, with_host  # noqa: E402
from presswork.session import durable, fresh_path, spread  # noqa: E402
from presswork.sinks import store  # noqa: E402
from presswork.sources.links import anchor_links  # noqa: E402
from presswork.sources.pages import (
    cap_per_source, drop_seen, from_exchange, load_seen, read_articles_json, read_pages, with_fallback,
)  # noqa: E402
from presswork.sources.registry import Source, invalid_sources, lookup_sources, registry_frame, with_source  # noqa: E402
from presswork.streaming import ingest, state  # noqa: E402

# Parameters of the registered queries, shared with the SQL side.
P = oracle_queries.PARAMETERS


# Columns need a running session, so even constants are made on demand.
def _run_ts():
    return F.expr(views.RUN_TS)


def _as_of():
    return F.lit(P["as_of"]).cast("timestamp_ntz")


def _title():
    return views.first_line("text")



def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark, sf) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def _docs(spark, sf) -> DataFrame:
    return _table(spark, sf, "documents")


def _docs_spread(spark, sf) -> DataFrame:
    """Documents for costly text work."""
    return spread(_docs(spark, sf), "doc_id")


def _pages_spread(spark, sf) -> DataFrame:
    return spread(_pages(spark, sf), "page_id")


def _articles(spark, sf) -> DataFrame:
    return views.articles_from_documents(_docs(spark, sf))


def _articles_spread(spark, sf) -> DataFrame:
    return views.articles_from_documents(_docs_spread(spark, sf))


def _events(spark, sf) -> DataFrame:
    return _table(spark, sf, "events")


def _on_docs(**columns) -> Callable[[SparkSession, str], DataFrame]:
    """A query adding column expressions to every document."""
    def run(spark, sf):
        return _docs_spread(spark, sf).select("doc_id", *[make().alias(name) for name, make in columns.items()])

    return run


def _on_articles(*keep, **columns):
    def run(spark, sf):
        return _articles_spread(spark, sf).select(*keep, *[make().alias(name) for name, make in columns.items()])

    return run


def _report(build, *args, view=None, **kwargs):
    def run(spark, sf):
        return build((view or _articles)(spark, sf), *args, **kwargs)

    return run


def _of_events(view):
    return lambda spark, sf: view(_events(spark, sf))


_runs, _status = _of_events(views.runs_from_events), _of_events(views.status_from_events)
_log, _requests = _of_events(views.source_log_from_events), _of_events(views.requests_from_events)


def _ntz(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


# ------------------------------------------------------------- sources

SITES = [Source(key, name, f"https://{host}", f"https://{host}/", {}) for key, name, host in P["sites"]]


def page_sources(spark, sf):
    placed = with_source(_pages(spark, sf), registry_frame(spark, SITES))
    return placed.select("page_id", "host", "source")


def source_lookup(spark, sf):
    asked = _docs(spark, sf).select(F.col("source").alias("name"))
    registry = registry_frame(spark, [Source(k, k.upper(), f"https://{k}.example", "", {}) for k in P["doc_sources"]])
    return lookup_sources(registry, asked).select("key", "source", "base_url")


def invalid_source_names(spark, sf):
    asked = _docs(spark, sf).groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    bad = invalid_sources(asked, P["doc_sources"])
    return bad.select("lang", F.array_join("invalid_sources", ",").alias("invalid_sources"))


def capped_links(spark, sf):
    links = anchor_links(_pages(spark, sf))
    placed = links.select(
        url_host("url").alias("source"), "title", "url",
        (F.col("page_id") * 100_000 + F.col("pos")).alias("pos"),
    )
    return cap_per_source(placed, P["links_per_source"])


def _seen(spark, sf) -> DataFrame:
    return with_host(_pages(spark, sf)).filter(F.startswith("host", F.lit("blog."))).select(
        "url", F.lit(None).cast("string").alias("content_fingerprint"))


def unseen_pages(spark, sf):
    return drop_seen(_pages(spark, sf), _seen(spark, sf)).select("page_id", "url")


def fallback_rows(spark, sf):
    run = paragraphs.quick_articles(_pages(spark, sf)).filter("quality_score > 1").select("title", "quality_score")
    spare = _articles(spark, sf).select("title", "quality_score")
    return with_fallback(run, spare)


def articles_union(spark, sf):
    return union_sources([
        paragraphs.quick_articles(_pages(spark, sf)).select("url", "title", "quality_score"),
        _articles(spark, sf).select("url", "title", "quality_score"),
    ])


# ---------------------------------------------------------- extraction

def leaf_text(spark, sf):
    return _pages(spark, sf).select("page_id", paragraphs.leaf_paragraphs("html").alias("content"))


def fallback_text(spark, sf):
    return _pages(spark, sf).select(
        "page_id", paragraphs.page_title("html").alias("title"),
        paragraphs.first_paragraphs("html").alias("content"))


def _tagged_pages(spark, sf) -> DataFrame:
    """Every document as a page carrying OpenGraph tags."""
    def attribute(c):
        for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
            c = F.replace(c, F.lit(char), F.lit(entity))
        return c

    title = attribute(views.first_line("text"))
    return _docs_spread(spark, sf).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id").alias("url"),
        F.concat(
            F.lit('<html><head><meta property="og:title" content="'), title,
            F.lit('"><meta name="twitter:image" content="/img/'), "doc_id",
            F.lit('.jpg"></head><body><p>'), attribute(F.col("text")), F.lit("</p></body></html>"),
        ).alias("html"))


def opengraph_fields(spark, sf):
    return _tagged_pages(spark, sf).select(
        "page_id", paragraphs.meta_content("html", "og:title").alias("title"),
        paragraphs.meta_content("html", "og:description").alias("description"),
        paragraphs.meta_content("html", "twitter:image").alias("image_url"))


def _json_ld_pages(spark, sf) -> DataFrame:
    """Every document as a page whose article is JSON-LD, its author a list of objects."""
    item = F.to_json(F.struct(
        F.lit("NewsArticle").alias("@type"), views.first_line("text").alias("headline"),
        F.col("text").alias("articleBody"), F.array(F.struct(F.col("source").alias("name"))).alias("author"),
        F.lit("2024-01-02T03:04:05").alias("datePublished"),
    ))
    return _docs_spread(spark, sf).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id").alias("url"),
        F.concat(
            F.lit('<html><head><script type="application/ld+json">{bad</script><script type="application/ld+json">'),
            F.replace(item, F.lit("</"), F.lit("<\\/")), F.lit("</script></head><body></body></html>"),
        ).alias("html"))


def json_ld_articles(spark, sf):
    return extract_articles(_json_ld_pages(spark, sf)).select(
        "page_id", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"), "author",
        "published_date", "quality_score", "extraction_strategy")


def microdata_articles(spark, sf):
    def html_text(c):
        for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
            c = F.replace(c, F.lit(char), F.lit(entity))
        return c

    pages = _docs_spread(spark, sf).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id").alias("url"),
        F.concat(
            F.lit('<html><body><div itemscope itemtype="https://schema.org/NewsArticle"><h2 itemprop="name">'),
            html_text(views.first_line("text")), F.lit('</h2><meta itemprop="author" content="'), html_text(F.col("source")),
            F.lit('"><section itemprop="articleBody">'), html_text(F.col("text")),
            F.lit("</section></div></body></html>"),
        ).alias("html"))
    return extract_articles(pages).select(
        "page_id", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"), "author",
        "quality_score", "extraction_strategy")


def strategy_choice(spark, sf):
    """Best of two candidates per page, built from the markup: leaf text under the page
    title, and the page title alone; else the fallback text."""
    def candidate(strategy, title, content):
        return F.struct(
            F.lit(strategy).alias("strategy"), title.alias("title"), content.alias("content"),
            *[F.lit("").alias(f) for f in ("description", "author", "date", "image_url")])

    title = paragraphs.page_title("html")
    read = _pages(spark, sf).select(
        "page_id", title.alias("t"), paragraphs.leaf_paragraphs("html").alias("c"),
        paragraphs.first_paragraphs("html").alias("f"))
    best = choose_strategy(
        F.array(
            candidate("opengraph", F.lit(""), F.col("c")), candidate("html_semantic", F.col("t"), F.col("c")),
            candidate("html_heuristic", F.col("t"), F.col("c"))),
        candidate("fallback", F.col("t"), F.col("f")))
    return read.withColumn("best", best).select(
        "page_id", F.col("best.found.strategy").alias("strategy"), F.col("best.quality_score").alias("quality_score"))


def extracted_pages(spark, sf):
    placed = with_source(_pages_spread(spark, sf), registry_frame(spark)).drop("base_url", "list_url", "host")
    return extract_articles(placed)


def page_metrics(spark, sf):
    return extraction_metrics(extract_articles(_pages_spread(spark, sf)))


def stored_metric_rows(spark, sf):
    quick = paragraphs.quick_articles(_pages(spark, sf)).select(
        "url", F.lit("html_semantic").alias("strategy"), "quality_score", confidence("quality_score").alias("confidence_score"),
        F.length("content").alias("content_length"),
        F.when(F.col("content") == "", F.array(F.lit("no content"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return store.metric_rows(quick, F.expr("timestamp_ntz'2024-01-01 00:00:00'"))


def host_quality(spark, sf):
    """Flagship: pages to gated articles to a report per site."""
    read = with_host(paragraphs.quick_articles(_pages(spark, sf)))
    return (
        gate(read).groupBy("host")
        .agg(F.count("*").alias("n_articles"), F.round(F.avg("quality_score"), 6).alias("avg_quality"),
             F.sum(F.length("content")).alias("n_chars"))
    )


def best_images(spark, sf):
    links = F.transform(
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), lambda h: F.concat(h, F.lit(".jpg")))
    return _pages(spark, sf).select("page_id", best_image(links, "url").alias("image_url"))


# -------------------------------------------------------------- dedupe

def _keyed_docs(spark, sf) -> DataFrame:
    """Documents with a site-wide address: copies of a title on one site share it."""
    url = F.concat(F.lit("https://"), "lang", F.lit(".example/"), F.md5(F.substring("text", 1, 20)))
    return _docs_spread(spark, sf).select(
        "doc_id", "lang", url.alias("url"), title_hash(views.first_line("text")).alias("title_hash"),
        fingerprint(views.first_line("text"), "text", url, None).alias("content_fingerprint"))


def first_by(key):
    def run(spark, sf):
        return dd.first_per_key(_keyed_docs(spark, sf).select("doc_id", key), key, "doc_id").select("doc_id", key)

    return run


DEDUPE_KEYS = ["url", "title_hash", "content_fingerprint"]


def dedupe_verdicts(spark, sf):
    return dd.dedupe(_keyed_docs(spark, sf), "doc_id", DEDUPE_KEYS).select(
        "doc_id", "is_duplicate", "reason", "similarity", "matched")


def failure_streaks(spark, sf):
    return _ntz(_ntz(health.failure_streaks(_log(spark, sf)), "started_at"), "ended_at")


def json_round_trip(spark, sf):
    """Articles as exported and read again."""
    path = fresh_path(spark, "export")
    store.export_json(_articles_spread(spark, sf), path, _run_ts(), P["doc_sources"])
    return from_exchange(read_articles_json(spark, f"{path}/articles")).select(
        "news_id", "source", "url", "title", F.md5("content").alias("content_md5"), "quality_score", "extraction_strategy", "published_date")


def export_metadata(spark, sf):
    """The one row that describes an export, its maps flattened."""
    meta = store.export_metadata(_articles(spark, sf), _run_ts(), P["doc_sources"])
    return meta.select(
        "total_articles", F.col("quality_distribution.*"), F.size("sources_processed").alias("n_sources"),
        F.array_join(F.array_sort(F.transform(F.map_entries("source_breakdown"), lambda e: F.concat(
            e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("breakdown"))


def duplicate_counts(spark, sf):
    return dd.duplicate_counts(dedupe_verdicts(spark, sf))


def _sim_texts(spark, sf) -> DataFrame:
    return _articles_spread(spark, sf).select(
        "doc_id", "source", "created_at", similarity_text("title", "content", None).alias("sim_text"))


def tfidf_stored_match(spark, sf):
    texts = _sim_texts(spark, sf)
    kept = windows.comparison_set(texts.select("doc_id", "source", "created_at"), tie="doc_id")
    stored = durable(kept.select(F.col("source").alias("grp"), F.col("doc_id").alias("key")))
    vec = shared_vectors(texts, "doc_id", "sim_text", "source", P["stop_words"], threshold=P["tfidf_threshold"], stored=stored)
    found = best_stored_match(vec, stored, P["tfidf_threshold"])
    return found.select(F.col("key").alias("doc_id"), "matched", F.round("similarity", 6).alias("similarity"))


def tfidf_dedupe(spark, sf):
    texts = durable(_sim_texts(spark, sf).join(_keyed_docs(spark, sf), "doc_id"))
    similar = tfidf_similar(texts, "doc_id", "sim_text", "source", stop_words=P["stop_words"])
    # The texts have become vectors; the rounds read the keys alone.
    keyed = durable(texts.select("doc_id", *DEDUPE_KEYS))
    return dd.dedupe(keyed, "doc_id", DEDUPE_KEYS, similar=similar, pair_bound=similar.pair_bound).select(
        "doc_id", "is_duplicate", "reason", F.round("similarity", 6).alias("similarity"), "matched")


def cosine_stored_match(spark, sf):
    emb = _table(spark, sf, "embeddings")
    kept = windows.comparison_set(emb, source="label", ts="vec_id", tie="vec_id")
    found = vectors.first_stored_match(emb, kept, "vec_id", "embedding", "label", threshold=P["cosine_threshold"])
    return found.select("vec_id", "label", "matched", F.round("similarity", 6).alias("similarity"))


def cosine_earlier_match(spark, sf):
    """Every embedding's most similar earlier one, of all rows."""
    found = earlier_matches(_table(spark, sf, "embeddings"), "vec_id", "embedding", threshold=P["cosine_threshold"])
    return found.select("vec_id", "matched", F.round("similarity", 6).alias("similarity"), "n_matches")


def cosine_dedupe(spark, sf):
    """Embeddings near an earlier kept one, whole copies first."""
    rows = _table(spark, sf, "embeddings").select("vec_id", "embedding", F.md5(F.to_json("embedding")).alias("vector_hash"))
    similar = CosineSimilar(rows, "vec_id", "embedding", threshold=P["cosine_threshold"])
    return dd.dedupe(rows, "vec_id", ["vector_hash"], [("same_vector", 1.0)], similar, "cosine_similarity",
                     pair_bound=similar.pair_bound, batch_rows=BATCH_ROWS, pair_budget=PAIR_BUDGET).select(
        "vec_id", "is_duplicate", "reason", F.round("similarity", 6).alias("similarity"), "matched")


def comparison_rows(spark, sf):
    kept = windows.comparison_set(_articles(spark, sf).select("doc_id", "source", "created_at"), tie="doc_id")
    return kept.select("source", "doc_id", "recency")


def insertable_articles(spark, sf):
    rows = durable(_keyed_docs(spark, sf).select(
        "doc_id", "lang", article_id(F.col("doc_id").cast("string"), _run_ts()).alias("news_id"), "url",
        "content_fingerprint"))
    stored, new = rows.filter(F.col("lang") == P["stored_lang"]), rows.filter(F.col("lang") != P["stored_lang"])
    return store.insertable(new, stored, "doc_id").select("doc_id", "news_id", "url")


# ------------------------------------------------------------- search

def _conditions() -> dict:
    s = P["search"]
    return dict(
        sources=s["sources"], quality_min=s["quality_min"], query=s["query"],
        date_from=F.lit(s["date_from"]).cast("timestamp_ntz"), date_to=F.lit(s["date_to"]).cast("timestamp_ntz"))


def article_search(spark, sf):
    found = srch.search(_articles(spark, sf), P["search"]["limit"], P["search"]["offset"], **_conditions())
    return found.drop("content").withColumnRenamed("description", "summary")


def indexed_article_search(spark, sf):
    """The same search over the postings of all articles."""
    index, articles = GramIndex(spark, fresh_path(spark, "grams")), durable(_articles_spread(spark, sf))
    index.add(articles, 0)
    found = indexed_search(articles, index, P["search"]["limit"], P["search"]["offset"], **(_conditions() | {"query": P["search"]["long_query"]}))
    return found.drop("content").withColumnRenamed("description", "summary")


def search_page_info(spark, sf):
    return srch.page_info(_articles(spark, sf), P["search"]["limit"], P["search"]["offset"], **_conditions())


def next_search_page(spark, sf):
    last = P["search"]["date_to"]
    found = srch.search_after(
        _articles(spark, sf), F.lit(last).cast("timestamp_ntz"), "", P["search"]["limit"], sources=P["search"]["sources"])
    return found.select("news_id", "published_date")


# ------------------------------------------------------------- streams

def _event_stream(spark, sf) -> DataFrame:
    schema = _events(spark, sf).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1)
        .parquet(sf)
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run_stream(spark, df: DataFrame, label: str) -> DataFrame:
    """Run a stream over what has landed and read its output back."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        out = fresh_path(spark, label)
        (df.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", fresh_path(spark, f"{label}-state"))
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(out)


def stream_distinct_events(spark, sf):
    once = ingest.stream_dedupe(_event_stream(spark, sf).unionByName(_event_stream(spark, sf)), ["event_id"], "ts", "400 days")
    return _ntz(_run_stream(spark, once, "distinct")).select("event_id", "user_id", "event_type", "ts")


def stream_admissions(spark, sf):
    asked = views.requests_from_events(_event_stream(spark, sf))
    out = _run_stream(spark, state.stream_admissions(asked, P["admission_limit"], P["admission_window_s"]), "admission")
    return _ntz(out).select("client_id", "event_id", "ts", "admitted", "late")


def stream_source_health(spark, sf):
    log = views.source_log_from_events(_event_stream(spark, sf))
    out = _run_stream(spark, state.stream_health(log, recovery_s=P["recovery_s"]), "health")
    last = out.groupBy("source").agg(F.max_by("success_rate", F.struct("ts", "event_id")).alias("rate"))
    return last.select("source", F.round("rate", 6).alias("success_rate"))


def stream_latest_status(spark, sf):
    out = fresh_path(spark, "status")
    (views.status_from_events(_event_stream(spark, sf)).writeStream.foreachBatch(state.status_writer(out))
     .option("checkpointLocation", fresh_path(spark, "status-state")).trigger(availableNow=True).start().awaitTermination())
    return state.stored_status(spark, out)


def _late_events(spark, sf) -> str:
    """Events that arrive up to ``event_lag_s`` seconds after their time."""
    out = fresh_path(spark, "events")
    arrived = (F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") * 7919 % P["event_lag_s"]) * 10_000_000 + F.col("event_id")
    ingest.ingest_events(_event_stream(spark, sf).withColumn("arrived", arrived), out, fresh_path(spark, "events-state"), P["event_keys"],
                         "arrived", "ts", P["event_delay_s"]).awaitTermination()
    return out


def stream_first_events(spark, sf):
    """The first event of each user and kind that was not late."""
    return _ntz(ingest.stored_events(spark, _late_events(spark, sf), _events(spark, sf).schema)).select("event_id", "user_id", "event_type", "ts")


def stream_late_events(spark, sf):
    return _ntz(ingest.stored_events(spark, _late_events(spark, sf), _events(spark, sf).schema, late=True)).select("event_id", "user_id", "event_type", "ts")


def stream_ingest(spark, sf):
    out = fresh_path(spark, "articles")
    pages = (spark.readStream.schema(_pages(spark, sf).schema).option("pathGlobFilter", "pages.parquet").parquet(sf))
    ingest.ingest_pages(pages, out, fresh_path(spark, "ingest-state"), _run_ts()).awaitTermination()
    return _ntz(ingest.stored_batches(spark, out), "created_at").select(
        "url", "source", "title", "quality_score", "content_fingerprint", "ai_summary")


# -------------------------------------------------------- windows, logs

def breaker_states(spark, sf):
    out = health.breaker_replay(_log(spark, sf), threshold=P["breaker_threshold"], recovery_s=P["recovery_s"])
    return _ntz(out)


def admissions(spark, sf):
    return _ntz(health.admission_audit(_requests(spark, sf), limit=P["admission_limit"], window_s=P["admission_window_s"]))


def trailing_requests(spark, sf):
    return _ntz(health.trailing_requests(_requests(spark, sf), window_s=P["admission_window_s"]))


def source_success_rate(spark, sf):
    return health.success_rate(_log(spark, sf)).select("source", F.round("success_rate", 6).alias("success_rate"))


def _quick_extractions(spark, sf) -> DataFrame:
    quick = with_host(paragraphs.quick_articles(_pages(spark, sf)))
    return quick.select(
        "page_id", "host", "quality_score",
        F.when(F.col("quality_score") < 0.3, "fallback").otherwise("html_semantic").alias("extraction_strategy"))


def trimmed_strategy_means(spark, sf):
    kept = health.trimmed_history(_quick_extractions(spark, sf), longest=P["history_longest"], keep=P["history_keep"])
    return _rounded(reports.strategy_means(kept), "mean_quality")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


def newest_articles(spark, sf):
    rows = _articles(spark, sf).select("source", "doc_id", "title", "created_at")
    return windows.recent_per_source(rows, P["recent_n"], tie="doc_id", rank="recency")


def dashboard(spark, sf):
    return _rounded(reports.dashboard_rows(_articles(spark, sf), _runs(spark, sf), _as_of()), "value")


def _pick(values, number):
    """One of the values for each number, in turn."""
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def dated_orders(spark, sf):
    """Order dates written in a different way per priority; the last one is no known shape."""
    shapes = F.when(F.startswith("o_orderpriority", F.lit("1")), F.date_format("o_orderdate", "yyyy-MM-dd"))
    for first, shape in (("2", "MM/dd/yyyy"), ("3", "MMMM d, yyyy")):
        shapes = shapes.when(F.startswith("o_orderpriority", F.lit(first)), F.date_format("o_orderdate", shape))
    written = shapes.otherwise(F.date_format("o_orderdate", "dd MM yyyy"))
    return _table(spark, sf, "orders").select("o_orderkey", looks_like_date(written).alias("dated"))


def _ranked(c):
    return F.transform(ranked_sentences(c), lambda s: F.concat_ws(
        ":", s["position"].cast("string"), F.round(-s["minus_score"], 6).cast("string"), s["words"].cast("string")))


def entry(spark: SparkSession) -> DataFrame:
    return host_quality(spark, "/root/testdata/sf0.001")


def _training_data():
    """Queries and SQL of the training-data operators and their pipeline, where those are present.

    A fault inside them is not hidden: only their absence is.
    """
    found = [importlib.util.find_spec(name) for name in ("corpus_pipeline", "presswork.llm")]
    if not all(spec and spec.origin for spec in found):
        return {}, {}
    import corpus_pipeline
    from presswork.llm import queries as training_data

    own, sql = training_data.queries(), training_data.oracle_sql()
    own["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return own, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | _training_data()[0]


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sources and sinks
        "page_scan": lambda s, d: _pages(s, d).select("page_id", "url", F.length("html").alias("n_chars")),
        "page_sources": page_sources,
        "source_lookup": source_lookup,
        "invalid_source_names": invalid_source_names,
        "anchor_links": lambda s, d: anchor_links(_pages(s, d)),
        "capped_links": capped_links,
        "seen_state": lambda s, d: load_seen(_articles_spread(s, d)),
        "unseen_pages": unseen_pages,
        "fallback_rows": fallback_rows,
        "articles_union": articles_union,
        "failure_streaks": failure_streaks,
        "json_round_trip": json_round_trip,
        "export_metadata": export_metadata,
        "csv_export_rows": lambda s, d: store.csv_frame(_articles(s, d)),
        "insertable_articles": insertable_articles,
        "stored_metric_rows": stored_metric_rows,
        # text, addresses, hashes, scores
        "clean_text": _on_docs(text=lambda: clean_text("text")),
        "normalize_text": _on_docs(text=lambda: normalize_text("text")),
        "key_phrases": _on_docs(phrases=lambda: key_phrases("text")),
        "content_fingerprint": _on_articles("doc_id", content_fingerprint=lambda: fingerprint("title", "content", "url")),
        "title_hash": _on_docs(title_hash=lambda: title_hash(_title())),
        "article_id": lambda s, d: _pages(s, d).select("page_id", article_id("url", _run_ts()).alias("news_id")),
        "url_parts": lambda s, d: _pages(s, d).select(
            "page_id", url_scheme("url").alias("scheme"), url_host("url").alias("host"), url_path("url").alias("path")),
        "looks_like_date": dated_orders,
        "date_part": lambda s, d: _events(s, d).select(
            "event_id", date_part(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("day")),
        "boilerplate": lambda s, d: _table(s, d, "conversations").select(
            "conv_id", "turn", is_boilerplate(F.concat("text", F.lit(" "), _pick(P["endings"], F.col("conv_id") + F.col("turn")))).alias("is_boilerplate")),
        "image_scores": lambda s, d: _pages(s, d).select(
            "page_id", image_score(F.concat("url", _pick(P["images"], F.col("page_id"))), "url").alias("score")),
        "best_images": best_images,
        "article_quality": _on_docs(quality_score=lambda: quality_score(_title(), "text", "lang", "source")),
        "confidence": _on_docs(confidence=lambda: confidence(quality_score(_title(), "text"))),
        "quality_tier": _on_articles("doc_id", tier=lambda: quality_tier("quality_score"),
                                     tier_or_poor=lambda: quality_tier("quality_score", "poor")),
        "similarity_text": _on_docs(text=lambda: similarity_text(_title(), "text")),
        "text_prefixes": _on_docs(
            n_chars=lambda: F.length("text"), **{f"first_{n}": (lambda n=n: F.md5(F.substring("text", 1, n)))
                                                 for n in (300, 1000, 2000, 3000)}),
        "summary_length": _on_docs(n_words=lambda: word_count("text"), in_range=lambda: length_in_range("text")),
        "title_or_link": _on_docs(title=lambda: title_or_link(F.regexp_extract("text", "^(.*)\\n", 1), F.col("source"))),
        "summary_prompt": _on_docs(prompt=lambda: summary_prompt(_title(), "text")),
        # extraction
        "leaf_paragraphs": leaf_text,
        "fallback_extraction": fallback_text,
        "opengraph_fields": opengraph_fields,
        "json_ld_articles": json_ld_articles,
        "microdata_articles": microdata_articles,
        "strategy_choice": strategy_choice,
        "extracted_articles": extracted_pages,
        "extraction_metrics": page_metrics,
        "host_quality": host_quality,
        # filters
        "quality_gate": lambda s, d: gate(paragraphs.quick_articles(_pages(s, d))).select("page_id", "quality_score"),
        "export_threshold": lambda s, d: _articles(s, d).filter(export_threshold("quality_score", 0.7)).select("doc_id", "quality_score"),
        "article_search": article_search,
        "indexed_article_search": indexed_article_search,
        "search_page_info": search_page_info,
        "next_search_page": next_search_page,
        # duplicates
        "first_per_url": first_by("url"),
        "first_per_title": first_by("title_hash"),
        "first_per_fingerprint": first_by("content_fingerprint"),
        "dedupe_verdicts": dedupe_verdicts,
        "duplicate_counts": duplicate_counts,
        "comparison_rows": comparison_rows,
        "cosine_stored_match": cosine_stored_match,
        "cosine_earlier_match": cosine_earlier_match,
        "cosine_dedupe": cosine_dedupe,
        "tfidf_stored_match": tfidf_stored_match,
        "tfidf_dedupe": tfidf_dedupe,
        # reports
        "total_articles": _report(reports.total_articles),
        "recent_articles": lambda s, d: reports.recent_articles(_articles(s, d), _as_of()),
        "source_performance": _report(reports.source_performance),
        "strategy_performance": _report(reports.strategy_performance),
        "quality_distribution": _report(reports.quality_distribution),
        "quality_columns": _report(reports.quality_columns),
        "source_share": lambda s, d: _rounded(reports.source_share(_articles(s, d)), "share_pct"),
        "source_columns": _report(reports.source_columns, P["doc_sources"]),
        "strategy_share": lambda s, d: _rounded(reports.strategy_share(_articles(s, d)), "share_pct"),
        "quality_stats": lambda s, d: _rounded(reports.quality_stats(_articles(s, d)), "avg_quality"),
        "length_stats": lambda s, d: _rounded(reports.length_stats(_articles(s, d)), "avg_length"),
        "sample_article": lambda s, d: reports.sample_article(
            _articles(s, d), [F.desc("created_at"), F.col("news_id")]),
        "strategy_means": lambda s, d: _rounded(reports.strategy_means(_quick_extractions(s, d)), "mean_quality"),
        "run_rate": lambda s, d: _rounded(reports.run_rate(_runs(s, d)), "articles_per_minute"),
        "run_totals": lambda s, d: reports.run_totals(views.outcomes_from_events(_events(s, d))),
        "recent_runs": _report(reports.recent_runs, view=_runs),
        "mean_run_time": lambda s, d: _rounded(reports.mean_run_time(_runs(s, d)), "mean_runtime"),
        "latest_status": lambda s, d: reports.with_details(
            reports.latest_status(_status(s, d), "event_id"), {"k": "int"}),
        "dashboard": dashboard,
        # windows and replays
        "newest_articles": newest_articles,
        "success_rate": source_success_rate,
        "breaker_states": breaker_states,
        "trimmed_strategy_means": trimmed_strategy_means,
        "admissions": admissions,
        "trailing_requests": trailing_requests,
        # summaries
        "sentences": _on_docs(n_sentences=lambda: F.size(sentences("text")), first_sentence=lambda: F.get(sentences("text"), F.lit(0))),
        "sentence_scores": _on_docs(ranked=lambda: F.array_join(_ranked("text"), " ")),
        "extractive_summary": _on_docs(summary=lambda: extractive_summary("text")),
        "leading_text": _on_docs(summary=lambda: leading_text("text")),
        # streams
        "stream_distinct_events": stream_distinct_events,
        "stream_admissions": stream_admissions,
        "stream_source_health": stream_source_health,
        "stream_latest_status": stream_latest_status,
        "stream_first_events": stream_first_events,
        "stream_late_events": stream_late_events,
        "stream_ingest": stream_ingest,
    }


def oracle_sql() -> dict[str, str]:
    return oracle_queries.statements() | _training_data()[1]
