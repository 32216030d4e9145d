"""A collection run: landed pages in, new articles out."""
from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.fixed_values import DUPLICATE_REASONS
from ..functions.summary import extractive_summary
from ..functions.text import article_id, fingerprint, published_ts, similarity_text, title_hash, title_or_link
from ..functions.urls import url_host
from ..operators.dedupe import dedupe
from ..operators.extract import extract_articles, extraction_metrics, gate
from ..operators.reports import run_totals
from ..operators.text_index import TextIndex
from ..operators.tfidf import TfidfSimilar, tfidf_similar
from ..schemas import ARTICLE
from ..session import durable
from ..sinks.key_index import KeyIndex
from ..sinks.store import append_run
from ..sources.pages import drop_seen
from ..sources.registry import SOURCES, Source, registry_frame, with_source

KEYS = ["url", "title_hash", "content_fingerprint"]


@dataclass
class Run:
    """What a run produced.  All frames are lazy except the ones read twice."""

    articles: DataFrame
    verdicts: DataFrame
    metrics: DataFrame
    totals: DataFrame
    #: Term vectors of the new articles, by ``news_id``, for the text index; None without one.
    vectors: DataFrame | None = None
    started: float = 0.0


def english_stop_words() -> list[str]:
    """The stop words that Spark ships for English."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def article_rows(extracted: DataFrame, run_ts: Column) -> DataFrame:
    """Extracted rows with their ids, keys and dates; the text is kept once.

    The fingerprint is of the whole content: it decides which rows are dropped.
    A page without a title takes the text of the link it was found by
    (``link_title``), where there is one.
    """
    if "link_title" in extracted.columns:
        extracted = extracted.withColumn("title", title_or_link("title", "link_title")).drop("link_title")
    return extracted.select(
        "*",
        article_id("url", run_ts).alias("news_id"),
        title_hash("title").alias("title_hash"),
        fingerprint("title", "content", "url", None).alias("content_fingerprint"),
        published_ts("published_date").alias("published_ts"),
        run_ts.alias("created_at"), F.to_date(run_ts).alias("created_date"),
    )


def _unseen(rows: DataFrame, stored: DataFrame | KeyIndex, key: str, part: int | None) -> DataFrame:
    return stored.unseen(rows, key, part) if isinstance(stored, KeyIndex) else drop_seen(rows, stored, key)


def _repeats(rows: DataFrame, order: str, reason: str, similarity: Column) -> DataFrame:
    """Verdicts of rows that repeat a stored article."""
    return rows.select(order, F.lit(True).alias("is_duplicate"), F.lit(reason).alias("reason"), similarity.alias("similarity"),
                       F.lit(None).cast("long").alias("matched"))


def collect_run(
    pages: DataFrame, run_ts: Column, order: str = "page_id", stored: DataFrame | KeyIndex | None = None,
    sources: Sequence[Source] = SOURCES, near_copies: bool = True, stop_words: Sequence[str] | None = None,
    stored_keys: Sequence[str] = ("content_fingerprint",), text_index: TextIndex | None = None, part: int | None = None,
) -> Run:
    """Pages to new articles: skip known URLs, extract, gate, drop duplicates, summarise.

    ``order`` (a unique long) is the order of arrival; it decides which copy is
    kept.  Texts above the TF-IDF cosine threshold count as duplicates
    (``near_copies``), those of earlier runs too with a ``text_index``.
    ``stored`` is the stored articles or, better, the index of their keys;
    ``stored_keys`` are the keys that, besides the URL, a stored article blocks.
    ``part`` is the number under which :func:`save_run` will store this run: a
    repeated run does not meet its own first attempt.
    """
    started = time.time()
    if stored is not None:
        pages = _unseen(pages, stored, "url", part)     # before the parse: a known page is never opened
    placed = with_source(pages, registry_frame(pages.sparkSession, list(sources)))
    placed = placed.drop("base_url", "list_url")
    # The parse is the costly step and is read several times below.
    extracted = durable(extract_articles(placed, sources).withColumn(
        "source", F.coalesce("source", "host")))
    arrived = rows = durable(article_rows(gate(extracted), run_ts))
    known = []
    if stored is not None:
        # Rows that repeat a stored article are duplicates with a verdict like any other.
        for key in stored_keys:
            fresh = durable(_unseen(rows, stored, key, part))
            reason, score = DUPLICATE_REASONS[KEYS.index(key)]
            known.append(_repeats(rows.select(order).join(fresh.select(order), order, "left_anti"), order, reason, F.lit(float(score))))
            rows = fresh
    similar = weighed = None
    if near_copies:
        texts = rows.select(order, "source", similarity_text("title", "content", None).alias("sim_text"))
        words = english_stop_words() if stop_words is None else stop_words
        if text_index is None:
            similar = tfidf_similar(texts, order, "sim_text", "source", stop_words=words)
        else:
            texts = durable(texts.select(F.col(order).cast("string").alias("key"), F.col("source").alias("grp"), F.col("sim_text").alias("text")))
            text_index.fit(texts)
            weighed = durable(text_index.weigh(texts))
            found = durable(text_index.matches(weighed, part).select(F.col("key").cast("long").alias(order), "similarity"))
            known.append(_repeats(found, order, "tfidf_similarity", F.col("similarity")))
            rows = durable(rows.join(found.select(order), order, "left_anti"))
            similar = TfidfSimilar(durable(weighed.withColumn("key", F.col("key").cast("long"))), text_index.threshold)
    verdicts = durable(dedupe(rows, order, KEYS, similar=similar, **(
        {"pair_bound": similar.pair_bound} if similar else {})))
    if known:
        verdicts = durable(verdicts.unionByName(arrived.join(union_sources(known), order)))
    articles = (
        verdicts.filter(~F.col("is_duplicate"))
        .drop("is_duplicate", "reason", "similarity", "matched")
        .withColumn("ai_summary", extractive_summary("content"))
    )
    totals = run_totals(
        extracted.select(order, (F.size("errors") > 0).alias("failed"))
        .join(verdicts.select(order, "is_duplicate"), order, "left")
        .select(F.when(F.col("is_duplicate"), "duplicate").when(~F.col("is_duplicate"), "kept")
                .when(F.col("failed"), "error").otherwise("poor").alias("outcome"))
    )
    vectors = None
    if weighed is not None:
        names = articles.select(F.col(order).cast("string").alias("key"), "news_id")
        vectors = weighed.join(names, "key").select("grp", F.col("news_id").alias("key"), "term", "weight", "in_prefix")
    return Run(articles, verdicts, extraction_metrics(extracted), totals, vectors, started)


def save_run(
    run: Run, path: str, part: int, run_ts: Column, key_index: KeyIndex | None = None, text_index: TextIndex | None = None,
    runs_path: str | None = None, keys: Sequence[str] = ("url", "title_hash", "content_fingerprint"),
) -> dict:
    """Store a run as ``batch=<part>`` of ``path``, enter it into the indexes, and append its record; returns that record.

    Everything but the record overwrites what a first attempt left.  The new
    articles are counted while they are written.
    """
    counted = Observation("articles")
    rows = run.articles.select(*[F.col(f.name).cast(f.dataType) for f in ARTICLE.fields])
    rows.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={part}")
    stored = rows.sparkSession.read.schema(ARTICLE).parquet(f"{path}/batch={part}")
    if key_index is not None:
        key_index.add(stored, part, keys)
    if text_index is not None and run.vectors is not None:
        text_index.add(run.vectors, part)
    totals = run.totals.first().asDict()
    n = counted.get["n"]
    record = {"run_id": f"run_{part:012d}", **totals, "articles_found": n, "new_articles": n, "runtime_seconds": time.time() - run.started}
    if runs_path is not None:
        spark = rows.sparkSession
        append_run(spark.createDataFrame([record]).withColumn("created_at", run_ts), runs_path)
    return record


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all per-source results."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", url_host("url"))
