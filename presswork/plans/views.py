"""Articles, runs, logs and requests derived from general tables.

Lets every operator run over whole ``documents``, ``pages`` and ``events``
tables.  Columns nobody selects are pruned, so the view costs only what a
query reads.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.quality import quality_score
from ..functions.summary import leading_text
from ..functions.text import article_id, fingerprint

RUN_TS = "timestamp'2024-01-01 00:00:00'"


def first_line(text: Column | str) -> Column:
    return F.substring_index(text, "\n", 1)


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """One stored article per document, a minute apart.  One-line documents have no
    score; every sixth has no strategy."""
    strategies = F.array(*[F.lit(s) for s in fixed.STRATEGIES], F.lit(None).cast("string"))
    base = documents.select(
        "doc_id", "lang", "source",
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        first_line("text").alias("title"), F.col("text").alias("content"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id AS int), 0)").alias("created_at"),
    )
    return base.select(
        "doc_id", "lang",
        article_id("url", F.expr(RUN_TS)).alias("news_id"),
        "source", "url", "title", "content",
        F.lit("").alias("description"), F.lit("").alias("author"),
        F.date_format("created_at", "yyyy-MM-dd").alias("published_date"),
        F.lit("").alias("image_url"),
        leading_text("content").alias("ai_summary"),
        F.when(F.col("title") != F.col("content"), quality_score("title", "content")).alias("quality_score"),
        fingerprint("title", "content", "url", None).alias("content_fingerprint"),
        F.get(strategies, (F.col("doc_id") % 6).cast("int")).alias("extraction_strategy"),
        "created_at",
        F.to_date("created_at").alias("created_date"),
    )


def _prop(name: str) -> Column:
    return F.get_json_object("props", f"$.{name}").cast("int")


def runs_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("run_"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("run_id"),
        F.col("user_id").alias("articles_found"), F.col("user_id").alias("new_articles"),
        _prop("k").cast("long").alias("duplicates"),
        (F.col("event_type") == "error").cast("long").alias("errors"),
        F.col("value").alias("runtime_seconds"), F.col("ts").alias("created_at"),
    )


def outcomes_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "duplicate")
        .otherwise("kept").alias("outcome"))


def status_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("exec_"), F.col("user_id").cast("string")).alias("execution_id"),
        F.col("event_type").alias("status"), F.col("props").alias("details"), F.col("ts").alias("updated_at"),
        "event_id",
    )


def source_log_from_events(events: DataFrame) -> DataFrame:
    """One attempt per event: errors failed, the rest returned ``k`` modulo 3 articles."""
    return events.select(
        F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        (F.col("event_type") != "error").alias("ok"), (_prop("k") % 3).alias("n_articles"),
    )


def requests_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("client_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
