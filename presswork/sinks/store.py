"""Writing articles, logs and exports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.dedupe import keep_order
from ..operators.reports import quality_columns
from ..schemas import ARTICLE, EXTRACTION_METRIC, FALLBACK_ARTICLE, RUN, STATUS
from ..session import durable
from ..sources.pages import drop_seen

UNIQUE_KEYS = ["news_id", "url", "content_fingerprint"]
CSV_COLUMNS = [
    "news_id", "source", "url", "title", "ai_summary", "published_date", "quality_score", "created_at",
]


def insertable(
    new: DataFrame, stored: DataFrame, order: str, keys: Sequence[str] = UNIQUE_KEYS,
) -> DataFrame:
    """Rows of ``new`` that unique keys let in: no clash with a stored row or an earlier inserted one."""
    # Only order and keys take part; the wide rows are read again at the end.
    keyed = durable(new.select(order, *keys))
    for key in keys:
        keyed = drop_seen(keyed, stored, key)
    let_in = keep_order(durable(keyed), order, keys)
    return new.join(let_in.withColumnRenamed("ord", order), order, "left_semi")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Stored articles; no rows when nothing was stored yet."""
    try:
        return spark.read.schema(ARTICLE).parquet(path)
    except Exception as error:  # the path appears with the first append
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ARTICLE)


def append_articles(new: DataFrame, path: str, order: str, keys: Sequence[str] = UNIQUE_KEYS) -> DataFrame:
    """Append the insertable rows, by day of creation, and return them."""
    stored = read_store(new.sparkSession, path)
    rows = durable(insertable(new, stored, order, keys))
    (
        rows.withColumn("created_date", F.to_date("created_at"))
        .select(*ARTICLE.fieldNames())
        # Sorted files keep url ranges narrow, so key look-ups skip row groups.
        .sortWithinPartitions("created_date", "url")
        .write.mode("append").partitionBy("created_date").parquet(path)
    )
    return rows


def _append(df: DataFrame, path: str, schema) -> None:
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(path)


def metric_rows(metrics: DataFrame, run_ts: Column) -> DataFrame:
    """Extraction metrics as stored: the errors as JSON text."""
    return metrics.withColumn("errors", F.to_json("errors")).withColumn("created_at", run_ts)


def append_extraction_metrics(metrics: DataFrame, path: str, run_ts: Column) -> None:
    _append(metric_rows(metrics, run_ts), path, EXTRACTION_METRIC)


def append_run(run: DataFrame, path: str) -> None:
    _append(run, path, RUN)


def append_status(status: DataFrame, path: str) -> None:
    """A status change is a new row; :func:`presswork.operators.reports.latest_status` reads the last."""
    _append(status, path, STATUS)


def csv_frame(articles: DataFrame) -> DataFrame:
    """All articles, newest first, with the exported columns."""
    return articles.select(*CSV_COLUMNS).orderBy(F.desc("created_at"), "news_id")


def export_csv(articles: DataFrame, path: str) -> None:
    """Sorted part files whose names follow the order; a range shuffle, not one task."""
    csv_frame(articles).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_metadata(articles: DataFrame, run_ts: Column, sources: Sequence[str], metrics: Column | None = None) -> DataFrame:
    """One row describing an export."""
    quality = quality_columns(articles)
    per_source = articles.groupBy(F.coalesce("source", F.lit("Unknown")).alias("source")).agg(F.count("*").alias("n"))
    breakdown = per_source.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("source_breakdown"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_articles"),
    )
    parts = quality.select(F.struct("*").alias("quality_distribution"), F.lit(1).alias("one")).join(
        breakdown.withColumn("one", F.lit(1)), "one")
    return parts.select(
        F.lit("2.0").alias("pipeline_version"), run_ts.alias("generated_at"), "total_articles",
        F.array(*[F.lit(s) for s in sources]).alias("sources_processed"),
        (metrics if metrics is not None else F.lit(None).cast("map<string,double>")).alias("metrics"),
        "quality_distribution", "source_breakdown",
    )


def exchange_rows(articles: DataFrame, run_ts: Column) -> DataFrame:
    """Stored articles with the column names that exchanged files have."""
    return articles.select(
        "news_id", F.col("source").alias("news_source"), F.col("url").alias("source_url"), F.col("title").alias("news_title"),
        F.col("content").alias("news_content"), "description", "author", F.col("published_date").alias("news_published_date"), "image_url",
        F.struct(
            F.col("extraction_strategy"), F.col("quality_score"), F.lit(None).cast("double").alias("confidence_score"),
            F.length("content").cast("long").alias("content_length"), F.date_format(run_ts, "yyyy-MM-dd'T'HH:mm:ss").alias("scraped_at"),
        ).alias("metadata"),
        "ai_summary").select([f.name for f in FALLBACK_ARTICLE.fields])


def export_json(
    articles: DataFrame, path: str, run_ts: Column, sources: Sequence[str], metrics: Column | None = None,
    compression: str = "gzip",
) -> None:
    """``articles/``, one exchanged article per line, and a one-row ``metadata/``."""
    exchange_rows(articles, run_ts).write.mode("overwrite").option("compression", compression).json(f"{path}/articles")
    export_metadata(articles, run_ts, sources, metrics).write.mode("overwrite").json(f"{path}/metadata")
