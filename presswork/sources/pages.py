"""Landed pages and stored state as DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import FALLBACK_ARTICLE, PAGE


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(path)


def stream_pages(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(PAGE)
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def read_articles_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Exported or fallback articles, one JSON object per line.

    With ``whole_files`` each file is one array or object, read by one task.
    """
    return spark.read.schema(FALLBACK_ARTICLE).option("multiLine", whole_files).json(path)


def from_exchange(rows: DataFrame) -> DataFrame:
    """Exchanged articles with the column names of the store."""
    return rows.select(
        "news_id", F.col("news_source").alias("source"), F.col("source_url").alias("url"), F.col("news_title").alias("title"),
        F.col("news_content").alias("content"), "description", "author", F.col("news_published_date").alias("published_date"),
        "image_url", "ai_summary", F.col("metadata.quality_score").alias("quality_score"),
        F.col("metadata.extraction_strategy").alias("extraction_strategy"))


def load_seen(articles: DataFrame) -> DataFrame:
    """What earlier runs accepted: every URL, and fingerprints where there are any."""
    return articles.select("url", F.nullif("content_fingerprint", F.lit("")).alias("content_fingerprint"))


def drop_seen(df: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not in the stored state.

    The stored side only grows, so it is not the one to move: the hits are
    found first (Spark sends the batch's keys to the store when they are few),
    and the batch is then checked against the hits alone.
    """
    wanted = df.select(key).filter(F.col(key).isNotNull()).distinct()
    hits = seen.select(key).join(wanted, key, "left_semi").distinct()
    return df.join(hits, key, "left_anti")


def with_fallback(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """The run's rows, or the fallback rows when the run has none."""
    n_rows = df.limit(1).agg(F.count("*")).scalar()
    return df.unionByName(fallback.filter(n_rows == 0), allowMissingColumns=True)


def cap_per_source(links: DataFrame, n: int, source: str = "source", order: str = "pos") -> DataFrame:
    """The first ``n`` links of each source in page order, before any seen-URL filter.

    Spark keeps only ``n`` rows per source on each task before the shuffle
    (window group limit), so a large source costs no more than a small one.
    """
    return top_rows(links, [source], [F.col(order), F.col("url")], n)


def top_rows(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key.

    Groups are trimmed in salted parts first, so no task sorts a whole large
    group, whatever ``n`` is.
    """
    from pyspark.sql import Window

    name = rank or "_rank"
    # Spark itself trims each task's groups before the shuffle up to this rank only.
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]), F.lit(64)))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= n).drop("_rank", "_salt")
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)
