"""Article search: filters, pages of results and page info."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

RESULT = {
    "title": "title", "ai_summary": "description", "url": "redirect_url", "source": "source",
    "image_url": "image_url", "created_at": "published_date", "news_id": "news_id", "content": "content",
}


def search_filter(
    sources: Sequence[str] | None = None, quality_min: float | None = None,
    date_from: Column | None = None, date_to: Column | None = None, query: str | None = None,
) -> Column:
    """All given conditions at once, on plain columns so that they reach the scan.

    Both date bounds are included.  ``query`` is a case-insensitive substring
    in which ``%`` and ``_`` are wildcards.
    """
    tests: list[Column] = []
    if sources:
        tests.append(F.col("source").isin(*sources))
    if quality_min is not None:
        tests.append(F.col("quality_score") >= F.lit(float(quality_min)))
    if date_from is not None:
        tests.append(F.col("created_at") >= date_from)
    if date_to is not None:
        tests.append(F.col("created_at") <= date_to)
    if query:
        pattern = "%" + query.replace("\\", "\\\\") + "%"
        tests.append(F.col("title").ilike(pattern) | F.col("content").ilike(pattern))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def search(articles: DataFrame, limit: int = 50, offset: int = 0, **conditions) -> DataFrame:
    """One page of matches, newest first."""
    return (
        articles.filter(search_filter(**conditions))
        .select(*[F.col(c).alias(name) for c, name in RESULT.items()])
        .orderBy(F.desc("published_date"), "news_id")
        .offset(offset).limit(limit)
    )


def search_after(articles: DataFrame, last_created: Column, last_id: str, limit: int = 50, **conditions) -> DataFrame:
    """The page after a known last row: for deep pages, where an offset would
    sort everything before it again."""
    later = (F.col("created_at") < last_created) | (
        (F.col("created_at") == last_created) & (F.col("news_id") > F.lit(last_id)))
    return search(articles.filter(later), limit=limit, **conditions)


def page_info(articles: DataFrame, limit: int = 50, offset: int = 0, **conditions) -> DataFrame:
    """Total matches and where the next page starts."""
    total = articles.filter(search_filter(**conditions)).agg(F.count("*").alias("total"))
    has_more = F.lit(offset + limit) < F.col("total")
    return total.select(
        F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), "total", has_more.alias("has_more"),
        F.when(has_more, F.lit(offset + limit)).alias("next_offset"),
    )
