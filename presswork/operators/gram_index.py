"""Substring search over a large store by stored posting lists of three-letter grams.

An article that matches a pattern holds every three-letter run of each stretch
between the pattern's wildcards.  Postings (gram, news_id) lie in hash buckets:
a query reads the buckets of its own grams, keeps the articles that have all of
them, and only those are looked up and checked with the pattern itself.  A
pattern without a stretch of three letters cannot use the index and scans.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import bind
from ..sinks.buckets import BUCKETS, BucketTable
from .search import search

GRAM = 3


def grams_of(text: Column) -> Column:
    """The distinct three-letter runs of a text, in lower case."""
    # By signs, as a substring by place would count from the start for each gram.
    signs = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    return bind(signs, lambda c: F.array_distinct(F.transform(
        F.filter(F.transform(c, lambda x, i: i), lambda i: i + GRAM <= F.size(c)), lambda i: F.concat(*[F.get(c, i + k) for k in range(GRAM)]))))


def stretches(pattern: str) -> list[str]:
    """The parts between wildcards that are long enough to have a gram."""
    return [part for part in re.split("[%_]+", pattern) if len(part) >= GRAM]


class GramIndex(BucketTable):
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        super().__init__(spark, path, "gram string, news_id string", ["gram"], buckets)

    def add(self, articles: DataFrame, part: int) -> None:
        """Postings of a batch's articles (news_id, title, content)."""
        both = F.array_union(grams_of(F.coalesce("title", F.lit(""))), grams_of(F.coalesce("content", F.lit(""))))
        self.append(articles.select("news_id", F.explode(both).alias("gram")), part)

    def candidates(self, pattern: str) -> DataFrame | None:
        """Articles (news_id) that hold all grams of the pattern; None if it has none."""
        parts = stretches(pattern)
        if not parts:
            return None
        asked = self.spark.range(1).select(F.explode(F.array_distinct(F.flatten(F.array(*[grams_of(F.lit(p)) for p in parts])))).alias("gram"))
        n = asked.count()
        hits = self.read(asked).join(F.broadcast(asked), "gram")  # as many rows as the pattern has grams
        return hits.groupBy("news_id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == n).select("news_id")


def indexed_search(articles: DataFrame, index: GramIndex, limit: int = 50, offset: int = 0, query: str | None = None, **conditions) -> DataFrame:
    """:func:`presswork.operators.search.search` that looks up the candidates of ``query`` first."""
    found = index.candidates(query) if query else None
    if found is not None:
        articles = articles.join(found, "news_id", "left_semi")
    return search(articles, limit, offset, query=query, **conditions)
