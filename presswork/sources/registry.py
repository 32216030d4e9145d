"""The source registry: which sites are read and how their pages are laid out."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.urls import url_host


@dataclass(frozen=True)
class Source:
    key: str
    name: str
    base_url: str
    list_url: str
    primary: dict[str, str]
    fallback: dict[str, list[str]] = field(default_factory=dict)

    @property
    def host(self) -> str:
        return self.base_url.split("://", 1)[1].split("/", 1)[0]


# Names, addresses and selectors of the five sites.
SOURCES = [
    Source(
        "inc42", "Inc42", "https://inc42.com", "https://inc42.com/buzz/",
        {
            "articles": "div.card-wrapper",
            "title": "h2.entry-title a",
            "link": "h2.entry-title a",
            "image": "figure.card-image img",
            "content": "div.single-post-content",
        },
        {
            "articles": [".post", ".entry", "article"],
            "title": ["h1", ".title", ".headline"],
            "content": [".content", ".post-content", "article"],
        },
    ),
    Source(
        "entrackr", "Entrackr", "https://entrackr.com", "https://entrackr.com/news",
        {
            "articles": "main div div a, .post-item, article, .news-item",
            "title": "h2, h3, .entry-title, .post-title",
            "link": 'a[href*="/"], a[href*="entrackr"]',
            "content": "article .content, .post-content, .entry-content, main article",
        },
        {
            "articles": [".td_module_flex", ".entry", ".post"],
            "title": ["h1", "h2", "h3"],
            "content": [".content", "article", "main"],
        },
    ),
    Source(
        "moneycontrol", "Moneycontrol", "https://www.moneycontrol.com",
        "https://www.moneycontrol.com/news/business/startup/",
        {
            "articles": "#cagetory li.clearfix",
            "title": "h2 a",
            "link": "h2 a",
            "content": "#contentdata",
            "image": "section img, .artImg img, .article-image img",
        },
        {
            "articles": [".news-item", ".story", ".article"],
            "content": [".content", ".story-content", ".news-content"],
        },
    ),
    Source(
        "startupnews", "StartupNews.fyi", "https://startupnews.fyi", "https://startupnews.fyi/the-latest/",
        {
            "articles": ".td_module_flex, .td_module_mx_1, article, .post",
            "title": "h3.entry-title a, .td-module-title a, h2.entry-title a",
            "link": "h3.entry-title a, .td-module-title a, h2.entry-title a",
            "content": "div.tdb-block-inner.td-fix-index, .post-content, .entry-content",
        },
        {
            "articles": [".post", ".entry", "article"],
            "content": [".content", ".post-content", "article"],
        },
    ),
    Source(
        "indianstartup", "IndianStartupNews", "https://indianstartupnews.com", "https://indianstartupnews.com/news",
        {
            "articles": "div.small-post",
            "title": "div.post-title",
            "link": "a[href]",
            "content": "div#post-container",
        },
        {
            "articles": [".post", ".news-item", ".entry"],
            "content": [".content", ".post-content", ".news-content"],
        },
    ),
]

REGISTRY_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("base_url", T.StringType()),
    T.StructField("list_url", T.StringType()),
    T.StructField("primary_selectors", T.MapType(T.StringType(), T.StringType())),
    T.StructField("fallback_selectors", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])

# A registry is configuration.  Beyond this it is data and must not be broadcast.
BROADCAST_SOURCES = 10_000


def choose_sources(names: list[str] | None = None, sources: list[Source] = SOURCES) -> list[Source]:
    """Sources by key; unknown names are dropped, and none left means all."""
    picked = [s for s in sources if names and s.key in names]
    return picked or list(sources)


def registry_frame(spark: SparkSession, sources: list[Source] = SOURCES) -> DataFrame:
    rows = [(s.key, s.name, s.host, s.base_url, s.list_url, s.primary, s.fallback) for s in sources]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def lookup_sources(registry: DataFrame, requested: DataFrame, name: str = "name") -> DataFrame:
    """The registry rows a table of requested names asks for; all rows when no name is valid."""
    valid = registry.join(requested.select(F.col(name).alias("key")).distinct(), "key", "left_semi")
    n_valid = valid.agg(F.count("*")).scalar()
    return valid.unionByName(registry.filter(n_valid == 0))


def invalid_sources(requests: DataFrame, valid_names: list[str], column: str = "sources") -> DataFrame:
    """Requests naming unknown sources, with the unknown names."""
    valid = F.array(*[F.lit(v) for v in valid_names])
    return (
        requests.withColumn("invalid_sources", F.array_except(F.col(column), valid))
        .filter(F.size("invalid_sources") > 0)
    )


def with_source(pages: DataFrame, registry: DataFrame, url: str = "url") -> DataFrame:
    """Attach the source whose site a page belongs to; pages of other sites keep NULL."""
    site = registry.select(F.col("host"), F.col("source"), F.col("base_url"), F.col("list_url"))
    if len(site.take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        site = F.broadcast(site)
    return pages.withColumn("host", url_host(url)).join(site, "host", "left")
