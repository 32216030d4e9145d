"""Reports over stored articles, runs and status logs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import LOWEST_TIER, TIERS
from ..functions.quality import quality_tier
from ..functions.text import as_col


def total_articles(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("total_articles"))


def recent_articles(articles: DataFrame, as_of: Column) -> DataFrame:
    """Articles since midnight of the day before ``as_of`` (so 24 to 48 hours)."""
    since = F.date_sub(F.to_date(as_of), 1).cast("timestamp")
    return articles.filter(F.col("created_at") >= since).agg(F.count("*").alias("articles_last_24h"))


def _shown_average(c: Column) -> Column:
    """Average to three places; missing shows as 0."""
    return F.coalesce(F.round(c, 3), F.lit(0.0))


def source_performance(articles: DataFrame) -> DataFrame:
    return (
        articles.groupBy("source")
        .agg(F.count("*").alias("n_articles"), _shown_average(F.avg("quality_score")).alias("avg_quality"))
        .orderBy(F.desc("n_articles"), "source")
    )


def strategy_performance(articles: DataFrame) -> DataFrame:
    return (
        articles.filter(F.col("extraction_strategy").isNotNull())
        .groupBy(F.col("extraction_strategy").alias("strategy"))
        .agg(F.count("*").alias("n_articles"), F.avg("quality_score").alias("_avg"))
        .orderBy(F.desc("_avg"), "strategy")
        .select("strategy", "n_articles", _shown_average(F.col("_avg")).alias("avg_quality"))
    )


def quality_distribution(articles: DataFrame, nulls: str = "drop") -> DataFrame:
    """Articles per tier.  ``nulls``: ``drop`` or ``poor``."""
    tiers = articles.select(quality_tier("quality_score", nulls).alias("tier"))
    return tiers.filter(F.col("tier").isNotNull()).groupBy("tier").agg(F.count("*").alias("n_articles"))


def quality_columns(articles: DataFrame, nulls: str = "poor") -> DataFrame:
    """The same as one row with a column per tier, zeros included."""
    tier = quality_tier("quality_score", nulls)
    names = [t for t, _ in TIERS] + [LOWEST_TIER]
    return articles.agg(*[F.count_if(tier == n).alias(n) for n in names])


def _share(df: DataFrame, key: Column, name: str) -> DataFrame:
    counts = df.groupBy(key.alias(name)).agg(F.count("*").alias("n_articles"))
    return (
        counts.withColumn("share_pct", F.col("n_articles") / df.agg(F.count("*")).scalar() * 100)
        .orderBy(F.desc("n_articles"), name)
    )


def source_share(articles: DataFrame) -> DataFrame:
    return _share(articles, F.coalesce("source", F.lit("Unknown")), "source")


def source_columns(articles: DataFrame, names: list[str]) -> DataFrame:
    """One row with a count per named source."""
    return articles.agg(*[F.count_if(F.col("source") == n).alias(n) for n in names])


def strategy_share(articles: DataFrame) -> DataFrame:
    """Share of each strategy in *all* articles; articles without one are not listed."""
    counts = articles.groupBy(F.col("extraction_strategy").alias("strategy")).agg(F.count("*").alias("n_articles"))
    return (
        counts.withColumn("share_pct", F.col("n_articles") / articles.agg(F.count("*")).scalar() * 100)
        .filter(F.col("strategy").isNotNull())
        .orderBy(F.desc("n_articles"), "strategy")
    )


def quality_stats(articles: DataFrame) -> DataFrame:
    q = F.col("quality_score")
    return articles.agg(F.avg(q).alias("avg_quality"), F.max(q).alias("max_quality"), F.min(q).alias("min_quality"))


def length_stats(articles: DataFrame) -> DataFrame:
    n = F.coalesce(F.length("content"), F.lit(0))
    return articles.agg(F.avg(n).alias("avg_length"), F.sum(n).alias("total_length"))


def sample_article(articles: DataFrame, order: list[Column]) -> DataFrame:
    """The first article as shown in a run summary."""
    return articles.orderBy(*order).limit(1).select(
        F.concat(F.substring(F.coalesce("title", F.lit("N/A")), 1, 80), F.lit("...")).alias("title"),
        "source", "quality_score", F.col("extraction_strategy").alias("strategy"),
    )


def strategy_means(extractions: DataFrame) -> DataFrame:
    """Mean quality per host and strategy."""
    return extractions.groupBy("host", F.col("extraction_strategy").alias("strategy")).agg(
        F.avg("quality_score").alias("mean_quality"), F.count("*").alias("n_pages"))


# ------------------------------------------------------------------ runs

def run_rate(runs: DataFrame) -> DataFrame:
    """Articles per minute of each run; NULL for a run without duration."""
    return runs.select(
        "run_id", (F.try_divide(F.col("articles_found"), F.col("runtime_seconds")) * 60).alias("articles_per_minute"))


def run_totals(outcomes: DataFrame) -> DataFrame:
    """Found, new, duplicate and failed counts of one run, from one row per attempted page.

    Found and new are the same number: both count what the sources returned.
    """
    kept = F.col("outcome") == "kept"
    return outcomes.agg(
        F.count_if(kept).alias("articles_found"), F.count_if(kept).alias("new_articles"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return (
        runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)
        .select("run_id", "articles_found", "new_articles", "duplicates",
                F.round("runtime_seconds", 1).alias("runtime"), "created_at")
    )


def mean_run_time(runs: DataFrame, n: int = 100) -> DataFrame:
    """Mean over the newest ``n`` runs; a missing run time counts as zero."""
    newest = runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)
    return newest.agg(F.avg(F.coalesce("runtime_seconds", F.lit(0.0))).alias("mean_runtime"))


def latest_status(log: DataFrame, tie: str | None = None) -> DataFrame:
    """Last status of each execution with its details."""
    order = F.struct("updated_at", *([tie] if tie else []))
    return (
        log.groupBy("execution_id")
        .agg(F.max_by(F.struct("status", "details", "updated_at"), order).alias("last"))
        .select("execution_id", "last.status", "last.details", "last.updated_at")
    )


def with_details(status: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Spread JSON details into columns (``name -> type``); bad JSON gives NULLs."""
    parsed = F.try_parse_json("details")
    return status.select("*", *[F.try_variant_get(parsed, f"$.{k}", t).alias(k) for k, t in fields.items()])


# ------------------------------------------------------------- dashboard

def dashboard(articles: DataFrame, runs: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """All dashboard parts by name."""
    return {
        "total_articles": total_articles(articles),
        "articles_last_24h": recent_articles(articles, as_of),
        "source_performance": source_performance(articles),
        "extraction_strategies": strategy_performance(articles),
        "quality_distribution": quality_distribution(articles),
        "recent_runs": recent_runs(runs),
    }


def dashboard_rows(articles: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """The dashboard as one long table: part, name, count, value.

    The article parts come from a single scan: one aggregation by source,
    strategy, tier and recency, small enough to be re-aggregated five ways.
    """
    since = F.date_sub(F.to_date(as_of), 1).cast("timestamp")
    cube = articles.groupBy(
        "source", "extraction_strategy", quality_tier("quality_score").alias("tier"),
        (F.col("created_at") >= since).alias("recent"),
    ).agg(F.count("*").alias("n"), F.count("quality_score").alias("n_q"), F.sum("quality_score").alias("sum_q"))

    # grouping_id over (source, strategy, tier): which part a row belongs to.
    sets = cube.groupingSets(
        [[F.col("source")], [F.col("extraction_strategy")], [F.col("tier")], []],
        F.col("source"), F.col("extraction_strategy"), F.col("tier"),
    ).agg(
        F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.sum("n_q").alias("n_q"), F.sum("sum_q").alias("sum_q"),
        F.sum(F.when(F.col("recent"), F.col("n")).otherwise(0)).alias("n_recent"),
    )
    mean = F.when(F.col("n_q") > 0, F.col("sum_q") / F.col("n_q"))
    article_rows = sets.select(F.explode(F.when(F.col("gid") == 7, F.array(
        F.struct(F.lit("total_articles").alias("part"), F.lit("").alias("name"), F.col("n").alias("n"), F.lit(None).cast("double").alias("value")),
        F.struct(F.lit("articles_last_24h").alias("part"), F.lit("").alias("name"), F.col("n_recent").alias("n"), F.lit(None).cast("double").alias("value")),
    )).when(F.col("gid") == 3, F.array(
        F.struct(F.lit("source_performance").alias("part"), F.col("source").alias("name"), F.col("n").alias("n"), _shown_average(mean).alias("value")),
    )).when((F.col("gid") == 5) & F.col("extraction_strategy").isNotNull(), F.array(
        F.struct(F.lit("extraction_strategies").alias("part"), F.col("extraction_strategy").alias("name"), F.col("n").alias("n"), _shown_average(mean).alias("value")),
    )).when((F.col("gid") == 6) & F.col("tier").isNotNull(), F.array(
        F.struct(F.lit("quality_distribution").alias("part"), F.col("tier").alias("name"), F.col("n").alias("n"), F.lit(None).cast("double").alias("value")),
    ))).alias("row")).select("row.*")
    run_rows = recent_runs(runs).select(
        F.lit("recent_runs").alias("part"), F.col("run_id").alias("name"), F.col("articles_found").alias("n"),
        F.col("runtime").alias("value"))
    return article_rows.unionByName(run_rows)
