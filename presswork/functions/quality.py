"""Content quality, confidence and tiers."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fixed
from .text import as_col, text_or_empty


def quality_score(
    title: Column | str,
    content: Column | str,
    description: Column | str = None,
    author: Column | str = None,
    date: Column | str = None,
    image_url: Column | str = None,
) -> Column:
    """Score in [0, 1] from field presence and length.

    The weights are doubles added in this order; the sums are not exact
    hundredths and tier borders depend on that.
    """
    def filled(c):
        return F.lit(False) if c is None else text_or_empty(c) != ""

    title_len, content_len = F.length(text_or_empty(title)), F.length(text_or_empty(content))
    score = F.lit(0.0)
    for rule, weight in (
        (title_len > 0, 0.2),
        (title_len > 10, 0.1),
        (content_len > 100, 0.3),
        (content_len > 500, 0.2),
        (content_len > 1000, 0.1),
        (filled(description), 0.1),
        (filled(author), 0.05),
        (filled(date), 0.05),
        (filled(image_url), 0.1),
    ):
        score = score + F.when(rule, F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(score, F.lit(1.0))


def candidate_quality(c: Column) -> Column:
    """Quality of an article candidate struct."""
    return quality_score(
        c["title"], c["content"], c["description"], c["author"], c["date"], c["image_url"]
    )


def confidence(quality: Column | str) -> Column:
    return F.least(as_col(quality) * F.lit(1.2), F.lit(1.0))


def quality_tier(quality: Column | str, nulls: str = "drop") -> Column:
    """Tier name.  ``nulls``: ``drop`` leaves NULL (reports filter it out),
    ``poor`` counts a missing score as zero."""
    if nulls not in ("drop", "poor"):
        raise ValueError(f"nulls must be 'drop' or 'poor', not {nulls!r}")
    q = as_col(quality)
    tier = F.when(q.isNull(), F.lit(None if nulls == "drop" else fixed.LOWEST_TIER).cast("string"))
    for name, floor in fixed.TIERS:
        tier = tier.when(q >= F.lit(floor), F.lit(name))
    return tier.otherwise(F.lit(fixed.LOWEST_TIER))


def passes_gate(quality: Column | str, floor: float = fixed.MIN_QUALITY) -> Column:
    return as_col(quality) >= F.lit(float(floor))


def export_threshold(quality: Column | str, floor: float) -> Column:
    """Export filter: a missing score counts as zero, and a zero floor keeps all."""
    return F.coalesce(as_col(quality), F.lit(0.0)) >= F.lit(float(floor))
