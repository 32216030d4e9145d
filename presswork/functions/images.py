"""Image scoring and choice."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fixed
from .text import bind, contains_any
from .urls import resolve_image


def image_score(src: Column | str, base_url: Column | str) -> Column:
    """Sum of the word rules, never below zero.  Terms are added in rule order
    because the result is a double."""
    def score(url):
        total = F.lit(0.0)
        for words, weight in (
            (fixed.IMAGE_SIZE_WORDS, 0.3),
            (fixed.IMAGE_STORY_WORDS, 0.4),
            (fixed.IMAGE_CHROME_WORDS, -0.5),
            (fixed.IMAGE_EXTENSIONS, 0.2),
        ):
            total = total + F.when(contains_any(url, words), F.lit(weight)).otherwise(F.lit(0.0))
        return F.greatest(F.lit(0.0), total)

    return bind(F.lower(resolve_image(src, base_url)), score)


def best_image(sources: Column | str, base_url: Column | str) -> Column:
    """First source with the strictly highest score above zero, as written; else ``''``."""
    sources = F.col(sources) if isinstance(sources, str) else sources
    scored = F.transform(
        sources, lambda s: F.struct(image_score(s, base_url).alias("score"), s.alias("src"))
    )
    return F.aggregate(
        scored,
        F.struct(F.lit(0.0).alias("score"), F.lit("").alias("src")),
        lambda best, x: F.when(x["score"] > best["score"], x).otherwise(best),
        lambda best: best["src"],
    )
