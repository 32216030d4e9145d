"""Cosine of embedding columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import SIMILARITY_THRESHOLD
from ..functions.text import bind, once


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def unit(vector: Column | str) -> Column:
    """The vector as doubles of length one; a zero vector stays zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return bind(F.sqrt(_dot(v, v)), lambda norm: F.transform(
        v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0))))


def cosine(a: Column | str, b: Column | str) -> Column:
    return _dot(unit(a), unit(b))


def first_stored_match(
    df: DataFrame, stored: DataFrame, key: str, vector: str, group: str, rank: str = "recency",
    threshold: float = SIMILARITY_THRESHOLD,
) -> DataFrame:
    """For every row the first stored row of its group above the threshold.

    ``stored`` is a bounded comparison set ranked by ``rank``; all its vectors
    of a group form one small array, sent to every row of the group.  Work per
    row is fixed, so a large group is only more rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(group).alias("grp"), F.col(vector).alias("_vec"))
    rows = rows.withColumn("u", unit("_vec")).drop("_vec")
    side = (
        stored.select(F.col(group).alias("grp"), F.col(rank).alias("rank"), F.col(key).alias("matched"),
                      F.col(vector).alias("_vec"))
        .withColumn("v", unit("_vec")).drop("_vec")
        .groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("rank", "matched", "v"))).alias("others"))
    )
    scored = rows.join(side, "grp").select(
        "key", "grp",
        F.transform("others", lambda o: F.struct(
            o["matched"].alias("matched"), _dot(F.col("u"), o["v"]).alias("similarity"))).alias("scored"),
    )
    hit = F.get(F.filter("scored", lambda s: (s["similarity"] > F.lit(float(threshold))) & (s["matched"] != F.col("key"))), F.lit(0))
    return (
        scored.select("key", "grp", once(hit).alias("hit")).filter(F.col("hit").isNotNull())
        .select(F.col("grp").alias(group), F.col("key").alias(key), F.col("hit.matched").alias("matched"),
                F.col("hit.similarity").alias("similarity"))
    )
