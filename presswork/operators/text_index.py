"""A stored inverted index of TF-IDF vectors, so that a run meets near copies of what earlier runs stored.

Document frequencies are fitted once and kept (``fit``); later texts are weighed
by them, terms unknown then counting as rarest.  So all vectors, stored and new,
share one set of weights and one order of terms, and nothing is fitted again
until ``rebuild``.  Postings hold only prefix terms (rarest first, until the
rest is shorter than the threshold): two vectors above it share one.  A batch
reads the buckets of its own prefix terms, then the vectors of the candidates
alone, and checks them exactly.

In groups of fewer than ``FEW`` texts no term counts as too common.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.fixed_values import SIMILARITY_THRESHOLD
from ..session import durable
from ..sinks.buckets import BUCKETS, BucketTable
from .tfidf import grams

FEW = 20


class TextIndex:
    """``texts`` are always (key, grp, text); keys are kept as strings."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = SIMILARITY_THRESHOLD, stop_words: Sequence[str] = (),
                 longest: int = 3, max_df: float = 0.95, buckets: int = BUCKETS):
        self.spark, self.path, self.threshold, self.stop_words = spark, path.rstrip("/"), threshold, tuple(stop_words)
        self.longest, self.max_df, self.buckets = longest, max_df, buckets
        #: Marks a finished fit.
        self._fits = BucketTable(spark, f"{self.path}/fits", "fit long", ["fit"], 1)

    def version(self) -> int | None:
        """Number of the fit in use."""
        return max((p for p in self._fits.parts() if p >= 0), default=None)

    def _table(self, name: str, columns: str, key: Sequence[str], version: int | None) -> BucketTable:
        return BucketTable(self.spark, f"{self.path}/fit={version or 0}/{name}", columns, key, self.buckets)

    def _terms(self, version: int | None) -> BucketTable:
        return self._table("terms", "grp string, term string, df long, n long", ["grp", "term"], version)

    def _postings(self, version: int | None) -> BucketTable:
        return self._table("postings", "grp string, term string, key string", ["grp", "term"], version)

    def _vectors(self, version: int | None) -> BucketTable:
        return self._table("vectors", "grp string, key string, term string, weight double", ["key"], version)

    def _counted(self, texts: DataFrame) -> DataFrame:
        rows = texts.select(F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), F.col("key").cast("string").alias("key"), "text")
        return rows.select("grp", "key", F.explode(grams(F.col("text"), self.stop_words, self.longest)).alias("term")).groupBy(
            "grp", "key", "term").agg(F.count("*").alias("tf"))

    def _fit(self, texts: DataFrame, version: int) -> None:
        sizes = texts.groupBy(F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp")).agg(F.count("*").alias("n"))
        found = self._counted(texts).groupBy("grp", "term").agg(F.count("*").alias("df")).join(sizes, "grp")
        # A row without a term has the size of a group.
        self._terms(version).append(found.unionByName(sizes.select("grp", F.lit("").alias("term"), F.lit(0).alias("df"), "n")), 0)

    def fit(self, texts: DataFrame) -> None:
        """Take the document frequencies from ``texts``, unless there is a fit already."""
        if self.version() is None:
            self._fit(texts, 0)
            self._fits.append(self.spark.range(1).select(F.col("id").alias("fit")), 0)

    def weigh(self, texts: DataFrame, version: int | None = None) -> DataFrame:
        """Unit vectors (grp, key, term, weight, in_prefix) by the stored frequencies."""
        version = self.version() if version is None else version
        tf = durable(self._counted(texts))
        # Only the buckets of the texts' own terms are read, and those that hold the groups' sizes.
        known = self._terms(version).read(tf.select("grp", "term").union(tf.select("grp", F.lit(""))))
        sizes = known.filter("term = ''").select("grp", "n")
        rows = (
            tf.join(known.filter("term <> ''").select("grp", "term", "df"), ["grp", "term"], "left").join(sizes, "grp", "left")
            .select("grp", "key", "term", "tf", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("n", F.lit(0)).alias("n"))
            .filter((F.col("df") <= self.max_df * F.col("n")) | (F.col("df") < FEW))
            .withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0))
        )
        own = Window.partitionBy("grp", "key")
        unit = rows.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own)))
        rest = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(own.orderBy(F.desc("df"), F.asc("term"))))
        return unit.select("grp", "key", "term", "weight", (rest >= self.threshold - 1e-9).alias("in_prefix"))

    def add(self, weighed: DataFrame, part: int, version: int | None = None) -> None:
        """Store the vectors of a batch; the same batch again replaces them."""
        version = self.version() if version is None else version
        self._vectors(version).append(weighed, part)
        self._postings(version).append(weighed.filter("in_prefix"), part)

    def matches(self, weighed: DataFrame, without: int | None = None) -> DataFrame:
        """(key, matched, similarity): the most similar stored text above the threshold, the smaller key on a tie."""
        version = self.version()
        asked = weighed.filter("in_prefix").select("grp", "term", F.col("key").alias("asked"))
        candidates = durable(asked.join(self._postings(version).read(asked, without), ["grp", "term"]).select("grp", "asked", "key").distinct())
        stored = self._vectors(version).read(candidates, without).join(candidates.select("grp", "key").distinct(), ["grp", "key"], "left_semi")
        dots = (
            candidates.join(weighed.select("grp", F.col("key").alias("asked"), "term", F.col("weight").alias("a")), ["grp", "asked"])
            .join(stored.select("grp", "key", "term", F.col("weight").alias("b")), ["grp", "key", "term"])
            .groupBy("asked", "key").agg(F.sum(F.col("a") * F.col("b")).alias("similarity"))
            .filter(F.col("similarity") > F.lit(float(self.threshold)))
        )
        best = F.min(F.struct((-F.col("similarity")).alias("minus"), F.col("key").alias("matched"))).alias("best")
        return dots.groupBy("asked").agg(best).select(
            F.col("asked").alias("key"), F.col("best.matched").alias("matched"), (-F.col("best.minus")).alias("similarity"))

    def rebuild(self, texts: DataFrame, part: int = 0) -> None:
        """Fit anew on all stored ``texts`` and store their vectors; the new fit is used once everything is written."""
        version = (self.version() or 0) + 1
        self._fit(texts, version)
        self.add(durable(self.weigh(texts, version)), part, version)
        self._fits.append(self.spark.range(1).select(F.lit(version).alias("fit")), version)
