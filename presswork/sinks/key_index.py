"""Stored keys as a narrow table in hash buckets: a batch meets the buckets of its own keys, not the article store."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .buckets import BUCKETS, BucketTable


class KeyIndex(BucketTable):
    """Rows (kind, hash): 128-bit hashes of the key values that stored articles have.  A NULL key is not stored and not found."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        super().__init__(spark, path, "kind string, hash binary", ["hash"], buckets)

    @staticmethod
    def _hash(kind: str, value: Column | str) -> Column:
        return F.unhex(F.md5(F.concat(F.lit(f"{kind}\x00"), F.col(value).cast("string") if isinstance(value, str) else value)))

    def add(self, articles: DataFrame, part: int, keys: Sequence[str]) -> None:
        """The keys of a batch's articles."""
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), self._hash(k, k).alias("hash")) for k in keys]))
        self.append(articles.select(pairs.alias("x")).select("x.*").filter("hash IS NOT NULL").distinct(), part)

    def unseen(self, df: DataFrame, key: str, without: int | None = None) -> DataFrame:
        """Rows whose ``key`` no stored article has; part ``without``, a batch's own first attempt, does not count."""
        wanted = df.select(self._hash(key, key).alias("hash")).filter("hash IS NOT NULL").distinct()
        hits = self.read(wanted, without).filter(F.col("kind") == key).join(wanted, "hash", "left_semi").select(F.col("hash").alias("_hash")).distinct()
        return df.join(hits, self._hash(key, key) == F.col("_hash"), "left_anti")
