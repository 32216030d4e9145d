"""A table whose rows lie in hash buckets, so that a small batch reads few of them.

Layout: ``gen=<n>/part=<batch>/bucket=<b>``.  A batch writes its own part and,
repeated after a failure, overwrites it.  Compaction writes a new generation and
its base last; Spark's success marker of that base is the switch readers follow,
so a crash before it leaves the old generation in use and loses nothing.  One
writer at a time; readers of the old generation finish undisturbed, and
``forget_old`` removes it when they have.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKETS = 64
#: The part that holds what was compacted.
BASE = -1


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, columns: str, key: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        self.fields = T.StructType.fromDDL(columns)
        self._schema = T.StructType([*self.fields, T.StructField("part", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _exists(self, path: str) -> bool:
        fs, place = self._place(path)
        return fs.exists(place)

    def _numbers(self, path: str, prefix: str) -> list[int]:
        """Numbers of the folders ``<prefix><number>`` in ``path``."""
        fs, place = self._place(path)
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))

    def generation(self) -> int:
        found = self._numbers(self.path, "gen=")
        return max((g for g in found if self._exists(f"{self.path}/gen={g}/part={BASE}/_SUCCESS")), default=0)

    def parts(self) -> list[int]:
        """Numbers of the finished parts in use."""
        root = f"{self.path}/gen={self.generation()}"
        return [p for p in self._numbers(root, "part=") if self._exists(f"{root}/part={p}/_SUCCESS")]

    def bucket(self, *columns: Column | str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def read(self, among: DataFrame | None = None, without: int | None = None) -> DataFrame:
        """All rows, or those in the buckets of the keys in ``among``; not those of part ``without``.

        The buckets are a constant of the plan (at most ``buckets`` numbers), so
        the scan lists only their folders.
        """
        parts = [p for p in self.parts() if p != without]
        if not parts:
            return self.spark.createDataFrame([], self.fields)
        root = f"{self.path}/gen={self.generation()}"
        rows = self.spark.read.schema(self._schema).option("basePath", root).parquet(*[f"{root}/part={p}" for p in parts])
        if among is not None:
            touched = among.select(self.bucket(*self.key).alias("b")).distinct()
            rows = rows.filter(F.col("bucket").isin([r["b"] for r in touched.collect()]))
        return rows.select(*self.fields.fieldNames())

    def _write(self, rows: DataFrame, generation: int, part: int) -> None:
        placed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.fields], self.bucket(*self.key).alias("bucket"))
        (placed.repartition("bucket").sortWithinPartitions("bucket", *self.key)
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/gen={generation}/part={part}"))

    def append(self, rows: DataFrame, part: int) -> None:
        """Rows of a batch; the same batch again replaces them."""
        if part < 0:
            raise ValueError("parts are numbered from 0")
        self._write(rows, self.generation(), part)

    def compact(self, before: int, fold: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Make the parts below ``before`` one, of ``fold`` of their rows; those from there on stay parts, as their batch may yet be repeated."""
        old, parts = self.generation(), self.parts()
        if sum(p < before for p in parts) < 2:
            return
        root = f"{self.path}/gen={old}"
        rows = self.spark.read.schema(self._schema).option("basePath", root).parquet(*[f"{root}/part={p}" for p in parts])
        for part in parts:
            if part >= before:
                self._write(rows.filter(F.col("part") == part), old + 1, part)
        self._write(fold(rows.filter(F.col("part") < before)), old + 1, BASE)

    def forget_old(self) -> None:
        """Remove generations that are no longer in use."""
        now = self.generation()
        for g in self._numbers(self.path, "gen="):
            if g < now:
                fs, place = self._place(f"{self.path}/gen={g}")
                fs.delete(place, True)
