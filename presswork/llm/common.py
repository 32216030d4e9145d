"""Helpers shared by the training-data operators."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork.session import fresh_path

#: White space that separates words: space and U+0009 to U+000D.
BLANKS = "\t\n\x0b\x0c\r "
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Rows of whole texts that go to a Python worker at a time.
BATCH_ROWS = 1_000

_kept: dict[str, dict] = {}


def landed(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a table under the shared folder: later reads prune columns,
    and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows in an Arrow batch, fewer if the session says so: executor and worker hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def worker_slot(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator; asking for another's drops it."""
    if owner not in _kept:
        _kept.clear()
        give_back()
        _kept[owner] = {}
    return _kept[owner]


@lru_cache(maxsize=1)
def _trim():
    """The C library's ``malloc_trim``, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers live on from stage to stage, and would hold the most they ever used."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def strings(column, rows: int = 500) -> Iterator[str | None]:
    """The strings of an Arrow column, few of them as Python objects at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
