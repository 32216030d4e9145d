"""Incremental ingest and exact streaming de-duplication."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import highest_before
from ..plans.collect import collect_run, save_run
from ..schemas import ARTICLE
from ..session import durable
from ..sinks.key_index import KeyIndex
from ..sources.registry import SOURCES, Source


def stored_batches(spark, path: str, before: int | None = None) -> DataFrame:
    """Articles of the batches written so far; only those before ``before`` when given.

    A repeated batch must not meet its own first attempt.
    """
    schema = T.StructType([*ARTICLE.fields, T.StructField("batch", T.LongType())])
    try:
        stored = spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], schema)
    return stored if before is None else stored.filter(F.col("batch") < before)


def ingest_pages(
    pages: DataFrame, path: str, checkpoint: str, run_ts, order: str = "page_id",
    sources: Sequence[Source] = SOURCES, near_copies: bool = False, compact_every: int = 50, **trigger,
) -> StreamingQuery:
    """Append new articles of a page stream to ``path``.

    Each micro-batch is a collection run against the keys of what earlier
    batches stored, kept in ``<path>_keys``: no batch reads article folders, and
    of the keys only the buckets it asks for.  A batch overwrites its own
    ``batch=`` folder and keys, so one repeated after a failure stores the same
    rows once.  Every ``compact_every`` batches the keys of older batches are
    folded into one part.  Near copies are compared within a batch only if
    asked for (``near_copies``); titles are remembered over all batches, as the
    stream is one run.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        index = KeyIndex(batch.sparkSession, f"{path.rstrip('/')}_keys")
        run = collect_run(batch, run_ts, order, index, sources, near_copies, stored_keys=("title_hash", "content_fingerprint"), part=batch_id)
        save_run(run, path, batch_id, run_ts, index)
        if batch_id and batch_id % compact_every == 0:
            index.compact(before=batch_id)
            index.forget_old()

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_dedupe(events: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First row per key; a key is remembered for ``delay`` of event time."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp"))   # a watermark needs a zoned timestamp
        .withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark(list(keys))
    )


def mark_late(rows: DataFrame, seq: str, ts: str, delay_s: float, latest_us: int | None = None) -> DataFrame:
    """``late``: whether a row is more than ``delay_s`` older than the newest row that arrived before it.

    Arrival is the order of ``seq``, so the answer does not depend on how rows
    fall into batches; ``latest_us`` is the newest time of earlier batches.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    seen = highest_before(rows, [F.asc(seq)], at, "_newest", F.lit(latest_us).cast("long"))
    late = F.coalesce(at < F.col("_newest") - int(delay_s * 1_000_000), F.lit(False))
    return seen.withColumn("late", late).drop("_newest")


def ingest_events(
    events: DataFrame, path: str, checkpoint: str, keys: Sequence[str], seq: str, ts: str, delay_s: float, compact_every: int = 50, **trigger,
) -> StreamingQuery:
    """Store each event once in ``<path>/events`` and the late ones in ``<path>/late``, where they can be counted.

    Lateness is that of :func:`mark_late`; of equal ``keys`` the row that
    arrived first counts, over all batches (their keys lie in ``<path>/keys``).
    A batch overwrites what it wrote before, so repeating it changes nothing.
    Rows have to arrive in the order of ``seq`` from batch to batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = KeyIndex(spark, f"{path}/keys")
        before = spark.read.parquet(f"{path}/newest/batch={batch_id - 1}").first()["newest"] if batch_id else None
        rows = durable(mark_late(batch.withColumn("_key", F.to_json(F.struct(*keys))), seq, ts, delay_s, before))
        rows.filter("late").drop("late", "_key").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        first = Window.partitionBy("_key").orderBy(seq)
        fresh = index.unseen(rows.filter("NOT late").withColumn("_at", F.row_number().over(first)).filter("_at = 1").drop("_at"), "_key", batch_id)
        fresh.drop("late", "_key").write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
        stored = rows.filter("NOT late").select("_key")
        index.add(stored, batch_id, ["_key"])
        newest = rows.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("own")).select(
            F.greatest("own", F.lit(before).cast("long")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")
        if batch_id and batch_id % compact_every == 0:
            index.compact(before=batch_id)
            index.forget_old()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored_events(spark, path: str, schema, late: bool = False) -> DataFrame:
    """What :func:`ingest_events` stored, or the late rows."""
    return spark.read.schema(schema).parquet(f"{path}/{'late' if late else 'events'}")
