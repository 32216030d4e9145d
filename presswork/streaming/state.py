"""Per-key state machines over streams: source health, admission, run status.

State is a few numbers per key.  Rows of one micro-batch are put in time order
before the step sees them; across batches a row older than what was already
processed for its key is late and is emitted as ``late``, not applied.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.health import admission_step, breaker_step, micros
from ..operators.reports import latest_status
from ..sinks.buckets import BucketTable


class _Ordered(StatefulProcessor):
    """Collects one key's rows of a micro-batch, orders them and steps through."""

    key_name = "key"

    def rows_in_order(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")

    def close(self) -> None:
        pass


class Admission(_Ordered):
    """Admit fewer than ``limit`` per window; remembers the admissions still inside it."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Admissions older than the window are dropped by the step itself.
        self.seen = handle.getValueState("seen", "latest long, admitted array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest, kept = self.seen.get() if self.seen.exists() else (-1, [])
        admitted, step = deque(kept), admission_step(self.limit, self.window_us)
        out = []
        for at, event_id in self.rows_in_order(rows)[["at", "event_id"]].itertuples(index=False):
            late = at < latest
            ok = False if late else step(admitted, int(at))[0]
            latest = max(latest, int(at))
            out.append((key[0], int(at), int(event_id), ok, late))
        self.seen.update((latest, list(admitted)))
        yield pd.DataFrame(out, columns=["client_id", "at", "event_id", "admitted", "late"])


class Health(_Ordered):
    """Breaker state and success rate of a source after each attempt."""

    def __init__(self, threshold: int, recovery_us: int):
        self.threshold, self.recovery_us = threshold, recovery_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState(
            "health", "latest long, name string, failures int, last long, rate double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest, name, failures, last, rate = (
            self.saved.get() if self.saved.exists() else (-1, "CLOSED", 0, -1, 1.0))
        state, step = [name, failures, None if last < 0 else last], breaker_step(self.threshold, self.recovery_us)
        out = []
        for at, event_id, ok, n in self.rows_in_order(rows)[["at", "event_id", "ok", "n_articles"]].itertuples(index=False):
            if at < latest:
                out.append((key[0], int(at), int(event_id), "late", state[0], state[1], rate))
                continue
            latest = int(at)
            action, name, failures = step(state, int(at), bool(ok))
            if ok:
                rate = min(rate * 0.9 + 0.1, 1.0) if n > 0 else rate * 0.95
            out.append((key[0], int(at), int(event_id), action, name, failures, rate))
        self.saved.update((latest, state[0], state[1], -1 if state[2] is None else state[2], rate))
        yield pd.DataFrame(out, columns=[
            "source", "at", "event_id", "action", "state", "failure_count", "success_rate"])


def _run(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return (
        df.withColumn("at", micros("ts")).groupBy(key)
        .transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="None")
        .withColumn("ts", F.timestamp_micros("at")).drop("at")
    )


def stream_admissions(requests: DataFrame, limit: int = 3, window_s: float = 3600) -> DataFrame:
    """Streaming form of :func:`presswork.operators.health.admission_audit`."""
    return _run(requests, "client_id", Admission(limit, int(window_s * 1_000_000)),
                "client_id string, at long, event_id long, admitted boolean, late boolean")


def stream_health(log: DataFrame, threshold: int = 5, recovery_s: float = 300) -> DataFrame:
    """Streaming form of the breaker replay and the success rate.

    A stream tries whatever arrives, so the rate counts every success, as in
    :func:`presswork.operators.health.success_rate`.
    """
    return _run(log, "source", Health(threshold, int(recovery_s * 1_000_000)),
                "source string, at long, event_id long, action string, state string, "
                "failure_count int, success_rate double")


class StatusLog(BucketTable):
    """Status changes of executions.  Folding keeps the last of each, so reading costs the same after any number of batches."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "execution_id string, status string, details string, updated_at timestamp, tie long", ["execution_id"])

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("status", "details", "updated_at", "tie"), F.struct("updated_at", "tie")).alias("last")
        return rows.groupBy("execution_id").agg(last).select("execution_id", "last.*")

    def append(self, rows: DataFrame, part: int) -> None:
        super().append(self._last(rows), part)

    def fold(self, before: int) -> None:
        self.compact(before, self._last)
        self.forget_old()

    def latest(self, executions: DataFrame | None = None) -> DataFrame:
        """Last status of all executions, or of those in the buckets of ``executions`` (execution_id)."""
        return latest_status(self.read(executions), "tie")


def status_writer(path: str, fold_every: int = 50) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that stores the last status per execution of each batch.

    A batch's own part is overwritten, so repeating it is harmless; every
    ``fold_every`` batches the older ones are folded into one.  Among equal
    times the highest ``event_id`` is the last, where there is one.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        log = StatusLog(batch.sparkSession, path)
        tie = F.col("event_id") if "event_id" in batch.columns else F.lit(0)
        log.append(batch.withColumn("tie", tie.cast("long")), batch_id)
        if batch_id and batch_id % fold_every == 0:
            log.fold(batch_id)

    return write


def stored_status(spark: SparkSession, path: str) -> DataFrame:
    return StatusLog(spark, path).latest()
