"""Source health and admission, replayed from logs.

``success_rate`` and ``trailing_requests`` are plain aggregations.  The
breaker and the admission rule depend on their own earlier decisions, so rows
of one stretch are read in order; stretches start where the past cannot
matter any more and are spread over the cluster.  Inside a stretch the state
is a few numbers, and rows stream through: no group is held in memory.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .windows import in_ranges, last_marked, previous_value, running_total

DAY_US = 86_400_000_000


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def _day(order: Column) -> Column:
    return F.floor(order / F.lit(DAY_US)).cast("long")


# ---------------------------------------------------------------- W4

def success_rate(log: DataFrame, source: str = "source", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Success rate per source after its whole log.

    Starts at 1.  A success with rows gives ``0.9 r + 0.1``, one without rows
    ``0.95 r``; failures leave it.  Unrolled, every success with rows adds
    ``0.1`` times the factors of the successes after it, so counting what
    comes after each row is enough: a sum, not a fold.
    """
    at = micros(ts)
    wins = log.filter("ok").select(
        source, at.alias("at"), F.col(tie).alias("tie"),
        (F.col("n_articles") > 0).cast("long").alias("full"), (F.col("n_articles") <= 0).cast("long").alias("empty"),
    )
    newest_first = [F.desc("at"), F.desc("tie")]
    wins = in_ranges(wins, [source], newest_first)
    wins = running_total(wins, [source], newest_first, F.col("full"), "full_after", before=True)
    wins = running_total(wins, [source], newest_first, F.col("empty"), "empty_after", before=True)
    part = F.lit(0.1) * F.col("full") * F.pow(F.lit(0.9), "full_after") * F.pow(F.lit(0.95), "empty_after")
    rates = wins.groupBy(source).agg(
        (F.pow(F.lit(0.9), F.sum("full")) * F.pow(F.lit(0.95), F.sum("empty")) + F.sum(part)).alias("rate")
    )
    # Sources without a success keep the starting rate.
    return log.select(source).distinct().join(rates, source, "left").select(
        source, F.coalesce("rate", F.lit(1.0)).alias("success_rate"))


# ------------------------------------------------------- failure streaks

def failure_streaks(log: DataFrame, source: str = "source", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Runs of failures without a success between them: source, length, first and last time.

    Failures with equally many successes before them are one run, so a
    running count over ranges and one aggregation find all of them.
    """
    at = micros(ts)
    rows = log.select(source, ts, at.alias("at"), F.col(tie).alias("tie"), F.col("ok").cast("long").alias("won"))
    counted = running_total(rows, [source], [F.asc("at"), F.asc("tie")], F.col("won"), "wins_before", before=True)
    return counted.filter("won = 0").groupBy(source, "wins_before").agg(
        F.count(F.lit(1)).alias("n_failures"), F.min(ts).alias("started_at"), F.max(ts).alias("ended_at")).drop("wins_before")


# ------------------------------------------------------- ordered replay

def _stretches(df: DataFrame, key: str, ts: str, tie: str, reset: Callable[[Column, Column], Column]) -> DataFrame:
    """Add ``at`` (µs) and ``stretch``.  ``reset(at, previous_at)`` marks rows
    whose outcome, and all after it, does not depend on the rows before."""
    df = df.withColumn("at", micros(ts))
    order = F.struct(F.col("at"), F.col(tie))
    df = previous_value(df, [key], order, _day(F.col("at")), F.col("at"), "_prev")
    fresh = F.col("_prev").isNull() | F.coalesce(reset(F.col("at"), F.col("_prev")), F.lit(False))
    return last_marked(df, [key], order, _day(F.col("at")), fresh, "stretch").drop("_prev")


def _replay(df: DataFrame, key: str, tie: str, columns: Sequence[str], out_schema: str, new_state, step) -> DataFrame:
    """Run ``step(state, *columns) -> output tuple`` over each stretch in order."""
    ready = (
        df.select(key, "stretch", "at", F.col(tie).alias("_tie"), *columns)
        .repartition(key, "stretch")
        .sortWithinPartitions(key, "stretch", "at", "_tie")
        .select(key, F.col("stretch.at").alias("_from"), F.col(f"stretch.{tie}").alias("_from_tie"), "at", "_tie", *columns)
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, None
        for pdf in frames:
            out = []
            names = zip(pdf[key], pdf["_from"], pdf["_from_tie"])
            for name, row in zip(names, pdf[["at", *columns]].itertuples(index=False, name=None)):
                if name != here:
                    here, state = name, new_state()
                out.append(step(state, *row))
            result = pd.DataFrame(out, columns=out_names)
            yield pd.concat([pdf[[key, "at", "_tie"]].reset_index(drop=True), result], axis=1)

    out_names = [c.split()[0] for c in out_schema.split(",")]
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    schema = f"{key} {kinds[key]}, at long, _tie {kinds['_tie']}, {out_schema}"
    return ready.mapInPandas(run, schema).select(
        key, F.timestamp_micros("at").alias("ts"), F.col("_tie").alias(tie), *out_names)


# ---------------------------------------------------------------- W5

def breaker_step(threshold: int, recovery_us: int):
    """One event of a circuit breaker; the state is [name, failures, last failure]."""
    def step(state, at, ok):
        name, failures, last = state
        if name == "OPEN":
            if last is not None and at - last <= recovery_us:
                return "skip", name, failures
            name = "HALF_OPEN"
        if ok:
            name, failures = "CLOSED", 0
        else:
            failures, last = failures + 1, at
            # The count survives the half-open try, so one more failure reopens.
            if failures >= threshold:
                name = "OPEN"
        state[:] = [name, failures, last]
        return "try", name, failures

    return step


def breaker_replay(
    log: DataFrame, source: str = "source", ts: str = "ts", tie: str = "event_id",
    threshold: int = 5, recovery_s: float = 300,
) -> DataFrame:
    """Circuit breaker per source over its log: ``action``, ``state`` and ``failure_count`` per event.

    A success more than the recovery time after the event before it is tried
    in any state and closes the breaker, so it starts a stretch.
    """
    wait = int(recovery_s * 1_000_000)
    marked = _stretches(log, source, ts, tie, lambda at, prev: F.col("ok") & (at - prev > wait))
    return _replay(marked, source, tie, ["ok"], "action string, state string, failure_count int",
                   lambda: ["CLOSED", 0, None], breaker_step(threshold, wait))


# ---------------------------------------------------------------- W7

def admission_step(limit: int, window_us: int):
    """Admit while fewer than ``limit`` admissions lie inside the window."""
    def step(admitted, at):
        while admitted and at - admitted[0] >= window_us:
            admitted.popleft()
        if len(admitted) >= limit:
            return (False,)
        admitted.append(at)
        return (True,)

    return step


def admission_audit(
    requests: DataFrame, client: str = "client_id", ts: str = "ts", tie: str = "event_id",
    limit: int = 3, window_s: float = 3600,
) -> DataFrame:
    """Per request whether it was admitted.  Rejected requests do not count.

    A request a full window after the one before it finds no admission in its
    window, so it starts a stretch.
    """
    window = int(window_s * 1_000_000)
    marked = _stretches(requests, client, ts, tie, lambda at, prev: at - prev >= window)
    return _replay(marked, client, tie, [], "admitted boolean", deque, admission_step(limit, window))


def trailing_requests(
    requests: DataFrame, client: str = "client_id", ts: str = "ts", window_s: float = 3600,
) -> DataFrame:
    """Requests per client in the window up to and including each request time.

    Every request enters at its time and leaves one window later; the count is
    a running sum of both, which is split into ranges for busy clients.  (A
    sliding window frame would hold and re-read a client's whole window.)
    """
    window = int(window_s * 1_000_000)
    per_ts = requests.groupBy(F.col(client), micros(ts).alias("at")).agg(F.count("*").alias("n"))
    moves = per_ts.select(client, "at", F.col("n").alias("change"), F.lit(True).alias("arrival")).unionByName(
        per_ts.select(client, (F.col("at") + window).alias("at"), (-F.col("n")).alias("change"), F.lit(False).alias("arrival"))
    )
    counted = running_total(moves, [client], [F.asc("at"), F.asc("arrival")], F.col("change"), "n_trailing")
    return counted.filter("arrival").select(
        client, F.timestamp_micros("at").alias("ts"), F.col("change").alias("n_requests"), "n_trailing")


# ---------------------------------------------------------------- W6

def trimmed_history(
    extractions: DataFrame, host: str = "host", order: str = "page_id", longest: int = 100, keep: int = 50,
) -> DataFrame:
    """What a host's history holds at the end: past 100 entries it is cut to the newest 50.

    The length follows from the count alone (a saw-tooth), so only the newest
    100 rows per host are ranked.
    """
    from ..sources.pages import top_rows

    n = F.col("_n")
    left = F.when(n <= longest, n).otherwise(F.lit(keep) + F.pmod(n - longest - 1, F.lit(longest - keep + 1)))
    sizes = extractions.groupBy(host).agg(F.count("*").alias("_n")).select(host, left.alias("_left"))
    newest = top_rows(extractions, [host], [F.desc(order)], longest, rank="_recency")
    return newest.join(sizes, host).filter(F.col("_recency") <= F.col("_left")).drop("_recency", "_left")
