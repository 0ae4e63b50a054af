"""Usage streams: daily quotas by event time and lockouts by keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..catalog import register
from ..plans.service import DAILY_LIMIT
from ..storage import checkpointed

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def daily_usage(events: DataFrame, limit: int = DAILY_LIMIT, late: str = "1 day") -> DataFrame:
    """user_id, day, used, remaining, exceeded; days close when the watermark passes them, later events are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("used"))
    return counted.select(
        "user_id", F.to_date("window.start").cast("string").alias("day"), "used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).alias("remaining"), (F.col("used") > limit).alias("exceeded")
    )


def _micros(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).value // 1000)


def _moments(frames: Iterator[pd.DataFrame]) -> dict[str, list[int]]:
    """A user's times in microseconds, in order, by kind of event; events of one kind and time are alike."""
    kinds, times = [], []
    for f in frames:
        kinds.append(f["event_type"].to_numpy(dtype=object))
        times.append(f["ts"].to_numpy().astype("datetime64[us]").astype(np.int64))
    found: dict[str, list[int]] = {}
    for kind, now in zip(np.concatenate(kinds).tolist(), np.concatenate(times).tolist()):
        found.setdefault(kind, []).append(now)
    return {kind: sorted(moments) for kind, moments in found.items()}


def _until(state: GroupState, micros: int) -> None:
    """A timer of event time, in whole milliseconds after the moment; one that the watermark has passed fires at once."""
    state.setTimeoutTimestamp(max(micros // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def lockouts(events: DataFrame, most: int = 5, seconds: int = 900, ttl: int = 86_400, late: str = "1 hour") -> DataFrame:
    """user_id, locked_at, locked_until: ``most`` failures in a row lock a user; a success, or ``ttl`` seconds without an event, resets the count.

    State is two numbers a user, and a timer frees it ``ttl`` after the last failure, so only users of late are kept. Whether
    a count has run out is decided by the events' own times, so the result doesn't depend on when timers fire. Events of a
    micro-batch are taken in order of time and id.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            failures, last = state.get if state.exists else (0, 0)
            for event_type, ts in pd.concat(list(frames)).sort_values(["ts", "event_id"])[["event_type", "ts"]].itertuples(index=False):
                if failures and _micros(ts) - last > ttl * 1_000_000:
                    failures = 0
                failures, last = 0 if event_type == "click" else failures + 1, _micros(ts)
                if failures == most:
                    out.append((key[0], ts, ts + pd.Timedelta(seconds=seconds)))
            if failures:
                state.update((failures, last))
                _until(state, last + ttl * 1_000_000)
            elif state.exists:
                state.remove()  # nothing to remember of a user whose last event was a success
        if out:
            yield pd.DataFrame(out, columns=["user_id", "locked_at", "locked_until"])

    watched = events.withWatermark("ts", late)
    return watched.groupBy("user_id").applyInPandasWithState(step, "user_id long, locked_at timestamp, locked_until timestamp", "failures long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give back its output, from the shared folder."""
    spark = stream.sparkSession
    checkpointed(spark.range(1).toDF("x"))  # sees to it that a shared folder is set
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:  # every batch's changed rows, in a folder of its own: a batch that is run again replaces its rows
        keep = lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", "long")).parquet(f"{base}/out")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*")


@register(
    "stream_quota_daily",
    f"SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS used, greatest({DAILY_LIMIT} - count(*), 0) AS remaining, count(*) > {DAILY_LIMIT} AS exceeded FROM events GROUP BY 1, 2",
)
def stream_quota_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In update mode only changed days are written, and the watermark frees closed days' state; the last version counts."""
    rows = run_available(daily_usage(stream(spark, sf_dir)), "update")
    return rows.groupBy("user_id", "day").agg(*[F.max_by(c, "batch").alias(c) for c in ("used", "remaining", "exceeded")])


@register(
    "stream_lockout",
    """WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400000000, true) AS late FROM events),
f AS (SELECT *, sum(CASE WHEN late OR event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g),
c AS (SELECT *, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS failures FROM f)
SELECT user_id, CAST(ts AS VARCHAR) AS locked_at, CAST(ts + INTERVAL 900 SECOND AS VARCHAR) AS locked_until FROM c WHERE failures = 5 AND event_type <> 'click'""",
)
def stream_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts run out after a day; the data have thirty."""
    rows = run_available(lockouts(stream(spark, sf_dir)))
    return rows.select("user_id", F.col("locked_at").cast("string").alias("locked_at"), F.col("locked_until").cast("string").alias("locked_until"))


def one_time(events: DataFrame, ttl: int = 3 * 86_400, late: str = "1 hour") -> DataFrame:
    """user_id, event_type, moment, outcome of tokens (a user's kind of event).

    A token's first event issues it; within ``ttl`` seconds the next one is accepted and others are reused. After that the token is
    gone: an event issues it anew. A token that ran out without a use is reported as expired, with the moment it did: by a timer when
    the watermark passes it, or by the event that issues it anew, whichever comes first, and once. Timers free the state of
    every token that has run out.

    A user's tokens are one state, so that a call of Python serves them all; its timer is that of the token that runs out first.
    """
    length = ttl * 1_000_000

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int, str]] = []
        live = {kind: (issued, uses) for kind, issued, uses in zip(*state.get)} if state.exists else {}
        for kind, moments in ({} if state.hasTimedOut else _moments(frames)).items():
            issued, uses = live.get(kind, (None, 0))
            for now in moments:
                if issued is not None and now > issued + length:
                    if not uses:
                        out.append((kind, issued + length, "expired"))
                    issued = None
                if issued is None:
                    issued, uses = now, 0
                    out.append((kind, now, "issued"))
                else:
                    out.append((kind, now, "reused" if uses else "accepted"))
                    uses = 1
            live[kind] = issued, uses
        passed = state.getCurrentWatermarkMs()
        for kind, (issued, uses) in list(live.items()):
            if (issued + length) // 1000 + 1 < passed:
                if not uses:
                    out.append((kind, issued + length, "expired"))
                del live[kind]
        if live:
            state.update((list(live), [issued for issued, _ in live.values()], [uses for _, uses in live.values()]))
            _until(state, min(issued for issued, _ in live.values()) + length)
        elif state.exists:
            state.remove()
        if out:
            kinds, moments, outcomes = zip(*out)
            yield pd.DataFrame({"user_id": key[0], "event_type": kinds, "moment": np.array(moments, dtype="datetime64[us]"), "outcome": outcomes})

    # only what tokens are made of goes to Python
    watched = events.withWatermark("ts", late).select("user_id", "event_type", "ts")
    schema = "user_id long, event_type string, moment timestamp, outcome string"
    return watched.groupBy("user_id").applyInPandasWithState(step, schema, "kinds array<string>, issued array<bigint>, uses array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


@register(
    "stream_one_time_tokens",
    """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events), top AS (SELECT max(t) // 1000 * 1000 - 3600000000 AS mark FROM e),
life(user_id, event_type, since) AS (SELECT user_id, event_type, min(t) FROM e GROUP BY ALL UNION ALL
  SELECT e.user_id, e.event_type, min(e.t) FROM life l JOIN e ON e.user_id = l.user_id AND e.event_type = l.event_type AND e.t > l.since + 259200000000 GROUP BY ALL),
u AS (SELECT e.user_id, e.event_type, e.t, e.event_id, max(l.since) AS since FROM e JOIN life l ON e.user_id = l.user_id AND e.event_type = l.event_type AND l.since <= e.t GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, since ORDER BY t, event_id) AS n, count(*) OVER (PARTITION BY user_id, event_type, since) AS all_n, max(since) OVER (PARTITION BY user_id, event_type) AS newest FROM u),
o AS (SELECT user_id, event_type, t AS moment, CASE n WHEN 1 THEN 'issued' WHEN 2 THEN 'accepted' ELSE 'reused' END AS outcome FROM n
UNION ALL SELECT user_id, event_type, since + 259200000000, 'expired' FROM n, top WHERE n = 1 AND all_n = 1 AND (since < newest OR since + 259200000000 < mark))
SELECT user_id, event_type, CAST(make_timestamp(moment) AS VARCHAR) AS moment, outcome FROM o""",
)
def stream_one_time_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that run out after three days; the data have thirty."""
    return run_available(one_time(stream(spark, sf_dir))).withColumn("moment", F.col("moment").cast("string"))
