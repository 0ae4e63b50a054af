"""Keyed state with timers: one batch or many give the same rows, and what has run out is freed."""

import datetime as dt
import glob
import random

import pytest

from termloom.streaming import usage

START = dt.datetime(2024, 1, 1)


def events(spark, tmp_path, files=6, n=240):
    """Files in order of time, with one event long after all others, so that every timer but its own fires."""
    rng = random.Random(3)
    at, rows = START, []
    for i in range(n):
        at += dt.timedelta(minutes=rng.choice([10, 60, 600, 2000]))
        rows.append((i, at, rng.randrange(4), rng.choice(["click", "error", "view"]), 0.0, None))
    rows.append((n, at + dt.timedelta(days=30), 99, "view", 0.0, None))
    step = len(rows) // files + 1
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], usage.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"events.parquet{i}"))
    return rows


def stream(spark, tmp_path, one_by_one):
    reader = spark.readStream.schema(usage.EVENTS)
    return (reader.option("maxFilesPerTrigger", 1) if one_by_one else reader).parquet(str(tmp_path / "events.parquet*"))


@pytest.mark.parametrize("one_by_one", [False, True])
def test_lockouts(spark, tmp_path, one_by_one):
    want, state = [], {}
    for _, ts, user, kind, *_ in events(spark, tmp_path):
        failures, last = state.get(user, (0, None))
        if last and (ts - last).total_seconds() > 86_400:
            failures = 0
        failures = 0 if kind == "click" else failures + 1
        state[user] = failures, ts
        if failures == 3:
            want.append((user, ts))
    got = usage.run_available(usage.lockouts(stream(spark, tmp_path, one_by_one), most=3)).collect()
    assert sorted((r.user_id, r.locked_at) for r in got) == sorted(want) and want


@pytest.mark.parametrize("one_by_one", [False, True])
def test_tokens(spark, tmp_path, one_by_one):
    ttl, lives, want = dt.timedelta(days=3), {}, []
    rows = events(spark, tmp_path)
    for _, ts, user, kind, *_ in rows:
        key = user, kind
        since, uses = lives.get(key, (None, 0))
        if since and ts > since + ttl:
            if not uses:
                want.append((*key, since + ttl, "expired"))
            since = None
        if since is None:
            lives[key] = ts, 0
            want.append((*key, ts, "issued"))
        else:
            lives[key] = since, 1
            want.append((*key, ts, "reused" if uses else "accepted"))
    want += [(*key, since + ttl, "expired") for key, (since, uses) in lives.items() if not uses and key[0] != 99]
    got = usage.run_available(usage.one_time(stream(spark, tmp_path, one_by_one))).collect()
    assert sorted((r.user_id, r.event_type, r.moment, r.outcome) for r in got) == sorted(want)
    assert {w[3] for w in want} == {"issued", "accepted", "reused", "expired"}
    assert glob.glob(str(tmp_path / "events.parquet*"))


def test_one_call_takes_all_kinds_of_a_user_in_order_of_time():
    import pandas as pd

    frames = [pd.DataFrame({"event_type": ["view", "click"], "ts": [START + dt.timedelta(seconds=2), START]}), pd.DataFrame({"event_type": ["view"], "ts": [START]})]
    zero = pd.Timestamp(START).value // 1000
    assert usage._moments(iter(frames)) == {"view": [zero, zero + 2_000_000], "click": [zero]}
