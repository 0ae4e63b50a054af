"""Versions with two writers, pinned readers and one that died; runs that stop, fail in part, go on, and refuse another identity."""

import pytest
from pyspark.sql import functions as F

from termloom.sources import ledger
from termloom.sources.versions import Clash, Versions
from termloom.storage import Folder, scratch


def numbers(df):
    return sorted(r[0] for r in df.collect())


def test_two_writers_and_a_pinned_reader(spark):
    path = scratch(spark, "versions-test")
    one, two = Versions(spark, path), Versions(spark, path)
    assert one.latest() == 0
    assert one.append(spark.range(3)) == 3
    pinned = two.read(1)
    base = two.latest()
    assert one.append(spark.range(3, 5), base) == 2
    with pytest.raises(Clash):
        two.append(spark.range(100, 101), base)
    assert numbers(pinned) == numbers(two.read(1)) == [0, 1, 2] and numbers(two.read()) == [0, 1, 2, 3, 4]
    assert len(Folder(spark, path).names("data")) == 2  # what the refused writer wrote is gone
    two.replace(spark.range(7, 8))
    assert numbers(one.read()) == [7] and numbers(one.read(2)) == [0, 1, 2, 3, 4]
    assert [h[:2] for h in one.history()] == [(1, "append"), (2, "append"), (3, "replace")]
    with pytest.raises(ValueError):
        one.read(9)


def test_a_writer_that_died_leaves_nothing_visible(spark):
    path = scratch(spark, "versions-dead")
    store = Versions(spark, path)
    store.append(spark.range(2))
    spark.range(50).write.parquet(f"{path}/data/orphan")
    assert numbers(store.read()) == [0, 1] and store.append(spark.range(2, 3)) == 1 and numbers(store.read()) == [0, 1, 2]


def test_a_record_is_never_replaced(spark):
    folder = Folder(spark, scratch(spark, "folder"))
    assert folder.create("a/x", "one") and not folder.create("a/x", "two")
    assert folder.read("a/x") == "one" and folder.read("a/y") is None and folder.names("a") == ["x"]


def corpus(spark, n=40):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), (F.col("id") % 10).cast("int").alias("batch"))


def test_a_stopped_run_does_only_what_is_missing(spark):
    path, calls = scratch(spark, "run-test"), []

    def work(rows, attempt):
        own = sorted(r.batch for r in rows.select("batch").distinct().collect())
        calls.append((own, attempt))
        if len(calls) == 3:
            raise KeyboardInterrupt  # the driver dies in its third job
        return rows.select("doc_id", "batch")

    with pytest.raises(KeyboardInterrupt):
        ledger.Run(spark, path, {"m": 1}, corpus(spark), "batch", 10).go_on(work, wave=2)
    run = ledger.Run(spark, path, {"m": 1}, corpus(spark), "batch", 10)
    assert run.missing() == [4, 5, 6, 7, 8, 9] and run.results().count() == 16
    assert run.go_on(work, wave=2) == []
    assert [c for c, _ in calls] == [[0, 1], [2, 3], [4, 5], [4, 5], [6, 7], [8, 9]]
    assert sorted(r.doc_id for r in run.results().collect()) == list(range(40))
    assert run.go_on(work) == [] and len(calls) == 6


def test_bad_batches_fail_alone_and_come_again(spark):
    path = scratch(spark, "run-fail")

    def work(rows, attempt):
        if attempt < 3 and not rows.where("batch = 5").isEmpty():
            raise RuntimeError("rate limit\nmore")
        return rows.select("doc_id", "batch")

    run = ledger.Run(spark, path, {}, corpus(spark), "batch", 10)
    assert run.go_on(work, wave=4) == [5]
    assert run.go_on(work) == [5] and run.go_on(work) == []
    rows = {(r.batch, r.attempt): (r.finished, r.error) for r in run.attempts().collect()}
    assert rows[5, 1] == rows[5, 2] == (False, "rate limit") and rows[5, 3] == (True, None) and rows[4, 1] == (True, None) and len(rows) == 12
    assert run.results().count() == 40


def test_another_identity_is_refused(spark):
    path = scratch(spark, "run-other")
    ledger.Run(spark, path, {"model": "a"}, corpus(spark), "batch", 10)
    for settings, docs, batches in (({"model": "b"}, corpus(spark), 10), ({"model": "a"}, corpus(spark, 41), 10), ({"model": "a"}, corpus(spark), 11)):
        with pytest.raises(ValueError, match="another run"):
            ledger.Run(spark, path, settings, docs, "batch", batches)
    ledger.Run(spark, path, {"model": "a"}, corpus(spark).orderBy(F.desc("doc_id")), "batch", 10)
