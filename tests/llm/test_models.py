"""Classifiers: held-out accuracy, awkward rows, and inputs that mustn't matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import common, quality, toxicity

from .fixtures import TEXTS, empty, frame

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("module, column, folds, held, at_least", [(quality, "quality", 5, 0, 0.95), (toxicity, "toxic", 3, 1, 0.93)])
def test_held_out_accuracy(spark, module, column, folds, held, at_least):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    got = module.predict(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got[column]).mean() >= at_least
    import zlib

    assert all(zlib.crc32(str(i).encode()) % folds == held for i in got.doc_id)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows(spark, module):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 1, 1), (10, None, None), (23, 0, 1), (12, 1, 0)], "doc_id long, quality int, toxic int")
    got = module.predict(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in got)
    assert module.predict(empty(spark), labels).count() == 0
    none = module.predict(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}


def test_scores_ignore_other_columns(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    a = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    b = {r.doc_id: r.score for r in toxicity.score(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None)}), model).collect()}
    assert a == b


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit_model(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95 and (0, 1) in m.pairs
    x = rng.random((2000, 3))
    assert (((m.score(x) > 0.5) == ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5))).mean()) > 0.9


def test_log_count_ratios_point_the_right_way():
    counts = np.zeros((2, toxicity.CELLS))
    counts[1, 5], counts[0, 6] = 30, 30
    r, evidence = toxicity.log_count_ratios(counts, np.array([100, 100]))
    assert r[5] > 0 > r[6] and evidence[5] > 2


def test_reject_keeps_clean_rows(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    assert len(clean & ids) >= 0.99 * len(clean)
    assert toxicity.reject(docs.limit(0), labels).count() == 0
