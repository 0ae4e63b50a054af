"""The two-phase mapping with stand-in providers, and the command line."""

import pandas as pd
from pyspark.sql import functions as F

from termloom import cli
from termloom.operators import phases

from .conftest import SF


def extractor(batches):
    for frame in batches:
        rows = []
        for doc, grp, prompt in frame[["doc_id", "grp", "prompt"]].itertuples(index=False):
            if "fail" in prompt and "small" not in prompt:
                rows.append((doc, grp, None, None, None, None, "Request timed out"))
            elif "denied" in prompt:
                rows.append((doc, grp, None, None, None, None, "403"))
            else:
                rows += [(doc, grp, p.strip(), "abnormal", "affirmed", p, None) for p in prompt.replace("fail", "").replace("small", "").split(",")]
        yield pd.DataFrame(rows, columns=["doc_id", "grp", "phrase", "category", "assertion", "evidence", "error"])


def test_run(spark):
    groups = spark.createDataFrame([(1, 0, "short arms, SHORT ARMS"), (2, 0, "fail odd gait"), (3, 0, "denied"), (4, 0, "hand/foot pain")], "doc_id long, grp int, prompt string")
    labels = [("short arms", "T1", "Short arm", 0.6), ("odd gait", "T2", "Strange walk", 0.5), ("odd gait", "T3", "Other", 0.4), ("hand pain", "T4", "x", 0.9), ("foot pain", "T5", "y", 0.2)]
    table = spark.createDataFrame(labels, "phrase string, term string, label string, score double")

    def retrieve(rows):
        return rows.select(F.col("phrase"), F.lower("phrase").alias("k")).join(table.withColumnRenamed("phrase", "k"), "k").drop("k")

    seen = []

    def regroup(rows, mode):
        seen.append(mode)
        return rows.withColumn("prompt", F.concat("prompt", F.lit(" small") if mode == "grouped_small" else F.lit("")))

    got = {(r.doc_id, r.term, r.method) for r in phases.run(groups, extractor, retrieve, phases.first_offer, regroup=regroup).collect()}
    assert got == {(1, "T1", "local"), (2, "T2", "mapped"), (4, "T4", "score"), (4, "T5", "mapped")}
    assert seen == ["grouped_large", "grouped_small"]


def test_failures(spark):
    messages = ["Quota: 429", "Timed out while parsing JSON", "JSON schema", "literal_error", "SSL connection", "Model not found", "boom", None]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    assert [r.c for r in df.select(phases.classify_failure(F.col("m")).alias("c")).collect()] == ["provider_auth_error", "provider_timeout", "structured_json_invalid", "structured_schema_validation_failed", "provider_transport_error", "provider_config_error", "provider_execution_error", None]


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["list"]) == 0 and "knn_topk" in capsys.readouterr().out
    assert cli.main(["run", "quota_daily", "--data", SF, "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    assert cli.main(["explain", "prf_micro", "--data", SF]) == 0
