"""The pipeline against a brute-force version of every stage."""

import re

import pytest

import corpus_pipeline
from termloom.llm import secrets_scan, toxicity

from .fixtures import empty, frame
from .test_texts import check_packing

SF = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return {" ".join(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set()


def test_stages_against_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    from termloom.llm import common

    model = toxicity.fit(docs, labels.filter(common.fold(3) != 1))
    texts = {i: r.text for i, r in rows.items()}
    scores = dict(zip(texts, model.score(list(texts.values())), strict=True))
    kept = {i: t for i, t in texts.items() if scores[i] < toxicity.THRESHOLD}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    # the stage's contract: five-word shingles, links at a Jaccard likeness of 0.8 or more
    shingles = {i: plain_shingles(t) for i, t in kept.items()}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {i: secrets_scan.masked(t) for i, t in kept.items() if find(i) == i}

    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SF)
        assert got.columns == docs.columns, name
        got = spark.createDataFrame(got.collect(), docs.schema)
    assert {r.doc_id: r.text for r in got.collect()} == kept
    packed = corpus_pipeline.run(spark, SF).collect()
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids_of = {i: [library.encode(t, add_special_tokens=False).ids + [2]] for i, t in kept.items()}
    n = check_packing(packed, ids_of)
    assert {r.doc_id for r in packed} == set(kept)
    assert n <= 1.05 * sum(len(v[0]) for v in ids_of.values()) / 1024 + 1


def test_stages_survive_awkward_and_empty_tables(spark):
    for docs in (frame(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, SF).collect()
            assert len(rows) >= (1 if docs.count() else 0)
