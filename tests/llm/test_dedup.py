"""Exact and near duplicates against brute force."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import components, exact_dedup, near_copies, simhash

from .fixtures import LONG, TEXTS, empty, frame, words


def test_exact_groups_on_awkward_rows(spark):
    got = sorted(map(tuple, exact_dedup.exact_groups(frame(spark)).collect()), key=repr)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in TEXTS]
    assert len(got) == len(TEXTS)
    for text in {t for _, t in norm}:
        ids = [i for i, t in norm if t == text]
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [g for g in got if g[4] == sha]
        assert sorted((g[0] for g in mine), key=repr) == sorted(ids, key=repr)
        assert {(g[1], g[2]) for g in mine} == {(keep, len(ids))}
        assert [g[0] for g in mine if g[3]] == [keep]  # one row stays, whatever repeats


def test_exact_empty_table(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.keep_first(empty(spark)).count() == 0


def test_keep_first_keeps_columns_and_one_row(spark):
    docs = frame(spark)
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(norm(r.text) for r in got.collect()) == sorted({norm(t) for _, t in TEXTS})


def test_directory_splits_and_covers():
    buckets = exact_dedup.build_directory({0: 10, 1: 10, 2: 1, 7: 100}, 3, capacity=12)
    assert buckets[0] == (0, 1, 10) and (7, 1, 100) in buckets
    assert sum(w for _, w, _ in buckets) == 8
    owners = dict(exact_dedup.owners_of(buckets, 25))
    assert sorted(owners) == list(range(8)) and list(owners.values()) == sorted(owners.values())


def test_hash_collisions_compare_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.xxhash, "xxh64_intdigest", lambda raw, seed: 7)
    docs = frame(spark, [(i, words(i % 3, 20)) for i in range(12)])
    pages = docs.select("doc_id", F.col("text").alias("norm")).collect()
    import pyarrow as pa

    class Context:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Context))
    batch = pa.RecordBatch.from_pydict({"doc_id": [p.doc_id for p in pages], "norm": [p.norm for p in pages]})
    rows = pa.Table.from_batches(list(exact_dedup._pages(iter([batch]))))
    assert len(set(rows["h"].to_pylist())) == 1
    found = pa.Table.from_batches(list(exact_dedup._chain(iter(rows.to_batches()))))
    assert len(set(found["grp"].to_pylist())) == 3


def brute_components(prints, distance=4):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= distance:
                root[find(b)] = find(a)
    return {v: find(v) for v in values}


def test_near_groups_on_awkward_rows(spark):
    got = simhash.near_groups(frame(spark)).collect()
    prints = [simhash.fingerprint(t or "") for _, t in TEXTS]
    roots = brute_components(prints)
    least = {}
    for (i, _), p in zip(TEXTS, prints, strict=True):
        known = least.get(roots[p])
        least[roots[p]] = i if known is None else known if i is None else min(known, i)
    expect = sorted(((i, f"{p:016x}", least[roots[p]]) for (i, _), p in zip(TEXTS, prints, strict=True)), key=repr)
    assert sorted(map(tuple, got), key=repr) == expect
    assert simhash.near_groups(empty(spark)).count() == 0


def test_fingerprint_definition():
    import xxhash

    text = "A b  c\td E\x0bf"
    shingles = ["a b c d", "b c d e", "c d e f"]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    expect = sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint(text) == expect
    assert simhash.fingerprint("") == 0 == simhash.fingerprint(" \n")
    assert simhash.fingerprint("Ä b") == xxhash.xxh64_intdigest("Ä b", 42)
    assert simhash.fingerprint(LONG) != 0


def test_covering_meets_every_link():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    flips = np.array([sum(1 << int(bit) for bit in rng.choice(64, 4, replace=False)) for _ in x], dtype=np.uint64)
    for way in simhash.WAYS:
        met = np.zeros(len(x), dtype=bool)
        for cover in way:
            (a, _), (b, bits) = simhash.cut(x, cover), simhash.cut(x ^ flips, cover)
            met |= (np.stack(simhash.anchors(b, bits)) == simhash.homes(a)).any(axis=0)
        assert met.all()


def test_dense_and_salted_groups_keep_their_components(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 40)
    prints = set()
    for c in centres:
        for _ in range(40):
            v = int(c)
            for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                v ^= 1 << int(bit)
            prints.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in prints]
    df = spark.createDataFrame(signed, "fp long")
    for chunk, way in ((4096, None), (8, simhash.WAYS[0]), (8, simhash.WAYS[1]), (4096, simhash.WAYS[2])):  # eight salts every anchor that holds more
        found = {r.node & (1 << 64) - 1: r.root for r in components.components(simhash.fingerprint_links(df, chunk, way)).collect()}
        groups = {}
        for v, r in brute_components(prints).items():
            groups.setdefault(r, set()).add(v)
        for members in groups.values():
            if len(members) > 1:
                assert len({found[m] for m in members}) == 1
        assert len(set(found.values())) == sum(len(m) > 1 for m in groups.values())


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components.components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_keep_first(spark):
    docs = frame(spark)
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.collect()}
    assert {1, 4, 7, 8, None} <= kept and not {2, 3, 5, 6} & kept  # null ids are smallest in a group of their own


def test_ways_follow_the_number_of_fingerprints():
    assert [simhash.WAYS.index(simhash.covers_for(n)) for n in (0, 10**6, 10**9, 10**11)] == [0, 0, 0, 2]
    with np.testing.assert_raises(ValueError):
        simhash.covers(4, 2)


def test_clashing_names_keep_their_columns(spark):
    names = ("__id", "__sha", "own_sha", "dropped_id", "DROPPED_SHA", "wanted_id", "component_id", "root", "fp")
    rows = [(1, words(1, 60)), (2, words(1, 60)), (3, words(2, 90)), (3, words(2, 90)), (None, words(3, 50)), (None, words(3, 50))]
    docs = frame(spark, rows).select("doc_id", "text").withColumns({n: F.lit(n) for n in names})
    for module in (exact_dedup, simhash, near_copies):
        got = module.keep_first(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert all(r[n] == n for r in found for n in names)
        assert {r.doc_id for r in found} == {1, 3, None}
    assert exact_dedup.keep_first(docs).count() == 3
