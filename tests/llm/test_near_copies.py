"""Near copies in general: recall and precision against the texts' own likeness."""

import random

import numpy as np

import corpus_pipeline
from termloom.llm import components, near_copies

from .fixtures import empty, frame, words


def likeness(a, b):
    a, b = set(near_copies.shingle_set(a).tolist()), set(near_copies.shingle_set(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, n, seed):
    rng, parts = random.Random(seed), text.split()
    for at in rng.sample(range(len(parts)), n):
        parts[at] = f"edit{seed}x{at}"
    return " ".join(parts)


def test_stage_drops_edited_copies_and_nothing_less_alike(spark):
    rows, close = [], {}
    for k in range(120):
        base = words(1000 + k, 400)
        other = edited(base, (2, 5, 7, 16)[k % 4], k)
        rows += [(2 * k, base), (2 * k + 1, other)]
        close[2 * k + 1] = likeness(base, other)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    assert {2 * k for k in range(120)} <= kept
    near = [i for i, j in close.items() if j >= 0.8]
    assert len(near) > 60 and all(i in kept for i, j in close.items() if j < 0.8)
    assert sum(i not in kept for i in near) >= 0.95 * len(near)


def test_large_group_is_one_component(spark):
    base = words(7, 300)
    rows = [(i, edited(base, 2, i)) for i in range(60)] + [(100 + i, words(200 + i, 300)) for i in range(5)]
    kept = {r.doc_id for r in near_copies.keep_first(frame(spark, rows)).collect()}
    assert kept == {0, 100, 101, 102, 103, 104}
    assert near_copies.keep_first(empty(spark)).count() == 0


def test_salted_groups_give_the_same_components(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(30):
        centre = rng.integers(0, 1 << 62, near_copies.WORDS)
        for m in range(12):
            own = centre.copy()
            own[m % near_copies.WORDS] ^= 1 << int(rng.integers(0, 60))
            rows.append((g * 12 + m, *map(int, own)))
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"f{i} long" for i in range(near_copies.WORDS)))
    for chunk in (4096, 4):
        found = {r.node: r.root for r in components.components(near_copies.candidates(nodes, len(rows), chunk)).collect()}
        assert found == {i: i - i % 12 for i in range(len(rows))}
