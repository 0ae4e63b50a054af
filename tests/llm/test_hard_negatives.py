"""Hard negatives against all rows in plain Python: clustered vectors, a vector that a third of all rows share, odd rows."""

import math
import random

import numpy as np
import pytest

from termloom.llm import hard_negatives
from termloom.llm.hard_negatives import Block, Space, Tree

SCHEMA = "vec_id long, embedding array<double>, label int, score double, cell int"


def plain(rows, every=100, k=5):
    taken = []
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        taken.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in vec)))
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for anchor, label, q in {t for t in taken if t[0] % every == 0}:
        scored = [(held(sum(a * b for a, b in zip(q, v))), i, kind) for i, kind, v in taken]
        scored.sort(key=lambda t: (-t[0], t[1]))
        for s, i, _ in [t for t in scored if t[2] == label and t[1] != anchor][:k]:
            for rank, (n, j, _) in enumerate([t for t in scored if t[2] != label and 80 * s <= 100 * t[0] <= 100 * s][:k], 1):
                out.append((anchor, i, rank, j, s, n))
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, 0.5, 1) for i, v, label in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(df, **more).collect())


def clustered(n, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.04) for x in c], rng.randrange(5)))
    return rows


def test_many_cells_and_a_hot_vector(spark):
    rows = clustered(900, 8, 1)
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(450)]
    assert found(spark, rows, every=50, block_rows=100, block_anchors=7) == plain(rows, every=50)


def test_odd_rows(spark):
    rows = clustered(60, 6, 2)
    rows += [(None, rows[1][1], 1), (100, None, 1), (100, rows[1][1], None), (200, [0.1, None], 1), (200, [float("nan")] * 6, 1), (200, [float("inf")] * 6, 1)]
    rows += [(300, [], 2), (301, [], 2), (302, [0.0] * 6, 3), (100, rows[5][1], 2), (100, rows[5][1], 2), (100, rows[6][1], 2), (103, rows[5][1], 2), (103, rows[5][1], 2), (104, rows[5][1], 4), (104, rows[5][1], 4)]
    rows += [(-100, [0.2, 0.1, 0.3], 1), (400, rows[0][1] + [0.5, -0.5], -3)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("scale", [3e4, 1e12])
def test_products_beyond_doubles(spark, scale):
    rows = [(i, [x * scale for x in v], label) for i, v, label in clustered(120, 5, 3)]
    assert found(spark, rows, every=20) == plain(rows, every=20)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(100, None, 1)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_a_block_walks_its_tree_in_order(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(256 * rng.normal(0, 0.1, (1500, 6)) * (1 + 3 * (rng.random((1500, 1)) < 0.1)))
    x[200:500] = x[7]
    ids, labels = rng.permutation(1500), rng.integers(0, 4, 1500)
    space = Space(6, float((x * x).sum(axis=1).max()), True)
    block = Block(ids, labels, x, space, leaf_rows=50)
    chosen = rng.integers(0, 1500, 20)
    s = (x @ x[chosen].T).astype(int).T
    most, least = block.bounds(x[chosen])
    for i, leaf in enumerate(block.leaves):
        assert (s[:, leaf] <= most[:, [i]]).all() and (s[:, leaf] >= least[:, [i]]).all()
    assert len(block.leaves) > 10
    windows = [[(w, int(np.quantile(row, b - 0.2)), int(np.quantile(row, b))) for w, b in enumerate([0.99, 0.9, 0.95, 0.6])] for row in s]
    for same, asked in ((False, windows), (True, [[(0, -(2**63), 2**63 - 1)]] * 20)):
        got = list(block.asked(x[chosen], [int(i) for i in ids[chosen]], [int(i) for i in labels[chosen]], same, asked, 5))
        for a, c in enumerate(chosen):
            fits = (labels == labels[c]) & (ids != ids[c]) if same else labels != labels[c]
            for w, low, high in asked[a]:
                want = sorted((-int(s[a, i]), int(ids[i])) for i in np.flatnonzero(fits) if low <= s[a, i] <= high)[:5]
                assert [(-score, i) for b, name, score, i in got if (b, name) == (a, w)] == want


def test_bounds_hold_every_score():
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(0, 0.1, (2000, 5)))
    space = Space(5, float((x * x).sum(axis=1).max()), True)
    tree = Tree.fit(x[:800], space, 20)
    cells, q = tree.cell_of(space.lifted(x)), x[:30]
    most, least = tree.bounds(q)
    assert tree.cells > 10 and set(cells) == set(range(tree.cells))
    s = q @ x.T
    assert (s <= most[:, cells]).all() and (s >= least[:, cells]).all()
    assert (most[np.arange(30)] < s.max(axis=1)[:, None]).any()
