"""Close pairs at an anchor: none is left out, and a dense group that holds together costs a tree."""

import numpy as np

from termloom.llm import near_copies

from .fixtures import frame, words


def prints_of(n, seed):
    rng = np.random.default_rng(seed)
    prints = np.tile(rng.integers(0, 1 << 62, near_copies.WORDS).astype(np.uint64), (n, 1))
    for row in prints:
        for bit in rng.choice(256, rng.integers(10, 32), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    return prints


def close(prints):
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    return {(i, j) for i, j in zip(*np.nonzero(d <= near_copies.DISTANCE)) if i < j}


def unordered(a, b):
    return {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())}


def test_a_group_over_eight_gives_all_its_close_pairs():
    prints = prints_of(30, 1)
    key = np.repeat([1, 2], [20, 10])
    wanted = close(prints[:20]) | {(i + 20, j + 20) for i, j in close(prints[20:])}
    assert len(wanted) > 60 and unordered(*near_copies._pairs_of(key, prints)) == wanted


def test_a_dense_group_is_looked_at_again_where_its_tree_left_it_apart():
    prints = prints_of(150, 2)
    a, b = near_copies.tree(prints)
    wanted = close(prints)
    assert len(wanted) > near_copies.MOST * 150 and {i for i, j in zip(a, b) if i == j} == {i for pair in wanted for i in pair}
    root = np.repeat([0, 1, 2], 50)
    found = [unordered(x, y) for x, y in near_copies._pairs_apart(np.ones(150, dtype=np.int64), prints, root)]
    assert set().union(*found) == {(i, j) for i, j in wanted if root[i] != root[j]}
    assert not list(near_copies._pairs_apart(np.ones(150, dtype=np.int64), prints, np.zeros(150, dtype=np.int64)))


def test_a_cluster_left_apart_gives_its_joining_links_and_no_row_a_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.choice(1 << 40, 150, replace=False)
    texts = []
    for _ in range(300):  # half of the pairs are links, by single shingles that are replaced
        own = base.copy()
        own[rng.choice(150, rng.integers(4, 40), replace=False)] = rng.choice(1 << 40, 1)[0] + np.arange(1)
        texts.append(np.unique(own).astype(np.uint64))
    prints = np.stack([near_copies.wide_print(t) for t in texts])
    sizes = np.array([len(t) for t in texts])
    links = list(near_copies.joining(prints, np.arange(300), np.concatenate(texts), sizes, 0.8))
    alike = [(i, j) for i, j in close(prints) if len(np.intersect1d(texts[i], texts[j])) >= 0.8 * len(np.union1d(texts[i], texts[j]))]
    assert len(alike) > 3000 and {(min(p), max(p)) for p in links} <= set(alike) and len(links) < 300
    assert groups(links, 300) == groups(alike, 300) and len(set(groups(links, 300))) > 1
    roots = groups(alike[::2], 300)
    assert len(list(near_copies.joining(prints, np.array(roots), np.concatenate(texts), sizes, 0.8))) == len(set(roots)) - len(set(groups(alike, 300)))


def test_close_texts_of_little_likeness_are_no_rows_of_pairs(spark):
    base = words(11, 150).split()
    rows = []
    for i in range(400):
        rng = np.random.default_rng(i)
        own = list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    docs = frame(spark, rows)
    sets = [set(near_copies.shingle_set(t).tolist()) for _, t in rows]
    prints = np.stack([near_copies.wide_print(near_copies.shingle_set(t)) for _, t in rows])
    alike = [(i, j) for i, j in close(prints) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = {r.doc_id: r.component_id for r in near_copies.near_groups(docs).collect()}
    wanted = groups(alike, 400)
    assert sum(found[i] == wanted[i] for i in range(400)) >= 398 and len(set(wanted)) > 3  # a lone pair may meet at no anchor


def groups(pairs, n):
    root = list(range(n))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = up(int(a)), up(int(b))
        root[max(x, y)] = min(x, y)
    return [up(i) for i in range(n)]
