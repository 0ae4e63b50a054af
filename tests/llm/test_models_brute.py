"""Both classifiers against plain versions: every score of the registered queries, refitted without Spark."""

import itertools
import math
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd

from termloom.llm import queries, quality, toxicity

SF = "/root/testdata/sf0.01"


def tables(column, folds, held):
    docs, labels = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    texts = {int(i): t or "" for i, t in zip(docs.doc_id, docs.text, strict=True)}
    known = {int(i): int(v) for i, v in zip(labels.doc_id, labels[column], strict=True) if v == v and zlib.crc32(str(int(i)).encode()) % folds != held}
    return texts, {i: v for i, v in known.items() if i in texts}


def plain_cells(text):
    folded = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in f" {text} ".encode())
    while b"  " in folded:
        folded = folded.replace(b"  ", b" ")
    found = Counter()
    for n in toxicity.LENGTHS:
        for at in range(len(folded) - n + 1):
            value = int.from_bytes(folded[at : at + n], "big") + (n << 56)
            found[(value * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - 18)] += 1
    return found


def test_toxicity_equals_a_plain_fit(spark):
    texts, known = tables("toxic", 3, 1)
    cells = {i: plain_cells(t) for i, t in texts.items()}
    rows = Counter(known.values())
    count = {label: Counter(c for i, v in known.items() if v == label for c in cells[i]) for label in (0, 1)}
    ratio = {}
    for c in set(count[0]) | set(count[1]):
        p, q = count[1][c] + 1, count[0][c] + 1
        r = math.log(p / (rows[1] + 2)) - math.log(q / (rows[0] + 2))
        if p + q - 2 >= 3 and abs(r) / math.sqrt(1 / p + 1 / q) >= math.sqrt(2 * math.log(2**18)):
            ratio[c] = r
    order = sorted(ratio)
    assert len(order) > 20
    matrix = lambda ids: np.array([[ratio[c] * math.log1p(cells[i].get(c, 0)) for c in order] + [1.0] for i in ids])
    x, y, w = matrix(known), np.array(list(known.values()), dtype=float), np.zeros(len(order) + 1)
    ridge = np.array([1.0] * len(order) + [1e-6])
    for _ in range(200):  # damped Newton steps with dense equations
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + ridge * w
        w -= 0.5 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), g)
    expect = dict(zip(texts, 1 / (1 + np.exp(-matrix(texts) @ w)), strict=True))
    got = queries.op10_toxicity(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - expect[r.doc_id]) < 1e-4 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def plain_features(text):
    """Some of the numbers, each by its definition."""
    words, raw = text.split(), text.encode()
    lines = [x for x in text.split("\n") if x.strip()]
    share = [c / len(raw) for c in Counter(raw).values()]
    return {
        "log_chars": math.log(1 + len(text)), "log_words": math.log(1 + len(words)), "word_length": sum(map(len, words)) / len(words), "distinct_words": len(set(words)) / len(words),
        "commonest_word": Counter(words).most_common(1)[0][1] / len(words), "repeated_next": sum(a == b for a, b in itertools.pairwise(words)) / max(1, len(words) - 1),
        "distinct_trigrams": len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2) if len(words) > 2 else 1.0, "lines": math.log(1 + len(lines)), "distinct_lines": len(set(lines)) / len(lines),
        "digits": sum(48 <= b < 58 for b in raw) / len(raw), "upper": sum(65 <= b < 91 for b in raw) / len(raw), "non_ascii": sum(b > 127 for b in raw) / len(raw),
        "long_words": sum(len(w) > 15 for w in words) / len(words), "entropy": -sum(s * math.log2(s) for s in share),
    }


def test_quality_scores_are_sums_of_table_entries(spark):
    texts, known = tables("quality", 5, 0)
    for text in list(texts.values())[:200]:
        if text.split():
            got = dict(zip(quality.FEATURES, quality.features_of(text), strict=True))
            for name, value in plain_features(text).items():
                assert abs(got[name] - value) < 1e-9, name
    rows = sorted((np.array(quality.features_of(texts[i])).tobytes(), v) for i, v in known.items())
    rows = [rows[i] for i in np.random.default_rng(7).permutation(len(rows))]
    model = quality.fit_model(np.array([np.frombuffer(x) for x, _ in rows]), np.array([float(v) for _, v in rows]))
    got = {r.doc_id: r for r in queries.op1_quality(spark, SF).collect()}
    assert set(got) == set(texts) and model.pairs
    for i, text in texts.items():
        x = quality.features_of(text)
        z = model.intercept + sum(table[bisect_right(list(edges), v)] for v, edges, table in zip(x, model.edges, model.tables, strict=True))
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            z += table[bisect_right(list(model.pair_edges[a]), x[a])][bisect_right(list(model.pair_edges[b]), x[b])]
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_trees_are_the_best_of_all():
    rng = np.random.default_rng(3)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9) + 0.6
        best = max(range(1, 9), key=lambda c: gain(g[:c], h[:c]) + gain(g[c:], h[c:]))
        step = quality.shallow_tree(g, h, leaves=2)
        if gain(g[:best], h[:best]) + gain(g[best:], h[best:]) > gain(g, h) + 1e-9:
            expect = np.concatenate([np.full(best, -g[:best].sum() / (h[:best].sum() + 1)), np.full(9 - best, -g[best:].sum() / (h[best:].sum() + 1))])
            assert np.allclose(step, expect)
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.6
        every = []
        for gg, hh in ((g, h), (g.T, h.T)):
            for cut in range(1, len(gg)):
                total = -gain(g, h)
                for part in (slice(0, cut), slice(cut, None)):
                    total += max([gain(gg[part], hh[part])] + [gain(gg[part, :c], hh[part, :c]) + gain(gg[part, c:], hh[part, c:]) for c in range(1, gg.shape[1])])
                every.append(total)
        assert abs(quality.pair_tree(g, h)[0] - max(0, *every)) < 1e-9
