"""Fingerprints against a plain version of one-permutation MinHash, and ids that many rows share."""

import hashlib

import numpy as np
import pytest
import xxhash

from termloom.llm import minhash

from .fixtures import TEXTS, frame, words

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_sketch(text):
    own = [xxhash.xxh3_64_intdigest(w) for w in text.split()]
    if len(own) < minhash.SHINGLE:
        value = int(minhash._STEP) + len(own)
        for h in own:
            value = mixed((value * 0x94D049BB133111EB + h) & MASK)
        hashes = [value & MASK]
    else:
        hashes = []
        for at in range(len(own) - minhash.SHINGLE + 1):
            value = 0
            for h in own[at : at + minhash.SHINGLE]:
                value = mixed((value * int(minhash._STEP) + h) & MASK)
            hashes.append(value)
    bins = {}
    for h in hashes:  # one hash a shingle: its low bits are the bin, the rest the value
        bins[h % 512] = min(bins.get(h % 512, MASK), h >> 9)
    out = []
    for i in range(512):
        source = i if i in bins else min(bins, key=lambda b: minhash._ORDER[i][b])  # the full bin that comes first in the bin's own order
        out.append(mixed((bins[source] + (i + 1) * int(minhash._STEP)) & MASK) & 15)
    return out


def digits(bins):
    return "".join(f"{b:x}" for b in bins)


def plain_likeness(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 512 - 1 / 16) / (1 - 1 / 16))


def expected(rows):
    order = sorted((i is not None, i or 0, t or "") for i, t in rows)
    prints = {t: plain_sketch(t) for t in {o[2] for o in order}}
    for at, (known, i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][2]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        own, new = prints[text], plain_sketch(changed)
        yield (i if known else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), digits(own), digits(new), plain_likeness(own, new), plain_likeness(own, prints[following]))


def test_query_equals_a_plain_version(spark):
    got = sorted(map(tuple, minhash.with_edits(frame(spark)).collect()), key=repr)
    for a, b in zip(got, sorted(expected(TEXTS), key=repr), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])


@pytest.mark.parametrize("hot", [None, 7])
def test_an_id_of_many_rows_is_cut_by_its_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "RANGE_ROWS", 10)
    rows = [(hot, words(n, 12)) for n in range(120)] + [(n + 8, words(500 + n, 12)) for n in range(60)] + [(hot, None), (hot, "é"), (hot, words(3, 12))]
    found = minhash.with_edits(frame(spark, rows))
    got = sorted(map(tuple, found.collect()), key=repr)
    for a, b in zip(got, sorted(expected(rows), key=repr), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])
    sizes = found.select().rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert max(sizes) <= 60  # of 183 rows, 123 of them with one id
