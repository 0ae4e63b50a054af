"""The manifest against a plain tree built in Python, over odd rows, small buckets and a language that holds most rows."""

import hashlib
import zlib

import pytest

from termloom.llm import merkle

from .fixtures import SCHEMA, TEXTS, empty, frame

SHORT = "doc_id long, text string, lang string, source string, n_chars long, idx long, tree string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    n_chars = row["n_chars"] if row["n_chars"] is None else row["n_chars"] + more
    values = [row["doc_id"], row["source"], row["lang"], n_chars, row["text"]]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def paths(leaves):
    """Root of a list of leaves and each leaf's siblings as (sibling, right)."""
    nodes, at, out = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for i, k in enumerate(at):
            if (k ^ 1) < len(nodes):
                out[i].append((nodes[k ^ 1], k % 2 == 1))
            else:
                out[i].append(("", False))
        nodes = [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return nodes[0], out


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for x in groups.values():
        x.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, leaf_of(r)))
    trees = {x: paths([leaf_of(r) for r in groups[x]]) for x in langs}
    root, upper = paths([trees[x][0] for x in langs])
    out = []
    for lang, above in zip(langs, upper):
        for row, path in zip(groups[lang], trees[lang][1]):
            path = path + above
            start = leaf_of(row, more=int(row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0))
            h = start
            for sibling, right in path:
                h = H(sibling, h) if right else H(h, sibling)
            out.append((row["doc_id"], leaf_of(row), trees[lang][0], root, H(*[s for s, _ in path]), h, h == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits", [1, 2, merkle.BUCKET_BITS])
def test_small_buckets_and_a_hot_language(spark, bits):
    rows = [{"doc_id": i, "text": f"text {i % 7}", "lang": "en" if i % 3 else ["de", "\u00e9s", None, ""][i // 3 % 4], "source": None if i % 5 else "s", "n_chars": None if i % 11 == 0 else i, "idx": 1, "tree": "x"} for i in range(130)]
    rows += [dict(rows[1]), dict(rows[1]), {**rows[0], "doc_id": None}, {**rows[0], "doc_id": None, "text": "\u00fc" * 50_000}, {**rows[2], "doc_id": 4, "text": None}]
    rows.append({**rows[3], "doc_id": 900, "lang": "lone"})
    got = merkle.verified(spark.createDataFrame(rows, SHORT), bits)
    assert found(got) == plain(rows)
    assert not all(r.verified for r in got.collect())


def test_odd_rows(spark):
    df = frame(spark)
    assert found(merkle.verified(df)) == plain([r.asDict() for r in df.collect()])
    assert len(TEXTS) == df.count() and "fp long" in SCHEMA


def test_empty_and_largest_count(spark):
    assert merkle.verified(empty(spark)).collect() == []
    one = {"doc_id": 3, "text": "", "lang": None, "source": "", "n_chars": 2**63 - 1, "idx": 0, "tree": ""}
    assert found(merkle.verified(spark.createDataFrame([one], SHORT))) == plain([one])
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0]
    rows = [{**one, "doc_id": i} for i in ids]
    got = merkle.verified(spark.createDataFrame(rows, SHORT))
    assert found(got) == plain(rows) and not any(r.verified for r in got.collect())
