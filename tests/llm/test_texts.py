"""Tokenizers, packing, fingerprints, secrets, licenses and WARC against brute force and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import bpe, common, licenses, minhash, packing, secrets_scan, warc

from .fixtures import TEXTS, empty, frame, words

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def word_library():
    return tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_library():
    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbBzÉéß'’.,<|>$#\n\t  　½٣Σσİ日語🙂́x0_\x1d\x85"), max_size=60))
def test_bpe_equals_library(text):
    own, library = bpe.codec(P.path("word_bpe_49k.json")), tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")) if not hasattr(test_bpe_equals_library, "t") else test_bpe_equals_library.t
    test_bpe_equals_library.t = library
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == own.round_trip(text)[1]


def test_bpe_query_on_awkward_rows(spark, word_library):
    got = sorted(map(tuple, bpe.digests(frame(spark)).collect()), key=repr)
    expect = []
    for i, t in TEXTS:
        ids = word_library.encode(t or "", add_special_tokens=False).ids
        text = word_library.decode(ids, skip_special_tokens=False)
        expect.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expect, key=repr)
    assert bpe.digests(empty(spark)).count() == 0
    assert sum(len(r.ids) for r in bpe.encode(frame(spark)).collect()) == sum(e[1] for e in expect)


def test_long_words_merge_alike():
    codec = bpe.codec(P.path("word_bpe_49k.json"))
    rng = random.Random(2)
    for _ in range(50):
        raw = [codec.inner[rng.choice(b"abcdefgh")] for _ in range(150)]
        assert codec.merge_short(list(raw)) == codec.merge_long(list(raw))


def check_packing(rows, ids_of, capacity=1024):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    left = {k: sorted((tuple(ids) for ids in v), key=len) for k, v in ids_of.items()}
    for doc, parts in by_doc.items():
        assert sum(p.length for p in parts) == sum(map(len, left[doc]))
    return len(bins)


def test_packing_on_awkward_rows(spark, byte_library):
    rows = packing.pack(frame(spark)).collect()
    ids_of = {}
    for i, t in TEXTS:
        ids_of.setdefault(i, []).append(byte_library.encode(t or "", add_special_tokens=False).ids + [2])
    n = check_packing(rows, ids_of)
    assert n <= 1.05 * sum(len(x) for v in ids_of.values() for x in v) / 1024 + 1
    for doc in (1, 7, 11, 22):
        ids = np.array(ids_of[doc][0], dtype="<u4")
        for at, (p, (start, length)) in enumerate(zip(sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece), packing.cut(len(ids), 1024), strict=True)):
            assert (p.piece, p.start, p.length) == (at, start, length)
            assert p.ids_crc32 == zlib.crc32(ids[start : start + length].tobytes())
    assert packing.pack(empty(spark)).count() == 0


def test_reduction_never_costs_a_sequence():
    rng = np.random.default_rng(1)
    for _ in range(100):
        capacity = int(rng.integers(5, 60))
        sizes = rng.integers(1, capacity + 1, size=int(rng.integers(1, 200)))
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed, rest = packing.reduce_instance(counts, capacity)
        used = rest.copy()
        for pattern, times in fixed:
            assert sum(s * n for s, n in pattern) <= capacity
            for s, n in pattern:
                used[s] += n * times
        assert (used == counts).all()
        patterns, _ = packing.solve(counts, capacity)
        plain = []
        for s in sorted(sizes, reverse=True):
            room = [i for i, r in enumerate(plain) if r >= s]
            if room:
                plain[min(room, key=lambda i: plain[i])] -= s
            else:
                plain.append(capacity - s)
        assert sum(t for _, t in patterns) <= len(plain)


def test_minhash_estimates_and_edges(spark):
    a = words(1, 800)
    b = minhash.edited(a, words(2, 800))
    x, y = (set(minhash.shingle_hashes(t).tolist()) for t in (a, b))
    true = len(x & y) / len(x | y)
    assert abs(minhash.likeness(minhash.sketch(a), minhash.sketch(b)) - true) < 0.08
    assert minhash.likeness(minhash.sketch("one"), minhash.sketch("two")) < 0.1
    assert minhash.likeness(minhash.sketch(""), minhash.sketch("")) == 1
    assert (minhash.unpacked(minhash.packed(minhash.sketch(a))) == minhash.sketch(a)).all()
    assert minhash.edited("abcdefgh", "XYZ") == "abcdefXY" and minhash.edited("abcdefgh", "X") == "abcdefX"


@pytest.mark.parametrize("range_rows", [4000, 3])
def test_minhash_query_follows_ids(spark, monkeypatch, range_rows):
    monkeypatch.setattr(minhash, "RANGE_ROWS", range_rows)
    got = minhash.with_edits(frame(spark)).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in TEXTS))
    expect = []
    for at, (known, i, text) in enumerate(order):
        nxt = order[(at + 1) % len(order)][2]
        e = minhash.edited(text, nxt)
        s, n, x = minhash.sketch(text), minhash.sketch(nxt), minhash.sketch(e)
        expect.append((i if known else None, len(text), hashlib.sha256(e.encode()).hexdigest(), minhash.packed(s), minhash.packed(x), minhash.likeness(s, x), minhash.likeness(s, n)))
    assert sorted(map(tuple, got), key=repr) == sorted(expect, key=repr)
    assert minhash.with_edits(empty(spark)).count() == 0
    assert minhash.with_edits(frame(spark, [(5, words(1, 30))])).first().near_next == 1


def brute_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            found.append((m.start(), m.end(), "assign"))
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "=", ":", " ", '"', "abcdef12", "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f6071", "x", "é", "password", "api_key", "ſecret", "\n", "."]), max_size=14))
def test_secret_base_spans(parts):
    text = "".join(parts)
    assert sorted(secrets_scan.base_spans(text)) == brute_base(text)


def test_secret_scan_on_awkward_rows(spark):
    got = {(r.doc_id, r.base): r for r in secrets_scan.scan(frame(spark)).collect()}
    assert len(got) >= 15 and got[(20, "assign:0:49,hex:9:49")].spans == "assign:0:49,hex:9:49,novel:9:49"
    assert got[(4, "")].spans == ""
    assert secrets_scan.digest(secrets_scan.scan(empty(spark))).count() == 0
    masked = {r.doc_id: r.text for r in secrets_scan.mask(frame(spark)).collect()}
    assert masked[20] == '[secret]"' and masked[4] is None and masked[8] == words(2, 200)


def test_novelty_tells_keys_from_words():
    assert secrets_scan.novel_spans("the auth key is: Zk9x8Qw2LmN4pR7tVb3y")
    assert not secrets_scan.novel_spans("password: changeme_your_password_here1")
    assert not secrets_scan.novel_spans("a token internationalization of words")


def test_license_rules(spark):
    text = "Permission is hereby granted, " + licenses.SENTENCES["mit.grant"].split("granted, ", 1)[1] + "\n\n" + licenses.SENTENCES["mit.include"] + " Words. " + licenses.SENTENCES["mit.asis"]
    docs = frame(spark, [*TEXTS, (30, text), (31, "LICENSED under the  apache license, version 2.0!"), (32, licenses.SENTENCES["mit.asis"] + " " + licenses.SENTENCES["mit.grant"])])
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[30].rules == ["mit-text"] and got[30].sentence_ids == ["mit.grant", "mit.include", "mit.asis"]
    assert got[31].licenses == ["Apache-2.0"] and got[21].rules == ["mit-line"]
    assert got[32].rules == [] and len(got[32].sentence_ids) == 2  # wrong order
    assert got[4].rules == [] and licenses.scan(empty(spark)).count() == 0
    table = licenses.sentence_table()
    for r in licenses.scan(docs).collect():
        src = dict([*TEXTS, (30, text), (31, "LICENSED under the  apache license, version 2.0!"), (32, licenses.SENTENCES["mit.asis"] + " " + licenses.SENTENCES["mit.grant"])]).get(r.doc_id)
        assert r.doc_id in (12, None) or r.sentence_ids == [table[s] for s in licenses.normal_sentences(src or "") if s in table]


PAGES = [
    (1, "http://a/1", "<html lang=de><head><title>A &amp; B</title><script>var x='<p>no</p>'</script></head><body><p>One&nbsp;two<br>three<!-- c --></p><a href=\"/x?a=1&amp;b=2\">go</a></body>"),
    (2, None, None), (3, "http://a/3", ""), (1, "http://a/1", "plain"), (None, "u", "<style>p{}"), (9, "http://a/9", "<p>" + "word " * 20_000),
]


def test_warc_derivatives_and_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, block string")
    found = warc.derive(warc.responses(pages))
    rows = found.collect()
    assert len(rows) == 2 * len(PAGES)
    by = {(r.page_id, r.record_type, r.target_uri, r.content_length): r for r in rows}
    one = next(r for r in rows if r.page_id == 1 and r.record_type == "conversion" and "One" in r.block)
    assert one.block == "A & B\nOne two\nthree\ngo"
    meta = next(r for r in rows if r.refers_to == one.refers_to and r.record_type == "metadata")
    assert "title: A & B\r\n" in meta.block and "outlink: /x?a=1&b=2\r\n" in meta.block and "language: de\r\n" in meta.block
    for r in rows:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
    assert len({r.record_id for r in rows}) == len(rows) and len(by) == len(rows)
    warc.write_warc(found, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((b.header["warc-record-id"], b.header["warc-refers-to"], b.block) for b in back) == sorted((r.record_id, r.refers_to, r.block) for r in rows)
    assert all(b.complete for b in back)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_shared_folder_comes_from_the_session():
    class Conf:
        def get(self, key, default=None):
            return "s3a://bucket/checkpoints" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert common.shared_dir(Session()) == "s3a://bucket/checkpoints"
