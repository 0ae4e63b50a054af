"""WARC files of both versions, awkward blocks and mark-up, and derivatives of records that were read."""

import gzip
import hashlib
import time
import zlib

import pytest

from termloom.llm import warc


def record(version, kind, number, block, extra=b""):
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{number}>\r\nWARC-Target-URI: http://a/{number}\r\nWARC-Date: 2020-02-0{number}T00:00:00Z\r\n"
    return head.encode() + extra + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http(body, extra="", kind="text/html"):
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n{extra}\r\n".encode() + body


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_records_are_cut_by_length(spark, tmp_path, version, packed):
    blocks = [b"first", b"", f"holds\r\nWARC/{version}\r\nContent-Length: 3\r\n\r\nabc and WARC/1.0\r\n more WARC/1.".encode(), bytes(range(256)), b"last"]
    records = [record(version, "resource", n, b, b"Software: WARC/1.0 tools\r\n" if n == 3 else b"") for n, b in enumerate(blocks, 1)]
    name = tmp_path / ("a.warc.gz" if packed else "a.warc")
    name.write_bytes(b"".join(map(gzip.compress, records)) if packed else b"".join(records))
    got = sorted(warc.read_records(spark, str(name)).collect(), key=lambda r: r.header["warc-record-id"])
    assert [bytes(r.block) for r in got] == blocks and all(r.complete for r in got)
    assert {r.version for r in got} == {f"WARC/{version}"} and [r.content_length for r in got] == list(map(len, blocks))
    assert got[2].header["software"] == "WARC/1.0 tools"


def test_files_that_end_early(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record("1.0", "resource", 1, b"whole") + record("1.1", "resource", 2, b"cut short")[:-9])
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "c.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: 3")
    got = {r.header["warc-record-id"]: (r.complete, bytes(r.block)) for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert got == {"<urn:uuid:1>": (True, b"whole"), "<urn:uuid:2>": (False, b"cut "), "3": (False, b"")}


def test_derivatives_of_read_responses(spark, tmp_path):
    page = "<html lang=fr><title>Caf\xe9</title><p>un<p>deux <a href='/x'>x</a>"
    blocks = {
        1: http(page.encode("latin-1"), kind="text/html; charset=ISO-8859-1"),
        2: http(gzip.compress(page.encode()), "Content-Encoding: gzip\r\n", "text/html; charset=utf-8"),
        3: http(b"5\r\n<p>ab\r\n4;x=y\r\ncd<p\r\n3\r\n>ef\r\n0\r\n\r\n", "Transfer-Encoding: chunked\r\n"),
        4: http(b"1 < 2\r\n  two", kind="text/plain"),
        5: http(b"\x89PNG <p>no</p>", kind="image/png"),
        6: http(zlib.compress(page.encode()), "Content-Encoding: deflate\r\n"),
    }
    raw = [record("1.0", "response", n, b, b"WARC-Payload-Digest: sha1:OWN\r\n" if n == 2 else b"") for n, b in blocks.items()] + [record("1.0", "request", 7, b"GET / HTTP/1.1\r\n\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    rows = warc.derive(warc.responses_of(warc.read_records(spark, str(tmp_path)))).collect()
    assert len(rows) == 12
    text = {int(r.refers_to[10]): r.block for r in rows if r.record_type == "conversion"}
    assert text == {1: "Café\nun\ndeux x", 2: "Café\nun\ndeux x", 3: "ab" + "cd\nef", 4: "1 < 2\ntwo", 5: "", 6: "Café\nun\ndeux x"}
    meta = {int(r.refers_to[10]): r for r in rows if r.record_type == "metadata"}
    assert meta[2].source_digest == "sha1:OWN" and meta[5].source_digest == "sha256:" + hashlib.sha256(b"\x89PNG <p>no</p>").hexdigest()
    assert "language: fr\r\n" in meta[1].block and "outlink: /x\r\n" in meta[1].block and "source-http: Content-Type: image/png\r\n" in meta[5].block
    assert {r.date for r in rows if r.refers_to == "<urn:uuid:3>"} == {"2020-02-03T00:00:00Z"}


@pytest.mark.parametrize("version", ["WARC/1.0", "WARC/1.1"])
def test_pages_written_and_read_give_the_same_derivatives(spark, tmp_path, version):
    found = warc.responses(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    warc.write_responses(found, str(tmp_path / "w"), version)
    pick = ("record_type", "record_id", "refers_to", "target_uri", "date", "block_digest", "source_digest", "block")
    got = warc.derive(warc.responses_of(warc.read_records(spark, str(tmp_path / "w")))).select(*pick)
    assert sorted(got.collect()) == sorted(warc.derive(found).select(*pick).collect())


def test_awkward_markup():
    assert warc.plain_text('x<img alt="a>b">y<a href=\'c>d\'>z</a><b title="open>w') == "xyzw"
    assert warc.told('<a title="a>b" data-href="no" href="/yes">')[3] == ["/yes"]
    assert warc.visible("a<script>b</script >c<!-- d --><style>e") == "a c  "
    assert warc.visible("a<script b") == "a<script b" and warc.visible("a<script <!-- c") == "a<script  "
    assert warc.plain_text("1 < 2 &amp;lt; 3 &notaname; <3") == "1 < 2 &lt; 3 &notaname; <3"


@pytest.mark.parametrize("part", ["<title", "<title>", "<a ", '<a href="', "<a href='x", "<script", "<script>", "<!--", "<style ", "&nbsp;", " \n", "<", "</p", "<p =", "<meta charset=", "&#", "<a =\"'"])
@pytest.mark.parametrize("end", ["", ">", '">', "\n"])
def test_pages_take_linear_time(part, end):
    page = part * 60_000 + end
    began = time.perf_counter()
    markup = warc.visible(page)
    warc.told(markup)
    warc.plain_text(markup)
    assert time.perf_counter() - began < 5
