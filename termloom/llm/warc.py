"""WARC derivatives: metadata and plain-text conversion records from response records.

Every response gives two linked records. Both keep its target URI and date, refer to its record id
(``WARC-Refers-To``) and carry its payload digest and, in the metadata block, its own header lines; both have a block digest
and a content length of their own. The metadata block is ``application/warc-fields``: title, language, character set and
outlinks. The conversion block is the page's text.

Responses come from crawled pages (``responses``) or from WARC files (``responses_of(read_records(...))``). Files are cut at
version lines of WARC/1.0 and 1.1 by Spark's own text reader, so any store will do, and put together again by content
length: a block that holds version lines stays one. Mark-up is scanned by Python over Arrow batches, in one run along the text:
tags end at the ``>`` that no quoted value holds, and nothing is looked for twice where it wasn't found, so time goes with
the length of a page, whatever is unclosed. There is no shuffle.
Record ids are name-based: the same response gives the same ids in every run and after any lost executor.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

VERSION = "WARC/1.1"
#: Capture date of pages that carry none.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

#: Character entities that most pages have, and what they give here (fixed values); all others are as HTML has them.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "),
    ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"),
)

#: Tags that end a line (fixed values).
_BLOCKS = "p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|aside|main|nav|header|footer|title|body|blockquote|pre|form|option"
#: Patterns of the given statement, which looks at the whole page by regular expressions.
_HIDDEN = r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<noscript\b[^>]*>.*?(?:</noscript\s*>|\z)|<!--.*?(?:-->|\z)"
_BLOCK = rf"(?i)</?(?:{_BLOCKS})\b[^>]*>"
_TAG = r"<[/!?]?[A-Za-z][^>]*>"
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
_LANG = r"(?is)<html\b[^>]*?\blang=[\"']?([A-Za-z-]+)"
_CHARSET = r"(?is)<meta\b[^>]*?\bcharset=[\"']?([A-Za-z0-9_-]+)"
#: Links as the given statement has them; the scan also takes single quotes, none, and blanks around the sign.
_LINK = r"(?is)<a\b[^>]*?\bhref=\"([^\"<>]*)\""

#: The rest of a tag: up to the next > that isn't in a quoted value.
_REST = r"""(?>[^>=]+|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>"""
_OPEN_HIDDEN = re.compile(r"<(?:(script|style|noscript)\b|!--)", re.IGNORECASE)
_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in ("script", "style", "noscript")} | {"": re.compile("-->")}
_ANY_TAG = re.compile(rf"<(?:/?({_BLOCKS})\b|[/!?]?[A-Za-z]){_REST}", re.IGNORECASE)
_TOLD = re.compile(rf"<(a|html|meta)\b{_REST}", re.IGNORECASE)
_TITLE_OPEN, _TITLE_CLOSE = re.compile(r"<title\b[^>]*+>", re.IGNORECASE), re.compile("</title", re.IGNORECASE)
_HREF = re.compile(r"""(?<![\w-])href\s*+=\s*+(?:"([^"<>]*)"|'([^'<>]*)'|([^\s"'<>]+))""", re.IGNORECASE)
_LANG_VALUE = re.compile(r"""\blang=["']?([A-Za-z-]+)""", re.IGNORECASE)
_CHARSET_VALUE = re.compile(r"""\bcharset=["']?([A-Za-z0-9_-]+)""", re.IGNORECASE)
_REFERENCE = re.compile(r"&(?:#([0-9]{1,9}|[xX][0-9A-Fa-f]{1,8})|([A-Za-z][A-Za-z0-9]{1,31}));")
_OWN = dict(ENTITIES)
_BLANKS = re.compile(r"[ \t\r\n\f]{2,}|[\t\r\n\f]")
_LINES = re.compile(r"(?<![ \xa0])[ \xa0]*+\n[ \xa0\n]*+")


def _uuid(name: Column) -> Column:
    """A URN of 128 bits of a digest of the name, marked as a name-based (version 8) id."""
    h = F.sha2(name, 256)
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">")
    )


def decoded(text: str) -> str:
    """Character references as what they stand for; unknown names stay as they are."""
    return _REFERENCE.sub(_character, text) if "&" in text else text


def _character(m: re.Match) -> str:
    if (own := _OWN.get(m[0])) is not None:
        return own
    return html.unescape(m[0]) if m[1] else html5.get(m[2] + ";", m[0])


def visible(markup: str) -> str:
    """Mark-up without scripts, styles and comments; what isn't closed ends with the page."""
    out, at, kept, last = [], 0, 0, markup.rfind(">")
    while opened := _OPEN_HIDDEN.search(markup, at):
        name, end = (opened[1] or "").lower(), opened.end()
        if name and not (end := markup.find(">", end, last + 1) + 1):
            at = opened.end()  # no tag
            continue
        out += [markup[kept : opened.start()], " "]
        closed = _CLOSE[name].search(markup, end)
        at = kept = closed.end() if closed else len(markup)
    return "".join(out) + markup[kept:] if out else markup


def plain_text(markup: str) -> str:
    """Visible mark-up without its tags: block tags end lines, white space is one blank, empty lines are dropped."""
    text = _BLANKS.sub(" ", markup)
    end = text.rfind(">") + 1  # no tag ends behind it
    text = _ANY_TAG.sub(lambda m: "\n" if m[1] else "", text[:end]) + text[end:]
    return _LINES.sub("\n", decoded(text)).strip(" \n")


def told(markup: str) -> tuple[str, str, str, list[str]]:
    """Title, language, character set and outlinks of visible mark-up; empty where it tells none."""
    title, language, charset, links = "", "", "", []
    end = markup.rfind(">") + 1
    if (opened := _TITLE_OPEN.search(markup, 0, end)) and (closed := _TITLE_CLOSE.search(markup, opened.end())):
        title = re.sub(r"[ \t\r\n\f]+", " ", decoded(markup[opened.end() : closed.start()])).strip(" ")
    for m in _TOLD.finditer(markup, 0, end):
        name, tag = m[1].lower(), m[0]
        if name == "a":
            if found := _HREF.search(tag):
                links.append(re.sub(r"[\r\n]+", " ", decoded(found[1] or found[2] or found[3] or "")))
        elif name == "html" and not language:
            language = found[1] if (found := _LANG_VALUE.search(tag)) else ""
        elif name == "meta" and not charset:
            charset = found[1] if (found := _CHARSET_VALUE.search(tag)) else ""
    return title, language, charset, links


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_id, target_uri, date, http_headers, payload of crawled pages (page_id, url, html).

    A null page has an empty payload, a null URL an empty URI. Rows that are equal throughout have one record id.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("target_uri"), F.coalesce("html", F.lit("")).alias("payload"))
    length = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF))
    digest = F.sha2("payload", 256)
    rows = rows.withColumn("payload_digest", F.concat(F.lit("sha256:"), digest))
    name = F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri", "payload_digest")
    return rows.select("page_id", _uuid(name).alias("record_id"), "target_uri", F.lit(date).alias("date"), http.alias("http_headers"), "payload_digest", "payload")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.in_slices(batches):
        fields, texts = [], []
        for payload in batch.column("payload").to_pylist():
            markup = visible(payload or "")
            title, language, charset, links = told(markup)
            fields.append("".join(f"{line}{CRLF}" for line in (f"title: {title}", f"language: {language}", f"charset: {charset}", *(f"outlink: {u}" for u in links))))
            texts.append(plain_text(markup))
        kept = batch.select(["page_id", "record_id", "target_uri", "date", "http_headers", "payload_digest"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(fields, pa.string()), pa.array(texts, pa.string())], names=[*kept.schema.names, "told", "text"])


def derive(found: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata and its conversion record.

    page_id, record_type, record_id, refers_to, target_uri, date, content_type, content_length (bytes), block_digest,
    source_digest (the response's payload), block. Extra columns are ignored; empty payloads give empty conversions.
    """
    common.prepare(found.sparkSession)
    rows = found.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload_digest", "payload")
    rows = rows.mapInArrow(_scan, "page_id long, record_id string, target_uri string, date string, http_headers string, payload_digest string, told string, text string")
    fields = F.concat(
        F.lit("source-record: "), "record_id", F.lit(f"{CRLF}source-payload-digest: "), "payload_digest",
        F.lit(f"{CRLF}source-http: "), F.replace(F.regexp_replace("http_headers", r"\r\n\z", ""), F.lit(CRLF), F.lit(f"{CRLF}source-http: ")),
        F.lit(CRLF), "told",
    )
    two = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    )
    rows = rows.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_digest"), F.explode(two).alias("r"))
    rows = rows.select("page_id", "refers_to", "target_uri", "date", "source_digest", "r.*")
    return rows.select(
        "page_id", "record_type", _uuid(F.concat_ws("|", "record_type", "refers_to")).alias("record_id"), "refers_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), F.concat(F.lit("sha256:"), F.sha2("block", 256)).alias("block_digest"), "source_digest", "block",
    )


def record_text(found: DataFrame) -> DataFrame:
    """Derived records as WARC text, one record a row."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    text = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("source_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
        F.lit(CRLF), F.col("block"), F.lit(CRLF),
    )
    return found.select(text.alias("value"))  # the writer's line end is the record's last CRLF


def write_warc(found: DataFrame, path: str, compression: str = "gzip") -> None:
    """Derived records as WARC files through Spark's own writer, so any store that Spark writes to will do."""
    record_text(found).write.option("lineSep", CRLF).option("compression", compression).text(path)


def write_responses(found: DataFrame, path: str, version: str = VERSION, compression: str = "gzip") -> None:
    """Responses (as ``responses`` gives them) as WARC files."""
    block = F.concat("http_headers", F.lit(CRLF), "payload")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    text = F.concat(
        F.lit(version + CRLF), line("WARC-Type", F.lit("response")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")),
        line("WARC-Payload-Digest", F.col("payload_digest")), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block, F.lit(CRLF),
    )
    found.select(text.alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)


#: What files are cut at; the version's last figure begins a piece.
_CUT = "WARC/1."
#: Bytes of a record's header at most; beyond, it isn't taken for one.
MOST_HEADER = 1 << 20
_RECORDS_DDL = "version string, header map<string,string>, content_length long, block binary, complete boolean"


def _header(raw: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").splitlines():
        name, sign, value = line.partition(":")
        if sign:
            key, value = name.strip().lower(), value.strip()
            found[key] = f"{found[key]}, {value}" if key in found else value
    return found


class _Record:
    """A record as its pieces come in."""

    def __init__(self, piece: bytes):
        self.raw = bytearray(piece)
        self.end = self.length = -1  # of the header, and of the block
        self.fields: dict[str, str] = {}
        self.look()

    def add(self, piece: bytes) -> None:
        self.raw += _CUT.encode() + piece
        self.look()

    def look(self) -> None:
        if self.end >= 0:
            return
        if m := re.search(rb"\r?\n\r?\n", self.raw[: MOST_HEADER + 4]):
            self.end = m.end()
            self.fields = _header(bytes(self.raw[1 : m.start()]))
            length = self.fields.get("content-length", "")
            self.length = int(length) if length.isdigit() else -1
        elif len(self.raw) > MOST_HEADER:
            self.end = len(self.raw)

    def row(self) -> tuple[str, dict[str, str], int | None, bytes, bool]:
        if self.end < 0:  # the file ends in the header
            self.end, self.fields = len(self.raw), _header(bytes(self.raw[1:]))
        at = self.end
        block = bytes(self.raw[at : at + self.length] if self.length >= 0 else self.raw[at:])
        return _CUT + chr(self.raw[0]), self.fields, self.length if self.length >= 0 else None, block, self.length >= 0 and len(block) == self.length


def _rows_of(records: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*records, strict=True))
    types = (pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary(), pa.bool_())
    names = ("version", "header", "content_length", "block", "complete")
    values = [columns[0], [list(h.items()) for h in columns[1]], *columns[2:]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)


_STARTS = re.compile(rb"[01]\r?\n")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, split's start, number in the split, place in the split, piece) of pieces as they come."""
    where, number, place = None, 0, 0
    for got in batches:
        for file, start, piece in zip(*(got.column(k).to_pylist() for k in ("file", "start", "value")), strict=True):
            if where != (file, start):
                where, number, place = (file, start), 0, 0
            yield file, start, number, place, piece
            number, place = number + 1, place + len(piece) + len(_CUT)


_MEASURED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("reach", pa.int64()), ("head", pa.binary())])
_SEVERAL = pa.schema([("file", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("record", pa.int64()), ("place", pa.int64())])
_BLANK = re.compile(rb"\r?\n\r?\n")


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's place and, if it may begin a record, how far that record's block goes (-1: no length told; null: no start).

    head holds what a header may go on with: the piece up to its first empty line, where it begins a header that it doesn't end, where
    the piece before it in the split has no empty line, and at a split's first piece.
    """

    def rows() -> Iterator[tuple]:
        open_ = True
        for file, start, number, place, piece in _pieces(batches):
            blank = _BLANK.search(piece)
            reach, begun = None, False
            if _STARTS.match(piece):
                record = _Record(piece)
                begun = record.end < 0
                reach = record.end + record.length if record.end >= 0 and record.length >= 0 else -1
            head = piece[: blank.end() if blank else MOST_HEADER + 4] if begun or open_ or not number else None
            yield file, start, number, place, len(piece) + len(_CUT), reach, head
            open_ = blank is None

    yield from _batched(rows(), _MEASURED)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a file come in order, as numbers only: one that starts before the last record's block ends belongs to that.

    Gives the pieces of records of several pieces, with their record's place. State is one record's header, whatever the file's size.
    """

    def rows() -> Iterator[tuple]:
        where, end, at, first, told, header = None, 0, None, None, False, None
        for got in batches:
            for file, start, number, place, reach, head in zip(*(got.column(k).to_pylist() for k in ("file", "start", "number", "at", "reach", "head")), strict=True):
                if where != file:
                    where, at, header = file, None, None
                if at is not None and (header is not None or place - len(_CUT) < end):
                    if not told:
                        yield first
                        told = True
                    yield file, start, number, at, place
                    if header is not None:
                        header.add(head or b"")
                elif reach is not None:
                    at, first, told = place, (file, start, number, place, place), False
                    end, header = place + reach if reach >= 0 else 0, _Record(head) if reach < 0 and head is not None else None
                else:
                    at = None  # what stands between records
                if header is not None and header.end >= 0:
                    end, header = at + header.end + header.length if header.length >= 0 else 0, None

    yield from _batched(rows(), _SEVERAL)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one piece each; other pieces stand between records."""
    rows, held = [], 0
    for got in batches:
        for piece in got.column("value").to_pylist():
            if _STARTS.match(piece):
                rows.append(_Record(piece).row())
                held += len(rows[-1][3])
            if len(rows) >= 256 or held >= 8 << 20:
                yield _rows_of(rows)
                rows, held = [], 0
    if rows:
        yield _rows_of(rows)


def _joined_record(pieces: pa.Table) -> pa.Table:
    values = pieces.sort_by("place").column("value").to_pylist()
    record = _Record(values[0])
    for piece in values[1:]:
        record.add(piece)
    return pa.Table.from_batches([_rows_of([record.row()])])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("value", pa.binary())])
    for file, start, number, _, piece in _pieces(batches):
        rows.append((file, start, number, piece))
        held += len(piece)
        if len(rows) >= 1024 or held >= 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC/1.0 and 1.1 files: version, header (map, names in lower case), content_length, block (bytes), complete.

    ``complete`` is false where the file ends before the block does, or the header tells no length. Files are cut at version lines
    wherever Spark splits them; which of these begin records is settled by the records' lengths from the file's first byte on, in one pass
    over numbers: a piece's place comes from the sizes of the splits before its own. Only pieces of blocks that hold version
    lines move between tasks; all other records stay where they were read. Files are read twice. An empty folder or file has no records.
    """
    common.prepare(spark)
    rows = spark.read.option("lineSep", _CUT).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    sizes = common.staged(rows.mapInArrow(_measure, "file string, start long, number long, place long, size long, reach long, head binary"), "warc-pieces")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = sizes.groupBy("file", "start").agg(F.sum("size").alias("size")).select("file", "start", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    placed = sizes.join(splits, ["file", "start"]).select("file", "start", "number", "reach", "head", (F.col("base") + F.col("place")).alias("at"))
    walked = placed.repartition("file").sortWithinPartitions("file", "at").mapInArrow(_walk, "file string, start long, number long, record long, place long")
    several = common.staged(walked, "warc-several")
    known = F.broadcast(several) if several.count() <= common.BROADCAST_ROWS else several
    pieces = rows.mapInArrow(_numbered, "file string, start long, number long, value binary")
    keys = ["file", "start", "number"]
    alone = pieces.join(known.select(*keys), keys, "left_anti").select("value").mapInArrow(_alone, _RECORDS_DDL)
    apart = pieces.join(known, keys).select("file", "record", "place", "value").groupBy("file", "record").applyInArrow(_joined_record, _RECORDS_DDL)
    return alone.unionByName(apart)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``read_records`` with the blocks as text: header, content_length, block, complete."""
    return read_records(spark, path).select("header", "content_length", F.decode("block", "utf-8").alias("block"), "complete")


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]{0,200}\r\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            break
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out) if out else body


def http_payload(block: bytes) -> tuple[str, bytes, str]:
    """Header lines, payload (transfer and content encodings undone) and text of an HTTP response; no text for other media types."""
    m = re.search(rb"\r?\n\r?\n", block[:MOST_HEADER])
    head, body = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    lines = head.decode("utf-8", "replace").splitlines()
    fields = _header(head.split(b"\n", 1)[1] if b"\n" in head else b"")
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    for encoding in reversed(fields.get("content-encoding", "").lower().split(",")):
        if encoding.strip() in ("gzip", "x-gzip", "deflate"):
            try:
                body = zlib.decompressobj(47 if "gzip" in encoding else 15).decompress(body)
            except zlib.error:
                break  # sent as it is, whatever the header says
    kind = fields.get("content-type", "text/html").lower()
    if not kind.startswith(("text/", "application/xhtml")):
        return CRLF.join(lines) + CRLF, body, ""
    charset = re.search(r"""charset=["']?([\w.:-]+)""", kind) or re.search(r"""(?i)<meta\b[^>]{0,500}charset=["']?([\w.:-]+)""", body[:4096].decode("latin-1"))
    try:
        text = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    if not kind.startswith(("text/html", "application/xhtml")):  # plain text keeps its lines and signs
        text = "<br>".join(html.escape(line, quote=False) for line in text.splitlines())
    return CRLF.join(lines) + CRLF, body, text


def responses_of(records: DataFrame) -> DataFrame:
    """The responses among ``read_records`` in the form of ``responses``, with null page ids: input for ``derive``.

    The payload digest is the record's own where it has one. Incomplete records give what they hold.
    """
    common.prepare(records.sparkSession)
    ddl = "page_id long, record_id string, target_uri string, date string, http_headers string, payload_digest string, payload string"
    wanted = ("warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest")

    def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            out = {k: [] for k in ("page_id", "record_id", "target_uri", "date", "http_headers", "payload_digest", "payload")}
            for values in zip(*(batch.column(k).to_pylist() for k in (*wanted, "block")), strict=True):
                record, uri, date, digest, block = values
                lines, body, text = http_payload(block or b"")
                row = (None, record or "", uri or "", date or "", lines, digest or "sha256:" + hashlib.sha256(body).hexdigest(), text)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), *(pa.array(v, pa.string()) for k, v in out.items() if k != "page_id")], names=list(out))

    rows = records.filter(F.col("header")["warc-type"] == "response").select(*[F.col("header")[k].alias(k) for k in wanted], "block")
    return rows.mapInArrow(_rows, ddl)


def oracle() -> str:
    """DuckDB SQL of ``derive(responses(pages))``, by regular expressions over the whole page instead of a scan."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    nl = "chr(13) || chr(10)"

    def decoded(x: str) -> str:
        for entity, char in ENTITIES:
            x = f"replace({x}, {quote(entity)}, {quote(char)})"
        return x

    def uuid(h: str) -> str:
        return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-8' || {h}[14:16] || '-a' || {h}[18:20] || '-' || {h}[21:32] || '>'"

    text = f"trim(regexp_replace({decoded(f"regexp_replace(regexp_replace(regexp_replace(markup, '[ \\t\\r\\n\\f]+', ' ', 'g'), {quote(_BLOCK)}, chr(10), 'g'), {quote(_TAG)}, '', 'g')")}, '[ \\x{{a0}}]*\\n[ \\x{{a0}}\\n]*', chr(10), 'g'), ' ' || chr(10))"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest FROM pages),
n AS (SELECT *, sha256('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || target_uri || '|' || payload_digest) AS h FROM p),
r AS (SELECT *, {uuid('h')} AS refers_to, regexp_replace(payload, {quote(_HIDDEN)}, ' ', 'g') AS markup FROM n),
m AS (SELECT page_id, refers_to, target_uri, payload_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
  'source-record: ' || refers_to || {nl} || 'source-payload-digest: ' || payload_digest || {nl} || 'source-http: HTTP/1.1 200 OK' || {nl}
  || 'source-http: Content-Type: text/html; charset=utf-8' || {nl} || 'source-http: Content-Length: ' || octet_length(encode(payload)) || {nl}
  || 'title: ' || trim(regexp_replace({decoded(f"regexp_extract(markup, {quote(_TITLE)}, 1)")}, '[ \\t\\r\\n\\f]+', ' ', 'g')) || {nl}
  || 'language: ' || regexp_extract(markup, {quote(_LANG)}, 1) || {nl} || 'charset: ' || regexp_extract(markup, {quote(_CHARSET)}, 1) || {nl}
  || coalesce(array_to_string([ 'outlink: ' || regexp_replace(replace(u, '&amp;', '&'), '[\\r\\n]+', ' ', 'g') || {nl} for u in regexp_extract_all(markup, {quote(_LINK)}, 1)], ''), '') AS block FROM r),
c AS (SELECT page_id, refers_to, target_uri, payload_digest, 'conversion' AS record_type, 'text/plain' AS content_type, {text} AS block FROM r),
a AS (SELECT *, sha256(record_type || '|' || refers_to) AS h FROM (SELECT * FROM m UNION ALL SELECT * FROM c))
SELECT page_id, record_type, {uuid('h')} AS record_id, refers_to, target_uri, '{DATE}' AS date, content_type, octet_length(encode(block)) AS content_length,
  'sha256:' || sha256(block) AS block_digest, payload_digest AS source_digest, block FROM a
"""
