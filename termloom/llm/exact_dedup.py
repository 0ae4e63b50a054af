"""Exact duplicates through an extendible-hash index on shared files.

1. *Pages.* Every task normalises its texts and hashes them (64 bit). Copies inside one Arrow slice are compared byte
   by byte and collapse to one page row that carries the ids of its members. Texts a task has met before (as far as
   they fit a fixed amount of memory) leave it without their bytes, so a text that fills a third of the table is
   shuffled about once a task. The pages are written to the shared folder.
2. *Directory.* Bytes are counted by hash prefix. Starting from one bucket, the directory doubles as long as a bucket
   holds more bytes than its capacity: the bucket splits on the next hash bit and its halves get the directory slots.
   A bucket whose rows share the whole prefix can't split and stays as an overflow chain.
3. *Owners.* Consecutive buckets form key ranges of about equal bytes; each owner task reads one range sorted by hash,
   chains equal hashes, compares their bytes and names each page's group. It holds the distinct texts of one hash
   value only (one, unless hashes collide) and streams the rest.
4. *Groups.* Each group's smallest id and size are aggregated from the pages (partial sums first) and join back on
   the group, then on the page, which has no more members than a slice has rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text that a bucket holds before it splits.
BUCKET_BYTES = 4 << 20
#: Longest hash prefix the directory counts, in bits.
MAX_DEPTH = 20
#: Bytes of text of an owner's key range.
OWNER_BYTES = 48 << 20

#: Bytes of texts a task remembers, to send each of them once.
REMEMBERED_BYTES = 24 << 20
#: Owners at most; beyond, their ranges grow.
MOST_OWNERS = 20_000

_PAGES = pa.schema([
    ("page", pa.string()), ("entry", pa.string()), ("h", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()),
    ("n", pa.int64()), ("members", pa.list_(pa.int64())), ("sha", pa.string()), ("norm", pa.string()),
])
_PAGES_DDL = "page string, entry string, h long, bytes long, first_id long, n long, members array<long>, sha string, norm string"
_FOUND = pa.schema([("page", pa.string()), ("grp", pa.string()), ("first_id", pa.int64()), ("n", pa.int64())])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, serial = TaskContext.get().partitionId(), 0
    known: dict[str, tuple[str, int, str]] = {}
    held = 0
    for batch in common.in_slices(batches, 2048):
        seen: dict[str, list[int]] = {}  # keyed by the whole text: equality is that of bytes
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("norm").to_pylist(), strict=True):
            seen.setdefault(text, []).append(doc)
        out = {f.name: [] for f in _PAGES}
        for text, docs in seen.items():
            page = f"{task}-{serial}"
            serial += 1
            ids = [d for d in docs if d is not None]
            if (old := known.get(text)) is not None:
                entry, h, sha = old
                out["bytes"].append(0)
                out["norm"].append(None)
            else:
                raw = text.encode()
                entry, h, sha = page, xxhash.xxh64_intdigest(raw, 42) - (1 << 63), hashlib.sha256(raw).hexdigest()
                out["bytes"].append(len(raw))
                out["norm"].append(text)
                if held + 2 * len(raw) <= REMEMBERED_BYTES:
                    held += 2 * len(raw) + 200
                    known[text] = entry, h, sha
            out["page"].append(page)
            out["entry"].append(entry)
            out["h"].append(h)
            out["first_id"].append(min(ids) if ids else None)
            out["n"].append(len(docs))
            out["members"].append(docs)
            out["sha"].append(sha)
        yield common.table_batches(out, _PAGES)


def build_directory(size_of: dict[int, int], depth: int, capacity: int = BUCKET_BYTES) -> list[tuple[int, int, int]]:
    """Buckets as (first prefix, prefixes, bytes), in order of their prefixes of ``depth`` bits.

    ``size_of`` maps a prefix to its bytes. A bucket splits while it has over ``capacity`` bytes and bits remain.
    """
    size = np.zeros(1 << depth, dtype=np.int64)
    for prefix, total in size_of.items():
        size[prefix] = total
    before = np.concatenate([[0], np.cumsum(size)])
    buckets, done = [(0, 1 << depth)], []
    while buckets:  # one doubling of the directory a turn
        halves = []
        for at, width in buckets:
            total = int(before[at + width] - before[at])
            if total > capacity and width > 1:
                halves += [(at, width // 2), (at + width // 2, width // 2)]
            else:
                done.append((at, width, total))
        buckets = halves
    return sorted(done)


def owners_of(buckets: list[tuple[int, int, int]], owner_bytes: int) -> list[tuple[int, int]]:
    """(prefix, owner) for every prefix: owners take whole buckets in order, about equal bytes each."""
    slots, owner, held = [], 0, 0
    for at, width, total in buckets:
        if held and held + total > owner_bytes:
            owner, held = owner + 1, 0
        held += total
        slots += [(prefix, owner) for prefix in range(at, at + width)]
    return slots


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash, entry and whether their bytes are absent; equal hashes are resolved by their bytes."""
    head, texts, entry_at, at = None, {}, None, None
    for batch in common.in_slices(batches, 1024):
        out = {f.name: [] for f in _FOUND}
        cols = (batch.column(k).to_pylist() for k in ("h", "page", "entry", "first_id", "n", "norm"))
        for h, page, entry, first, n, text in zip(*cols, strict=True):
            if h != head:
                head, texts, entry_at = h, {}, None
            if entry != entry_at:
                entry_at, at = entry, texts.setdefault(text, entry)  # a dictionary compares the whole text
            out["page"].append(page)
            out["grp"].append(at)
            out["first_id"].append(first)
            out["n"].append(n)
        yield common.table_batches(out, _FOUND)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is an empty one. Of equal texts one row stays, one with the smallest doc_id; null ids come after all
    others, and a group of nothing but null ids keeps one of its rows and has a null keep_id. Repeated rows are members
    of their group like any other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.regexp_replace(common.text_or_empty(), common.SPACES, " ").alias("norm"))
    pages = common.staged(rows.mapInArrow(_pages, _PAGES_DDL), "dedup-pages")

    total = pages.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    depth = min(MAX_DEPTH, max(1, (4 * total // BUCKET_BYTES).bit_length()))
    cell = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - depth).cast("int")
    cells = pages.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("b")).collect()  # 2^MAX_DEPTH rows at most
    slots = owners_of(build_directory({r.cell: r.b for r in cells}, depth), max(OWNER_BYTES, total // MOST_OWNERS))
    directory = spark.createDataFrame(slots, "cell int, owner int")  # as many rows; its size is bounded by MAX_DEPTH

    index = common.staged(
        pages.select("h", "page", "entry", "first_id", "n", "norm", cell.alias("cell"))
        .join(F.broadcast(directory), "cell")
        .repartitionById(slots[-1][1] + 1, F.col("owner"))
        .sortWithinPartitions("h", "entry", F.col("norm").isNull())
        .select("h", "page", "entry", "first_id", "n", "norm")
        .mapInArrow(_chain, "page string, grp string, first_id long, n long"),
        "dedup-index",
    )
    groups = index.groupBy("grp").agg(
        F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "page")).alias("best"), F.sum("n").alias("group_size")
    )
    resolved = index.select("page", "grp").join(groups, "grp").select("page", "best", "group_size")
    members = pages.select("page", "sha", "members", F.posexplode("members").alias("at", "doc_id"))
    first_at = F.when(F.col("best.none"), F.lit(0)).otherwise(F.array_position("members", F.col("best.first_id")) - 1)
    return members.join(resolved, "page").select(
        "doc_id",
        F.col("best.first_id").alias("keep_id"),
        "group_size",
        ((F.col("page") == F.col("best.page")) & (F.col("at") == first_at)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns; rows repeated in full stay once."""
    found = exact_groups(docs).select("doc_id", "text_sha256", "kept")
    by_row = common.staged(found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "dedup-kept")
    stats = by_row.agg(F.count_if(~F.col("kept")).alias("dropped"), F.coalesce(F.max("rows"), F.lit(0)).alias("most")).first()
    key = F.sha2(F.regexp_replace(common.text_or_empty(), common.SPACES, " "), 256)
    rows = docs
    own, gone, sha = (common.scratch(docs, x) for x in ("own_sha", "dropped_id", "dropped_sha"))
    if stats.most > 1:
        rows = rows.withColumn(own, key).dropDuplicates(["doc_id", own]).drop(own)
    dropped = by_row.filter(~F.col("kept")).select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(sha))
    if stats.dropped <= common.BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, F.col("doc_id").eqNullSafe(F.col(gone)) & (key == F.col(sha)), "left_anti")
