"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every five-word shingle is hashed once. The hash's low part names one of BINS bins, its high part is the value, and each bin
keeps its minimum. An empty bin copies the bin that a random order of its own, the same for all documents, meets first
among the bins that aren't empty; two documents with equal bins therefore copy alike, and the copied bins' collisions stay
unbiased and nearly independent. Of each bin's value only the low-order bits are stored, packed. Two fingerprints agree
by chance in 2^-BITS of the bins that differ, so likeness is (agreeing share - 2^-BITS) / (1 - 2^-BITS), at least 0.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
BINS = 512
BITS = 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Place of bin b in the order of bin i, for densification.
_ORDER = np.random.default_rng(20_011).permuted(np.tile(np.arange(BINS, dtype=np.int16), (BINS, 1)), axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``width`` words; one of all words of a shorter text, so that the empty text has one too."""
    words = text.split()
    digest = xxhash.xxh3_64_intdigest
    own = np.array([digest(w) for w in words], dtype=np.uint64)
    if len(own) < width:
        rest = np.full(1, _STEP + np.uint64(len(own)), dtype=np.uint64)
        for h in own:
            rest = _mixed(rest * _M2 + h)
        return rest
    found = np.zeros(len(own) - width + 1, dtype=np.uint64)
    for k in range(width):
        found = _mixed(found * _STEP + own[k : len(own) - width + 1 + k])
    return found


def sketch(text: str, width: int = SHINGLE) -> np.ndarray:
    """The BITS low-order bits of each bin, one byte a bin."""
    with np.errstate(over="ignore"):
        hashes = shingle_hashes(text, width)
    bins = np.full(BINS, _NONE, dtype=np.uint64)
    at = (hashes & np.uint64(BINS - 1)).astype(np.int64)
    np.minimum.at(bins, at, hashes >> np.uint64(9))
    full = np.flatnonzero(bins != _NONE)
    if len(full) < BINS:
        empty = np.flatnonzero(bins == _NONE)
        source = full[_ORDER[np.ix_(empty, full)].argmin(axis=1)] if len(full) > 1 else full[0]
        bins[empty] = bins[source]
    # values are mixed with their bin's number: low bits are even, and bins that copied one value agree by chance each on its own
    with np.errstate(over="ignore"):
        bins = _mixed(bins + np.arange(1, BINS + 1, dtype=np.uint64) * _STEP)
    return (bins & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(bins: np.ndarray) -> str:
    """Hexadecimal digits, the first bin's bits highest."""
    bits = (bins[:, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(bits).tobytes().hex()


def unpacked(fingerprint: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)).reshape(-1, BITS)
    return (bits << np.arange(BITS - 1, -1, -1, dtype=np.uint8)).sum(axis=1).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of two sketches, with the bias of chance agreement removed."""
    chance = 2.0**-BITS
    return float(max(0.0, ((a == b).mean() - chance) / (1 - chance)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row; a null text counts as empty, equal texts have equal fingerprints."""
    common.prepare(docs.sparkSession)

    def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array([packed(sketch(t)) for t in common.texts_of(batch)], pa.string())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_prints, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by the first as many, or all, of another's."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


#: Documents of a range of ids, about; ranges are the unit that one task walks in order of ids.
RANGE_ROWS = 4_000
MOST_RANGES = 20_000


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of ``docs``.

    The next document is the next row by ascending (doc_id, text), null ids first and null texts as empty ones; after the
    last comes the first. Rows that repeat are rows like any other. Texts move once, to ranges of ids; a range also gets
    the first row of the range after it, whose place is known from the ranges' smallest ids. An id that would fill ranges of
    its own (null, say) is cut further by how its texts begin. A table of one row is its own next; an empty one gives no rows.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("doc_id").isNull().alias("none"), common.text_or_empty().alias("text"))
    count = rows.count()
    ranges = min(MOST_RANGES, max(1, -(-count // RANGE_ROWS)))
    quantiles = lambda df, column, n: df.approxQuantile(column, [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    found = Counter(int(c) for c in quantiles(rows, "id", ranges))
    hot = {i: n for i, n in found.items() if n > 1}
    # the first bytes of a text as a number, in the order of texts
    begin = F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(0))
    rows = rows.withColumn("begin", F.when(F.col("id").isin(list(hot)), begin).otherwise(0) if hot else F.lit(0).cast("long"))
    cuts = sorted({(i, 0) for i in found} | {(i, int(c)) for i, n in hot.items() for c in quantiles(rows.filter(F.col("id") == i), "begin", n + 1)})

    def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [bisect_right(cuts, key) for key in zip(batch.column("id").to_pylist(), batch.column("begin").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int32())], names=[*batch.schema.names, "range"])

    ranged = rows.select("id", "begin").mapInArrow(_ranged, "id long, begin long, range int")
    heads = ranged.groupBy("range").agg(F.min(F.struct("id", "begin")).alias("head")).orderBy("range").collect()  # a row for each range
    before = {tuple(heads[i].head): heads[i - 1].range for i in range(len(heads))} if heads else {}
    return _walk(rows, cuts, before)


def _walk(rows: DataFrame, cuts: list[tuple[int, int]], before: dict[tuple[int, int], int]) -> DataFrame:
    ranges = len(cuts) + 1

    def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row for its own range, and the first keys of ranges also for the range before."""
        for batch in common.in_slices(batches, 4096):
            ids = list(zip(batch.column("id").to_pylist(), batch.column("begin").to_pylist(), strict=True))
            at = list(range(len(ids))) + [i for i, d in enumerate(ids) if d in before]
            own = [bisect_right(cuts, d) for d in ids] + [before[d] for d in ids if d in before]
            guest = [False] * len(ids) + [True] * (len(at) - len(ids))
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(own, pa.int32()), pa.array(guest, pa.bool_())], names=["id", "none", "text", "begin", "range", "guest"])

    def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range, the range's own before guests, then id and text."""
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        last = None  # (range, id or none, text, sketch)

        def emit(doc: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> None:
            changed = edited(text, following)
            new = sketch(changed) if changed != text else own
            out["doc_id"].append(doc)
            out["n_chars"].append(len(text))
            out["edited_sha256"].append(hashlib.sha256(changed.encode()).hexdigest())
            out["fingerprint"].append(packed(own))
            out["edited_fingerprint"].append(packed(new))
            out["near_edited"].append(likeness(own, new))
            out["near_next"].append(likeness(own, other))

        for batch in common.in_slices(batches):
            for where, guest, i, none, text in zip(*(batch.column(k).to_pylist() for k in ("range", "guest", "id", "none", "text")), strict=True):
                if guest and (last is None or last[0] != where):
                    continue  # a further row with the first id of the next range
                own = sketch(text)
                if last is not None and last[0] == where:
                    emit(last[1], last[2], last[3], text, own)
                last = None if guest else (where, None if none else i, text, own)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, _TYPES[k]) for k, v in out.items()})
            for v in out.values():
                v.clear()

    dealt = rows.mapInArrow(_dealt, "id long, none boolean, text string, begin long, range int, guest boolean")
    ordered = dealt.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "guest", F.col("none").cast("int") * -1, "id", "text")
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_pairs, ddl)


_TYPES = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
