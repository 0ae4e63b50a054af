"""SimHash near-duplicates by anchor-point covering.

*Fingerprints.* 64 bits; a bit is set if it is set in over half of the hashes of the word shingles.

*Covering.* The 64 bits form blocks, and *covers* of some of the blocks together, such that of two fingerprints that differ in
at most four bits one cover differs in at most one (pigeonhole); each cover is searched with threshold 1. With three
blocks the covers are the blocks (21 or 22 bits); with five blocks their ten pairs (25 or 26 bits), as the two blocks with the fewest
differences have one at most together; with six blocks their twenty triples (31 to 33 bits). More bits mean more anchors and fewer
comparisons, more covers mean more replicas: ``covers_for`` takes what costs least for the number of fingerprints.
A cover's anchors are the words of a covering code: the perfect Hamming code of 15 bits (covering radius 1) times all words
of the cover's other bits. A fingerprint lies within radius 1 of one nearest anchor, its *home*. It is replicated to every anchor
within radius plus threshold of it, that is to each anchor which is the home of something that differs from it in at most one
of the cover's bits. Two linked fingerprints therefore meet at each other's homes.

*Comparison.* At each anchor the homes are compared with all arrivals by exact bit counts, in breadth-first order. What a
search has reached isn't compared again, so a dense group of n costs some n comparisons and gives about n links,
not all pairs, and no connection is lost: every pair of one anchor is either compared or connected there already. Anchors with
many more arrivals than most are salted: homes are split into chunks, each of which meets all arrivals' chunks in tasks of
their own.

*Components.* Links join by alternating stars; copies with one fingerprint stand for each other throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, with_least

SHINGLE = 4
DISTANCE = 4
_CODED = 15
#: Arrivals that one task compares in a piece, at least; an anchor with more, and with four times the mean, is salted.
CHUNK = 4096
#: Comparisons that cost as much as writing, sorting and reading one replica.
COMPARISONS_A_REPLICA = 2_000

#: A cover is a tuple of (lowest bit, bits) of its blocks.
Cover = tuple[tuple[int, int], ...]


def covers(blocks: int, joined: int) -> list[Cover]:
    """All sets of ``joined`` of the ``blocks`` blocks of 64 bits. Of four differences at most one must be able to fall in one."""
    # the fewest differences that leave two: two in every block but joined - 1, or one in every block but joined - 2
    if min(2 * (blocks - joined + 1), blocks - joined + 2 if joined > 1 else DISTANCE + 1) <= DISTANCE:
        raise ValueError("some four differences leave two in every cover")
    ends = [64 * i // blocks for i in range(blocks + 1)]
    return list(combinations([(a, b - a) for a, b in zip(ends, ends[1:], strict=False)], joined))


#: The ways to cover, from few replicas to few comparisons.
WAYS = (covers(3, 1), covers(5, 2), covers(6, 3))


def expected(way: list[Cover], rows: int) -> tuple[float, float]:
    """Replicas, and comparisons, of a fingerprint among so many that are spread evenly."""
    bits = [sum(n for _, n in cover) for cover in way]
    arrivals = [1 + (_CODED - 1) / 2 + n - _CODED for n in bits]
    return sum(arrivals), sum(rows * a / 2.0 ** (n - 4) for a, n in zip(arrivals, bits, strict=True))


def covers_for(rows: int) -> list[Cover]:
    """The way with the least cost for so many distinct fingerprints."""

    def cost(way: list[Cover]) -> float:
        replicas, comparisons = expected(way, rows)
        return replicas + comparisons / COMPARISONS_A_REPLICA

    return min(WAYS, key=cost)


_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _SPACE else b for b in range(256))


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text's words, repeats included; none for a text without words."""
    raw = text.encode().translate(_LOWER)
    words = [w for w in raw.split(b" ") if w]
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.array(found, dtype=np.uint64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (a long that holds the 64 bits) of each row; null and empty texts have 0."""
    common.prepare(docs.sparkSession)

    def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            found = np.array([fingerprint(t, width) for t in common.texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found, pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_prints, "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Of 15-bit words: the exclusive or of the places (1 to 15) of their set bits; 0 for words of the Hamming code."""
    out = np.zeros(len(words), dtype=np.uint64)
    for place in range(1, _CODED + 1):
        out ^= ((words >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return out


def _nearest(words: np.ndarray) -> np.ndarray:
    """The Hamming codeword within distance 1."""
    places = _syndromes(words)
    flip = np.where(places > 0, np.uint64(1) << (np.maximum(places, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return words ^ flip


def homes(blocks: np.ndarray) -> np.ndarray:
    """The nearest anchor of each block value: its low 15 bits corrected, the other bits as they are."""
    low = blocks & np.uint64((1 << _CODED) - 1)
    return (blocks ^ low) | _nearest(low)


def anchors(blocks: np.ndarray, bits: int) -> list[np.ndarray]:
    """Each column: an anchor of every block value. Together they are all homes of values within distance 1, home first.

    Rows may repeat an anchor; the caller drops repeats.
    """
    return [homes(blocks)] + [homes(blocks ^ np.uint64(1 << bit)) for bit in range(bits)]


def cut(fps: np.ndarray, cover: Cover) -> tuple[np.ndarray, int]:
    """The bits of a cover's blocks, side by side, and their number."""
    value, bits = np.zeros(len(fps), dtype=np.uint64), 0
    for lowest, width in cover:
        value |= ((fps >> np.uint64(lowest)) & np.uint64((1 << width) - 1)) << np.uint64(bits)
        bits += width
    return value, bits


def _replicas(batches: Iterator[pa.RecordBatch], way: list[Cover]) -> Iterator[pa.RecordBatch]:
    """fp to (anchor key, home or not, fp)."""
    for batch in common.in_slices(batches, 4096):
        fps = batch.column("fp").to_numpy().astype(np.int64)
        for number, cover in enumerate(way):
            columns = np.stack(anchors(*cut(fps.view(np.uint64), cover)), axis=1)
            columns[:, 1:].sort(axis=1)
            new = np.ones(columns.shape, dtype=bool)
            new[:, 2:] = columns[:, 2:] != columns[:, 1:-1]
            new[:, 1:] &= columns[:, 1:] != columns[:, :1]
            row, column = np.nonzero(new)
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array((columns[row, column] | np.uint64(number << 40)).astype(np.int64), pa.int64()),
                "home": pa.array(column == 0, pa.bool_()),
                "fp": pa.array(fps[row], pa.int64()),
            })


def star_links(homes_: np.ndarray, others: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the pairs of a home and any member within ``distance`` connect.

    Each home starts or continues a breadth-first search. It is compared with all homes that no search has reached yet
    and with all others that its own search hasn't reached; a search that reaches an other again joins what it meets.
    """
    if len(homes_) == 1:
        near = others[np.bitwise_count(others ^ homes_[0]) <= distance]
        return np.full(len(near), homes_[0]), near
    left, right = [], []
    waiting = homes_
    while len(waiting):
        stack, waiting, rest = [waiting[0]], waiting[1:], others
        while stack and (len(waiting) or len(rest)):
            fp = stack.pop()
            near = np.bitwise_count(waiting ^ fp) <= distance
            if near.any():
                found = waiting[near]
                left.append(np.full(len(found), fp))
                right.append(found)
                stack += list(found)
                waiting = waiting[~near]
            near = np.bitwise_count(rest ^ fp) <= distance
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), fp))
                right.append(found)
                rest = rest[~near]
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come grouped by (anchor, salt), homes first; a group is gathered, compared and let go."""
    left, right, held = [], [], 0
    head, homes_, arrivals = None, [], []

    def close() -> None:
        nonlocal held
        if head is None:
            return
        h = np.concatenate(homes_)
        if not len(h):
            return
        a, b = star_links(h, np.concatenate(arrivals))
        if len(a):
            left.append(a)
            right.append(b)
            held += len(a)

    def links() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(left).view(np.int64)), "b": pa.array(np.concatenate(right).view(np.int64))})

    for batch in batches:
        anchor, salt = batch.column("anchor").to_numpy(), batch.column("salt").to_numpy()
        home, fp = batch.column("home").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
            if (key := (anchor[a], salt[a])) != head:
                close()
                head, homes_, arrivals = key, [], []
            mine = home[a:b]
            homes_.append(fp[a:b][mine])
            arrivals.append(fp[a:b][~mine])
            if held >= 65_536:
                yield links()
                left, right, held = [], [], 0
    close()
    if held:
        yield links()


def fingerprint_links(prints: DataFrame, chunk: int = CHUNK, way: list[Cover] | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within DISTANCE bits."""
    spark = prints.sparkSession
    common.prepare(spark)
    distinct = prints.select("fp").distinct()
    if way is None:
        rows = distinct.count()
        way = covers_for(rows)
        replicas, comparisons = expected(way, rows)
        chunk = max(chunk, int(4 * comparisons / replicas))

    def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _replicas(batches, way)

    placed = common.staged(distinct.mapInArrow(_placed, "anchor long, home boolean, fp long"), "replicas")
    # an anchor with n arrivals becomes c x c pieces, c = ceil(n / chunk): home chunk i meets arrival chunk j
    hot = placed.groupBy("anchor").count().filter(F.col("count") > chunk).select("anchor", F.ceil(F.col("count") / chunk).cast("int").alias("pieces"))
    hot = common.staged(hot, "hot-anchors")
    if hot.count() <= common.BROADCAST_ROWS:
        hot = F.broadcast(hot)
    placed = placed.join(hot, "anchor", "left").withColumn("c", F.coalesce("pieces", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    own, other = F.sequence(F.lit(0), F.col("c") - 1), F.sequence(F.lit(0), F.col("c") - 1)
    spread = F.when(F.col("c") == 1, F.array(F.struct(F.col("home").alias("as_home"), F.lit(0).alias("salt")))).otherwise(
        F.concat(
            F.when(F.col("home"), F.transform(own, lambda j: F.struct(F.lit(True).alias("as_home"), (part * F.col("c") + j).alias("salt")))).otherwise(F.array().cast("array<struct<as_home:boolean,salt:int>>")),
            F.transform(other, lambda i: F.struct(F.lit(False).alias("as_home"), (i * F.col("c") + part).alias("salt"))),
        )
    )
    pieces = placed.select("anchor", "fp", F.explode(spread).alias("p")).select("anchor", F.col("p.salt").alias("salt"), F.col("p.as_home").alias("home"), "fp")
    return pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home")).mapInArrow(_compare, "a long, b long")


def near_groups(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits), component_id for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. Null and empty texts have fingerprint
    zero and link like any other. Null ids come after all others: a component of nothing but null ids has a null
    component_id. Repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """
    prints = common.staged(fingerprints(docs, width), "simhash")
    by_print = common.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(fingerprint_links(by_print))
    labelled = by_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = with_least(labelled, "fp")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(by_root, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with all their columns, but of each group of near copies only those with the smallest doc_id.

    An id names a document: rows that share an id stay or go together, and an id stays if it is the smallest of any group.
    Null ids count as one such id, the largest.
    """
    kept = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stats = common.staged(near_groups(docs, width).groupBy("doc_id").agg(kept.alias("kept")), "simhash-kept")
    dropped = stats.filter(~F.col("kept"))
    return common.without(docs, dropped, dropped.count())
