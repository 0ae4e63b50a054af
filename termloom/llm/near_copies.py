"""Near copies in general: five-word shingles, Jaccard likeness of 0.8 or more, found by SimHash and verified on the texts.

Operator 4's own query has four-word shingles and links at four bits; that misses most pairs near 0.8. Here a fingerprint has
256 bits (four mixes of each distinct shingle's hash). Anchors cover blocks of sampled bits: the words of the perfect Hamming code
on 15 bits of a block, times all words of its other bits. As the covering radius is 1 and the threshold within a block is 0, a
fingerprint goes to the one anchor within 1 of it; texts up to two bits apart in a block share an anchor. Blocks are wide
enough that an anchor holds few texts and so many that of pairs with likeness 0.8 at most MISS meet at none; likelier pairs
meet nearly always. At an anchor all close pairs are taken; a group that has over MOST of them a text gives the shortest tree of its
close pairs first. What is close enough is verified on the shingle sets themselves, so no link is under the likeness asked for.
Where the first pass left texts of such groups that close pairs connect in several components, these components make a cluster, whose
texts of such groups meet once more, with their sets, in tiles: all close pairs of different components are verified inside the tiles' tasks,
which give only links that join components. None is left out, and no table has a row for each pair of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, contracted, with_least
from .simhash import _CODED, CHUNK, _nearest, shingle_hashes

SHINGLE = 5
LIKENESS = 0.8
WORDS = 4
BITS = 64 * WORDS
#: Share of pairs of just LIKENESS that may meet in no block.
MISS = 0.05
#: Groups up to this size are compared pair by pair.
SMALL = 8
#: Close pairs a text that a larger group gives at once; beyond that it gives a tree and its texts are looked at again.
MOST = 10
#: Rows of one of a cluster's chunks, at least and at most, the chunks of a cluster whose chunks can be larger, and shingles of a chunk.
FEW, MANY, CHUNKS, HELD = 128, CHUNK, 16, 1 << 21
_NAMES = [f"f{i}" for i in range(WORDS)]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def differing(likeness: float) -> float:
    """Share of bits in which the fingerprints of two sets of such a likeness differ: the angle of their vectors over pi."""
    return math.acos(2 * likeness / (1 + likeness)) / math.pi


#: Bits that a pair to verify differs in at most: the mean at LIKENESS and 2.5 standard deviations.
DISTANCE = round(BITS * differing(LIKENESS) + 2.5 * math.sqrt(BITS * differing(LIKENESS) * (1 - differing(LIKENESS))))


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits of a set of hashes; zeros for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    with np.errstate(over="ignore"):
        x = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        x ^= x >> np.uint64(31)
    for at in range(0, len(x), 255):  # sums fit a byte
        ones += np.unpackbits(x[at : at + 255].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def meeting(width: int, likeness: float = LIKENESS) -> float:
    """Share of pairs of such a likeness that have one anchor in a block of so many bits.

    Their other bits agree; of coded words one or two bits apart, one in eight has the same home.
    """
    d = differing(likeness)
    q = 1 - d
    n = _CODED
    return q ** (width - n) * (q**n + (n * d * q ** (n - 1) + math.comb(n, 2) * d**2 * q ** (n - 2)) / 8)


def blocks(rows: int) -> np.ndarray:
    """Places of bits, one row a block, coded ones first: wide enough for about four texts an anchor, as many as MISS asks for."""
    anchors = min(30, max(11, math.ceil(math.log2(max(2, rows))) - 2))  # the code has 2^11 words of 15 bits
    width = anchors + 4
    number = math.ceil(math.log(MISS) / math.log(1 - meeting(width)))
    rng = np.random.default_rng(20_804)
    found: list[np.ndarray] = []
    while len(found) < number:
        order = rng.permutation(BITS)
        found += [order[at : at + width] for at in range(0, BITS - width + 1, width)]
    return np.stack(found[:number])


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, set (128 bits that name the shingle set) and the fingerprint's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            sets = [shingle_set(t) for t in common.texts_of(batch)]
            prints = np.array([wide_print(s) for s in sets], dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = {"doc_id": batch.column("doc_id"), "set": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array(prints[:, i], pa.int64()) for i, k in enumerate(_NAMES)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, set binary, " + ", ".join(f"{k} long" for k in _NAMES))


def tree(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (places) within DISTANCE if they are at most MOST a row; else the edges of their shortest forest, by Prim's method,
    and of each row with such a pair the pair with itself."""
    n = len(prints)
    best, source, open_ = np.full(n, BITS + 1), np.zeros(n, dtype=np.int64), np.arange(n)
    left, right, at = [], [], 0
    ends: list[tuple[np.ndarray, np.ndarray]] | None = []
    held, linked = 0, np.zeros(n, dtype=bool)
    while True:
        open_ = open_[open_ != at]
        if not len(open_):
            break
        d = np.bitwise_count(prints[open_] ^ prints[at]).sum(axis=1, dtype=np.int64)
        near = open_[d <= DISTANCE]
        if len(near):
            linked[at] = True
            linked[near] = True
            held += len(near)
            if ends is not None:
                ends = [*ends, (np.full(len(near), at), near)] if held <= MOST * n else None
        nearer = open_[d < best[open_]]
        source[nearer] = at
        best[open_] = np.minimum(best[open_], d)
        at = open_[best[open_].argmin()]
        if best[at] <= DISTANCE:
            left.append(source[at])
            right.append(at)
    if ends is not None:
        x, y = (np.concatenate(e) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 2
        return x.astype(np.int64), y.astype(np.int64)
    again = np.flatnonzero(linked)
    return np.concatenate([np.array(left, dtype=np.int64), again]), np.concatenate([np.array(right, dtype=np.int64), again])


def _pairs_of(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places to verify among rows that come by key."""
    edges = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
    sizes = np.repeat(ends - starts, ends - starts)
    left, right = [], []
    for step in range(1, SMALL):
        a = np.flatnonzero((key[:-step] == key[step:]) & (sizes[:-step] <= SMALL))
        a = a[np.bitwise_count(prints[a] ^ prints[a + step]).sum(axis=1, dtype=np.int64) <= DISTANCE]
        left.append(a)
        right.append(a + step)
    for a, b in zip(starts[ends - starts > SMALL].tolist(), ends[ends - starts > SMALL].tolist(), strict=True):
        x, y = tree(prints[a:b])
        left.append(x + a)
        right.append(y + a)
    return np.concatenate(left), np.concatenate(right)


def _pairs_apart(key: np.ndarray, prints: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All close pairs of places with one key and different roots, a row's at a time; groups of one root give none."""
    edges = np.flatnonzero(key[1:] != key[:-1]) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
        if (root[a:b] == root[a]).all():
            continue
        for at in range(a, b - 1):
            others = at + 1 + np.flatnonzero(root[at + 1 : b] != root[at])
            near = others[np.bitwise_count(prints[others] ^ prints[at]).sum(axis=1, dtype=np.int64) <= DISTANCE]
            if len(near):
                yield np.full(len(near), at), near


def joining(prints: np.ndarray, root: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, likeness: float) -> Iterator[tuple[int, int]]:
    """Links (places) that join rows of different roots: every close pair of those is tried on its shingles, if its rows aren't joined yet.

    ``shingles`` holds the rows' sets one after another, ``sizes`` their lengths.
    """
    label = np.unique(root, return_inverse=True)[1].astype(np.int64)
    names, ids = np.unique(shingles, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    own = np.zeros(len(names), dtype=bool)
    for at, near in _pairs_apart(np.zeros(len(root), dtype=np.int64), prints, root):
        at = int(at[0])
        near = near[label[near] != label[at]]
        if not len(near):
            continue
        mine = ids[starts[at] : starts[at] + sizes[at]]
        own[mine] = True
        n = sizes[near]
        places = np.arange(n.sum()) + np.repeat(starts[near] - (np.cumsum(n) - n), n)
        common_ = np.bincount(np.repeat(np.arange(len(near)), n), weights=own[ids[places]], minlength=len(near))
        own[mine] = False
        union = n + sizes[at] - common_
        alike = near[(union == 0) | (common_ >= likeness * union)]
        labels, first = np.unique(label[alike], return_index=True)
        yield from ((at, int(alike[i])) for i in first)
        label[np.isin(label, labels)] = label[at]


def _join(likeness: float):
    """Of rows sorted by (key, salt): the links of each tile, which is held alone."""

    def links_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(parts).combine_chunks()
        node, root = tile.column("node").to_numpy(), tile.column("root").to_numpy()
        prints = np.stack([tile.column(k).to_numpy() for k in _NAMES], axis=1).view(np.uint64)
        sets = tile.column("shingles").combine_chunks()
        sizes = pa.compute.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
        found = np.array(list(joining(prints, root, sets.flatten().to_numpy(), sizes, likeness)), dtype=np.int64).reshape(-1, 2)
        a, b = node[found[:, 0]], node[found[:, 1]]
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                now = (key[start], salt[start])
                if held and now != head:
                    yield from links_of(held)
                    held = []
                head = now
                held.append(batch.slice(start, end - start))
        if held:
            yield from links_of(held)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, salt); whole groups are compared, the last one waits for its end."""
    seen: list[tuple[np.ndarray, ...]] = []
    held = 0

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal seen, held
        key, node, prints = (np.concatenate(x) for x in zip(*seen, strict=True))
        end = len(key) if last else int(np.searchsorted(key, key[-1]))  # keys are numbered in order
        seen, held = ([(key[end:], node[end:], prints[end:])], len(key) - end) if end < len(key) else ([], 0)
        if end < 2:
            return
        a, b = _pairs_of(key[:end], prints[:end])
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(node[a], node[b])), "b": pa.array(np.maximum(node[a], node[b]))})

    number, head = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
        new = np.concatenate([[head is not None and head != (key[0], salt[0])], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        numbers = number + np.cumsum(new)
        number, head = int(numbers[-1]), (key[-1], salt[-1])
        prints = np.stack([batch.column(k).to_numpy() for k in _NAMES], axis=1).view(np.uint64)
        seen.append((numbers, batch.column("node").to_numpy(), prints))
        held += batch.num_rows
        if held >= 32_768:
            yield from cut(False)
    if seen:
        yield from cut(True)


def candidates(nodes: DataFrame, rows: int, chunk: int = CHUNK) -> DataFrame:
    """Distinct pairs (a, b) of ``nodes`` (node, f0, ...) that meet at an anchor and differ in at most DISTANCE bits; of dense groups a tree."""
    return _met(nodes, rows, chunk).filter("a <> b")


def _met(nodes: DataFrame, rows: int, chunk: int = CHUNK) -> DataFrame:
    """The same pairs, and the pair with itself of each node of a dense group."""
    own = ["node", *_NAMES]
    places = blocks(rows)
    powers = (1 << np.arange(places.shape[1], dtype=np.int64))[None, None, :]
    coded = (1 << _CODED) - 1

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _nearest(np.arange(coded + 1, dtype=np.uint64)).astype(np.int64)
        for batch in common.in_slices(batches, 1024):
            prints = np.stack([batch.column(k).to_numpy() for k in _NAMES], axis=1)
            bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
            values = (bits[:, places] * powers).sum(axis=2)
            keys = values & ~coded | nearest[values & coded] | (np.arange(len(places), dtype=np.int64) << 40)
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(places)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *batch.take(at).columns], names=["key", *own])

    longs = ", ".join(f"{k} long" for k in ("key", *own))
    placed = nodes.select(*own).mapInArrow(replicas, longs)
    hot = common.staged(placed.groupBy("key").count().filter(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("c")), "hot-blocks")
    if hot.count() <= common.BROADCAST_ROWS:
        hot = F.broadcast(hot)
    placed = placed.join(hot, "key", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    return _tiles(placed, own).mapInArrow(_compare, "a long, b long").distinct()


def _tiles(placed: DataFrame, own: list[str]) -> DataFrame:
    """key, salt and the own columns, dealt and sorted: a group of c chunks becomes a piece for each pair of chunks."""
    part = F.pmod(F.xxhash64(*_NAMES), F.col("c")).cast("int")
    salts = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.least(j, part) * F.col("c") + F.greatest(j, part))
    salts = F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(salts)
    pieces = placed.select("key", F.explode(salts).alias("salt"), *own)
    return pieces.repartition("key", "salt").sortWithinPartitions("key", "salt", "node")


def _ids_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    name = common.scratch(docs, "wanted_id")
    ids = ids.select(F.col("doc_id").alias(name)).distinct()
    # a null id is a key like any other, and no condition but an equality is left
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")


def rooted(docs: DataFrame, nodes: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """node, root of the nodes that links join to others: the least node that links of sets as alike as asked reach.

    Links are joined once: what comes after them is of their roots, as more links of one component tell nothing.
    """
    rows = nodes.count()
    met = common.staged(_met(nodes, rows), "near-pairs")
    dense = common.staged(met.filter("a = b").select(F.col("a").alias("node")).distinct(), "near-dense")
    tried = common.staged(_tried(docs, nodes, met.filter("a <> b"), dense, likeness), "near-tried")
    roots = common.staged(components(tried.filter("alike").select("a", "b")), "near-roots")
    # what the trees of dense groups left apart: clusters of several components that close pairs connect
    close = tried.filter("dense and not alike").select("a", "b")
    if close.isEmpty():
        return roots
    clusters = common.staged(components(contracted(close, roots)).select(F.col("node").alias("root"), F.col("root").alias("key")), "near-clusters")
    if clusters.isEmpty():
        return roots
    members = dense.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    apart = common.staged(members.join(clusters, "root").select("key", "node", "root"), "near-apart")
    held = _shingles(docs, nodes, apart.select("node")).withColumn("n", F.size("shingles"))
    held = common.staged(apart.join(nodes.select("node", *_NAMES), "node").join(held, "node"), "near-tiles")
    chunks = F.greatest(F.ceil(F.count("*") / MANY), F.least(F.lit(CHUNKS), F.ceil(F.count("*") / FEW)), F.ceil(F.sum("n") / HELD))
    sizes = common.staged(held.groupBy("key").agg(chunks.cast("int").alias("c")), "near-chunks")
    if sizes.count() <= common.BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    tiles = _tiles(held.join(sizes, "key"), ["node", "root", *_NAMES, "shingles"])
    joined = components(contracted(tiles.mapInArrow(_join(likeness), "a long, b long"), roots)).withColumnRenamed("root", "least")
    known = roots.unionByName(apart.select("node", "root")).distinct()
    return known.join(joined.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("least", "root").alias("root"))


def _tried(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, dense: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) of nodes; alike: whether their shingle sets are as alike as asked; dense: whether both are in ``dense`` (node)."""
    held = _shingles(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    held = held.join(dense.withColumn("dense", F.lit(True)), "node", "left")
    side = lambda k: held.select(F.col("node").alias(k), F.col("shingles").alias("s" + k), F.coalesce("dense", F.lit(False)).alias("d" + k))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("n", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("n")
    return both.select("a", "b", ((union == 0) | (F.col("n") >= likeness * union)).alias("alike"), (F.col("da") & F.col("db")).alias("dense"))


def _shingles(docs: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """node, shingles of the nodes of ``ends`` (node, distinct), from their texts."""
    wanted = common.staged(nodes.join(ends, "node").select("node", "set", F.col("least").alias("doc_id")), "near-ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            found = [shingle_set(t) for t in common.texts_of(batch)]
            arrays = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"set": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), "shingles": arrays})

    texts = _ids_in(docs, wanted).select("text").mapInArrow(run, "set binary, shingles array<bigint>")
    return common.staged(texts.join(wanted.select("node", "set"), "set").select("node", "shingles").dropDuplicates(["node"]), "near-shingles")


def near_groups(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """doc_id, component_id of each row: the smallest doc_id that links of near copies reach; null ids come last."""
    common.prepare(docs.sparkSession)
    sets = common.staged(_sets(docs), "near-sets")
    nodes = sets.groupBy("set").agg(F.min("doc_id").alias("least"), *[F.first(k).alias(k) for k in _NAMES])
    # in order of sets: the same texts are compared in the same order in every run
    nodes = common.staged(nodes.orderBy("set").select(F.monotonically_increasing_id().alias("node"), "*"), "near-nodes")
    labelled = nodes.join(rooted(docs, nodes, likeness), "node", "left").select("set", "least", F.coalesce("root", "node").alias("root"))
    by_root = with_least(labelled, "set")
    return sets.select("doc_id", "set").join(by_root, "set").select("doc_id", "component_id")


def keep_first(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """The rows of ``docs`` with all their columns, but of each group of near copies only those with the smallest doc_id.

    Rows that share an id stay or go together, and an id stays if it is the smallest of any group; null ids count as one such
    id, the largest.
    """
    kept = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stats = common.staged(near_groups(docs, likeness).groupBy("doc_id").agg(kept.alias("kept")), "near-kept")
    dropped = stats.filter(~F.col("kept"))
    return common.without(docs, dropped, dropped.count())
