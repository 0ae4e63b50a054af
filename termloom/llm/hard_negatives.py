"""Hard negatives by score windows: a vantage-point tree over norm-augmented vectors, searched nearest first.

Every vector x gets one more component, sqrt(M^2 - |x|^2), M being the largest norm, so that all have the norm M. An anchor q
gets a zero there: its squared distance to a row is |q|^2 + M^2 - 2 q.x, so the nearest row has the highest inner product and a
window of scores is an annulus of distances.

One tree, fitted on a bounded sample, cuts the space into cells; every row is put into its cell, and large cells are dealt
into blocks of some BLOCK_ROWS rows, by a running number, so that a vector that a third of all rows share fills many blocks.
A task gets one block of rows and one block of requests (anchor and window), builds the block's own tree, whose nodes know the
least and greatest distance of their rows to the vantage point, and walks it nearest first inside the annulus until it has k
rows of the wanted label. A search has two rounds: in the anchor's own cell, whose k-th score then narrows the window, and in
every other cell that the window still meets. Both are exact: bounds carry slack for rounding, scores are integers.

Odd rows: rows with a null id, label, vector or component, or with a component that is NaN or infinite, take no part; vectors
of fewer components than the longest count as padded with zeros; components may be as large as a 4-byte float holds; repeated rows are rows each, but an anchor that is repeated
whole is one anchor; a positive has another id than its anchor; scores beyond a long are held at its ends; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: Every ANCHORS-th id is an anchor; it has so many positives, each with so many negatives.
ANCHORS, POSITIVES, NEGATIVES = 100, 5, 5

#: Vectors on which the tree over cells is fitted: some so many, twice as many at most.
SAMPLE_ROWS = 8192

#: Rows of a block, about; anchors of a block of requests; rows of a leaf in a block's own tree.
BLOCK_ROWS, BLOCK_ANCHORS, LEAF_ROWS = 2048, 256, 128

#: The tree has a cell for so many sample rows at most.
CELL_SAMPLE = 16

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (shifted for every seventh id) and embedding of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(whole).select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


_PACKED = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("wide", T.BooleanType()), T.StructField("most", T.DoubleType()), T.StructField("norm2", T.DoubleType())]
)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Floor of 256 times each component, as 4-byte floats where these hold it exactly, else as 8-byte ones."""
    for batch in batches:
        lists = batch.column(2)
        ends, flat = np.asarray(lists.offsets), np.floor(256.0 * np.asarray(lists.values, dtype=np.float64))
        out: dict[str, list] = {"vec": [], "wide": [], "most": [], "norm2": []}
        for a, b in zip(ends[:-1], ends[1:]):
            v = flat[a:b]
            most = float(np.abs(v).max(initial=0.0))
            out["wide"].append(most > 1 << 24)
            out["vec"].append(v.astype("<f8" if most > 1 << 24 else "<f4").tobytes())
            out["most"].append(most)
            out["norm2"].append(float(v @ v))
        yield common.table_batches({"vec_id": batch.column(0), "label": batch.column(1), **out}, to_arrow_schema(_PACKED))


def _matrix(vecs: list[bytes], wide: list[bool], dim: int) -> np.ndarray:
    """Packed vectors as rows of doubles, padded with zeros."""
    if vecs and not any(wide) and all(len(v) == 4 * dim for v in vecs):
        return np.frombuffer(b"".join(vecs), "<f4").reshape(len(vecs), dim).astype(np.float64)
    out = np.zeros((len(vecs), dim))
    for i, (v, w) in enumerate(zip(vecs, wide)):
        x = np.frombuffer(v, "<f8" if w else "<f4")
        out[i, : len(x)] = x
    return out


@dataclass(frozen=True)
class Space:
    """What all vectors share: dimensions, the square of the largest norm, and whether products of doubles are exact."""

    dim: int
    m2: float
    exact: bool

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.m2 - (x * x).sum(axis=1)))])

    def whole(self, x: np.ndarray) -> np.ndarray:
        """Components for exact products: doubles, or Python's integers where sums may pass 2^53."""
        return x if self.exact else np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)

    def scores(self, near: np.ndarray, far: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest and least score that distances from ``near`` to ``far`` allow; reach = |q|^2 + M^2. With slack for rounding."""
        slack, one = 1e-6 * np.sqrt(reach), 1 + 1e-9 * reach
        return (reach - np.maximum(0.0, near - slack) ** 2) / 2 + one, (reach - (far + slack) ** 2) / 2 - one


def _distances(points: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((points - p) ** 2).sum(axis=1)))


@dataclass(frozen=True)
class Tree:
    """The cells: vantage points with radii; children of 0 and more are nodes, others are cells (-1 is cell 0)."""

    space: Space
    points: np.ndarray
    radii: np.ndarray
    children: list[tuple[int, int]]
    cells: int

    @staticmethod
    def fit(sample: np.ndarray, space: Space, cells: int) -> Tree:
        """Halves the sample at the median distance to a vantage point until there are ``cells`` parts or a part is too small."""
        lifted, points, radii, children, done = space.lifted(sample), [], [], [], 0
        least = max(CELL_SAMPLE, -(-len(sample) // max(1, cells)))
        stack: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
        while stack:
            at, parent, side = stack.pop()
            split = None
            if len(at) >= 2 * least:
                start = _distances(lifted[at], lifted[at[0]])
                vantage = lifted[at[int(start.argmax())]]
                d = _distances(lifted[at], vantage)
                radius = float(np.median(d))
                if (inside := d <= radius).any() and not inside.all():
                    split = (at[inside], at[~inside])
            me = len(points) if split else -1 - done
            if parent >= 0:
                children[parent][side] = me
            if split:
                points.append(vantage)
                radii.append(radius)
                children.append([0, 0])
                stack += [(split[1], me, 1), (split[0], me, 0)]  # inner parts first: cells get numbers in the order of the tree
            else:
                done += 1
        return Tree(space, np.array(points).reshape(len(points), space.dim + 1), np.array(radii), [tuple(c) for c in children], done)

    def cell_of(self, lifted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lifted), dtype=np.int32)
        stack = [(0, np.arange(len(lifted)))] if self.children else []
        while stack:
            node, at = stack.pop()
            inside = _distances(lifted[at], self.points[node]) <= self.radii[node]
            for child, part in zip(self.children[node], (at[inside], at[~inside])):
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    stack.append((child, part))
        return out

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and cell the greatest and least score that a row there can have."""
        reach = (q * q).sum(axis=1) + self.space.m2
        near, far = np.zeros((len(q), self.cells)), np.full((len(q), self.cells), np.inf)
        stack = [(0, np.zeros(len(q)), np.full(len(q), np.inf))] if self.children else []
        while stack:
            node, low, high = stack.pop()
            d = np.sqrt(np.maximum(0.0, reach - 2 * (q @ self.points[node][:-1])))
            r = self.radii[node]
            for child, a, b in zip(self.children[node], (np.maximum(low, d - r), np.maximum(low, r - d)), (np.minimum(high, d + r), high)):
                if child < 0:
                    near[:, -1 - child], far[:, -1 - child] = a, b
                else:
                    stack.append((child, a, b))
        return self.space.scores(near, far, reach[:, None])


class Block:
    """One block's own tree: nodes with a vantage row and, for either child, its rows' least and greatest distance; leaves of rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, space: Space, leaf_rows: int = LEAF_ROWS):
        self.ids, self.labels, self.x, self.whole, self.space = ids, labels, x, space.whole(x), space
        lifted = space.lifted(x)
        self.vantage: list[int] = []
        self.steps: list[tuple[int, int, float, float, bool]] = []  # (node, child, least, greatest, whether the child is a leaf), parents first
        self.leaves: list[np.ndarray] = []
        stack = [(np.arange(len(ids)), -1, 0.0, np.inf)]
        while stack:
            at, parent, least, greatest = stack.pop()
            split = None
            if len(at) > leaf_rows:
                vantage = at[int(_distances(lifted[at], lifted[at[0]]).argmax())]
                d = _distances(lifted[at], lifted[vantage])
                inside = d <= np.median(d)
                split = None if inside.all() else [(at[k], d[k]) for k in (inside, ~inside)]
            me = len(self.vantage) if split else len(self.leaves)
            if parent >= 0:
                self.steps.append((parent, me, least, greatest, split is None))
            if split:
                self.vantage.append(int(vantage))
                stack += [(part, me, float(d.min()), float(d.max())) for part, d in split]
            else:
                self.leaves.append(at)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and leaf the greatest and least score that a row there can have."""
        reach = (q * q).sum(axis=1) + self.space.m2
        shape = (len(q), len(self.leaves))
        near, far = np.zeros(shape), np.full(shape, np.inf)
        if self.vantage:
            to = np.sqrt(np.maximum(0.0, reach[:, None] - 2 * (q @ self.x[self.vantage].T)))
            low, high = {0: np.zeros(len(q))}, {0: np.full(len(q), np.inf)}
            for node, child, least, greatest, leaf in self.steps:
                d = to[:, node]
                closer, farther = np.maximum(low[node], np.maximum(d - greatest, least - d)), np.minimum(high[node], d + greatest)
                if leaf:
                    near[:, child], far[:, child] = closer, farther
                else:
                    low[child], high[child] = closer, farther
        return self.space.scores(near, far, reach[:, None])

    def asked(self, q: np.ndarray, ids: list[int], labels: list[int], same: bool, windows: list[list[tuple[int, int, int]]], k: int) -> Iterator[tuple[int, int, int, int]]:
        """The first k rows of each anchor's windows (name, low, high) as (anchor's place, window's name, score, id).

        An anchor goes through the leaves that its windows meet, the one with the greatest bound first, and yields rows in order
        of score as soon as no unseen leaf can hold a higher one; it ends when each window has k rows or is passed.
        """
        most, least = self.bounds(q)
        whole = self.space.whole(q)
        for a, own in enumerate(windows):
            low, high = min(w[1] for w in own), max(w[2] for w in own)
            meets = most[a] >= low
            if high < _MOST:
                meets &= least[a] <= high
            leaves = np.flatnonzero(meets)
            leaves = leaves[np.argsort(-most[a, leaves], kind="stable")]
            left, heap = {w: k for w, _, _ in own}, []
            for leaf in [*leaves, None]:
                bound = _LEAST - 1 if leaf is None else most[a, leaf]
                while heap and -heap[0][0] > bound and left:
                    score, vec_id, at, s, rows = heapq.heappop(heap)
                    for name, w_low, w_high in own:
                        if name in left:
                            if -score < w_low:
                                del left[name]
                            elif -score <= w_high:
                                yield a, name, -score, vec_id
                                left[name] -= 1
                                if not left[name]:
                                    del left[name]
                    if at + 1 < len(s):
                        heapq.heappush(heap, (-int(s[at + 1]), int(rows[at + 1]), at + 1, s, rows))
                if not left or leaf is None:
                    break
                at = self.leaves[leaf]
                s = np.clip(self.whole[at] @ whole[a], _LEAST, _MOST)
                fits = (s >= low) & (s <= high)
                if not fits.any():
                    continue
                fits &= (self.labels[at] == labels[a]) & (self.ids[at] != ids[a]) if same else self.labels[at] != labels[a]
                s, rows = s[fits], self.ids[at][fits]
                if len(s):
                    order = np.lexsort((rows, -s))
                    heapq.heappush(heap, (-int(s[order[0]]), int(rows[order[0]]), 0, s[order], rows[order]))


_FOUND = T.StructType([T.StructField("anchor", T.StringType()), T.StructField("window", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("vec_id", T.LongType())])


def _search(space: Space, k: int, same: bool):
    schema = to_arrow_schema(_FOUND)

    def search(rows: pa.Table, requests: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in schema}
        if rows.num_rows and requests.num_rows:
            x = _matrix(rows.column("vec").to_pylist(), rows.column("wide").to_pylist(), space.dim)
            block = Block(np.asarray(rows.column("vec_id")), np.asarray(rows.column("label")), x, space)
            q = _matrix(requests.column("vec").to_pylist(), requests.column("wide").to_pylist(), space.dim)
            names, ids, labels = (requests.column(c).to_pylist() for c in ("anchor", "anchor_id", "label"))
            windows = [[(w["window"], w["low"], w["high"]) for w in own] for own in requests.column("windows").to_pylist()]
            for a, window, score, vec_id in block.asked(q, ids, labels, same, windows, k):
                for name, value in (("anchor", names[a]), ("window", window), ("score", score), ("vec_id", vec_id)):
                    out[name].append(value)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in schema})

    return search


def _with_cells(tree, column: str):
    """Adds to each row its cell, or to each request all cells that its window meets but its own."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = tree.value
            x = _matrix(batch.column("vec").to_pylist(), batch.column("wide").to_pylist(), t.space.dim)
            points = np.column_stack([x, np.zeros(len(x))]) if column == "home" else t.space.lifted(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t.cell_of(points))], [*batch.schema.names, column])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = tree.value
            x = _matrix(batch.column("vec").to_pylist(), batch.column("wide").to_pylist(), t.space.dim)
            most, least = t.bounds(x)
            windows = batch.column("windows").to_pylist()
            low, high = (np.array([f(w[c] for w in own) for own in windows], dtype=np.float64)[:, None] for c, f in (("low", min), ("high", max)))
            meets = (most >= low) & ((least <= high) | (high >= _MOST))
            meets[np.arange(len(x)), np.asarray(batch.column("home"))] = False
            cells = pa.array([np.flatnonzero(m).astype(np.int32) for m in meets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, column])

    return others if column == "cells" else home


def _mapped(df: DataFrame, tree, column: str) -> DataFrame:
    kind = T.ArrayType(T.IntegerType()) if column == "cells" else T.IntegerType()
    return df.mapInArrow(_with_cells(tree, column), T.StructType([*df.schema.fields, T.StructField(column, kind)]))


@dataclass(frozen=True)
class Index:
    """Every usable row in its cell and block, the tree over the cells, and each cell's number of blocks."""

    rows: DataFrame
    tree: object
    space: Space
    parts: DataFrame


def build(embeddings: DataFrame, block_rows: int = BLOCK_ROWS) -> Index:
    spark = embeddings.sparkSession
    packed = common.staged(usable(embeddings).mapInArrow(_packed, _PACKED), "negatives-vectors")
    n, dim, most, m2 = packed.agg(F.count(F.lit(1)), F.max(F.when(F.col("wide"), F.length("vec") / 8).otherwise(F.length("vec") / 4)), F.max("most"), F.max("norm2")).first()
    space = Space(int(dim or 0), float(m2 or 0.0), (most or 0.0) ** 2 * (dim or 0) < 1 << 53)
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(42)), F.lit(1 << 32)) < int((1 << 32) * min(1.0, SAMPLE_ROWS / max(1, n)))
    sample = packed.where(drawn).select("vec", "wide").limit(2 * SAMPLE_ROWS).collect()
    tree = Tree.fit(_matrix([bytes(r.vec) for r in sample], [r.wide for r in sample], space.dim), space, -(-n // block_rows))
    tree = spark.sparkContext.broadcast(tree)
    rows = _mapped(packed.select("vec_id", "label", "vec", "wide"), tree, "cell").withColumn("seq", F.monotonically_increasing_id())
    rows = common.staged(rows, "negatives-cells")
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))  # a row a cell, SAMPLE_ROWS / 8 at most
    return Index(rows, tree, space, F.broadcast(common.staged(parts, "negatives-parts")))


def _grid(index: Index, wanted: DataFrame, k: int, same: bool) -> DataFrame:
    """Deals blocks of rows to the blocks of requests that want their cells, and searches each pair in a task of its own."""
    pairs = wanted.select("cell", "group").distinct()
    pairs = common.staged(pairs, "negatives-pairs")
    if pairs.count() <= common.BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    rows = index.rows.join(index.parts, "cell").withColumn("part", F.pmod(F.col("seq"), F.col("parts"))).join(pairs, "cell")
    asked = wanted.join(index.parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keys = ["cell", "part", "group"]
    rows = rows.select(*keys, "vec_id", "label", "vec", "wide").groupBy(*keys)
    return rows.cogroup(asked.groupBy(*keys)).applyInArrow(_search(index.space, k, same), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each anchor and window, with their places from 1; tasks cut their own rows to k before the shuffle."""
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(index: Index, requests: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor, window, place, score and vec_id of the first k rows of each request's windows: rows of the anchor's label but of
    other ids (``same``), or rows of other labels.

    requests: anchor (a key), anchor_id, label, vec, wide, home (its cell), group (its block of requests) and windows, an array
    of (window: a name, low and high: scores, inclusive).
    """
    near = common.staged(_first(_grid(index, requests.withColumn("cell", F.col("home")), k, same), k), "negatives-home")
    kth = near.where(F.col("place") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    raised = lambda w: F.struct(w["window"].alias("window"), F.coalesce(F.try_element_at("kth", w["window"]), w["low"]).alias("low"), w["high"].alias("high"))
    rest = requests.join(kth, "anchor", "left").withColumn("windows", F.transform("windows", raised)).select(*requests.columns)
    rest = _mapped(rest, index.tree, "cells").withColumn("cell", F.explode("cells")).drop("cells")
    far = _grid(index, common.staged(rest, "negatives-requests"), k, same)
    return common.staged(_first(near.drop("place").unionByName(far), k), "negatives-found")


def anchors(index: Index, chosen: Column, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """The chosen rows as anchors, each once, in blocks of neighbours of some BLOCK_ANCHORS."""
    rows = index.rows.where(chosen).withColumn("anchor", F.sha2(F.concat(F.concat_ws(":", "vec_id", "label", "wide").cast("binary"), F.col("vec")), 256))
    rows = _mapped(rows.dropDuplicates(["anchor"]).select("anchor", F.col("vec_id").alias("anchor_id"), "label", "vec", "wide"), index.tree, "home")
    rows = common.staged(rows, "negatives-anchors")
    by_cell = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    cells = rows.groupBy("home").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by_cell), F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("anchor"), F.col("n"))
    return rows.join(F.broadcast(cells), "home").withColumn("group", F.floor(place / block_anchors)).drop("n", "before")


def mine(
    embeddings: DataFrame, every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor and each of its first
    positives, the first rows of other labels whose score is 0.8 to 1 times the positive's."""
    index = build(embeddings, block_rows)
    asking = anchors(index, F.col("vec_id") % every == 0, block_anchors)
    window = lambda name, low, high: F.struct(name.cast("int").alias("window"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    everything = F.array(window(F.lit(0), F.lit(_LEAST), F.lit(_MOST)))
    found = nearest(index, asking.withColumn("windows", everything), positives, same=True)
    found = found.select("anchor", F.col("place").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    high = F.col("positive_score")
    low = high - F.floor(high / F.lit(5).cast("decimal(1,0)")).cast("long")  # the least score of which 100 times is 80 times the positive's or more
    windows = found.where("positive_score >= 0").groupBy("anchor").agg(F.collect_list(window(F.col("window"), low, high)).alias("windows"))
    hard = nearest(index, asking.join(windows, "anchor"), negatives, same=False)
    hard = hard.select("anchor", "window", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = hard.join(found, ["anchor", "window"]).join(asking.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


#: DuckDB SQL for ``mine`` with the contract's numbers, all rows against all anchors.
ORACLE = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id AS anchor_id, label, v FROM r WHERE vec_id % 100 = 0),
s AS MATERIALIZED (SELECT a.anchor_id, a.v, a.label = r.label AS same, r.vec_id, list_inner_product(a.v, r.v)::BIGINT AS score FROM a, r),
p AS (SELECT * FROM s WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id, v ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.v, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.v = p.v AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
