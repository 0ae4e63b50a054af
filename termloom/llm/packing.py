"""Best-fit packing after Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the instance is a histogram of at most ``capacity`` counts, whatever the
table's size. The driver solves it on the counts:

* *Reduction.* For a length L (largest first) with room S = capacity - L: when nothing fits, the set {L} dominates; when
  only one further piece ever fits, or one fills S exactly, {L, largest that fits} dominates; when at most two fit
  and the largest single piece is no smaller than the best sum of two, {L, that piece} dominates. Dominating sets are fixed as
  sequences, as often as their members last, and the instance shrinks.
* *Best fit.* The rest goes, in decreasing order, each to the fullest open sequence that takes it. Sequences with equal
  contents are one group with a multiplicity, and a step moves a whole group.

The outcome is a list of patterns with multiplicities, whose number depends on the capacity and not on the documents. Each
piece gets its rank among the pieces of its length: tasks number their own pieces as they write them, offsets per task and
length come from the counts. A sorted table of rank intervals then gives every piece its sequence and offset.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END_ID = 2

_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteLevelTokenizer:
    """Token ids of a byte-level BPE vocabulary file (``tokenizers`` JSON), through a faster library with the same ranks.

    Words of extreme length, where that library is quadratic, go to the ``tokenizers`` library itself.
    """

    LONG_WORD = 2_000

    def __init__(self, path: str):
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in keep)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._special = "all" if special else set()
        self._path, self._exact = path, None
        self._long = re.compile(r"\S{%d}|\s{%d}" % (self.LONG_WORD, self.LONG_WORD))

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= self.LONG_WORD and self._long.search(text):
            if self._exact is None:
                from tokenizers import Tokenizer

                self._exact = Tokenizer.from_file(self._path)
                self._exact.no_truncation()
                self._exact.no_padding()
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self._fast.encode_to_numpy(text, allowed_special=self._special), dtype="<u4")


_tokenizers: dict[str, ByteLevelTokenizer] = {}


def tokenizer(path: str) -> ByteLevelTokenizer:
    """One for each worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteLevelTokenizer(path)
    return _tokenizers[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: what exceeds whole pieces comes first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the piece's number within its task and length."""
    common.prepare(docs.sparkSession)

    def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        encoder = tokenizer(vocabulary or default_vocabulary())
        for batch in common.in_slices(batches):
            doc, number, start, length, crc, nth = [], [], [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), common.texts_of(batch), strict=True):
                ids = np.append(encoder.encode(text), end_id).astype("<u4")
                for i, (at, n) in enumerate(cut(len(ids), capacity)):
                    doc.append(d)
                    number.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    nth.append(int(seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                "task": pa.array([task] * len(doc), pa.int32()), "nth": pa.array(nth, pa.int64()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces, _PIECES_DDL)


Pattern = tuple[tuple[int, int], ...]  # (length, how many) in the order in which they lie


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Fix dominating sets; (patterns with multiplicities, counts that remain)."""
    left, fixed = counts.astype(np.int64).copy(), []
    for size in range(capacity, 0, -1):
        while left[size]:
            room = capacity - size
            left[size] -= 1  # the piece itself; what follows looks at the others
            fit = np.flatnonzero(left[: room + 1])
            if not len(fit):
                alone = left[size] + 1
                fixed.append((((size, 1),), int(alone)))
                left[size] = 0
                continue
            best, least = int(fit[-1]), int(fit[0])
            # the most pieces that fit beside it, up to three
            smallest = np.repeat(fit[:3], np.minimum(left[fit[:3]], 3))[:3]
            most = int((np.cumsum(smallest) <= room).sum())
            dominated = best == room or most == 1
            if not dominated and most == 2:
                down = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), -1))
                two = least
                for a in fit:
                    b = down[min(room - a, a - 1)] if left[a] < 2 else down[min(room - a, a)]
                    if b > 0:
                        two = max(two, int(a + b))
                dominated = best >= two
            if not dominated:
                left[size] += 1
                break
            times = (left[size] + 1) // 2 if best == size else min(left[size] + 1, left[best])
            left[size] += 1
            left[size] -= times
            left[best] -= times
            fixed.append((((size, 2),) if best == size else ((size, 1), (best, 1)), int(times)))
    return fixed, left


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing on counts: every piece goes to the open sequence with the least room that takes it."""
    open_: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        for room in range(size, capacity):
            if not left:
                break
            if not open_[room]:
                continue
            groups, open_[room] = open_[room], []
            for pattern, times in groups:
                each = room // size
                full = min(times, left // each)
                if full:
                    open_[room - each * size].append((pattern + ((size, each),), full))
                    left -= full * each
                    times -= full
                if times and left:  # under ``each`` of them are left
                    open_[room - left * size].append((pattern + ((size, left),), 1))
                    left, times = 0, times - 1
                if times:
                    open_[room].append((pattern, times))
        each = capacity // size
        if left >= each:
            open_[capacity - each * size].append((((size, each),), left // each))
        if left % each:
            open_[capacity - left % each * size].append((((size, left % each),), 1))
    return [group for groups in open_ for group in groups]


@dataclass
class Places:
    """Rank intervals of each length, sorted by (length, first rank)."""

    key: np.ndarray  # length << 48 | first rank
    sequence: np.ndarray  # of the interval's first piece
    each: np.ndarray  # pieces of this length in a sequence
    offset: np.ndarray  # of the first of them

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) | rank, side="right") - 1
        nth = rank - (self.key[at] & ((1 << 48) - 1))
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def solve(counts: np.ndarray, capacity: int) -> tuple[list[tuple[Pattern, int]], Places]:
    fixed, rest = reduce_instance(counts, capacity)
    patterns = fixed + best_fit(rest, capacity)
    ranks, rows, sequence = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for pattern, times in patterns:
        offset = 0
        for size, each in pattern:
            rows.append(((size << 48) | int(ranks[size]), sequence, each, offset))
            ranks[size] += each * times
            offset += size * each
        sequence += times
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T
    return patterns, Places(*columns)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of ``docs`` (doc_id, text).

    A null or empty text is one piece of the end id. Repeated rows and null ids are packed like any other row; other
    columns are ignored; an empty table gives no rows.
    """
    cutting = common.staged(pieces(docs, vocabulary, capacity, end_id), "pieces")
    by_task = cutting.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = common.staged(by_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-offsets")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r.length] = r.n
    _, places = solve(counts, capacity)

    def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column("before").to_numpy() + batch.column("nth").to_numpy()
            sequence, offset = places.of(batch.column("length").to_numpy(), rank)
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    # a merge join: the offsets grow with the number of tasks, and pieces are small rows
    placed = cutting.join(by_task.select("task", "length", "before").hint("merge"), ["task", "length"])
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return placed.mapInArrow(_place, ddl)
