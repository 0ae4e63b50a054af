"""First places of many labels in texts: one automaton for all labels, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed

try:
    import ahocorasick
except ImportError:  # a library that isn't everywhere; the fallback scans once a label
    ahocorasick = None

#: Labels that travel with a pass over the texts, about: some tens of MB on the driver and in each task.
MOST_LABELS = 200_000


def _finder(labels: list[tuple[int, str]]):
    if ahocorasick is None or not labels:
        return lambda text: [(i, at, at + len(s)) for i, s in labels if (at := text.find(s)) >= 0]
    automaton = ahocorasick.Automaton()
    for i, s in labels:
        automaton.add_word(s, (i, len(s)))
    automaton.make_automaton()

    def find(text: str) -> list[tuple[int, int, int]]:
        first: dict[int, tuple[int, int]] = {}
        for end, (i, n) in automaton.iter(text):
            if i not in first:
                first[i] = end + 1 - n, end + 1
        return [(i, a, b) for i, (a, b) in first.items()]

    return find


def first_places(docs: DataFrame, labels: list[tuple[int, str]]) -> DataFrame:
    """doc_id, item_id, start, end of each label's first place in each text of ``docs`` (doc_id, text); null texts have none.

    ``labels`` are (id, text), no text twice and none empty; cases count, so that callers lower both sides if they want.
    """
    def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(labels)
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for hit in find(t)]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(columns[0], pa.int64()), "item_id": pa.array(columns[1], pa.int64()), "start": pa.array(columns[2], pa.int32()), "end": pa.array(columns[3], pa.int32()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, "doc_id long, item_id long, start int, end int")


def places_of(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """``first_places`` of a table of labels (item_id, label) of any size.

    Labels are counted first and dealt into blocks of about ``most``; the driver holds one block at a time, and what a pass
    over the texts finds is written before the next block is read.
    """
    blocks = max(1, -(-labels.count() // most))
    own = F.pmod(F.xxhash64("label"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    out = None
    for block in range(blocks):
        found = first_places(docs, sorted((r.item_id, r.label) for r in labels.filter(own == block).select("item_id", "label").collect()))
        found = checkpointed(found) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out
