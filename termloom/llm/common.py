"""Shared plumbing: table access, the shared folder, staged tables and Arrow stream helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: White space of the contracts, as a Java and Python character class.
SPACES = r"[\x20\x09-\x0D]+"

#: Ids that are broadcast at most, some tens of MB as a hash table; beyond, joins shuffle.
BROADCAST_ROWS = 500_000

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_written: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Settle what Python workers need: the package's path, and Arrow batches of few rows, as texts are long.

    The path serves a package in the driver's source tree; on a cluster it is shipped as usual (``--py-files``), and a path
    that an executor lacks does no harm. A session that sets a batch size of its own keeps it.
    """
    if spark.conf.get(_BATCH_ROWS, "10000") == "10000":  # the default, made for short rows
        spark.conf.set(_BATCH_ROWS, "1000")
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is this machine alone, as in tests, is a temporary folder made and used; a
    cluster without the setting is an error, as its executors would each write to a folder of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if own := getattr(spark.sparkContext, "_termloom_shared", None):
        return own
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {spark.sparkContext.master} share")
    own = "file://" + tempfile.mkdtemp(prefix="termloom-")
    spark.sparkContext.setCheckpointDir(own)
    spark.sparkContext._termloom_shared = own
    return own


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    """Remove staged tables when the driver ends; what a killed driver leaves is under the shared folder."""
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:
            return  # the session is gone


def scratch(df: DataFrame, name: str) -> str:
    """A column name like the one given that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame, ids: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``dropped`` (doc_id; null is an id like any other), with all their columns.

    ``ids`` is the number of rows of ``dropped``; it is broadcast up to BROADCAST_ROWS of them.
    """
    name = scratch(docs, "dropped_id")
    dropped = dropped.select(F.col("doc_id").alias(name))
    if ids <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(remainders: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % F.lit(remainders)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256, held: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of few rows and about ``held`` bytes, so that Python copies of texts never pile up."""
    for batch in batches:
        step = max(1, min(rows, held * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def table_batches(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
