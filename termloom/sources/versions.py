"""A table as versions: data folders are written first, and a record that names a version's folders is put in place last.

A reader is pinned to one version and sees its folders only, whatever is written meanwhile. A writer names the version it read;
if another writer has made the next one, it is refused and its folder removed. A writer that dies leaves a folder that no
version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import Folder


class Clash(RuntimeError):
    """Another writer made the version that this one was to make."""


class Versions:
    def __init__(self, spark: SparkSession, root: str, adopted: str | None = None):
        """``adopted`` is a plain Parquet folder that counts as version 0."""
        self.spark, self.root, self.folder, self.adopted = spark, root.rstrip("/"), Folder(spark, root), adopted

    def latest(self) -> int:
        """The newest version's number; 0 for the adopted folder or nothing."""
        numbers = [int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json")]
        return max(numbers, default=0)

    def _record(self, version: int) -> dict:
        if version == 0 and self.adopted:
            return {"folders": [self.adopted], "rows": None}
        text = self.folder.read(f"versions/{version:010d}.json")
        if text is None:
            raise ValueError(f"{self.root} has no version {version}")
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*self._record(self.latest() if version is None else version)["folders"])

    def history(self) -> list[tuple[int, str, int]]:
        """(version, kind, rows written) of the versions that were committed here."""
        numbers = [int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json")]
        return [(n, (r := self._record(n))["kind"], r["rows"]) for n in sorted(numbers)]

    def _commit(self, rows: DataFrame, base: int, kept: list[str], kind: str) -> int:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        n = self.spark.read.parquet(f"{self.root}/{name}").count()
        record = {"kind": kind, "folders": [*kept, f"{self.root}/{name}"], "rows": n, "base": base}
        if not self.folder.create(f"versions/{base + 1:010d}.json", json.dumps(record)):
            self.folder.remove(name)
            raise Clash(f"version {base + 1} of {self.root} was made by another writer")
        return n

    def append(self, rows: DataFrame, base: int | None = None) -> int:
        """A version with ``rows`` more than ``base`` (the latest, if not named); returns their number."""
        base = self.latest() if base is None else base
        return self._commit(rows, base, self._record(base)["folders"] if base or self.adopted else [], "append")

    def replace(self, rows: DataFrame, base: int | None = None) -> int:
        """A version of ``rows`` alone; older versions stay readable."""
        return self._commit(rows, self.latest() if base is None else base, [], "replace")
