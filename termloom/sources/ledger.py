"""Runs over a corpus that can stop and go on: an identity, batches, and a ledger of what is finished.

A run's folder holds its identity (a digest of settings and corpus, and how many batches there are), the dealt documents, results by
attempt, and a ledger record for each attempt at a wave of batches, put in place after its results. A restart with the same
identity does the batches that no record calls finished; another identity is refused. Results of attempts without a record
are never read, so a wave that dies half-way leaves nothing behind that counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Folder

Work = Callable[[DataFrame, int], DataFrame]


def corpus_digest(docs: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: their number, and sums of two hashes of each."""
    cells = [F.xxhash64(F.lit(seed), *docs.columns).cast("decimal(38,0)") for seed in (1, 2)]
    n, a, b = docs.agg(F.count(F.lit(1)), *[F.sum(c) for c in cells]).first()
    return hashlib.sha256(f"{n}|{a}|{b}".encode()).hexdigest()


class Run:
    def __init__(self, spark: SparkSession, root: str, settings: dict, docs: DataFrame, batch: str, batches: int):
        """Opens or makes the run under ``root``. ``batch`` names the column of ``docs`` with their batch, 0 to ``batches`` - 1.

        Documents are dealt once, into a folder a batch; batches are as large as a job should be, so their number stays small.
        """
        self.spark, self.root, self.folder, self.batch = spark, root.rstrip("/"), Folder(spark, root), batch
        identity = {"settings": settings, "corpus": corpus_digest(docs), "batches": batches}
        text = json.dumps(identity, sort_keys=True)
        if not self.folder.create("identity.json", text) and (found := self.folder.read("identity.json")) != text:
            differs = sorted(k for k, v in json.loads(found).items() if v != identity[k])
            raise ValueError(f"{root} belongs to another run: {', '.join(differs)} differ")
        self.batches = batches
        if self.folder.read("dealt.json") is None:
            name = f"dealt/{uuid.uuid4().hex}"
            docs.repartition(batch).write.partitionBy(batch).parquet(f"{self.root}/{name}")
            self.folder.create("dealt.json", json.dumps({"folder": name, "columns": docs.schema.json()}))
        self._dealt = json.loads(self.folder.read("dealt.json"))

    def _records(self) -> list[dict]:
        return [json.loads(self.folder.read(f"ledger/{n}")) for n in self.folder.names("ledger") if n.endswith(".json")]

    def attempts(self) -> DataFrame:
        """batch, attempt, finished, error of every recorded attempt."""
        rows = [(b, r["attempt"], r["error"] is None, r["error"]) for r in self._records() for b in r["batches"]]
        return self.spark.createDataFrame(rows, "batch int, attempt int, finished boolean, error string")

    def missing(self) -> list[int]:
        done = {b for r in self._records() if r["error"] is None for b in r["batches"]}
        return [b for b in range(self.batches) if b not in done]

    def documents(self, batches: list[int]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self._dealt["columns"]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{self._dealt['folder']}").where(F.col(self.batch).isin(batches))

    def go_on(self, work: Work, wave: int = 8, most_waves: int | None = None, failures: tuple[type[Exception], ...] = (Exception,)) -> list[int]:
        """Do what is missing, ``wave`` batches a job; a wave that fails is done batch by batch, so that one bad batch fails alone.

        ``work`` gets documents and the attempt's number. Returns the batches still missing.
        """
        waves = 0
        tried = {b: 0 for b in range(self.batches)}
        for r in self._records():
            for b in r["batches"]:
                tried[b] = max(tried[b], r["attempt"])
        todo = self.missing()
        for at in range(0, len(todo), wave):
            if most_waves is not None and waves == most_waves:
                break
            waves += 1
            group = todo[at : at + wave]
            alike = len({tried[b] for b in group}) == 1
            if not (alike and len(group) > 1 and self._attempt(group, tried[group[0]] + 1, work, failures, quiet=True)):
                for b in group:
                    self._attempt([b], tried[b] + 1, work, failures)
        return self.missing()

    def _attempt(self, batches: list[int], attempt: int, work: Work, failures, quiet: bool = False) -> bool:
        name, error = f"results/{uuid.uuid4().hex}", None
        try:
            work(self.documents(batches), attempt).write.partitionBy(self.batch).parquet(f"{self.root}/{name}")
        except failures as e:
            self.folder.remove(name)
            if quiet:
                return False
            error = (str(e).strip() or type(e).__name__).splitlines()[0][:300]
        record = {"batches": batches, "attempt": attempt, "folder": name, "error": error}
        self.folder.create(f"ledger/{uuid.uuid4().hex}.json", json.dumps(record))
        return error is None

    def results(self) -> DataFrame | None:
        """Results of finished batches; of a batch that two runners finished, one attempt's."""
        folders: dict[int, str] = {}
        for r in sorted(self._records(), key=lambda r: r["folder"]):
            if r["error"] is None:
                folders |= {b: r["folder"] for b in r["batches"] if b not in folders}
        by_folder: dict[str, list[int]] = {}
        for b, f in folders.items():
            by_folder.setdefault(f, []).append(b)
        out = None
        for f, own in by_folder.items():
            part = self.spark.read.parquet(f"{self.root}/{f}").where(F.col(self.batch).isin(own))
            out = part if out is None else out.unionByName(part)
        return out
