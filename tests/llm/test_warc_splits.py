"""One uncompressed file gives the same records at any split size, also where blocks hold whole records."""

import random

import pytest

from termloom.llm import warc

from .test_warc_records import record


@pytest.mark.parametrize("size", [150, 3_000, 1 << 20])
def test_any_split_size(spark, tmp_path, size):
    rng = random.Random(5)
    blocks = []
    for n in range(24):
        inner = record("1.0", "resource", n % 9 + 1, b"x" * rng.randrange(60))
        blocks.append(rng.choice([b"plain" * rng.randrange(100), b"a\r\n" + inner + b"mid WARC/1. end" + inner, b"", b"WARC/1.0\r\n" * 5, bytes(range(256))]))
    raw = b"".join(record("1.1" if n % 2 else "1.0", "resource", n + 1, b) for n, b in enumerate(blocks))
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc").write_bytes(raw[: len(raw) - 30])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for name, cut in (("a.warc", 0), ("b.warc", 1)):
            got = sorted(warc.read_records(spark, str(tmp_path / name)).collect(), key=lambda r: int(r.header["warc-record-id"].strip("<>").split(":")[-1]))
            assert len(got) == 24 and sum(not r.complete for r in got) <= cut
            assert [bytes(r.block) for r in got][: 24 - cut] == blocks[: 24 - cut]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
