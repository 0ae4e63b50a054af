"""Notes and reports on small inputs."""

import re

from termloom.plans import notes

from .conftest import SF
from .test_chunking import sentences


def test_offsets(spark):
    expect = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text, at = r.text or "", 0
        for n, s in enumerate(sentences(text)):
            place = text.find(s, at)
            place = text.find(s) if place < 0 else place
            expect.append((r.doc_id, n, place))
            at = place + 1 if place >= 0 else at
    assert sorted(map(tuple, notes.note_offsets(spark, SF).collect())) == sorted(expect)


def test_replacements(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("q", "gone"), ("m", "d")], "id string, replaced_by string")
    live = spark.createDataFrame([("d",), ("z",)], "id string")
    assert {(r.id, r.target) for r in notes.latest_replacement(links, live).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("m", "d")}


def test_subject_ip(spark):
    rows = spark.createDataFrame([("10.0.0.1", "1.2.3.4, 10.0.0.9"), ("9.9.9.9", "1.2.3.4"), ("10.0.0.1", None), ("bad", "1.2.3.4"), ("10.0.0.1", "junk")], "c string, f string")
    resolve = notes.subject_ip(("10.0.0.0/8",))
    assert [r.x for r in rows.select(resolve("c", "f").alias("x")).collect()] == ["1.2.3.4", "9.9.9.9", "10.0.0.1", None, None]


def test_dangling(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in notes.dangling(a, b, ["k"]).collect()] == [2]
    assert re.match(r"\| priority", notes.report_markdown(spark, SF).first().report)


def test_first_places(spark, monkeypatch):
    from termloom.operators import attribution

    labels = [(1, "ab"), (2, "abc"), (3, "é x"), (4, "none")]
    texts = ["xabcab", None, "", "né x ab"]
    expect = sorted((i, n, t.find(s), t.find(s) + len(s)) for i, t in enumerate(texts) if t for n, s in labels if s in t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, attribution.first_places(docs, labels).collect())) == expect
    monkeypatch.setattr(attribution, "ahocorasick", None)
    assert attribution._finder(labels)("xabcab") == [(1, 1, 3), (2, 1, 4)]


def test_a_closure_follows_its_tables(spark, tmp_path):
    """Tables that are written anew give a new closure in the same session."""
    import shutil

    from termloom.plans import ontology

    for t in ontology._TABLES:
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    first = ontology.closed(spark, str(tmp_path)).count()
    assert ontology.closed(spark, str(tmp_path)) is ontology.closed(spark, str(tmp_path))
    spark.read.parquet(f"{SF}/supplier.parquet").limit(3).write.parquet(str(tmp_path / "fewer"))
    (tmp_path / "supplier.parquet").unlink()
    shutil.move(str(tmp_path / "fewer"), str(tmp_path / "supplier.parquet"))
    assert ontology.closed(spark, str(tmp_path)).count() < first


def test_labels_in_blocks(spark):
    from termloom.operators import attribution

    docs = spark.createDataFrame([(1, "aa bb cc aa"), (2, "cc"), (3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, w) for i, w in enumerate(["aa", "bb", "cc", "dd", "bb c"])], "item_id long, label string")
    want = [(1, 0, 0, 2), (1, 1, 3, 5), (1, 2, 6, 8), (1, 4, 3, 7), (2, 2, 0, 2)]
    for most in (100, 2, 1):
        assert sorted(tuple(r) for r in attribution.places_of(docs, labels, most).collect()) == want


def test_places_go_on_behind_the_one_before():
    text = "ab ab é ab. " * 3
    assert notes.offsets_in(text, ["ab", "ab", "é ab.", "none", "ab", "é", "ab ab é ab. ab ab é ab. ab"]) == [0, 3, 6, -1, 8, 18, 0]
    assert notes.offsets_in("", []) == []
