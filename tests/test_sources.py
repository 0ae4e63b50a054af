"""Sources, stores and streams on small files."""

import json

import pytest

from termloom.sources import corpora, index, obo
from termloom.streaming import usage

P = "http://purl.obolibrary.org/obo/HP_"


def node(i, label="", **meta):
    return {"id": f"{P}{i:07d}", "lbl": label, "meta": meta}


@pytest.fixture()
def graph_file(tmp_path):
    nodes = [
        node(1, "All"), node(118, "Abnormality", definition={"val": "d"}, synonyms=[{"val": "s1"}, {"val": ""}]), node(3, "", comments=["c"]),
        node(4, "gone", deprecated=True, basicPropertyValues=[{"pred": "http://x/IAO_0100001", "val": f"{P}0000118"}]), node(5, "Obsolete thing"),
        node(6, "child"), node(7, "two parents"), node(8, "island"), {"id": "http://purl.obolibrary.org/obo/MP_1", "lbl": "other"}, node(9, "leaf"),
    ]
    edge = lambda s, o, p="is_a", key="sub": {key: f"{P}{s:07d}", "pred": p, "obj": f"{P}{o:07d}"}
    edges = [edge(118, 1), edge(6, 118), edge(3, 118, key="subj"), edge(7, 6), edge(7, 3), edge(9, 7), edge(9, 404), edge(9, 8, "part_of"), edge(4, 1)]
    path = tmp_path / "hp.json"
    path.write_text(json.dumps({"graphs": [{"nodes": nodes, "edges": edges}]}))
    return path


def test_obo(spark, graph_file, tmp_path):
    import hashlib

    digest = hashlib.sha256(graph_file.read_bytes()).hexdigest()
    terms, edges = obo.read(spark, str(graph_file), sha256=digest)
    by = {r.id: r for r in terms.collect()}
    assert set(by) == {f"HP:{i:07d}" for i in (1, 118, 3, 6, 7, 8, 9)}
    assert by["HP:0000003"].label == "HP:0000003" and by["HP:0000118"].synonyms == ["s1"] and by["HP:0000006"].definition == ""
    assert {(r.child[-3:], r.parent[-3:]) for r in edges.collect()} == {("118", "001"), ("006", "118"), ("003", "118"), ("007", "006"), ("007", "003"), ("009", "007")}
    every, _ = obo.read(spark, str(graph_file), include_obsolete=True)
    assert {r.id: r.replaced_by for r in every.filter("obsolete").collect()} == {"HP:0000004": "HP:0000118", "HP:0000005": None}
    assert obo.parsing_summary(every).first().obsolete == 2
    with pytest.raises(ValueError):
        obo.verify_sha256(spark, str(graph_file), "0" * 64)
    store = str(tmp_path / "store")
    obo.prepare(spark, str(graph_file), store, "HP:0000001")
    depth = {r.term[-3:]: r.depth for r in spark.read.parquet(f"{store}/depths").collect()}
    assert depth == {"001": 0, "118": 1, "006": 2, "003": 2, "007": 3, "009": 4, "008": -1}
    closed = spark.read.parquet(f"{store}/closure")
    rows = spark.createDataFrame([("HP:0000009",), ("HP:0000001",), ("HP:0000118",), ("ZZ:1",)], "id string")
    assert {r.id for r in obo.without_unrelated(rows, closed, "HP:0000118").collect()} == {"HP:0000009", "HP:0000118", "ZZ:1"}
    known, missing = obo.terms_by_ids(spark.read.parquet(f"{store}/terms"), rows)
    assert known.count() == 3 and missing.first().id == "ZZ:1"
    assert {r.id: r.synonyms for r in obo.enrich(rows, terms).collect()}["HP:0000118"] == ["s1"]
    with pytest.raises(ValueError):
        obo.append_terms(terms, store)
    assert obo.tree_digest(spark, store) == obo.tree_digest(spark, store)


def test_corpora(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"description": "d", "text": "t", "expected_hpo_ids": ["HP:1", " "]}]))
    assert [[g.id for g in r.gold] for r in corpora.cases(spark, str(tmp_path / "cases.json")).collect()] == [["HP:1"]]
    (tmp_path / "c.json").write_text(json.dumps({"documents": [{"id": "x", "text": "t", "gold_hpo_terms": [{"id": "HP:1"}, {"id": "HP:2", "assertion": "ABSENT"}]}]}))
    assert [(g.id, g.assertion) for g in corpora.corpus(spark, str(tmp_path / "c.json")).first().gold] == [("HP:1", "PRESENT"), ("HP:2", "ABSENT")]
    folder = tmp_path / "GSC" / "annotations"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text(json.dumps({"doc_id": "1", "language": "en", "full_text": "t", "annotations": [{"hpo_id": "HP:1", "assertion_status": "normal"}, {"hpo_id": "HP:2", "assertion_status": "odd"}]}))
    row = corpora.annotated(spark, str(folder / "*.json")).first()
    assert row.dataset == "GSC" and [(g.id, g.assertion) for g in row.gold] == [("HP:1", "PRESENT")]
    (tmp_path / "a.jsonl").write_text('{"doc_id": "1", "full_text": "x"}\n\n{bad\n{"doc_id": "2"}\n')
    good, bad = corpora.json_lines(spark, str(tmp_path / "a.jsonl"))
    assert {r.doc_id for r in good.collect()} == {"1", "2"} and [r.value for r in bad.collect()] == ["{bad"]


def test_text_pairs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("small hands and feet")
    (tmp_path / "a.ann").write_text("[0::11] HP_0200055 | small hands\n[3::5] HP_1 | wrong\nnoise\n16\t20\tfeet\tHP:2\n")
    (tmp_path / "b.txt").write_text("unpaired")
    rows = corpora.text_pairs(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in rows] == ["a"] and [(x.start, x.id) for x in rows[0].annotations] == [(0, "HP:0200055"), (16, "HP:2")]


def test_projection_and_lexicon(spark):
    gold = spark.createDataFrame([("d", 1, "ABSENT"), ("d", 2, "UNCERTAIN"), ("e", 3, "UNCERTAIN")], "dataset string, id int, assertion string")
    rules = spark.createDataFrame([("d", "UNCERTAIN", None), ("d", "ABSENT", "PRESENT")], "dataset string, assertion string, projected string")
    assert {(r.id, r.assertion) for r in corpora.project(gold, rules).collect()} == {(1, "PRESENT"), (3, "UNCERTAIN")}
    s = "lang string, entry string"
    got = corpora.lexicon(spark.createDataFrame([("en", "No"), ("de", "kein")], s), spark.createDataFrame([("en", "Without")], s))
    assert {(r.lang, r.entry) for r in got.collect()} == {("en", "without"), ("de", "kein")}


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([("P:1__label__0", "P:1", "label", "small hand"), ("P:2__label__0", "P:2", "label", ""), ("P:1__synonym__0", "P:1", "synonym", "Hand small")], "doc_id string, term string, component string, text string")
    assert index.build(docs, str(tmp_path / "i"), "hash", "multi", "v1", bucket=2) == 3
    vectors, record = index.open_index(spark, str(tmp_path / "i"), model="hash")
    by = {r.doc_id: r.embedding for r in vectors.collect()}
    assert record["count"] == 3 and by["P:1__label__0"] == by["P:1__synonym__0"] and sum(by["P:2__label__0"]) == 0
    assert sum(x * x for x in by["P:1__label__0"]) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        index.open_index(spark, str(tmp_path / "i"), model="other")
    index.write_run(docs, str(tmp_path / "runs"), "extraction", "d", "m", "r1")
    assert index.read_runs(spark, str(tmp_path / "runs"), "extraction").count() == 3


def test_streams_of_nothing(spark, tmp_path):
    spark.createDataFrame([], usage.EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    assert usage.stream_lockout(spark, str(tmp_path)).count() == 0
