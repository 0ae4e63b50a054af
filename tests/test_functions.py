"""Scalar functions and operators against plain Python on small inputs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from termloom.functions import assertions, formula, pii, text
from termloom.operators import graph, phrase_query
from termloom.operators.knn import knn
from termloom.plans import extraction, fidelity, mapping, ranking, retrieval, setmetrics


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "source, expect",
    [("label + 1", 1.5), ("max(synonyms)", 0.9), ("min(synonyms) * 2 - definition", 0.4), ("avg(synonyms)", 0.55), ("label / 0", 0.0), ("definition or label", 0.5), ("0.9 if label > 0.4 else 0.1", 0.9), ("max(label, synonyms)", 0.9), ("-label", -0.5)],
)
def test_formula(spark, source, expect):
    got = one(spark, formula.compile_formula(source, F.lit(0.5), F.array(F.lit(0.2), F.lit(0.9)), F.lit(None).cast("double")))
    assert got == pytest.approx(expect)


@pytest.mark.parametrize("source", ["__import__('os')", "label.x", "label ** 2", "open('f')", "lambda: 1", "[1]", "'a'", "True", "label +"])
def test_formula_rejects(spark, source):
    with pytest.raises(ValueError):
        formula.compile_formula(source, F.lit(1.0), F.array(F.lit(1.0)), F.lit(1.0))


def test_strategies_on_missing_components(spark):
    rows = spark.createDataFrame([(0.4, [0.9, 0.1], None), (None, [], None), (None, [0.3], 0.8)], "label_score double, synonym_scores array<double>, definition_score double")
    got = {s: [r.x for r in rows.select(retrieval.strategy_score(s).alias("x")).collect()] for s in retrieval.STRATEGIES}
    assert got["label_only"] == [0.4, 0.0, 0.0]
    assert got["label_synonyms_min"] == [0.1, 0.0, 0.3] and got["label_synonyms_max"] == [0.9, 0.0, 0.3]
    assert got["all_weighted"] == [pytest.approx((0.4 * 0.5 + 0.9 * 0.3) / 0.8, abs=1e-6), 0.0, pytest.approx((0.3 * 0.3 + 0.8 * 0.2) / 0.5, abs=1e-6)]
    assert got["all_max"] == [0.9, 0.0, 0.8] and got["all_min"] == [0.1, 0.0, 0.3]


def test_knn_edges(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, embedding array<float>")
    got = [(r.query_id, r.doc_id, r.similarity) for r in knn(docs, docs.filter("id in (1, 4, 5)"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 1.0), (1, 3, 0.0), (4, 1, 0.0), (4, 2, 0.0)]
    assert knn(docs.limit(0), docs, 2).count() == 0 == knn(docs, docs.limit(0), 2).count()


#: Nine nodes, D has two parents and a shortcut to A, X is unreachable.
EDGES = [("A", "T"), ("B", "T"), ("C", "A"), ("D", "A"), ("D", "B"), ("E", "C"), ("F", "C"), ("E", "A"), ("X", "Y")]


@pytest.fixture(scope="module")
def closed(spark):
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    nodes = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
    return graph.closure(nodes, edges).cache()


def test_graph(spark, closed):
    got = {(r.term, r.ancestor): r.up for r in closed.collect()}
    assert got[("E", "A")] == 1 and got[("E", "T")] == 2 and got[("D", "B")] == 1 and got[("T", "T")] == 0 and ("X", "T") not in got
    depth = {r.term: r.depth for r in graph.depths(closed, "T").collect()}
    assert depth == {"T": 0, "A": 1, "B": 1, "C": 2, "D": 2, "E": 2, "F": 3, "X": -1, "Y": -1}
    reduced = {(r.child, r.parent) for r in graph.reduced_parents(closed).collect()}
    assert reduced == set(EDGES) - {("E", "A")}  # the shortcut is gone
    branch = {r.term: (r.branch, r.branches) for r in graph.branches(closed, "T").collect()}
    assert branch["D"] == ("A", ["A", "B"]) and branch["T"] == (None, [])
    terms = graph.term_features(closed, "T")
    pairs = spark.createDataFrame([("E", "F"), ("D", "A"), ("A", "D"), ("E", "D"), ("E", "E"), ("X", "E"), ("Q", "Q"), ("Q", "E"), ("C", "D")], "a string, b string")
    rows = {(r.a, r.b): r for r in graph.pair_features(pairs, terms).withColumns({"kind": graph.match_kind(), "credit": graph.pair_credit(), "partial": graph.partial_credit()}).collect()}
    assert rows[("E", "F")].lca == "C" and rows[("E", "F")].kind == "sibling" and rows[("E", "F")].partial == 0.7
    assert rows[("D", "A")].kind == "descendant" and rows[("D", "A")].credit == 0.95
    assert rows[("A", "D")].kind == "ancestor" and rows[("A", "D")].credit == 0.85
    assert rows[("E", "E")].hybrid == 1.0 and rows[("Q", "Q")].hybrid == 1.0 and rows[("Q", "E")].hybrid == 0.0 == rows[("X", "E")].hybrid
    assert rows[("E", "D")].kind == "semantic" and rows[("C", "D")].kind == "sibling"


def test_cycle_is_an_error_and_depth_is_none(spark):
    path = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "child string, parent string")
    nodes = path.select(F.col("child").alias("term"))
    assert graph.closure(nodes, path).filter("term = 'n0'").agg(F.max("up")).first()[0] == 8
    with pytest.raises(ValueError, match="cycle"):
        graph.closure(nodes, path.union(spark.createDataFrame([("n5", "n2")], path.schema)))


def test_assign_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[rng.choice([0, 0.2, 0.5, 0.9, rng.random()]) for _ in range(m)] for _ in range(n)]
        got = setmetrics.assign(w)
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
        wide = w if n <= m else [list(c) for c in zip(*w)]
        best = max(sum(wide[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert sum(w[i][j] for i, j in got) == pytest.approx(best)


def test_chunkers(spark):
    t = "Dr. Smith saw 2.5 cm. Pain, but no fever!\r\n\r\nNext paragraph and more"
    assert one(spark, text.punctuation_chunks("t"), t=t) == ["Dr. Smith saw 2.5 cm", "Pain", "but no fever", "Next paragraph and more"]
    assert one(spark, text.paragraphs("t"), t=t)[1] == "Next paragraph and more"
    assert one(spark, text.sentences("t"), t="One. Two\nThree!") == ["One.", "Two.", "Three!"]
    assert one(spark, text.conjunction_chunks("t"), t="fever AND chills or andes but x") == ["fever", "AND chills", "or andes", "but x"]
    assert one(spark, text.token_windows(text.words("t"), 3, 2), t="a b c d e") == ["a b c", "c d e"]
    assert one(spark, text.token_windows(text.words("t"), 3, 2), t="") == []
    assert one(spark, text.canonical_term_id("t"), t="hp_123") == "HP:0000123" and one(spark, text.canonical_term_id("t"), t="x") is None
    assert one(spark, text.clean_phrase("t"), t="Atrial_septal-defect (ASD)") == "atrial septal defect"
    assert one(spark, text.query_variants("t"), t="height 120 cm") == ["height 120 cm", "height"]
    assert one(spark, text.slug("t"), t="org/My Model-v2!") == "my_model_v2"
    assert one(spark, text.detect_language("t"), t="der Mann und die Frau mit dem Kind") == "de" and one(spark, text.detect_language("t"), t="kurz") == "en"


@pytest.mark.parametrize(
    "chunk, lang, expect",
    [("No fever but cough", "en", "negated"), ("not only pain", "en", "affirmed"), ("normal gait", "en", "normal"), ("kein Fieber", "de", "negated"), ("known", "en", "affirmed"), ("pas de fièvre", "fr", "negated")],
)
def test_assertion_status(spark, chunk, lang, expect):
    assert one(spark, assertions.status(assertions.spaced(F.col("t")), lang), t=chunk) == expect


def test_scopes_end_at_terminators_and_after_seven_words(spark):
    assert one(spark, assertions.negated_scopes(assertions.spaced(F.col("t"))), t="Without pain but with a rash") == ["pain"]
    assert one(spark, assertions.negated_scopes(assertions.spaced(F.col("t"))), t="no a b c d e f g h i") == ["a b c d e f g"]


PII = "Mail a.b@x.org, é 10.0.0.255 and 300.1.1.1; on 2024-05-06 www.site.net/x?y=1 end a@b.co"


def test_pii_matches_are_code_points(spark):
    for rule in pii.RULES[:4]:
        got = [(r.start, r.end) for r in one(spark, pii.matches(F.col("t"), rule.pattern), t=PII)]
        assert got == [m.span() for m in re.finditer(rule.pattern, PII)], rule.id


def test_pii_merge_and_redact(spark):
    found = pii.scan(F.col("t"), F.lit("en"))
    assert one(spark, pii.redact(F.col("t"), found), t=PII).startswith("Mail [EMAIL], é [IP] and ")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("rule"), F.lit(c).alias("confidence"), F.lit("[X]").alias("token")) for a, b, r, c in [(0, 4, "p", "review"), (2, 9, "q", "high"), (9, 10, "r", "review")]])
    got = [(f.start, f.end, f.rule, f.confidence) for f in one(spark, pii.merge(spans), t="")]
    assert got == [(0, 9, "q", "high"), (9, 10, "r", "review")]
    assert one(spark, pii.redact(F.col("t"), spans, True), t="0123456789ab") == "[X][X]ab"
    assert one(spark, pii.redact(F.col("t"), found), t="") == ""


@pytest.mark.parametrize("check, value, expect", [("valid_dni", "12345678Z", True), ("valid_dni", "X1234567L", True), ("valid_dni", "12345678A", False), ("valid_bsn", "111222333", True), ("valid_bsn", "123456789", False), ("valid_nir", "185057800608491", True), ("valid_nir", "185137800608491", False), ("valid_kvnr", "A123456789", True), ("valid_kvnr", "a1", False), ("valid_dni", None, False)])
def test_validators(spark, check, value, expect):
    assert one(spark, getattr(pii, check)(F.col("t").cast("string")), t=value) is expect


def test_candidate_fold(spark):
    rng = random.Random(1)
    rows = [(i, r, rng.randint(0, 9), round(rng.random(), 3), rng.random() < 0.2) for i in range(20) for r in range(1, 15)]
    got = sorted((x.item_id, x.rank) for x in phrase_query.select(spark.createDataFrame(rows, "item_id long, rank int, term long, score double, overlap boolean"), 0.7, 3, 5).collect())
    expect = []
    for i in range(20):
        seen, kept = set(), 0
        for _, r, term, score, overlap in [x for x in rows if x[0] == i]:
            if term in seen:
                continue
            seen.add(term)
            if kept < 5 and (overlap or score >= 0.7 or kept < 3):
                kept += 1
                expect.append((i, r))
    assert got == sorted(expect)


def test_budget_groups(spark):
    sizes = [(1, i, s) for i, s in enumerate([5, 5, 20, 1, 9, 3])]
    got = {r.pos: r.grp for r in mapping.token_budget_groups(spark.createDataFrame(sizes, "case_id long, pos long, size int"), 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3}


def test_bootstrap_brackets_the_mean(spark):
    values = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "key long, x double")
    r = ranking.bootstrap_means(values, "x", draws=200).first()
    assert r.low < r.mean < r.high and r.high - r.low < 1.5
    same = ranking.paired_bootstrap(values.withColumn("y", F.col("x")), "x", "y", draws=100).first()
    assert same.diff == 0 and not same.significant


def test_adaptive_rechunking_keeps_what_gains(spark):
    long = "First finding is here and long enough to stay. Second finding is here as well, quite long. Third one. Fourth finding ends the text at last."
    chunks = spark.createDataFrame([(1, "a", long), (1, "b", "Good chunk.")], "doc_id long, chunk_id string, text string")

    def retrieve(rows):
        score = F.when(F.col("text").contains("Good"), 0.9).when(F.length("text") > 120, 0.3).otherwise(0.5)
        return rows.select("doc_id", "chunk_id", score.alias("score"))

    got = {r.chunk_id for r in extraction.adaptive_rechunk(chunks, retrieve).collect()}
    assert "b" in got and "a" not in got and all(c == "b" or c.startswith("a.") for c in got)
    none = extraction.adaptive_rechunk(chunks, lambda rows: rows.select("doc_id", "chunk_id", F.lit(0.4).alias("score")))
    assert {r.chunk_id for r in none.collect()} == {"a", "b"}


def test_sampled_pairs(spark):
    got = [(r.a, r.b) for r in fidelity.sample_pairs(spark.range(50), 40).collect()]
    assert len(got) == len(set(got)) == 40 and all(a < b for a, b in got)
    for rows, asked, expect in ((20, 190, 190), (20, 500, 190), (20, 90, 90), (1, 5, 0), (0, 5, 0)):
        got = [(r.a, r.b) for r in fidelity.sample_pairs(spark.range(rows), asked).collect()]
        assert len(got) == len(set(got)) == expect and all(a < b for a, b in got)


def test_semantic_prf(spark):
    s = "doc_id long, term string"
    pred, gold = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C")], s), spark.createDataFrame([(1, "A"), (1, "D"), (2, "E")], s)
    sims = spark.createDataFrame([("B", "D", 0.8), ("C", "D", 0.9)], "a string, b string, hybrid double")
    got = {r.doc_id: (r.exact, r.semantic, r.n_pred, r.n_gold) for r in setmetrics.semantic_prf(pred, gold, sims).collect()}
    assert got == {1: (1, 2, 3, 2), 2: (0, 0, 0, 1)}  # B and C both count: a gold term may serve several predictions


def test_pairs_of_terms_that_are_alike_are_looked_at_once(spark, monkeypatch):
    from termloom.operators import graph

    edges = [("A", "T"), ("B", "T"), ("C", "A"), *[(f"x{i}", "C") for i in range(8)], *[(f"y{i}", p) for i in range(8) for p in ("B", "C")], ("lone", "other")]
    edges = spark.createDataFrame(edges, "child string, parent string")
    nodes = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
    terms = graph.term_features(graph.closure(nodes, edges), "T").localCheckpoint()
    names = [r.term for r in nodes.collect()] + ["unknown", None]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    plain, looked = graph._features, []

    def counted(few, terms):
        looked.append(few.count())
        return plain(few, terms)

    monkeypatch.setattr(graph, "_features", counted)
    found, wanted = graph.pair_features(pairs, terms), plain(pairs, terms.drop("rep", "twin"))
    rows = lambda df: sorted(map(str, df.select(sorted(wanted.columns)).collect()))
    assert sorted(found.columns) == sorted(wanted.columns) and rows(found) == rows(wanted)
    assert looked[0] < len(names) ** 2 / 2
