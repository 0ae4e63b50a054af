"""Chunking stages against plain Python, and small joins with known answers."""

import re

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.plans import chunking, details, privacy

from .conftest import SF

WS = " \t\n\r"


def strip(parts):
    return [p for p in (x.strip(WS) for x in parts) if p]


def paragraphs(t):
    return strip(re.split(r"\n[ \t]*\n+", t.replace("\r\n", "\n").replace("\r", "\n")))


def sentences(t):
    lines = strip(t.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return strip(re.findall(r"[^.?!]+[.?!]", " ".join(x if x[-1] in ".?!" else x + "." for x in lines)))


def punctuation(t):
    t = re.sub(r"\b(" + "|".join(T.ABBREVIATIONS) + r")\.", "\\1\x01", t, flags=re.ASCII)
    t = re.sub(r"([0-9])[.]([0-9])", "\\1\x01\\2", t)
    t = re.sub(r"[.,:;?!]+[ \t\n\r]*\Z", "", re.sub(r"[.,:;?!][ \t\n\r]+", "\x02", t))
    return [p.replace("\x01", ".") for p in strip(t.split("\x02"))]


def conjunctions(t):
    words = "|".join(sorted(T.CONJUNCTIONS["en"], key=lambda w: (-len(w), w)))
    return strip(re.split(rf"[ \t\n\r]+(?=(?:{words})[ \t\n\r])", t, flags=re.IGNORECASE | re.ASCII))


def negations(parts):
    out = []
    for p in parts:
        if out and re.search(rf"(?:\A|[ \t\n\r])(?:{'|'.join(chunking.NEGATIONS)})\Z", out[-1], re.IGNORECASE | re.ASCII) and len(p.split()) <= 5:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def clean(parts):
    listed = "|".join(sorted(chunking.LOW_VALUE, key=lambda w: (-len(w), w)))
    out = []
    for p in parts:
        for _ in range(2):
            p = re.sub(r"\A[ \t\n\r.,:;!?()-]+|[ \t\n\r.,:;!?()-]+\Z", "", p)
            p = re.sub(rf"\A(?:{listed})[ \t\n\r]+|[ \t\n\r]+(?:{listed})\Z", "", p, flags=re.IGNORECASE | re.ASCII)
        p = p.strip(" ")
        words = [w for w in re.split(r"[ \t\n\r]+", p) if w]
        if len(p) >= 2 and not (len(words) <= 2 and all(w.lower() in chunking.LOW_VALUE for w in words)):
            out.append(p)
    return out


def test_pipeline_equals_its_stages(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expect = []
    for i, t in docs:
        parts = [t]
        for split in (paragraphs, sentences, punctuation, conjunctions):
            parts = [p for x in parts for p in split(x)]
        expect += [(i, n, p) for n, p in enumerate(clean(negations(parts)))]
    got = [(r.doc_id, r.chunk_idx, r.chunk) for r in chunking.txt_pipeline(spark, SF).collect()]
    assert sorted(got) == sorted(expect)


def test_semantic_pieces_rejoin(spark):
    whole = {(r.conv_id, r.turn): (r.text or "").split() for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    pieces = {}
    for r in chunking.txt_semantic_split(spark, SF).orderBy("conv_id", "turn", "chunk_idx").collect():
        pieces.setdefault((r.conv_id, r.turn), []).append(r.chunk)
    assert any(len(p) > 1 for p in pieces.values())
    assert {k: " ".join(p).split() for k, p in pieces.items()} == {k: v for k, v in whole.items() if v}


def test_negations_join_what_they_negate(spark):
    row = spark.range(1).select(chunking.merge_negations(F.array(*map(F.lit, ["patient has no", "fever", "and kein", "a b c d e f", "pas"]))).alias("x")).first()
    assert row.x == ["patient has no fever", "and kein", "a b c d e f", "pas"]


def test_stages(spark):
    import pytest

    with pytest.raises(ValueError):
        chunking.build((chunking.Stage("unheard-of"),))
    assert chunking.override((chunking.Stage("semantic"), chunking.Stage("noop")), size=9)[0].size == 9


def test_word_boundaries(spark):
    t = "Größe normal. Ende"
    rows = spark.createDataFrame([(t, 1, 3), (t, 6, 9), (t, 5, 6), (t, 0, 18)], "t string, a int, b int")
    got = [tuple(r.x) for r in rows.select(chunking.to_word_boundaries(F.col("t"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [(0, 5), (6, 13), (5, 6), (0, 18)]


def test_match_status(spark):
    rows = spark.createDataFrame([("negated", 0, 5, [(3, 9)]), ("negated", 0, 3, [(3, 9)]), ("negated", None, None, [(3, 9)]), ("normal", 0, 5, [(3, 9)]), ("negated", 0, 5, [])], "s string, a int, b int, scopes array<struct<start:int,end:int>>")
    got = [r.x for r in rows.select(details.match_status(F.col("s"), F.col("a"), F.col("b"), F.col("scopes")).alias("x")).collect()]
    assert got == ["negated", "affirmed", "negated", "normal", "negated"]


def test_names(spark):
    row = spark.range(1).select(privacy.untitled_names(F.lit("Patient: Anna von Berg met Jörg Maier, not Berlin.")).alias("x")).first()
    assert [(n.name, n.score) for n in row.x] == [("Anna von Berg", 5), ("Jörg Maier", 4)]  # two points, a particle, a word of context within 32 characters


def test_parts_without_a_negation_skip_the_fold(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(["a b", "c"],), (["there is no", "fever", "x"],), ([],), (None,)], "p array<string>")
    merged = chunking.merge_negations(F.col("p"))
    assert [r.m for r in rows.select(merged.alias("m")).collect()] == [["a b", "c"], ["there is no fever", "x"], [], None]
    assert "exists(" in str(merged)
