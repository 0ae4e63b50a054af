"""Rules of personal data: written forms by locale, names against a plain version by tokens, long texts in linear time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from termloom.functions import pii

from .conftest import SF

BY_ID = {r.id: r for r in pii.RULES}


def found(spark, texts, rules=pii.RULES):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", pii.merge(pii.scan(F.col("t"), rules=rules)).alias("f"))
    got = {r.n: [(f.rule, texts[r.n][f.start : f.end], f.confidence) for f in r.f] for r in rows.collect()}
    return [got[i] for i in range(len(texts))]


CASES = [
    ("Her DOB: 01/02/1980 is known", ("birth-en", "DOB: 01/02/1980")),
    ("DOB:" + " " * 30 + "01/02/1980", ("birth-en", "DOB:" + " " * 30 + "01/02/1980")),
    ("geboren am 3.4.1970 dort", ("birth-de", "geboren am 3.4.1970")),
    ("née le 03/04/1970 ici", ("birth-fr", "née le 03/04/1970")),
    ("nacida el 1970-04-03 en", ("birth-es", "nacida el 1970-04-03")),
    ("Hauptstraße 5, 10115 Berlin", ("address-de", "Hauptstraße 5, 10115")),
    ("weg 12, bei 12345 ort", ("address-de", "weg 12, bei 12345")),
    ("au 12 rue de la Paix, 75002 Paris", ("address-fr", "12 rue de la Paix, 75002")),
    ("12 rue x 5, 75001 p", ("address-fr", "rue x 5, 75001")),
    ("la calle Mayor 7, 28013 Madrid", ("address-es", "calle Mayor 7, 28013")),
    ("adres: z 4b te 1234 AB x", ("address-nl", "adres: z 4b te 1234 AB")),
    ("de Kerkstraat 4b, 1017 GC", ("address-nl", "Kerkstraat 4b, 1017 GC")),
    ("at 221B Baker Street, London NW1 6XE now", ("address-en", "221B Baker Street, London NW1 6XE")),
    ("5 Main St, Springfield IL 62704", ("address-en", "5 Main St, Springfield IL 62704")),
    ("road 5 in sw1a 1aa", ("address-en", "road 5 in sw1a 1aa")),
    ("historia clínica: 4455 a", ("medical-record-es", "historia clínica: 4455")),
    ("MRN AB-12345 66 x", ("medical-record", "MRN AB-12345 66")),
    ("NIR 1 85 05 78 006 084 91 q", ("fr-nir", "NIR 1 85 05 78 006 084 91")),
    ("DNI: 12345678Z ok", ("es-dni", "DNI: 12345678Z")),
    ("NIE X-1234567-L ok", ("es-dni", "NIE X-1234567-L")),
    ("bsn 111222333 ok", ("nl-bsn", "bsn 111222333")),
    ("bsn: 1112.22.333 ok", ("nl-bsn", "bsn: 1112.22.333")),
    ("KVNR A123456780 ok", ("de-kvnr", "KVNR A123456780")),
    ("mevrouw? Mevrouw Janssen kwam", ("titled-name-nl", "Mevrouw Janssen")),
    ("Mr." + " " * 25 + "Smith came", ("titled-name-en", "Mr." + " " * 25 + "Smith")),
    ("by Anna van der Berg today", ("untitled-name", "Anna van der Berg")),
]


def test_written_forms(spark):
    for (text, expect), got in zip(CASES, found(spark, [t for t, _ in CASES]), strict=True):
        assert expect in [g[:2] for g in got], (text, got)
    none = ["DNI: 12345678A ok", "bsn 123456789 ok", "NIR 1 85 13 78 006 084 91 q", "number 111222333", "Down Syndrome", "ABC DEF", "aB Cd", "Vincent Van", None, ""]
    assert found(spark, [t or "" for t in none], tuple(r for r in pii.RULES if r.id in ("es-dni", "nl-bsn", "fr-nir", "untitled-name"))) == [[]] * len(none)


def plain_phones(text):
    """Numbers by trying every plan at every place: the longest prefix that leads to a number, then as many digits as its plan allows."""
    out, at = [], 0
    while at < len(text):
        m = phone_at(text, at)
        if m:
            out.append(text[at:m])
            at = m
        else:
            at += 1
    return out


def phone_at(text, at):
    before = text[max(0, at - 2) : at]
    if before and (before[-1].isalnum() and before[-1].isascii() or before[-1] == "+") or len(before) == 2 and before[0] in "0123456789" and before[1] in "./-":
        return None
    start = at + (text[at] == "(")
    if re.match(pii.DATE, text[start:]) or re.match(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])", text[start:]):
        return None

    def digits(i, wanted):
        """After the wanted characters with up to three signs after each."""
        for c in wanted:
            if text[i : i + 1] != c:
                return None
            i += 1 + signs(i + 1)
        return i

    def signs(i):
        n = 0
        while n < 3 and text[i + n : i + n + 1] and text[i + n] in " ()/.-":
            n += 1
        return n

    def national(i, plan):
        if not re.match(plan.first, text[i : i + 1]):
            return None
        i, n, ends = i + 1, 1, {}
        ends[1] = i
        while n < plan.most:
            j = i + signs(i)
            if not (text[j : j + 1] and text[j] in "0123456789"):
                break
            i, n = j + 1, n + 1
            ends[n] = i
        for n in range(max(ends), plan.least - 1, -1):
            if not re.match("[0-9A-Za-z]", text[ends[n] : ends[n] + 1]):
                return ends[n]
        return None

    for plan in pii.PLANS:
        for prefix in ("+" + plan.country, "00" + plan.country):
            if (i := digits(start, prefix)) is not None:
                skipped = i
                if plan.trunk and text.startswith(f"({plan.trunk})", i):
                    skipped = i + 3 + signs(i + 3)
                for j in (skipped, i):
                    if (end := national(j, plan)) is not None:
                        return end
    for trunk in ("0", ""):
        ends = [(national(i, p)) for p in pii.PLANS if p.trunk == trunk and (i := digits(start, trunk)) is not None]
        for p_end in [e for _, e in sorted(((f"{p.first}|{p.least}|{p.most}", e) for p, e in zip([p for p in pii.PLANS if p.trunk == trunk], ends)), key=lambda t: t[0])] if ends else []:
            if p_end is not None:
                return p_end
    return None


PHONES = ["+49 (0)30 1234567", "030/123 45 67", "020 7946 0958", "0044 20 7946 0958", "+1 (212) 555-0100", "06 12 34 56 78", "+34 912 345 678", "+31 20 123 4567"]


def test_telephones(spark):
    rules = (BY_ID["phone"],)
    assert [[g[1] for g in row] for row in found(spark, [f"call {p}, now" for p in PHONES], rules)] == [[p] for p in PHONES]
    none = ["born 01.02.1980", "2024-05-06 10:00", "1234", "at 192.168.0.1", "v1.2.3.4.5", "x030 1234567", "id 00000000000000000000", "12 3 4 5"]
    assert found(spark, none, rules) == [[]] * len(none)


def test_telephones_at_random(spark):
    rng = random.Random(4)
    pieces = ["+49", "0049", "+44", "+1", "030", "0", "06", "(0)", "(", ")", " ", "  ", "-", ".", "/", "12", "345", "6789", "555", "x", ",", "01.02.1980", "212"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    got = [[g[1] for g in row] for row in found(spark, texts, (BY_ID["phone"],))]
    want = [plain_phones(t) for t in texts]
    assert got == want


def test_scan_against_a_plain_one(spark):
    """Rule by rule with another regex engine, validators in plain Python, and a merge by sorting."""
    import pyarrow.parquet as pq
    import regex

    def valid(rule, value):
        number = re.sub(r"[\s.-]", "", (re.search(r"(?i)(?:(?<![A-Z])[A-Z][ .-]?|[XYZ])?[0-9][0-9 .-]{6,20}[A-Z]?", value) or [value])[0]).upper()
        if rule == "es-dni":
            m = re.fullmatch("([XYZ0-9][0-9]{7})([A-Z])", number)
            return bool(m) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[1].translate(str.maketrans("XYZ", "012"))) % 23] == m[2]
        if rule == "nl-bsn":
            return len(number) == 9 and (sum(int(c) * (9 - i) for i, c in enumerate(number[:8])) - int(number[8])) % 11 == 0 and number != "0" * 9
        if rule == "de-kvnr":
            return bool(re.fullmatch("[A-Z][0-9]{9}", number))
        if rule == "fr-nir":
            return bool(re.fullmatch("[12][0-9]{12}([0-9]{2})?", number)) and 1 <= int(number[3:5]) <= 12
        return True

    texts = [t or "" for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()] + [t for t, _ in CASES] + PHONES
    want = []
    for text in texts:
        spans = sorted((m.start(), m.end(), r.id, r.confidence) for r in pii.RULES for m in regex.finditer(r.guard + r.pattern, text) if valid(r.id, m.group()))
        merged = []
        for s in spans:
            if merged and s[0] < merged[-1][1]:
                last = merged[-1]
                takes = last[3] != "high" and (s[3] == "high" or s[1] - s[0] > last[1] - last[0])
                merged[-1] = (last[0], max(last[1], s[1]), *(s if takes else last)[2:])
            else:
                merged.append(s)
        want.append([(rule, text[a:b], confidence) for a, b, rule, confidence in merged])
    assert found(spark, texts) == want and sum(map(len, want)) > 40


def plain_names(text):
    """Spans of names by tokens: from each name on up to four tokens, particles between, to the last name; overlaps are joined."""
    tokens = [(m[0], *m.span()) for m in re.finditer(r"[A-Za-zÀ-ÖØ-öø-ÿß'-]+", text)]
    name = lambda w: bool(len(w) >= 2 and re.match("[A-ZÀ-ÖØ-Þ]", w) and not re.fullmatch("[A-ZÀ-ÖØ-Þ]{2,}", w) and not re.search("[a-z][A-Z]", w) and w.lower() not in pii.NO_NAMES)
    spans = []
    for at, (word, start, _) in enumerate(tokens):
        if not name(word):
            continue
        end = None
        for near in range(at + 1, min(at + 4, len(tokens))):
            if text[tokens[near - 1][2] : tokens[near][1]].strip():
                break
            if tokens[near][0].lower() in pii.PARTICLES:
                continue
            if not name(tokens[near][0]):
                break
            end = tokens[near][2]
        if end and spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        elif end:
            spans.append([start, end])
    return [text[a:b] for a, b in spans]


def test_names_against_tokens(spark):
    rng = random.Random(8)
    words = ["Anna", "Berg", "van", "de", "Van", "der", "x", "Émile", "ABC", "McCoy", "Case", "O'Neil", "Jean-Luc", "A", ",", "\n", "7"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = found(spark, texts, (BY_ID["untitled-name"],))
    assert [[g[1] for g in row] for row in got] == [plain_names(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 200_000, "0" * 200_000, "born" + " " * 200_000, "Aa " * 60_000, "str. 1 " * 20_000, "+" + "(" * 200_000])
def test_long_texts_take_linear_time(spark, text):
    found(spark, ["warm up"])
    start = time.time()
    found(spark, [text])
    assert time.time() - start < 60
