"""Assertion scopes by rules with directions: cues before a finding, after it or on either side, pseudo cues and terminators.

A rule set is data: a table of cue, category and direction, read from JSON or built in. All of it is one array expression a
text, so that rows aren't multiplied by rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .assertions import FORWARD, NORMAL, PSEUDO, SCOPE_WORDS, TERMINATE, spaced

DIRECTIONS = ("FORWARD", "BACKWARD", "BIDIRECTIONAL", "PSEUDO", "TERMINATE")
CATEGORIES = ("NEGATED_EXISTENCE", "POSSIBLE_EXISTENCE", "HISTORICAL", "HYPOTHETICAL", "FAMILY", "PSEUDO", "TERMINATE")
NEGATION = "NEGATED_EXISTENCE"
#: Cues that follow their finding, and cues that reach both ways (fixed values, own selection).
BACKWARD: dict[str, tuple[str, ...]] = {
    "en": ("ruled out", "is absent", "not seen", "unlikely"), "de": ("verneint", "ausgeschlossen", "nicht nachweisbar"), "fr": ("absente", "est exclu"), "es": ("descartado", "ausente"), "nl": ("uitgesloten", "afwezig"),
}
BOTH: dict[str, tuple[str, ...]] = {"en": ("excluded", "negative"), "de": ("negativ",), "fr": ("négatif",), "es": ("negativo",), "nl": ("negatief",)}
#: Characters of context on either side of a cue of normality, and to the left of a chunk.
NORMAL_CONTEXT, LEFT_CONTEXT = 30, 64


@dataclass(frozen=True)
class Rule:
    cue: str  # lower case, words parted by single blanks
    category: str
    direction: str


def parse_rules(text: str) -> list[Rule]:
    """Rules of a JSON object with ``context_rules`` (literal, category, direction); errors name the rule that is wrong."""
    data = json.loads(text)
    if "context_rules" not in data:
        raise ValueError("the rules' JSON has no context_rules")
    rules = []
    for at, entry in enumerate(data["context_rules"]):
        missing = [k for k in ("literal", "category", "direction") if not entry.get(k)]
        if missing:
            raise ValueError(f"rule {at} has no {', '.join(missing)}")
        if entry["category"] not in CATEGORIES or entry["direction"] not in DIRECTIONS:
            raise ValueError(f"rule {at}: unknown category {entry['category']} or direction {entry['direction']}")
        rules.append(Rule(" ".join(entry["literal"].lower().split()), entry["category"], entry["direction"]))
    return rules


def built_in(lang: str) -> list[Rule]:
    """The rules of a language, in the order in which scopes are reported."""
    by = (("FORWARD", FORWARD), ("BACKWARD", BACKWARD), ("BIDIRECTIONAL", BOTH), ("PSEUDO", PSEUDO), ("TERMINATE", TERMINATE))
    return [Rule(cue, d if d in ("PSEUDO", "TERMINATE") else NEGATION, d) for d, table in by for cue in table.get(lang, ())]


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once: an array of one value binds it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _places(s: Column, rules: list[Rule]) -> Column:
    """(start, end), from 1 and end exclusive, of each cue's first occurrence as whole words in a ``spaced`` text."""
    if not rules:
        return F.array().cast("array<struct<start:int,end:int>>")
    cues = F.array(*[F.lit(r.cue) for r in rules])
    found = F.transform(cues, lambda c: F.struct((F.position(F.concat(F.lit(" "), c, F.lit(" ")), s) + 1).alias("start"), F.length(c).alias("n")))
    return F.transform(F.filter(found, lambda f: f["start"] > 1), lambda f: F.struct(f["start"].alias("start"), (f["start"] + f["n"]).alias("end")))


def _words(part: Column, last: bool) -> Column:
    words = F.filter(F.split(F.trim(part), " +"), lambda w: w != "")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - SCOPE_WORDS + 1, F.lit(1)), SCOPE_WORDS) if last else F.slice(words, 1, SCOPE_WORDS), " ")


def scopes(s: Column, rules: list[Rule], category: str = NEGATION) -> Column:
    """cue, direction, scope of each rule of a category that has words in reach, in the rules' order; ``s`` is ``spaced``.

    A cue counts at its first occurrence; one that overlaps a pseudo cue's occurrence doesn't. A scope is at most SCOPE_WORDS
    words on a side, up to the nearest terminator's first occurrence. A scope on both sides shows its cue between them.
    """
    used = [r for r in rules if r.category == category and r.direction in DIRECTIONS[:3]]
    if not used:
        return F.array().cast("array<struct<cue:string,direction:string,scope:string>>")
    pseudo, ends = ([r for r in rules if r.direction == d] for d in ("PSEUDO", "TERMINATE"))
    table = F.array(*[F.struct(F.lit(r.cue).alias("cue"), F.lit(r.direction).alias("direction")) for r in used])

    def scope(x: Column, rule: Column) -> Column:
        text, start = x["s"], F.position(F.concat(F.lit(" "), rule["cue"], F.lit(" ")), x["s"]) + 1
        return _bound(
            F.struct(start.alias("a"), (start + F.length(rule["cue"])).alias("b")),
            lambda p: F.when(
                (p["a"] > 1) & ~F.exists(x["pseudo"], lambda q: (p["a"] < q["end"]) & (p["b"] > q["start"])),
                F.struct(rule["cue"].alias("cue"), rule["direction"].alias("direction"), _reach(text, p, x["ends"], rule).alias("scope")),
            ),
        )

    def found(x: Column) -> Column:
        return F.filter(F.transform(table, lambda r: scope(x, r)), lambda f: f["scope"] != "")

    return _bound(F.struct(s.alias("s"), _places(s, pseudo).alias("pseudo"), _places(s, ends).alias("ends")), found)


def _reach(text: Column, p: Column, ends: Column, rule: Column) -> Column:
    stop = F.coalesce(F.array_min(F.transform(F.filter(ends, lambda e: e["start"] > p["b"]), lambda e: e["start"])), F.length(text) + 1)
    begin = F.coalesce(F.array_max(F.transform(F.filter(ends, lambda e: e["end"] < p["a"]), lambda e: e["end"])), F.lit(1))
    after = _words(F.substring(text, p["b"], F.greatest(stop - p["b"], F.lit(0))), False)
    before = _words(F.substring(text, begin, F.greatest(p["a"] - begin, F.lit(0))), True)

    def joined(sides: Column) -> Column:
        both = F.concat(sides["before"], F.lit(" ["), rule["cue"], F.lit("] "), sides["after"])
        return F.when((sides["before"] != "") & (sides["after"] != ""), both).otherwise(F.concat(sides["before"], sides["after"]))

    two = _bound(F.struct(before.alias("before"), after.alias("after")), joined)
    return F.when(rule["direction"] == "FORWARD", after).when(rule["direction"] == "BACKWARD", before).otherwise(two)


def normal_contexts(s: Column, lang: str) -> Column:
    """``cue: context`` of each cue of normality, with NORMAL_CONTEXT characters of the text on either side of it."""
    cues = F.array(*[F.lit(c) for c in NORMAL.get(lang, NORMAL["en"])])

    def context(cue: Column) -> Column:
        at = F.position(F.concat(F.lit(" "), cue, F.lit(" ")), s) + 1
        start = F.greatest(at - NORMAL_CONTEXT, F.lit(1))
        return F.when(at > 1, F.concat(cue, F.lit(": "), F.trim(F.substring(s, start, at + F.length(cue) + NORMAL_CONTEXT - start))))

    return F.array_compact(F.transform(cues, context))


def status(s: Column, lang: str, rules: list[Rule] | None = None) -> Column:
    """Negated before normal before affirmed, of a ``spaced`` text."""
    negated = F.size(scopes(s, built_in(lang) if rules is None else rules)) > 0
    return F.when(negated, "negated").when(F.size(normal_contexts(s, lang)) > 0, "normal").otherwise("affirmed")


def with_left_context(text: Column, start: Column, end: Column, own: Column, lang: str, rules: list[Rule] | None = None) -> Column:
    """A chunk's status; an affirmed one is looked at again with LEFT_CONTEXT characters of the text before it.

    ``start`` counts from 0, ``end`` is exclusive. The wider look only ever turns affirmed to negated or normal.
    """
    begin = F.greatest(start - LEFT_CONTEXT, F.lit(0))
    wider = F.substring(text, begin + 1, end - begin)
    again = status(spaced(wider), lang, rules)
    return F.when((own == "affirmed") & (begin < start), again).otherwise(own)
