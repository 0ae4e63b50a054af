"""Assertion status of a chunk by cue words, their scopes and cues of normality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words a cue reaches over.
SCOPE_WORDS = 7
#: Cues by language: of negation before the finding, pseudo cues, words that end a scope, cues of normality (fixed values,
#: own selection after published cue lists).
FORWARD: dict[str, tuple[str, ...]] = {
    "en": ("no", "not", "without", "denies", "negative for", "absence of", "no evidence of"),
    "de": ("kein", "keine", "keinen", "nicht", "ohne", "verneint"),
    "fr": ("pas de", "pas", "sans", "aucun", "aucune", "absence de"),
    "es": ("no", "sin", "niega", "ausencia de"),
    "nl": ("geen", "niet", "zonder", "ontkent"),
}
PSEUDO: dict[str, tuple[str, ...]] = {"en": ("not only", "no increase", "no change"), "de": ("nicht nur",), "fr": ("pas seulement",), "es": ("no solo",), "nl": ("niet alleen",)}
TERMINATE: dict[str, tuple[str, ...]] = {"en": ("but", "however", "except"), "de": ("aber", "jedoch"), "fr": ("mais",), "es": ("pero",), "nl": ("maar",)}
NORMAL: dict[str, tuple[str, ...]] = {"en": ("normal", "unremarkable"), "de": ("normal", "unauffällig"), "fr": ("normal", "normale"), "es": ("normal",), "nl": ("normaal",)}

#: Spellings of assertion statuses (fixed values).
ALIASES = {
    "affirmed": ("affirmed", "present", "positive", "true", "yes"), "negated": ("negated", "absent", "negative", "excluded", "false", "no"),
    "normal": ("normal", "unremarkable"), "uncertain": ("uncertain", "possible", "probable", "suspected"),
}


def spaced(text: Column) -> Column:
    """Lower case, anything but letters and digits as one blank, blanks at both ends: whole words are then plain strings."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def negated_scopes(s: Column, lang: str = "en") -> Column:
    """Scope of each cue's first occurrence: up to SCOPE_WORDS words after it, cut at a terminating word; pseudo cues have none.

    ``s`` is a ``spaced`` text. Pseudo cues are blotted out once (an array of one value binds the result), and the cues are
    an array that one lambda walks, so that the plan stays small whatever the lexicon's size.
    """
    listed = FORWARD.get(lang, FORWARD["en"])
    has = s.rlike(" (?:" + "|".join(listed) + ") ")  # most texts have none and go no further
    for p in PSEUDO.get(lang, ()):
        s = F.replace(s, F.lit(f" {p} "), F.lit(" \x01 "))
    cues = F.array(*[F.lit(f" {c} ") for c in sorted(listed, key=lambda c: (-len(c), c))])
    ends = " (?:" + "|".join(TERMINATE.get(lang, ()) or ("\x02",)) + ") "

    def scope(text: Column, cue: Column) -> Column:
        at = F.position(cue, text)
        rest = F.get(F.split(F.concat(F.lit(" "), F.substring(text, at + F.length(cue), F.length(text))), ends, 2), F.lit(0))
        words = F.filter(F.split(F.trim(rest), " +"), lambda w: w != "")
        return F.when(at > 0, F.nullif(F.array_join(F.slice(words, 1, SCOPE_WORDS), " "), F.lit("")))

    bound = F.transform(F.array(s), lambda t: F.array_compact(F.transform(cues, lambda c: scope(t, c))))
    return F.when(has, F.get(bound, F.lit(0))).otherwise(F.array().cast("array<string>"))


def is_normal(s: Column, lang: str = "en") -> Column:
    return F.greatest(*[F.position(F.lit(f" {c} "), s) for c in NORMAL.get(lang, NORMAL["en"])], F.lit(0)) > 0


def status(s: Column, lang: str = "en") -> Column:
    """Of a ``spaced`` text: negated before normal before affirmed."""
    return F.when(F.size(negated_scopes(s, lang)) > 0, "negated").when(is_normal(s, lang), "normal").otherwise("affirmed")


def by_language(lang: Column, make, languages=tuple(FORWARD)) -> Column:
    return F.coalesce(*[F.when(lang == x, make(x)) for x in languages], make("en"))


def canonical(raw: Column) -> Column:
    """Any spelling to affirmed, negated, normal or uncertain; unknown ones are affirmed."""
    s = F.lower(F.trim(raw))
    out = F.when(s.isin(*ALIASES["negated"]), "negated").when(s.isin(*ALIASES["normal"]), "normal").when(s.isin(*ALIASES["uncertain"]), "uncertain")
    return out.otherwise("affirmed")


def excluded(raw: Column) -> Column:
    return canonical(raw).isin("negated", "normal")


def prefer(keyword: Column, dependency: Column, preference: str = "keyword") -> Column:
    """Of two detectors' statuses: one by preference, or any negative one."""
    match preference:
        case "keyword":
            return F.coalesce(keyword, dependency)
        case "dependency":
            return F.coalesce(dependency, keyword)
        case "any_negative":
            return F.when((keyword == "negated") | (dependency == "negated"), "negated").otherwise(F.coalesce(keyword, dependency))
    raise ValueError(f"unknown preference {preference}")
