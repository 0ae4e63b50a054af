"""Scalar text functions as Column expressions: cleaning, chunking, ids, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str

#: Words before which a sentence's clause is split (fixed values: own list of coordinating words by language).
CONJUNCTIONS: dict[str, tuple[str, ...]] = {
    "en": ("and", "or", "but", "however", "although", "whereas", "while", "with"),
    "de": ("und", "oder", "aber", "jedoch", "obwohl", "sowie"),
    "fr": ("et", "ou", "mais", "cependant", "tandis"),
    "es": ("y", "o", "pero", "aunque", "mientras"),
    "nl": ("en", "of", "maar", "echter", "terwijl"),
}
#: Abbreviations whose points end no chunk (fixed values).
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "St", "vs", "etc", "approx", "ca", "bzw", "usw", "Nr", "Sr", "Sra", "No")


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_line_endings(t: C) -> Column:
    return F.replace(F.replace(_c(t), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_spaces(t: C) -> Column:
    """Line breaks with the blanks around them become one blank, runs of white space too, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(t), r"[ \t\n\r]*\n[ \t\n\r]*", " "), r"[ \t\n\r]{2,}", " "))


def non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"\A[ \t\n\r]+|[ \t\n\r]+\z", "")), lambda p: p != "")


def noop_chunks(t: C) -> Column:
    return non_blank(F.array(clean_spaces(t)))


def paragraphs(t: C) -> Column:
    return non_blank(F.split(normalize_line_endings(t), r"\n[ \t]*\n+"))


def sentences(t: C) -> Column:
    """Regex sentences: every line gets an end mark if it has none; a sentence runs up to its end marks."""
    lines = non_blank(F.split(normalize_line_endings(t), r"\n"))
    ended = F.transform(lines, lambda s: F.when(s.rlike(r"[.?!]\z"), s).otherwise(F.concat(s, F.lit("."))))
    return non_blank(F.regexp_extract_all(F.array_join(ended, " "), F.lit(r"[^.?!]+[.?!]"), F.lit(0)))


def punctuation_chunks(t: C) -> Column:
    """Split after ``. , : ; ? !`` before white space; points of abbreviations and decimals are kept whole.

    The protected text comes back as it was matched.
    """
    guard = "\x01"
    s = _c(t)
    s = F.regexp_replace(s, r"\b(" + "|".join(ABBREVIATIONS) + r")\.", "$1" + guard)
    s = F.regexp_replace(s, r"([0-9])[.]([0-9])", "$1" + guard + "$2")
    s = F.regexp_replace(s, r"[.,:;?!][ \t\n\r]+", "\x02")
    s = F.regexp_replace(s, r"[.,:;?!]+[ \t\n\r]*\z", "")
    return F.transform(non_blank(F.split(s, "\x02")), lambda p: F.replace(p, F.lit(guard), F.lit(".")))


def conjunction_chunks(t: C, lang: str = "en") -> Column:
    """Split before a conjunction that stands as a word of its own; longest first, any case."""
    words = "|".join(sorted(CONJUNCTIONS.get(lang, CONJUNCTIONS["en"]), key=lambda w: (-len(w), w)))
    return non_blank(F.split(_c(t), rf"(?i)[ \t\n\r]+(?=(?:{words})[ \t\n\r])"))


def words(t: C) -> Column:
    return F.filter(F.split(_c(t), r"[ \t\n\r]+"), lambda w: w != "")


def token_windows(tokens: Column, size: int, step: int) -> Column:
    """Windows of ``size`` tokens every ``step``; one window of all tokens where there are fewer."""
    n = F.size(tokens)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - size, F.lit(step)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(tokens, s + 1, size), " ")))


def edge_clean(t: C, lead: tuple[str, ...], passes: int = 3) -> Column:
    """Strip punctuation and given words from both edges, in at most ``passes`` rounds."""
    s, listed = _c(t), "|".join(sorted(lead, key=lambda w: (-len(w), w)))
    for _ in range(passes):
        s = F.regexp_replace(s, r"\A[ \t\n\r.,:;!?()-]+|[ \t\n\r.,:;!?()-]+\z", "")
        s = F.regexp_replace(s, rf"(?i)\A(?:{listed})[ \t\n\r]+|[ \t\n\r]+(?:{listed})\z", "")
    return F.trim(s)


def normalize_term_id(t: C, prefix: str = "HP") -> Column:
    """``…/PREFIX_1`` becomes ``PREFIX:1``; anything else stays."""
    s = _c(t)
    return F.when(s.startswith(f"{prefix}:"), s).when(s.contains(f"{prefix}_"), F.concat(F.lit(f"{prefix}:"), F.substring_index(s, f"{prefix}_", -1))).otherwise(s)


def canonical_term_id(t: C, prefix: str = "HP", digits: int = 7) -> Column:
    """Many spellings of an id to ``PREFIX:`` and its digits, zero-padded; null where there is none."""
    found = F.regexp_extract(_c(t), rf"(?i)\A[ \t]*(?:{prefix}[:_ -]?)?([0-9]{{1,{digits}}})[ \t]*\z", 1)
    return F.when(found != "", F.concat(F.lit(f"{prefix}:"), F.lpad(found, digits, "0")))


def extract_term_id(t: C, prefix: str = "HP") -> Column:
    return F.nullif(F.regexp_extract(_c(t), rf"{prefix}:[0-9]+", 0), F.lit(""))


def token_set(t: C) -> Column:
    """Distinct words in lower case; a trailing s goes from words of over three characters."""
    found = F.regexp_extract_all(F.lower(_c(t)), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def clean_phrase(t: C) -> Column:
    s = F.regexp_replace(_c(t), r"[(][^)]*[)]", " ")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(s, "[_-]", " ")), r"[ \t\n\r]+", " "))


def slug(t: C, default: str = "default_model") -> Column:
    s = F.lower(F.regexp_replace(F.substring_index(_c(t), "/", -1), "[^A-Za-z0-9]+", "_"))
    return F.coalesce(F.nullif(F.regexp_replace(s, r"\A_+|_+\z", ""), F.lit("")), F.lit(default))


def sanitize_log(t: C, most: int = 500) -> Column:
    return F.substring(F.regexp_replace(_c(t), r"[\x00-\x1f\x7f]+", " "), 1, most)


def normalize_category(t: C) -> Column:
    return F.regexp_replace(F.lower(F.trim(_c(t))), "[ /_-]+", "_")


def sorted_tokens(t: C) -> Column:
    return F.array_join(F.sort_array(words(F.lower(_c(t)))), " ")


def token_sort_similarity(a: C, b: C) -> Column:
    """100 x (1 - edit distance / longer length) of the token-sorted phrases: a JVM-side stand-in for a sequence ratio."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(x, y) / longest))


def query_variants(t: C) -> Column:
    """A phrase, and the phrase without a trailing number and unit."""
    s = clean_spaces(t)
    return F.array_distinct(F.array(s, F.trim(F.regexp_replace(s, r"[ ]*[0-9]+([.,][0-9]+)?[ ]*(mg|kg|g|cm|mm|m|ml|l|%)?\z", ""))))


def spans_overlap(a0: C, a1: C, b0: C, b1: C) -> Column:
    """Half-open overlap; null or degenerate spans never overlap."""
    a0, a1, b0, b1 = map(_c, (a0, a1, b0, b1))
    return F.coalesce((a1 > a0) & (b1 > b0) & (F.greatest(a0, b0) < F.least(a1, b1)), F.lit(False))


def find_from(needle: C, hay: C, start: int = 0) -> Column:
    """0-based place of a string, null if it isn't there."""
    at = F.position(_c(needle), _c(hay), F.lit(start + 1))
    return F.when(at > 0, at - 1)


#: Common words by language (fixed values).
COMMON: dict[str, tuple[str, ...]] = {
    "en": ("the", "and", "of", "with", "for", "that", "was", "are"),
    "de": ("und", "der", "die", "das", "nicht", "mit", "ein", "von"),
    "fr": ("le", "la", "les", "des", "est", "une", "pour", "dans"),
    "es": ("el", "los", "las", "una", "con", "para", "por", "que"),
    "nl": ("het", "een", "van", "niet", "met", "voor", "zijn", "ook"),
}


def detect_language(t: C, default: str = "en", least: int = 20) -> Column:
    """Vote of common words; the default for short texts and for ties without a vote; the first of equals."""
    s = _c(t)

    def elected(votes: Column) -> Column:
        best = F.array_max(votes)
        return F.when(best > 0, F.get(F.array(*map(F.lit, COMMON)), F.array_position(votes, best).cast("int") - 1)).otherwise(default)

    def counted(listed: tuple[str, ...]) -> Column:
        # a listed word has a blank before and after it, which no neighbour shares: what goes without it tells how often it is there
        return lambda x: F.regexp_count(x, F.lit(r" (?:" + "|".join(listed) + r") "))

    # arrays of one value bind the words and the votes, so that each is made once
    spaced = F.array(F.concat(F.lit(" "), F.regexp_replace(F.lower(s), r"[^\p{L}]+", "  "), F.lit(" ")))
    votes = F.transform(spaced, lambda x: F.array(*[counted(ws)(x) for ws in COMMON.values()]))
    return F.when(F.length(F.trim(s)) < least, F.lit(default)).otherwise(F.coalesce(F.get(F.transform(votes, elected), F.lit(0)), F.lit(default)))
