"""Personal data: rules, validators, merging of overlaps and redaction, as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    confidence: str  # high, or review for findings that need a look
    pattern: str  # of those that queries with SQL use, one that Java's and RE2's engines read alike
    token: str
    locales: tuple[str, ...] = ()  # whose forms they are; none: all
    guard: str = ""  # goes before the pattern: where a match can't begin, so that long runs are tried once; matches stay the same
    shape: str = ""  # a text without a match of this plainer pattern has none of the rule's and isn't searched
    group: str = ""  # nor is one without a match of the group's pattern, which is looked for once for all its rules


_MONTH = r"(?:[Jj]an|[Ff]eb|[Mm]ar|[Aa]pr|[Mm]ay|[Jj]un|[Jj]ul|[Aa]ug|[Ss]ep|[Oo]ct|[Nn]ov|[Dd]ec)[a-z]*"

#: Titles, particles and words that are no names (fixed values).
TITLES = {
    "en": ("Mr", "Mrs", "Ms", "Dr", "Prof"),
    "de": ("Herr", "Frau", "Dr", "Prof"),
    "fr": ("Monsieur", "Madame", "M", "Mme", "Dr", "Prof"),
    "es": ("Señor", "Señora", "Sr", "Sra", "Dr", "Dra"),
    "nl": ("Dhr", "Mevrouw", "Mw", "Dr", "Prof"),
}
PARTICLES = ("de", "del", "da", "di", "du", "le", "la", "van", "von", "der", "den")
NO_NAMES = (
    "abnormality", "biolord", "called", "carinatum", "case", "clinical", "disease", "down", "hpo", "model", "naam", "nachname", "name", "nom",
    "paciente", "patient", "pectus", "phenotype", "syndrome", "term", "tracheomalacia", "vorname",
)
#: Words near a name that speak for one (fixed values, in small letters).
NAME_CONTEXT = ("called", "case", "name", "patient", "subject", "nachname", "vorname", "naam", "patiënt", "nom", "paciente")


#: Names of data that identify a person, by locale and kind (fixed values).
LABELS = {
    ("birth", "en"): ("DOB", "D.O.B.", "date of birth", "birth date", "birthdate", "born on", "born"),
    ("birth", "de"): ("Geburtsdatum", "Geburtstag", "geboren am", "geboren", "geb."),
    ("birth", "fr"): ("date de naissance", "né le", "née le"),
    ("birth", "es"): ("fecha de nacimiento", "nacido el", "nacida el"),
    ("birth", "nl"): ("geboortedatum", "geboren op", "geboren"),
    ("record", "en"): ("MRN", "medical record number", "medical record no.", "patient ID", "NHS number"),
    ("record", "es"): ("número de historia clínica", "historia clínica", "paciente ID"),
    ("dni", "es"): ("DNI", "NIE", "NIF"),
    ("bsn", "nl"): ("BSN", "burgerservicenummer"),
    ("kvnr", "de"): ("KVNR", "Krankenversichertennummer", "Versichertennummer"),
    ("nir", "fr"): ("NIR", "numéro de sécurité sociale", "sécurité sociale", "securite sociale"),
}
#: Words of streets, by locale (fixed values); in some languages they are also the ends of a street's name.
STREETS = {
    "en": ("street", "st", "road", "rd", "avenue", "ave", "drive", "dr", "lane", "square", "court", "terrace"),
    "de": ("straße", "strasse", "str", "weg", "platz", "allee", "gasse", "ring", "damm"),
    "fr": ("rue", "avenue", "av", "boulevard", "bd", "chemin", "place", "allée", "impasse", "quai"),
    "es": ("calle", "c/", "avenida", "avda", "paseo", "plaza", "camino", "carretera"),
    "nl": ("straat", "laan", "weg", "plein", "gracht", "kade", "singel", "adres"),
}
COMPOUNDED = ("de", "nl")
#: Postcodes: Britain's and the United States', Germany's, France's, Spain's, the Netherlands'.
POSTCODES = {
    "en": r"(?:[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}|[A-Z]{2} [0-9]{5}(?:-[0-9]{4})?)",
    "de": "[0-9]{5}", "fr": "[0-9]{5}", "es": "[0-9]{5}", "nl": "[1-9][0-9]{3} ?[A-Z]{2}",
}

#: What every postcode of a locale holds.
POSTCODE_SHAPES = {"en": "[0-9][A-Za-z]{2}|[0-9]{5}", "de": "[0-9]{5}", "fr": "[0-9]{5}", "es": "[0-9]{5}", "nl": "[1-9][0-9]{3} ?[A-Za-z]{2}"}

_DAY, _MONTH_NUMBER, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:[12][0-9]{3}|[0-9]{2})"
#: A date in digits: day and month in either order with one of the usual signs, or year first.
DATE = rf"(?:{_DAY}[./-]{_DAY}[./-]{_YEAR}|[12][0-9]{{3}}[./-]{_MONTH_NUMBER}[./-]{_DAY})(?![0-9])"

_NO_LETTER = r"(?<![\p{L}\p{M}0-9])"
#: Words between a number, a street's word and a postcode, at most.
ADDRESS_WORDS = 6


def spelled(words: tuple[str, ...]) -> str:
    """Any of the words, longer ones first, with blanks of any number for one."""
    return "|".join(r"\s++".join(re.escape(part) for part in w.split(" ")) for w in sorted(words, key=lambda w: (-len(w), w)))


def labelled(kind: str, locale: str, value: str) -> str:
    """The name of a datum, blanks and at most one sign, and its value. Blanks are taken whole, so that a long run of them is passed once."""
    return rf"(?iu){_NO_LETTER}(?:{spelled(LABELS[kind, locale])})\s*+[:=#-]?\s*+{value}"


def grouped(*parts: str) -> str:
    """Parts of a number with a blank, dot or hyphen, or nothing, between one and the next."""
    return "[ .-]?".join(parts) + "(?![0-9])"


def address(locale: str) -> str:
    """A street with its house number, before or after it, and a postcode further on in the line."""
    gap, word = r"(?:[^\S\n]++|,[^\S\n]*+)", r"[\p{L}][\p{L}\p{M}.'/-]*+"
    more = rf"(?:{gap}{word}){{0,{ADDRESS_WORDS}}}?"
    number = r"[0-9]{1,5}[A-Z]?(?![\p{L}\p{M}0-9])"
    own = rf"(?:{spelled(STREETS[locale])})\.?(?![\p{{L}}\p{{M}}0-9])"
    street = rf"(?<![\p{{L}}\p{{M}}0-9-])(?:[\p{{L}}\p{{M}}-]*?){own}" if locale in COMPOUNDED else _NO_LETTER + own
    sign = r"(?:\s*+[:#-])?"
    return rf"(?iu)(?:{_NO_LETTER}{number}{more}{gap}{street}|{street}{sign}{more}{gap}{number}){more}{gap}{POSTCODES[locale]}(?![\p{{L}}\p{{M}}0-9])"


@dataclass(frozen=True)
class Plan:
    """A region's numbering plan: country code, trunk prefix, first digits of a national number and its least and greatest length."""

    region: str
    country: str
    trunk: str
    first: str
    least: int
    most: int


#: Plans by the regions' published rules (fixed values). A region without a trunk prefix needs its country code or a full national number.
PLANS = (
    Plan("GB", "44", "0", "[1-35789]", 9, 10), Plan("US", "1", "", "[2-9]", 10, 10), Plan("DE", "49", "0", "[1-9]", 7, 11),
    Plan("FR", "33", "0", "[1-9]", 9, 9), Plan("ES", "34", "", "[6-9]", 9, 9), Plan("NL", "31", "0", "[1-9]", 9, 9),
)


def telephone(plans: tuple[Plan, ...] = PLANS) -> str:
    """One pattern for numbers of all plans: a trie of their prefixes (+CC, 00CC, trunk or none), each end with what may follow.

    Between digits stand at most three signs; a trunk zero may be given in brackets after the country code. Dates, network addresses and
    parts of longer numbers are none.
    """
    sign = "[ ()/.-]{0,3}"
    root: dict = {}

    def put(prefix: str, ending: str) -> None:
        node = root
        for c in prefix:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(ending)

    for p in plans:
        national = f"{p.first}(?:{sign}[0-9]){{{p.least - 1},{p.most - 1}}}"
        for prefix in ("+" + p.country, "00" + p.country):
            put(prefix, (rf"(?:\({p.trunk}\){sign})?" if p.trunk else "") + national)
        put(p.trunk, national)

    def spelled_out(node: dict) -> str:
        """The longest prefix is tried first."""
        ways = [re.escape(c) + sign + spelled_out(below) for c, below in sorted(node.items()) if c] + sorted(node.get("", ()))
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    inside = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"
    return rf"(?<![0-9A-Za-z+])(?<![0-9][./-])\(?(?!{DATE})(?!{inside}){spelled_out(root)}(?![0-9A-Za-z])"


def titled_name(titles: tuple[str, ...]) -> str:
    """A title and one or two capitalised words."""
    name = r"\p{Lu}[\p{L}\p{M}'-]+"
    return rf"(?<![\p{{L}}\p{{M}}])(?:{'|'.join(titles)})\.?\s++{name}(?:\s++{name})?(?![\p{{L}}\p{{M}}])"


def untitled_name() -> str:
    """Two or more capitalised words, at most two particles between one and the next.

    A word in capitals only, one with a capital inside, and NO_NAMES are no names; a particle is one however it is written,
    but for the first word.
    """
    letter, capital = "A-Za-zÀ-ÖØ-öø-ÿß'-", "A-ZÀ-ÖØ-Þ"
    ends = f"(?![{letter}])"
    particle = f"(?i:{'|'.join(PARTICLES)}){ends}"
    name = rf"(?![{capital}]{{2,}}{ends})(?!(?i:{'|'.join(NO_NAMES)}){ends})(?![{letter}]*[a-z][A-Z])[{capital}][{letter}]++"
    return rf"(?<![{letter}]){name}(?:\s++(?:{particle}\s++){{0,2}}(?!{particle}){name})++"


#: What every match of a group's rules begins with.
GROUPS = {
    "label": rf"(?iu){_NO_LETTER}(?:{'|'.join(sorted({re.escape(w.split(' ')[0]) for words in LABELS.values() for w in words}))})",
    "title": rf"(?<![\p{{L}}\p{{M}}])(?:{'|'.join(sorted({t for titles in TITLES.values() for t in titles}))})\.?\s++\p{{Lu}}",
}

#: The number of a record: letters or none, then groups with digits, four signs or more.
RECORD = r"(?=[A-Z0-9 -]{4})(?:[A-Z]{1,4}-?)?[0-9][0-9A-Z]*+(?:[ -][0-9]++)*+"

#: Rules for all texts, then by locale.
RULES: tuple[Rule, ...] = (
    Rule("email", "contact", "high", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[EMAIL]", guard=r"(?:\G|(?<![A-Za-z0-9._%+-]))", shape="@"),
    Rule("url", "contact", "high", r"(?:https?://|www\.)[A-Za-z0-9./?=&_%#:~+-]+", "[URL]", shape=r"http|www\."),
    Rule("ipv4", "network", "high", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b", "[IP]", shape=r"[0-9]\.[0-9]"),
    Rule("date", "date", "review", rf"\b(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{2,4}}|[0-9]{{1,2}} {_MONTH} [0-9]{{4}})\b", "[DATE]"),
    Rule("phone", "contact", "review", telephone(), "[PHONE]", shape=r"(?:[0-9][ ()/.-]{0,3}){8}"),
    *[Rule(f"titled-name-{locale}", "name", "review", titled_name(titles), "[NAME]", (locale,), group="title") for locale, titles in TITLES.items()],
    Rule("untitled-name", "name", "review", untitled_name(), "[NAME]"),
    *[Rule(f"birth-{locale}", "birth", "high", labelled(kind, locale, DATE), "[BIRTH]", (locale,), group="label") for kind, locale in LABELS if kind == "birth"],
    *[Rule("medical-record" + ("" if locale == "en" else f"-{locale}"), "identity", "high", labelled(kind, locale, RECORD), "[RECORD]", (locale,), group="label") for kind, locale in LABELS if kind == "record"],
    Rule("es-dni", "identity", "high", labelled("dni", "es", grouped("(?:[0-9]{8}|[0-9]{2}[.][0-9]{3}[.][0-9]{3}|[XYZ][ -]?[0-9]{7})", "[A-Z]") + "(?![A-Z])"), "[ID]", ("es",), group="label"),
    Rule("nl-bsn", "identity", "high", labelled("bsn", "nl", grouped(*["[0-9]"] * 9)), "[ID]", ("nl",), group="label"),
    Rule("de-kvnr", "identity", "high", labelled("kvnr", "de", grouped("[A-Z]", *["[0-9]{3}"] * 3)), "[ID]", ("de",), group="label"),
    Rule("fr-nir", "identity", "high", labelled("nir", "fr", grouped("[12]", *["[0-9]{2}"] * 3, "[0-9]{3}", "[0-9]{3}(?:[ .-]?[0-9]{2})?")), "[ID]", ("fr",), group="label"),
    *[Rule(f"address-{locale}", "address", "high", address(locale), "[ADDRESS]", (locale,), shape=POSTCODE_SHAPES[locale]) for locale in STREETS],
)

#: Any run of digits and the signs of telephone numbers: what a search without plans takes.
DIGIT_RUN = Rule("digit-run", "contact", "review", r"\+?[0-9][0-9 ()/.-]{7,}[0-9]", "[PHONE]")

FINDING = "array<struct<start:int,end:int,rule:string,confidence:string,token:string>>"


def matches(text: Column, pattern: str) -> Column:
    """(start, end) of each match, leftmost and non-overlapping, in code points; end exclusive.

    The text is cut at its matches: the parts' lengths give the places, in one pass of the regex engine and without a UDF.
    """
    # a mark before and after each match; texts are rid of the two control signs first
    clean = F.translate(text, "\x02\x03", "  ")
    cut = F.split(F.regexp_replace(clean, f"({pattern})", "\x02$1\x03"), "\x02", -1)
    start = F.struct(F.length(F.get(cut, F.lit(0))).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        n = F.length(F.substring_index(part, "\x03", 1))
        spans = F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"))))
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), spans.alias("found"))

    found = F.aggregate(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), start, step)["found"]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def valid_dni(value: Column) -> Column:
    """Check letter of a Spanish DNI or NIE: the number modulo 23."""
    digits = F.translate(F.substring(value, 1, 8), "XYZ", "012")
    ok = value.rlike(r"\A[XYZ0-9][0-9]{7}[A-Z]\z")
    return F.coalesce(F.when(ok, F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (F.try_to_number(digits, F.lit("99999999")).cast("int") % 23) + 1, F.lit(1)) == F.substring(value, 9, 1)), F.lit(False))


def valid_bsn(value: Column) -> Column:
    """Weighted sum of a Dutch BSN's nine digits, 9 to 2 and -1, is divisible by 11."""
    digit = lambda i: F.substring(value, i, 1).try_cast("int")
    total = sum((digit(i) * (10 - i) for i in range(1, 9)), F.lit(0)) - digit(9)
    return F.coalesce(F.when(value.rlike(r"\A[0-9]{9}\z"), (total % 11 == 0) & (value != "000000000")), F.lit(False))


def valid_kvnr(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[A-Z][0-9]{9}\z"), F.lit(False))


def valid_nir(value: Column) -> Column:
    month = F.substring(value, 4, 2).try_cast("int")
    return F.coalesce(F.when(value.rlike(r"\A[12][0-9]{12}([0-9]{2})?\z"), month.between(1, 12)), F.lit(False))


VALIDATORS = {"es-dni": valid_dni, "nl-bsn": valid_bsn, "de-kvnr": valid_kvnr, "fr-nir": valid_nir}


def scan(text: Column, locale: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules' findings of a text, sorted by place; validators drop what fails.

    Texts hold forms of other countries than their language's, so rules of all locales apply; with a ``locale`` only its
    own and the general ones do.
    """
    none = F.array().cast(FINDING)

    def parts(has: Column) -> Column:
        out = []
        for rule in rules:
            check = VALIDATORS.get(rule.id)
            found = matches(text, rule.guard + rule.pattern)
            if check:
                found = F.filter(found, _passes(text, check))
            named, asked = F.transform(found, _named(rule)), []
            if locale is not None and rule.locales:
                asked.append(locale.isin(*rule.locales))
            if rule.group:
                asked.append(has[rule.group])
            if rule.shape:
                asked.append(text.rlike(rule.shape))
            for condition in reversed(asked):
                named = F.when(condition, named).otherwise(none)
            out.append(named)
        return F.concat(*out)

    # an array of one value binds what the text has, so that each group is looked for once
    has = F.array(F.struct(*[text.rlike(pattern).alias(name) for name, pattern in GROUPS.items()]))
    return F.array_sort(F.get(F.transform(has, parts), F.lit(0)))


def identifier(found: Column) -> Column:
    """The number in a finding that also holds its name, without blanks, dots and hyphens, in capitals."""
    number = F.regexp_extract(found, r"(?i)(?:(?<![A-Z])[A-Z][ .-]?|[XYZ])?[0-9][0-9 .-]{6,20}[A-Z]?", 0)
    return F.upper(F.regexp_replace(F.when(number == "", found).otherwise(number), r"[\s.-]", ""))


def _passes(text: Column, check):
    return lambda m: check(identifier(F.substring(text, m["start"] + 1, m["end"] - m["start"])))


def _named(rule: Rule):
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(rule.id).alias("rule"), F.lit(rule.confidence).alias("confidence"), F.lit(rule.token).alias("token"))


def merge(findings: Column) -> Column:
    """Overlapping findings become one: the wider span, named by the first of high confidence, else by the longer one, by the first of equals."""
    first = F.array().cast(FINDING)

    def step(acc: Column, f: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        overlap = F.coalesce(f["start"] < last["end"], F.lit(False))
        taken = (last["confidence"] != "high") & ((f["confidence"] == "high") | (f["end"] - f["start"] > last["end"] - last["start"]))
        winner = F.when(taken, f).otherwise(last)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], f["end"]).alias("end"), *[winner[k].alias(k) for k in ("rule", "confidence", "token")])
        return F.when(overlap, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(f)))

    return F.aggregate(F.array_sort(findings), first, step)


def redact(text: Column, findings: Column, review: bool = False) -> Column:
    """The text with tokens in place of merged findings of high confidence, and of others if asked."""
    kept = merge(findings if review else F.filter(findings, lambda f: f["confidence"] == "high"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, f: Column) -> Column:
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, f["start"] - acc["at"]), f["token"])
        return F.struct(out.alias("out"), f["end"].alias("at"))

    return F.aggregate(kept, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
