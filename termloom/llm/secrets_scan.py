"""Secret scans: fixed patterns, and strings that a dictionary-primed compressor can't shorten.

The base patterns give spans of three kinds. The method adds a fourth: a *candidate* is a token-like string that begins or ends
within REACH characters of a word of sensitive context, a string that begins as a provider's tokens do, or the whole body of a private key;
lines of one alphabet that follow a reported string go with it, however many. Its novelty is its marginal size: the bytes that it adds when a zstandard
frame of the surrounding text, primed with a dictionary of common identifiers and code, is compressed with it and without
it. Ordinary words, identifiers, paths and repeats of the surroundings cost little; keys and passwords cost nearly what
their characters' entropy is. A candidate whose marginal bytes pass both an absolute and a relative bound is reported.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_CORE = re.compile(r"[0-9a-f]{24}")
_ASSIGN_WORDS = re.compile(rb"passw|secret|token|api_?key")

#: Words that make what follows them sensitive (fixed values). They may be part of a longer name: DB_PASSWORD_PROD, tokens.
#: Key and auth, which end or begin ordinary words as well (monkey, author), count only where a name's part begins and ends:
#: beside other signs than letters, at a change of case, or behind a word that such names have.
CONTEXT = re.compile(
    r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|authorization|credential|bearer|session[_-]?id|signature|(?:api|access|private|public|auth|ssh|master|encryption|signing|account)key)"
    r"|(?:(?<![A-Za-z])(?:[Kk]ey|[Aa]uth)|(?<=[a-z])(?:Key|Auth))s?(?![a-z])|(?<![A-Za-z])(?:KEY|AUTH)S?(?![A-Za-z])",
    re.ASCII,
)
#: How tokens of known providers begin (fixed values); such a string needs no word beside it.
PREFIXES = (
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "rk_test_", "pk_live_", "whsec_", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "xapp-",
    "AIza", "ya29.", "npm_", "pypi-", "SG.", "hf_", "sk-", "dop_v1_", "shpat_", "shpss_", "dckr_pat_", "lin_api_", "eyJ",
)
#: A candidate starts at most so many characters after the end of a sensitive word, whatever stands between, line ends too,
#: or ends at most so many before one.
REACH = 48
LEAST_CHARS = 12
_TOKEN = re.compile(r"[A-Za-z0-9+/_.~!@$%^*-][A-Za-z0-9+/_.=~!@$%^*-]{" + str(LEAST_CHARS - 1) + ",}", re.ASCII)
#: What is left of the name that a sensitive word is part of, up to its sign of assignment.
_NAME = re.compile(r"""[A-Za-z0-9_.-]{0,40}+["']?\s{0,40}+[:=]+""", re.ASCII)
#: What may stand between a sensitive word, or its name's sign of assignment, and a candidate right after it.
_DIRECT = re.compile(r"""["'\]>)]{0,4}(?:\s{1,40}+(?:is|was|=>))?\s{0,40}+[:=>]{0,2}\s{0,40}+["'(<\[]{0,2}""", re.IGNORECASE | re.ASCII)
#: What tells an assignment from mere sequence.
_SIGN = re.compile(r"""[:=>"'(<\[]|\b(?:is|was)\b""", re.IGNORECASE | re.ASCII)
_RUN_END = re.compile(r"[A-Za-z0-9+/_.=~!@$%^*-]*", re.ASCII)
_CONTEXT_WORDS = re.compile(rb"pass|pwd|secret|token|key|auth|credential|bearer|session|signature")
_PREFIX_BYTES = tuple(p.encode() for p in PREFIXES)
#: Whole strings of the alphabet, and those that begin as a provider's tokens do.
_RUNS = re.compile(r"[A-Za-z0-9+/_.=~!@$%^*-]{" + str(LEAST_CHARS) + ",}", re.ASCII)
_PREFIXED = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, PREFIXES)) + r")[A-Za-z0-9+/_.=-]{" + str(LEAST_CHARS) + ",}", re.ASCII)
#: The head of a private key's block; a foot; a line of a body: one alphabet, with quotes, comment signs or escapes about it.
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{0,60}PRIVATE KEY(?: BLOCK)?-----", re.ASCII)
_BODY = re.compile("[A-Za-z0-9+/]{16}", re.ASCII)
_FOOT = re.compile(r"-----END [A-Z0-9 ]{0,60}PRIVATE KEY(?: BLOCK)?-----", re.ASCII)
_LINE = re.compile(r"""(?:[ \t>"'+,;)\\]*+(?:\r?\n|\\r?\\?n)[ \t>#*"'+/(]*?(?=[A-Za-z0-9+/_]))([A-Za-z0-9+/_=-]+)(?=[ \t"'+,;)\\]*(?:\r?\n|\\|\Z))""", re.ASCII)

#: Identifiers and code that no secret consists of (fixed values): the primer of the compressor.
IDENTIFIERS = (
    "password passwd passphrase secret token access_token refresh_token api_key apikey client_id client_secret private_key public_key "
    "authorization bearer credentials session_id signature username user_name account email address localhost example.com "
    "http:// https:// www. .com .org .net index.html config settings environment variable undefined null none true false default "
    "function return import from class const static public private protected void string integer boolean number object array "
    "request response header content-type application/json charset utf-8 get post put delete select insert update where order group "
    "os.environ process.env getenv required optional placeholder changeme your_password_here your-api-key xxxxxxxx example sample test "
    "max min maximum minimum buffer length size count index offset limit timeout retry retries version build release debug warning error message "
    "handler listener callback controller service manager factory provider builder context session connection database table column schema "
    "document element node parent child first last next previous start stop begin end open close read write load save parse format convert "
    "file path folder directory stream socket thread process queue stack list map hash cache memory storage bucket region cluster server port "
    "initialize execute validate verify generate create remove append prepend replace search filter sort merge split join encode decode "
    "the and that with this have from they would there their what about which when make like time just know take people into year"
)
#: Characters on either side that a candidate is measured against.
SURROUNDINGS = 200
#: A candidate is novel if it adds so many bytes, and so many for each of its characters. Random text over 64 signs costs
#: 0.75 bytes a sign, random hexadecimal 0.5; words known from dictionary or surroundings cost under 0.3.
LEAST_BYTES = 9
LEAST_SHARE = 0.45

#: Words of four languages whose letter pairs prime the second coder (fixed values).
PROSE = (
    "internationalization administration configuration documentation communication organization implementation information development "
    "authentication authorization responsibility understanding nevertheless throughout environment management particularly government "
    "experience knowledge measurement performance relationship successfully independent requirements application processing distribution "
    "something everything although because between against without through another morning evening weather children question company "
    "verantwortung geschwindigkeit wissenschaft gesellschaft entwicklung veranstaltung untersuchung beschreibung zusammenarbeit krankenhaus "
    "zwischen schreiben sprechen vielleicht natuerlich eigentlich verschiedene moeglichkeit arbeitsplatz bundesregierung versicherung jahrhundert "
    "gouvernement developpement environnement particulierement connaissance aujourd quelque toujours beaucoup pourquoi recherche entreprise "
    "responsabilite communication naturellement traitement appartement bibliotheque professeur "
    "conocimiento desarrollo universidad investigacion administracion comunicacion especialmente trabajador siguiente entonces despues gobierno "
    "responsabilidad caracteristicas funcionamiento procedimiento establecimiento naturaleza pueblo quiere tiempo"
)
#: Bytes a character that the second coder needs for a candidate: words need under 0.55, random letters of one case 0.7 and more.
LEAST_SPELLING = 0.6
#: The same for mixed strings that are assigned right after a sensitive word.
LEAST_DIRECT = 0.55

#: Bytes a digit of strings of digits, which cost 0.42 at random; these count only where assigned right after a sensitive word.
LEAST_DIGITS = 0.36

_DICTIONARY = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
_compressor: zstandard.ZstdCompressor | None = None


def _size(raw: bytes) -> int:
    global _compressor
    if _compressor is None:
        _compressor = zstandard.ZstdCompressor(level=12, dict_data=_DICTIONARY, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(_compressor.compress(raw))


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Bytes that a candidate adds to its surroundings; other places of the same candidate are no part of them."""
    around = (before.replace(candidate, " ") + "\n" + after.replace(candidate, " ") + "\n").encode()
    return _size(around + candidate.encode()) - _size(around)


def _letter_bits() -> dict[str, float]:
    """Bits of each letter after another, or after "^" at a word's start, in the primer's words."""
    pairs: Counter[str] = Counter()
    heads: Counter[str] = Counter()
    for word in re.findall("[a-z]+", (IDENTIFIERS + " " + PROSE).lower()):
        for pair in zip("^" + word, word, strict=False):
            pairs["".join(pair)] += 1
            heads[pair[0]] += 1
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: -math.log2((pairs[a + b] + 0.2) / (heads[a] + 0.2 * 26)) for a in "^" + letters for b in letters}


_BITS = _letter_bits()
_HEXADECIMAL = re.compile("(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f-]+|[0-9A-F-]+)")
_RUN = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]")
_DIGITS = re.compile("[0-9]+", re.ASCII)
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_][0-9.+Z-]*)?")


def spelling_share(candidate: str) -> float:
    """Bytes a character that a coder of letter pairs needs. Each run of one kind costs its kind, too: letters, capitals, digits, signs.

    The signs that part the words of names cost no more than that.
    """
    bits = 0.0
    for run in _RUN.findall(candidate):
        bits += 2
        if run[0].isalpha():
            low = run.lower()
            bits += sum(_BITS[a + b] for a, b in zip("^" + low, low, strict=False))
        elif run not in "_-./":
            bits += len(run) * 3.32
    return bits / 8 / len(candidate)


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost, non-overlapping for each kind, failing matches dropped."""
    raw = text.encode() if raw is None else raw
    found = []
    if _ASSIGN_WORDS.search(raw.lower()):  # lowers ASCII letters only
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    at = 0
    while m := _HEX_CORE.search(text, at):  # the leftmost 24 lie at the start of their run
        end = _HEX.match(text, m.start()).end()
        found.append((m.start(), end, "hex"))
        at = end
    return found


def _mixed(candidate: str) -> bool:
    """Words of prose have letters of one case after their first."""
    return any(c.isdigit() for c in candidate) or any(c.isupper() for c in candidate[1:]) and any(c.islower() for c in candidate)


def _candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, direct) of the token-like strings that start within REACH of a sensitive word's end; each end once.

    A candidate is direct if it comes right after the word with a sign of assignment or an opening quote. Every string is run
    through once, however many sensitive words stand in it, and no search goes beyond REACH, so time goes with the text.
    """
    found: dict[int, tuple[int, bool]] = {}
    run_end = 0  # of the last string met
    for word in CONTEXT.finditer(text):
        at, last = word.end(), word.end() + REACH
        if name := _NAME.match(text, at):
            at = name.end()
        direct = _DIRECT.match(text, at).end()
        while token := _TOKEN.search(text, at, last + LEAST_CHARS):  # as far as one can begin in reach
            start = token.start()
            if start >= run_end:
                run_end = _RUN_END.match(text, start).end()
            end = run_end
            known = found.get(end, (start, False))
            found[end] = (max(start, known[0]), known[1] or start == direct and _SIGN.search(text, word.end(), start) is not None)
            at = end
    runs = None
    for word in CONTEXT.finditer(text):  # what ends shortly before a sensitive word; a run is looked at once
        if runs is None:
            runs = [m.span() for m in _RUNS.finditer(text)]
            ends = [end for _, end in runs]
        for start, end in runs[bisect.bisect_right(ends, word.start() - REACH) : bisect.bisect_right(ends, word.start())]:
            if end not in found and _mixed(text[start:end]):
                found[end] = (start, False)
    for m in _PREFIXED.finditer(text):
        found[m.end()] = (min(m.start(), found.get(m.end(), m.span())[0]), True)
    for end, (start, direct) in sorted(found.items()):
        yield start, end, direct


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Bodies of private keys: from the head's end to the foot, or to the last line of one alphabet where there is no foot."""
    found, at = [], 0
    while head := _BLOCK.search(text, at):
        following = _BLOCK.search(text, head.end())
        foot = _FOOT.search(text, head.end(), following.start() if following else len(text))
        end = foot.start() if foot else _lines_end(text, head.end())
        if _BODY.search(text, head.end(), end):
            found.append((head.end(), end))
        at = max(end, head.end())
    return found


def _lines_end(text: str, at: int) -> int:
    """The end of the lines of one alphabet that follow ``at`` directly; a line of letters of one case, as a word is, ends them."""
    while (line := _LINE.match(text, at)) and (_mixed(line[1]) or line[1].endswith("=")):
        at = line.end(1)
    return at


def novel_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, "novel") of candidates in sensitive context that don't compress.

    Words, names and addresses also come after sensitive words, so a candidate must be no spelling of words either; more so if
    it stands at a distance or without a sign of assignment, or has letters of one case only.
    """
    raw = text.encode() if raw is None else raw
    if not (_CONTEXT_WORDS.search(raw.lower()) or any(p in raw for p in _PREFIX_BYTES)):
        return []
    found = []
    for start, end in key_blocks(text):
        if _is_novel(text, start, end, LEAST_SHARE):
            found.append((start, end, "novel"))
    blocks, at = list(found), 0
    last = 0
    for start, end, direct in _candidates(text):
        while at < len(blocks) and blocks[at][1] <= start:
            at += 1
        if start < last or at < len(blocks) and blocks[at][0] < end:
            continue  # part of lines or of a block that are reported
        candidate = text[start:end]
        if _DATE.fullmatch(candidate):
            continue
        share = LEAST_SHARE
        if direct and _DIGITS.fullmatch(candidate):
            share = LEAST_DIGITS
        elif not _HEXADECIMAL.fullmatch(candidate) and spelling_share(candidate) < (LEAST_DIRECT if direct and _mixed(candidate) else LEAST_SPELLING):
            continue
        if _is_novel(text, start, end, share):
            last = _lines_end(text, end)
            found.append((start, max(end, last), "novel"))
    return sorted(found)


def _is_novel(text: str, start: int, end: int, share: float) -> bool:
    size = marginal_bytes(text[start:end], text[max(0, start - SURROUNDINGS) : start], text[end : end + SURROUNDINGS])
    return size >= LEAST_BYTES and size >= share * (end - start)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.in_slices(batches):
        base, new = [], []
        for text in common.texts_of(batch):
            raw = text.encode()
            base.append(base_spans(text, raw))
            new.append(novel_spans(text, raw))
        count = lambda kind, rows: pa.array([sum(s[2] == kind for s in row) for row in rows], pa.int64())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "n_assign": count("assign", base), "n_access": count("access", base), "n_hex": count("hex", base), "n_novel": count("novel", new),
            "base": pa.array([_joined(b) for b in base], pa.string()),
            "spans": pa.array([_joined(b + n) for b, n in zip(base, new, strict=True)], pa.string()),
        })


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base spans and all spans (kind:start:end in code points, end exclusive) of each row.

    A null text counts as empty and has no spans. Repeated rows are scanned each; other columns are ignored; an empty table
    gives an empty result. Long texts are scanned whole, in time that goes with their length.
    """
    common.prepare(docs.sparkSession)
    ddl = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, ddl)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")


MASK = "[secret]"


def masked(text: str) -> str:
    """The text with every reported span replaced by a mask; overlapping spans become one."""
    spans = sorted((s, e) for s, e, _ in base_spans(text) + novel_spans(text))
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in the texts and n_chars, where there is one, set to the new length.

    Every row stays, repeated ones too; null texts stay null, an empty table stays empty, and long texts are masked to their end.
    """
    common.prepare(docs.sparkSession)

    def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else masked(t) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                lengths = pa.array([None if t is None else len(t) for t in texts]).cast(batch.schema.field(n).type)
                batch = batch.set_column(n, batch.schema.field(n), lengths)
            yield batch

    return docs.mapInArrow(_mask, docs.schema)


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
