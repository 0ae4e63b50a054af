"""Queries on assertion rules with directions. Sentences are made of parts' words, so that every kind of cue occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import context as C
from ..functions.assertions import NORMAL, SCOPE_WORDS, is_normal, spaced
from ..operators import dependency
from ..storage import table

_RULES = C.built_in("en")
_CUES = [r.cue for r in _RULES] + list(NORMAL["en"])
_CYCLE = len(_CUES)

_SENTENCE_SQL = f"""p AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) || ' ' || ([{", ".join(f"'{c}'" for c in _CUES)}])[1 + p_partkey % {_CYCLE}] || ' ' || lower(p_type) || ' size ' || p_size || ' ' ||
([{", ".join(f"'{c}'" for c in _CUES)}])[1 + (p_partkey // 3 + p_size) % {_CYCLE}] || ' ' || lower(p_brand) || ' one two three four five six seven eight' AS text FROM part),
s AS (SELECT id, text, ' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS s FROM p)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: words of a part around two cues that its key picks."""
    cues = F.array(*[F.lit(c) for c in _CUES])
    k, size = F.col("p_partkey"), F.col("p_size")
    first, second = F.get(cues, (k % _CYCLE).cast("int")), F.get(cues, ((F.floor(k / 3) + size) % _CYCLE).cast("int"))
    text = F.concat(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit(" "), first, F.lit(" "), F.lower("p_type"), F.lit(" size "), size.cast("string"), F.lit(" "), second, F.lit(" "), F.lower("p_brand"), F.lit(" one two three four five six seven eight"))
    return table(spark, sf_dir, "part").select(k.alias("id"), text.alias("text"))


def _found_sql(source: str) -> str:
    """Scopes per rule of a table (id, s), with plain joins instead of array expressions."""
    rules = ", ".join(f"({n}, '{r.cue}', '{r.direction}')" for n, r in enumerate(_RULES))
    side = lambda text, cut: f"array_to_string(list_filter(string_split(trim({text}), ' '), lambda w: w <> ''){cut}, ' ')"
    return f"""rule(n, cue, direction) AS (VALUES {rules}),
places AS (SELECT id, s, n, cue, direction, strpos(s, ' ' || cue || ' ') + 1 AS a, strpos(s, ' ' || cue || ' ') + 1 + length(cue) AS b FROM {source}, rule WHERE strpos(s, ' ' || cue || ' ') > 0),
live AS (SELECT * FROM places x WHERE direction NOT IN ('PSEUDO', 'TERMINATE') AND NOT EXISTS (SELECT 1 FROM places y WHERE y.id = x.id AND y.direction = 'PSEUDO' AND x.a < y.b AND x.b > y.a)),
lim AS (SELECT l.id, l.s, l.n, l.cue, l.direction, l.a, l.b, min(CASE WHEN t.a > l.b THEN t.a END) AS stop, max(CASE WHEN t.b < l.a THEN t.b END) AS begin FROM live l LEFT JOIN places t ON t.id = l.id AND t.direction = 'TERMINATE' GROUP BY ALL),
sides AS (SELECT id, n, cue, direction, {side("substr(s, coalesce(begin, 1), a - coalesce(begin, 1))", f"[-{SCOPE_WORDS}:]")} AS before, {side("substr(s, b, coalesce(stop, length(s) + 1) - b)", f"[1:{SCOPE_WORDS}]")} AS after FROM lim),
found AS (SELECT id, n, cue, direction, CASE direction WHEN 'FORWARD' THEN after WHEN 'BACKWARD' THEN before ELSE CASE WHEN before <> '' AND after <> '' THEN before || ' [' || cue || '] ' || after ELSE before || after END END AS scope FROM sides)"""


@register("assertion_scopes", f"WITH {_SENTENCE_SQL}, {_found_sql('s')} SELECT id, cue, direction, scope FROM found WHERE scope <> ''")
def assertion_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of cues before, after and on both sides of findings, with pseudo cues and terminators."""
    found = F.explode(C.scopes(spaced(F.col("text")), _RULES))
    return sentences(spark, sf_dir).select("id", found.alias("f")).select("id", "f.cue", "f.direction", "f.scope")


_NORMAL_SQL = f"""normal AS (SELECT id, cue, cue || ': ' || trim(substr(s, greatest(a - {C.NORMAL_CONTEXT}, 1), a + length(cue) + {C.NORMAL_CONTEXT} - greatest(a - {C.NORMAL_CONTEXT}, 1))) AS context
FROM (SELECT id, s, cue, strpos(s, ' ' || cue || ' ') + 1 AS a FROM s, (VALUES {", ".join(f"('{c}')" for c in NORMAL["en"])}) v(cue)) WHERE a > 1)"""


@register("assertion_normal_context", f"WITH {_SENTENCE_SQL}, {_NORMAL_SQL} SELECT id, context FROM normal")
def assertion_normal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("id", F.explode(C.normal_contexts(spaced(F.col("text")), "en")).alias("context"))


_LOOK = f"SELECT id, ' ' || regexp_replace(lower(%s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS s FROM cut"


@register(
    "assertion_left_context",
    f"""WITH {_SENTENCE_SQL}, cut AS (SELECT id, text, CAST(length(text) // 2 AS INTEGER) AS start, CAST(length(text) - 20 AS INTEGER) AS "end" FROM p),
looks AS (SELECT 2 * id AS id, s FROM ({_LOOK % 'substr(text, start + 1, "end" - start)'}) UNION ALL SELECT 2 * id + 1 AS id, s FROM ({_LOOK % f'substr(text, greatest(start - {C.LEFT_CONTEXT}, 0) + 1, "end" - greatest(start - {C.LEFT_CONTEXT}, 0))'})),
{_found_sql('looks')},
st AS (SELECT l.id, CASE WHEN EXISTS (SELECT 1 FROM found f WHERE f.id = l.id AND f.scope <> '') THEN 'negated' WHEN {" OR ".join(f"strpos(s, ' {c} ') > 0" for c in NORMAL["en"])} THEN 'normal' ELSE 'affirmed' END AS status FROM looks l)
SELECT a.id // 2 AS id, a.status AS own, CASE WHEN a.status = 'affirmed' THEN b.status ELSE a.status END AS status FROM st a JOIN st b ON b.id = a.id + 1 AND a.id % 2 = 0""",
)
def assertion_left_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk from the middle of a sentence: its own status, and the one that cues to its left give it."""
    n = F.length("text")
    rows = sentences(spark, sf_dir).withColumns({"start": F.floor(n / 2).cast("int"), "end": n - 20})
    rows = rows.withColumn("own", C.status(spaced(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))), "en"))
    return rows.select("id", "own", C.with_left_context(F.col("text"), F.col("start"), F.col("end"), F.col("own"), "en").alias("status"))


@register("assertion_normal_cues", f"WITH {_SENTENCE_SQL} SELECT id, {' + '.join(f"CAST(strpos(s, ' {c} ') > 0 AS INTEGER)" for c in NORMAL['en'])} AS cues FROM s WHERE {' OR '.join(f"strpos(s, ' {c} ') > 0" for c in NORMAL['en'])}")
def assertion_normal_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a cue of normality, and how many different ones."""
    s = spaced(F.col("text"))
    cues = sum((F.when(s.contains(f" {c} "), 1).otherwise(0) for c in NORMAL["en"]), F.lit(0))
    return sentences(spark, sf_dir).filter(is_normal(s, "en")).select("id", cues.alias("cues"))


# --- scopes over a parse: the words of the sentences as a tree whose relations come from their places ---

_DEPS = ("nsubj", "dobj", "prep", "pobj", "neg", "attr", "amod")
_NEGATION, _NORMALITY = ("no", "not", "without", "absence", "denies"), NORMAL["en"]


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parse of every sentence: word i hangs on word i div 2."""
    rows = sentences(spark, sf_dir).select(F.col("id").alias("chunk_id"), F.posexplode(F.split("text", " ")).alias("i", "text"))
    dep = F.get(F.array(*[F.lit(d) for d in _DEPS]), ((F.col("i") + F.col("chunk_id")) % len(_DEPS)).cast("int"))
    pos = F.when((F.col("i") + F.col("chunk_id")) % 3 == 0, "ADJ").otherwise("NOUN")
    return rows.select("chunk_id", "i", "text", F.lower("text").alias("lemma"), pos.alias("pos"), dep.alias("dep"), F.floor(F.col("i") / 2).cast("int").alias("head"))


def _listed(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_PARSE_SQL = f"""{_SENTENCE_SQL}, w AS (SELECT id, string_split(text, ' ') AS w FROM p),
tok AS (SELECT id, i, w[i + 1] AS text, ([{_listed(_DEPS)}])[1 + (i + id) % {len(_DEPS)}] AS dep, (i + id) % 3 = 0 AS adj, i // 2 AS head FROM (SELECT id, w, unnest(range(0, len(w))) AS i FROM w)),
kid AS (SELECT * FROM tok WHERE head <> i),
gp AS (SELECT id, head AS i, arg_min(text, i) AS pobj FROM kid WHERE dep = 'pobj' GROUP BY id, head),
ofs AS (SELECT k.id, k.head AS i, arg_min(k.text || ' ' || gp.pobj, k.i) AS phrase FROM kid k JOIN gp ON gp.id = k.id AND gp.i = k.i WHERE k.dep = 'prep' AND lower(k.text) = 'of' GROUP BY k.id, k.head),
x AS (SELECT t.*, h.text AS ht, h.dep AS hd, g.text AS gt,
  (SELECT arg_max(k.text, k.i) FROM kid k WHERE k.id = t.id AND k.head = t.head AND k.dep IN ({_listed(dependency.SUBJECTS)})) AS subj, (SELECT arg_max(k.text, k.i) FROM kid k WHERE k.id = t.id AND k.head = t.head AND k.dep IN ({_listed(dependency.OBJECTS)})) AS obj,
  (SELECT arg_min(k.text, k.i) FROM kid k WHERE k.id = t.id AND k.head = t.i AND k.dep IN ({_listed(dependency.NEAR)})) AS near
  FROM tok t JOIN tok h ON h.id = t.id AND h.i = t.head JOIN tok g ON g.id = t.id AND g.i = h.head)"""


@register(
    "dependency_scopes",
    f"""WITH {_PARSE_SQL},
n AS (SELECT id, 'negated' AS kind, i, CASE WHEN dep <> 'neg' THEN text || ' → ' || coalesce(near, ht) WHEN subj IS NOT NULL AND obj IS NOT NULL THEN text || ' ' || ht || ': ' || subj || ' → ' || obj
  WHEN coalesce(subj, obj) IS NOT NULL THEN text || ' ' || ht || ': ' || coalesce(subj, obj) ELSE text || ' ' || ht END AS scope FROM x WHERE dep = 'neg' OR lower(text) IN ({_listed(_NEGATION)})),
m AS (SELECT x.id, 'normal' AS kind, x.i, CASE WHEN adj THEN x.text || ' ' || ht WHEN dep = 'pobj' AND hd = 'prep' THEN ht || ' ' || x.text || ' ← ' || gt WHEN phrase IS NOT NULL THEN x.text || ' ' || phrase
  ELSE array_to_string(w.w[greatest(x.i - {dependency.BEFORE}, 0) + 1 : x.i + {dependency.AFTER} + 1], ' ') END AS scope FROM x JOIN w ON w.id = x.id LEFT JOIN ofs ON ofs.id = x.id AND ofs.i = x.i WHERE lower(x.text) IN ({_listed(_NORMALITY)}))
SELECT id, kind, i::INTEGER AS i, scope FROM n UNION ALL SELECT id, kind, i::INTEGER, scope FROM m""",
)
def dependency_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parse = tokens(spark, sf_dir)
    kind = lambda scopes, name: scopes.select(F.col("chunk_id").alias("id"), F.lit(name).alias("kind"), "i", "scope")
    return kind(dependency.negation_scopes(parse, _NEGATION), "negated").unionByName(kind(dependency.normality_scopes(parse, _NORMALITY), "normal"))
