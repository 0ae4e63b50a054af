"""Scopes of negation and normality cues over a dependency parse, as joins of a token table with itself.

A parser's output is a table: chunk_id, i (a token's place from 0), text, lemma, pos, dep and head (the place of the token it hangs
on; its own for a root). What a cue reaches is found through its head, its head's other children and its own, each by an
equi-join on (chunk_id, place), so long chunks cost no square and one chunk with most tokens is no single group. A token table that
is made from a smaller one has no size that the planner knows, so these joins ask for a shuffle: none of its sides is ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBJECTS, OBJECTS, NEAR = ("nsubj", "nsubjpass"), ("dobj", "pobj", "attr"), ("pobj", "dobj")

#: Tokens before and after a normality cue that make its scope where the parse tells nothing.
BEFORE, AFTER = 2, 4


def _named(tokens: DataFrame, at: str, **columns: str) -> DataFrame:
    return _dealt(tokens.select("chunk_id", F.col("i").alias(at), *[F.col(c).alias(name) for name, c in columns.items()]))


def _dealt(rows: DataFrame) -> DataFrame:
    """A side of a join that is dealt out by its keys, whatever size the planner takes it to have."""
    return rows.hint("merge")


def children(tokens: DataFrame) -> DataFrame:
    """Of each token with children: the last subject and the last object, the first near object, the first "of" with an object."""
    return _kinds(tokens).join(_dealt(_of(tokens)), ["chunk_id", "head"], "left")


def _of(tokens: DataFrame) -> DataFrame:
    below = tokens.filter(F.col("head") != F.col("i"))
    pobj = below.groupBy("chunk_id", "head").agg(F.min_by("text", F.when(F.col("dep") == "pobj", F.col("i"))).alias("pobj"))
    of = below.filter((F.col("dep") == "prep") & (F.lower("text") == "of")).join(_dealt(pobj.select("chunk_id", F.col("head").alias("i"), "pobj")), ["chunk_id", "i"])
    return of.groupBy("chunk_id", "head").agg(F.min_by(F.struct("text", "pobj"), F.when(F.col("pobj").isNotNull(), F.col("i"))).alias("of"))


def _kinds(tokens: DataFrame) -> DataFrame:
    return tokens.filter(F.col("head") != F.col("i")).groupBy("chunk_id", "head").agg(
        F.max_by("text", F.when(F.col("dep").isin(*SUBJECTS), F.col("i"))).alias("subject"),
        F.max_by("text", F.when(F.col("dep").isin(*OBJECTS), F.col("i"))).alias("object"),
        F.min_by("text", F.when(F.col("dep").isin(*NEAR), F.col("i"))).alias("near"),
    )


def _is_cue(cues: tuple[str, ...]) -> Column:
    return F.lower("text").isin(*cues) | F.lower("lemma").isin(*cues)


def negation_scopes(tokens: DataFrame, cues: tuple[str, ...]) -> DataFrame:
    """chunk_id, i, scope of every negation: a token with the relation "neg", or a cue by its text or lemma.

    The relation reaches over its head with that one's subject and object; other cues over their own object, else their head.
    """
    found = tokens.filter((F.col("dep") == "neg") | _is_cue(cues))
    kids = _kinds(tokens)
    of_head = _dealt(kids.select("chunk_id", "head", "subject", "object"))
    own = _dealt(kids.select("chunk_id", F.col("head").alias("i"), "near"))
    rows = found.join(_named(tokens, "head", head_text="text"), ["chunk_id", "head"]).join(of_head, ["chunk_id", "head"], "left").join(own, ["chunk_id", "i"], "left")
    verb = F.concat_ws(" ", "text", "head_text")
    tied = F.when(F.col("subject").isNotNull() & F.col("object").isNotNull(), F.concat(verb, F.lit(": "), "subject", F.lit(" → "), "object"))
    tied = tied.when(F.coalesce("subject", "object").isNotNull(), F.concat(verb, F.lit(": "), F.coalesce("subject", "object"))).otherwise(verb)
    reached = F.concat(F.col("text"), F.lit(" → "), F.coalesce("near", "head_text"))
    return rows.select("chunk_id", "i", F.when(F.col("dep") == "neg", tied).otherwise(reached).alias("scope"))


def normality_scopes(tokens: DataFrame, cues: tuple[str, ...]) -> DataFrame:
    """chunk_id, i, scope of every normality cue: an adjective with its head; an object of a preposition with that and what it
    hangs on; a noun with its "of" phrase; else the tokens around."""
    found = tokens.filter(_is_cue(cues))
    heads = _named(tokens, "head", head_text="text", head_dep="dep", above="head")
    rows = found.join(heads, ["chunk_id", "head"]).join(_named(tokens, "above", above_text="text"), ["chunk_id", "above"])
    rows = rows.join(_dealt(_of(tokens).select("chunk_id", F.col("head").alias("i"), "of")), ["chunk_id", "i"], "left")
    near = found.select("chunk_id", "i", F.explode(F.sequence(F.col("i") - BEFORE, F.col("i") + AFTER)).alias("at"))
    around = near.join(_named(tokens, "at", word="text"), ["chunk_id", "at"]).groupBy("chunk_id", "i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("around"))
    rows = rows.join(_dealt(around), ["chunk_id", "i"])
    scope = F.when(F.col("pos") == "ADJ", F.concat_ws(" ", "text", "head_text"))
    scope = scope.when((F.col("dep") == "pobj") & (F.col("head_dep") == "prep"), F.concat(F.concat_ws(" ", "head_text", "text"), F.lit(" ← "), "above_text"))
    scope = scope.when(F.col("of.pobj").isNotNull(), F.concat_ws(" ", "text", "of.text", "of.pobj")).otherwise(F.col("around"))
    return rows.select("chunk_id", "i", scope.alias("scope"))


def statuses(tokens: DataFrame, negation: tuple[str, ...], normality: tuple[str, ...]) -> DataFrame:
    """chunk_id, negated, normal, negated_scopes, normal_scopes (in order of their cues) of every chunk."""
    listed = lambda scopes, name: scopes.groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "scope"))), lambda s: s["scope"]).alias(name))
    none = F.array().cast("array<string>")
    rows = tokens.select("chunk_id").distinct().join(_dealt(listed(negation_scopes(tokens, negation), "negated_scopes")), "chunk_id", "left").join(_dealt(listed(normality_scopes(tokens, normality), "normal_scopes")), "chunk_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("negated_scopes", "normal_scopes")})
    return rows.withColumns({"negated": F.size("negated_scopes") > 0, "normal": F.size("normal_scopes") > 0})
