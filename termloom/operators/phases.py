"""Two-phase mapping of documents to terms with a pluggable provider: extract mentions, retrieve, map what isn't settled.

A provider is any function from batches of requests to batches of answers (``mapInPandas``), so that a served model, a file
of recorded answers or the rule-based stand-in below plug in alike. Everything between the calls is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import checkpointed

#: (doc_id, group, prompt) to (doc_id, group, phrase, category, assertion, evidence, error).
Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
#: (item_id, payload) to (item_id, selected).
Mapper = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

EXTRACTED = "doc_id long, grp int, phrase string, category string, assertion string, evidence string, error string"
MODES = ("ungrouped", "grouped_large", "grouped_small")
#: Failure classes by words of the message in small letters; the first class with a word counts (fixed values).
FAILURES: dict[str, tuple[str, ...]] = {
    "structured_refusal": ("refusal",),
    "provider_timeout": ("timeout", "deadline_exceeded", "timed out"),
    "structured_json_invalid": ("json", "unterminated", "no structured response payload"),
    "structured_schema_validation_failed": ("validationerror", "schema", "field required", "input should", "literal", "pydantic"),
    "provider_auth_error": ("unauthorized", "forbidden", "authentication", "api key", "permission", "billing", "quota", "401", "403"),
    "provider_transport_error": ("connection", "network", "transport", "dns", "ssl", "remoteprotocol", "readerror", "connecterror"),
    "provider_config_error": ("unsupported", "misconfig", "configuration", "invalid base_url", "model not found", "unknown provider"),
}
#: Phrases whose answers go to all tasks at most.
BROADCAST_ROWS = 20_000
OTHER_FAILURE = "provider_execution_error"
#: Failures that smaller groups may mend.
RETRYABLE = ("provider_timeout", "structured_json_invalid", "structured_schema_validation_failed")


def classify_failure(message: Column) -> Column:
    out = F.when(message.isNull(), F.lit(None).cast("string"))
    for name, words in FAILURES.items():
        out = out.when(F.lower(message).rlike("|".join(words)), name)
    return out.otherwise(OTHER_FAILURE)


def next_mode(mode: str) -> str | None:
    at = MODES.index(mode) + 1
    return MODES[at] if at < len(MODES) else None


def experiencer(category: Column) -> Column:
    c = T.normalize_category(category)
    return F.when(c == "family_history", "family_history").when(c.isin("other", "unrelated", "general"), "other").otherwise("proband")


def category_of_axes(who: Column, assertion: Column, fallback: Column) -> Column:
    return F.when(who == "family_history", "family_history").when(assertion == "negated", "normal").when(assertion == "uncertain", "suspected").when(assertion == "affirmed", "abnormal").otherwise(fallback)


def split_combined(phrase: Column) -> Column:
    """``a/b c`` stands for ``a c`` and ``b c``; other phrases for themselves."""
    m = r"\A([^ /]+)/([^ /]+) (.+)\z"
    part = lambda i: F.concat(F.regexp_extract(phrase, m, i), F.lit(" "), F.regexp_extract(phrase, m, 3))
    return F.when(phrase.rlike(m), F.array(part(1), part(2))).otherwise(F.array(phrase))


def deduplicate_mentions(found: DataFrame) -> DataFrame:
    """One row a (document, cleaned phrase, category, assertion): its groups, its longest evidence."""
    key = T.clean_phrase("phrase")
    return found.groupBy("doc_id", key.alias("key"), "category", "assertion").agg(
        F.min("phrase").alias("phrase"), F.sort_array(F.collect_set("grp")).alias("groups"), F.max_by("evidence", F.struct(F.length("evidence"), F.col("evidence"))).alias("evidence")
    )


def run(
    groups: DataFrame, extractor: Extractor, retrieve: Callable[[DataFrame], DataFrame], mapper: Mapper, accept: float = 0.7, regroup: Callable[[DataFrame, str], DataFrame] | None = None
) -> DataFrame:
    """doc_id, term, assertion, category, phrase, method of groups (doc_id, grp, prompt).

    Groups whose call failed retryably go again in smaller groups by ``regroup``, at most through all MODES. ``retrieve`` gives
    (phrase, term, label, score) of distinct phrases (phrase). A candidate that matches locally or is sure enough is taken;
    the rest goes to the mapper, whose choice must be one of the item's candidates, else the item stays unresolved.
    """
    mode, parts = MODES[0], []
    open_ = groups
    while True:
        answers = checkpointed(open_.select("doc_id", "grp", "prompt").mapInPandas(extractor, EXTRACTED))  # each group is asked once
        failure = classify_failure(F.col("error"))
        parts.append(answers.filter("error IS NULL"))
        mode = next_mode(mode)
        if mode is None or regroup is None:
            break
        failed = answers.filter(failure.isin(*RETRYABLE)).select("doc_id", "grp").distinct()
        if failed.isEmpty():
            break
        open_ = regroup(open_.join(failed, ["doc_id", "grp"], "left_semi"), mode)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.withColumn("phrase", F.explode(split_combined(F.col("phrase")))).filter("phrase <> ''")
    items = checkpointed(deduplicate_mentions(found))
    candidates = retrieve(items.select("phrase").distinct())
    from ..plans.mapping import LOCAL_MATCH, local_match

    # what a phrase's candidates are is settled once a phrase, not once for every mention of it
    order = Window.partitionBy("phrase").orderBy(F.col("local").asc_nulls_last(), F.desc("score"), "term")
    rows = candidates.withColumn("local", local_match(F.col("phrase"), F.col("label"), LOCAL_MATCH)).withColumn("n", F.row_number().over(order))
    rows = checkpointed(rows.filter("term IS NOT NULL"))
    sure = F.col("local").isNotNull() | F.coalesce(F.col("score") >= accept, F.lit(False))
    best = rows.filter((F.col("n") == 1) & sure).select("phrase", "term", F.when(F.col("local").isNotNull(), "local").otherwise("score").alias("method"))
    best = checkpointed(best)
    few = best.count() <= BROADCAST_ROWS  # many mentions have few phrases: a join by phrase would put most rows into a few tasks
    settled = items.join(F.broadcast(best) if few else best, "phrase")
    key = ["doc_id", "key", "category", "assertion"]
    item = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256)
    open_ = rows.join(best.select("phrase"), "phrase", "left_anti").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "term", "label"))).alias("c"))
    payload = F.to_json(F.struct("phrase", F.transform("c", lambda c: F.struct(c["term"].alias("term"), c["label"].alias("label"))).alias("candidates")))
    open_ = checkpointed(open_.withColumn("payload", payload))
    asked, few = open_.select("phrase", "payload"), open_.count() <= BROADCAST_ROWS
    offers = items.withColumn("item_id", item).join(F.broadcast(asked) if few else asked, "phrase")
    chosen = checkpointed(offers.select("item_id", "payload").mapInPandas(mapper, "item_id string, selected string"))  # each item is asked once
    offered = open_.select("phrase", F.explode("c.term").alias("selected")).select("phrase", F.col("selected").cast("string")).distinct()
    mapped = offers.drop("payload").join(chosen, "item_id").join(offered, ["phrase", "selected"], "left_semi").withColumn("method", F.lit("mapped"))
    columns = ["doc_id", "term", "assertion", "category", "phrase", "method"]
    return settled.select(*columns).unionByName(mapped.withColumn("term", F.col("selected")).select(*columns).withColumn("term", F.col("term").cast(settled.schema["term"].dataType)))


def first_offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A mapper that takes the first candidate: the stand-in for tests."""
    import json

    for frame in batches:
        picked = [str((json.loads(p)["candidates"] or [{"term": None}])[0]["term"]) for p in frame["payload"]]
        yield pd.DataFrame({"item_id": frame["item_id"], "selected": picked})
