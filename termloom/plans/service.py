"""Usage accounting: daily quotas, lockouts, costs, token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..storage import table

DAILY_LIMIT = 3


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def quota(rows: DataFrame, limit: int = DAILY_LIMIT) -> DataFrame:
    """user_id, day, used, remaining, exceeded."""
    used = rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    return used.select("user_id", F.col("day").cast("string").alias("day"), "used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).alias("remaining"), (F.col("used") > limit).alias("exceeded"))


@register(
    "quota_daily",
    f"SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS used, greatest({DAILY_LIMIT} - count(*), 0) AS remaining, count(*) > {DAILY_LIMIT} AS exceeded FROM events GROUP BY 1, 2",
)
def quota_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota(events(spark, sf_dir))


@register(
    "quota_admitted",
    f"SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= {DAILY_LIMIT}",
)
def quota_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within the limit, in order of time."""
    order = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return events(spark, sf_dir).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= DAILY_LIMIT).select("event_id", "user_id")


@register(
    "lockout",
    """WITH f AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island, event_type FROM events),
c AS (SELECT *, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS failures FROM f)
SELECT user_id, count(*) AS lockouts, CAST(min(ts) + INTERVAL 900 SECOND AS VARCHAR) AS first_until FROM c WHERE failures = 5 AND event_type <> 'click' GROUP BY user_id""",
)
def lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five failures in a row (anything but a click) lock a user for 15 minutes; a success resets the count."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ok = F.col("event_type") == "click"
    rows = events(spark, sf_dir).withColumn("island", F.sum(F.when(ok, 1).otherwise(0)).over(order))
    run = Window.partitionBy("user_id", "island").orderBy("ts", "event_id")
    rows = rows.withColumn("failures", F.sum(F.when(ok, 0).otherwise(1)).over(run)).filter((F.col("failures") == 5) & ~ok)
    until = F.min("ts") + F.expr("INTERVAL 900 SECONDS")
    return rows.groupBy("user_id").agg(F.count("*").alias("lockouts"), until.cast("string").alias("first_until"))


def consume_tokens(issued: DataFrame, uses: DataFrame, seconds: int) -> DataFrame:
    """use_id, outcome of each use (use_id, token, ts) of one-time tokens (token, ts): unknown, expired, used or accepted.

    Of the uses within the time to live the first is accepted; a token has few uses, so one task orders them.
    """
    given = issued.groupBy("token").agg(F.min("ts").alias("issued_at"))
    rows = uses.join(given, "token", "left")
    fresh = F.col("ts").between(F.col("issued_at"), F.col("issued_at") + F.make_dt_interval(secs=F.lit(seconds)))
    first = F.row_number().over(Window.partitionBy("token", fresh).orderBy("ts", "use_id"))
    return rows.select("use_id", F.when(F.col("issued_at").isNull(), "unknown").when(~fresh, "expired").when(first > 1, "used").otherwise("accepted").alias("outcome"))


@register(
    "token_uses",
    """WITH i AS (SELECT user_id * 1000 + event_id % 5 AS token, min(ts) AS since FROM events WHERE event_id % 4 = 0 GROUP BY 1), u AS (SELECT event_id AS use_id, user_id * 1000 + event_id % 6 AS token, ts FROM events WHERE event_id % 4 <> 0),
r AS (SELECT u.*, i.since, coalesce(ts BETWEEN since AND since + INTERVAL 400000 SECOND, false) AS fresh FROM u LEFT JOIN i USING (token))
SELECT use_id, CASE WHEN since IS NULL THEN 'unknown' WHEN NOT fresh THEN 'expired' WHEN row_number() OVER (PARTITION BY token, fresh ORDER BY ts, use_id) > 1 THEN 'used' ELSE 'accepted' END AS outcome FROM r""",
)
def token_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth event issues a token of its user, the others use one, in time or not."""
    rows = events(spark, sf_dir)
    issued = rows.filter("event_id % 4 = 0").select((F.col("user_id") * 1000 + F.col("event_id") % 5).alias("token"), "ts")
    uses = rows.filter("event_id % 4 <> 0").select(F.col("event_id").alias("use_id"), (F.col("user_id") * 1000 + F.col("event_id") % 6).alias("token"), "ts")
    return consume_tokens(issued, uses, 400_000)


@register(
    "active_sessions",
    """WITH s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'click'), x AS (SELECT user_id, max(ts) AS revoked FROM events WHERE event_type = 'click' AND event_id % 3 = 0 GROUP BY 1),
t AS (SELECT max(ts) - INTERVAL 5 DAY AS since FROM events) SELECT s.user_id, s.event_id AS session_id FROM s LEFT JOIN x USING (user_id), t WHERE n = 1 AND ts >= since AND (revoked IS NULL OR ts > revoked)""",
)
def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's latest session if it is younger than five days and no revocation came after it."""
    rows = events(spark, sf_dir)
    latest = rows.filter("event_type <> 'click'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("s"))
    revoked = rows.filter("event_type = 'click' AND event_id % 3 = 0").groupBy("user_id").agg(F.max("ts").alias("revoked"))
    since = rows.agg((F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("since"))
    found = latest.join(revoked, "user_id", "left").crossJoin(F.broadcast(since))  # one row
    return found.filter("s.ts >= since AND (revoked IS NULL OR s.ts > revoked)").select("user_id", F.col("s.event_id").alias("session_id"))


def usage_cost(prompt: Column, cached: Column, output: Column, input_price: float, cached_price: float, output_price: float) -> Column:
    """Cost of tokens at prices a million, cached input at its own price."""
    fresh = F.greatest(prompt - cached, F.lit(0))
    return F.round((fresh * input_price + cached * cached_price + output * output_price) / 1e6, 8)


@register(
    "cost_estimate",
    "SELECT conv_id, turn, round((greatest(length(text) - turn * 10, 0) * 2.5::DOUBLE + turn * 10 * 0.25::DOUBLE + length(role) * 10.0::DOUBLE) / 1000000.0::DOUBLE, 8) AS cost FROM conversations WHERE text IS NOT NULL",
)
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    return rows.select("conv_id", "turn", usage_cost(F.length("text"), F.col("turn") * 10, F.length("role"), 2.5, 0.25, 10.0).alias("cost"))


@register(
    "token_usage_sum",
    "SELECT role AS usage_key, sum(length(text)) AS total FROM conversations WHERE text IS NOT NULL GROUP BY role UNION ALL SELECT 'turns', count(*) FROM conversations WHERE text IS NOT NULL",
)
def token_usage_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-wise sum of usage maps."""
    rows = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    usage = F.create_map(F.col("role"), F.length("text").cast("long"), F.lit("turns"), F.lit(1).cast("long"))
    return rows.select(F.explode(usage).alias("usage_key", "n")).groupBy("usage_key").agg(F.sum("n").alias("total"))


@register("subject_key_hash", "SELECT DISTINCT user_id, sha256(trim(' 10.0.' || user_id % 256 || '.' || user_id // 256 || ' ')) AS subject_key FROM events")
def subject_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(F.lit(" 10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), F.floor(F.col("user_id") / 256).cast("string"), F.lit(" "))
    return events(spark, sf_dir).select("user_id", F.sha2(F.trim(address), 256).alias("subject_key")).distinct()
