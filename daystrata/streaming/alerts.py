"""Forecast alerts up to the outbox table. Set-based: one micro-batch of forecasts
against the subscription and delivery tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daystrata.functions.scalar import risk_rank
from daystrata.spec import ALERT_ZONE, DAILY_CAP, QUIET_FROM, QUIET_UNTIL, RISK_RANK

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"

TEXT_COLUMNS = "language string, level string, summary string, tips array<string>, disclaimer string, unsubscribe string"


def current_subscriptions(changes: DataFrame, languages: tuple[str, ...] = ("en", "hi", "mr")) -> DataFrame:
    """Active, confirmed subscriptions from a change log (email, entity, action, ts,
    minimum_level, language), with their token.

    The newest unsubscribe ends everything before it; later subscribes form the
    active subscription, the last of which sets the preferences; a confirm after
    the first of them confirms it. A subscribe with a malformed address, an unknown
    level or an unknown language is refused. The token names the pair of address and
    entity and stays the same when preferences change.
    """
    keys = ["email", "entity"]
    known = F.col("minimum_level").isin(*RISK_RANK) & F.col("language").isin(*languages)
    log = changes.withColumn("email", F.lower("email")).filter(
        F.col("email").rlike(EMAIL) & ((F.col("action") != "subscribe") | F.coalesce(known, F.lit(False))))
    ended = F.max(F.when(F.col("action") == "unsubscribe", F.col("ts")))
    sub = F.col("action") == "subscribe"
    latest = log.groupBy(*keys).agg(ended.alias("_ended"))
    live = log.join(latest, keys).filter(F.col("_ended").isNull() | (F.col("ts") > F.col("_ended")))
    state = live.groupBy(*keys).agg(
        F.min(F.when(sub, F.col("ts"))).alias("since"),
        F.max_by(F.struct("minimum_level", "language"), F.when(sub, F.struct("ts", "minimum_level", "language"))).alias("_p"),
        F.max(F.when(F.col("action") == "confirm", F.col("ts"))).alias("_confirmed"))
    return (state.filter("since IS NOT NULL AND _confirmed > since")
            .select(*keys, "since", "_p.minimum_level", "_p.language", token(F.col("email"), F.col("entity")).alias("token")))


def token(email: Column, entity: Column, secret: str = "") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), email, entity.cast("string")), 256)


def waking_hours(now: Column, zone: str = ALERT_ZONE) -> Column:
    hour = F.hour(F.from_utc_timestamp(now, zone))
    return (hour >= QUIET_UNTIL) & (hour < QUIET_FROM)


def candidates(forecasts: DataFrame, subscriptions: DataFrame, salts: int = 16) -> DataFrame:
    """Forecast days (entity, date, level, probability) that reach a subscriber's minimum level.

    Equi-join on the entity and a salt with the rank comparison as residual condition: a popular entity has many
    subscribers, which are dealt over ``salts`` tasks, and only a forecast horizon of days, which are repeated for each.
    The number of tasks and the kind of join are given: subscriptions are small beside what is made of them, and Spark would
    put them into one task or send them all to it.
    """
    tasks = int(subscriptions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = forecasts.withColumns({"_rank": risk_rank(F.col("level")), "_salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
    wanted = subscriptions.withColumns({"_least": risk_rank(F.col("minimum_level")), "_salt": F.pmod(F.hash("id", "email"), F.lit(salts))})
    wanted = wanted.repartition(tasks, "entity", "_salt").hint("merge")
    on = (ranked.entity == wanted.entity) & (ranked._salt == wanted._salt) & (ranked._rank >= wanted._least)
    return ranked.join(wanted, on).select(
        F.col("id").alias("subscription_id"), wanted.entity, "email", "language", "date", "level", "probability")


def due(cand: DataFrame, deliveries: DataFrame, now: Column, cap: int = DAILY_CAP) -> DataFrame:
    """Candidates to send now: not sent yet, back-off over, daily cap respected.

    ``deliveries``: subscription_id, date, level, status, attempts, created_at (UTC).
    """
    keys = ["subscription_id", "date", "level"]
    sent = deliveries.filter("status = 'sent'")
    failed = deliveries.filter("status = 'failed'").groupBy(*keys).agg(
        F.max_by("attempts", "created_at").alias("attempts"), F.max("created_at").alias("last_failed"))
    local_day = lambda c: F.to_date(F.from_utc_timestamp(c, ALERT_ZONE))
    today = (sent.filter(local_day(F.col("created_at")) == local_day(now))
             .groupBy("subscription_id").agg(F.count(F.lit(1)).alias("sent_today")))
    # exponential back-off, one hour at most
    wait = F.least(F.lit(60.0), F.pow(F.lit(2.0), F.col("attempts")))
    ready = F.col("last_failed").isNull() | (now >= F.timestamp_seconds(F.unix_timestamp("last_failed") + wait * 60))
    open_ = (cand.filter(waking_hours(now)).join(sent.select(*keys).distinct(), keys, "left_anti")
             .join(failed, keys, "left").filter(ready).join(today, "subscription_id", "left"))
    # a subscriber has at most one candidate per forecast day and level
    w = Window.partitionBy("subscription_id").orderBy("date", risk_rank(F.col("level")))
    slot = F.row_number().over(w) + F.coalesce("sent_today", F.lit(0))
    return open_.withColumn("slot", slot).filter(F.col("slot") <= cap)


def render(alerts: DataFrame, texts: DataFrame, city: str = "entity", link: str = "/unsubscribe?id=") -> DataFrame:
    """Subject and body in the subscriber's language.

    ``texts`` (language, level, summary, tips, disclaimer, unsubscribe) holds all wording; a language that lacks the level
    falls back to English. ``{level}``, ``{city}``, ``{date}`` and ``{probability}`` are filled in the summary, ``{link}`` in
    the line on how to unsubscribe.
    """
    own = texts.select("language", "level", F.struct("summary", "tips", "disclaimer", "unsubscribe").alias("_own"))
    english = texts.filter("language = 'en'").select("level", F.struct("summary", "tips", "disclaimer", "unsubscribe").alias("_en"))
    x = alerts.join(own, ["language", "level"], "left").join(english, "level", "left").withColumn("_t", F.coalesce("_own", "_en"))
    name = F.initcap(F.col(city).cast("string"))
    fill = {"{level}": F.col("level"), "{city}": name, "{date}": F.col("date").cast("string"),
            "{probability}": F.format_string("%.0f%%", F.col("probability") * 100)}
    summary = F.col("_t.summary")
    for mark, value in fill.items():
        summary = F.replace(summary, F.lit(mark), value)
    leave = F.replace(F.col("_t.unsubscribe"), F.lit("{link}"), F.concat(F.lit(link), F.col("subscription_id").cast("string")))
    tips = F.coalesce("_t.tips", F.array().cast("array<string>"))
    body = F.concat_ws("\n", summary, F.array_join(F.transform(tips, lambda t: F.concat(F.lit("- "), t)), "\n"), F.col("_t.disclaimer"), leave)
    return x.withColumns({"subject": F.format_string("%s heat risk for %s", F.col("level"), name), "summary": summary, "tips": tips,
                          "body": body}).drop("_own", "_en", "_t")
