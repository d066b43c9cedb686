"""Alerts as a stream: what to send, when, and again after a failure, with keyed state and event-time timers.

``transformWithState`` with its RocksDB store is the Spark mechanism for state of this kind; from Python it runs in Python workers.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections import namedtuple
from collections.abc import Iterator
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from daystrata.spec import ALERT_ZONE, DAILY_CAP, QUIET_FROM, QUIET_UNTIL, RISK_RANK
from daystrata.streaming.live import rocksdb

EVENT = "subscription_id bigint, at bigint, kind string, date date, level string, probability double, attempts int"
ALERT = "date date, level string, wanted boolean, probability double, sent boolean, attempts int, failed bigint, handed bigint"
#: What the state holds: Python tuples packed into one value, since each value costs a call and two conversions in Spark.
PACKED = "packed binary"
DUE = "subscription_id bigint, date date, level string, probability double, slot int, due_at timestamp"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


ALERT_NAMES = _names(ALERT)
EventRow, DueRow = namedtuple("EventRow", _names(EVENT)), Row(*_names(DUE))
#: Groups that share their calls to the state store. Part of a checkpoint; about one for 64 subscriptions does well.
BLOCKS = 4096


@lru_cache(1 << 16)
def _local(t: int, zone: str) -> dt.datetime:
    return dt.datetime.fromtimestamp(t / 1000, dt.timezone.utc).astimezone(ZoneInfo(zone))


class Book:
    """The alerts of one subscription, moved on from instant to instant (milliseconds)."""

    def __init__(self, alerts: list[dict], day: dt.date | None, used: int, wake: int | None, cap: int, zone: str):
        self.alerts = {(a["date"], a["level"]): a for a in alerts}
        self.day, self.used, self.wake = day, used, wake
        self.cap, self.zone = cap, ZoneInfo(zone)

    def local(self, t: int) -> dt.datetime:
        return _local(t, self.zone.key)

    def waking(self, t: int) -> bool:
        return QUIET_UNTIL <= self.local(t).hour < QUIET_FROM

    def morning(self, t: int, days: int) -> int:
        day = self.local(t).date() + dt.timedelta(days=days)
        return int(dt.datetime.combine(day, dt.time(QUIET_UNTIL), self.zone).timestamp() * 1000)

    @staticmethod
    def retry(a: dict) -> int:
        """Exponential back-off since the last failure, one hour at most."""
        return a["failed"] // 1000 * 1000 + int(min(60.0, 2.0 ** a["attempts"]) * 60_000)

    def turn(self, t: int) -> None:
        """A new local day has a new allowance; alerts of past days are forgotten."""
        today = self.local(t).date()
        if self.day != today:
            self.day, self.used = today, 0
            self.alerts = {k: a for k, a in self.alerts.items() if k[0] >= today}

    def apply(self, e: EventRow) -> None:
        self.turn(e.at)
        key = (e.date, e.level)
        a = self.alerts.get(key) or {"date": e.date, "level": e.level, "wanted": False, "probability": None, "sent": False, "attempts": 0,
                                     "failed": None, "handed": None}
        counted = a["handed"] is not None and self.local(a["handed"]).date() == self.day
        if e.kind == "candidate":
            a["wanted"], a["probability"] = True, e.probability
        elif e.kind == "sent":
            self.used += not counted
            a["sent"], a["handed"] = True, None
        elif e.kind == "failed":
            self.used -= counted
            if a["failed"] is None or (e.at, e.attempts) > (a["failed"], a["attempts"]):
                a["failed"], a["attempts"] = e.at, e.attempts
            a["handed"] = None
        if e.date >= self.day:
            self.alerts[key] = a

    def due(self, t: int) -> list[tuple]:
        """Alerts to hand out at ``t``, by date and level, within the day's allowance; sets the time to look again."""
        self.turn(t)
        out = []
        waiting = [a for a in self.alerts.values() if a["wanted"] and not a["sent"] and a["handed"] is None]
        if self.waking(t):
            for a in sorted(waiting, key=lambda a: (a["date"], RISK_RANK[a["level"]])):
                if self.used < self.cap and (a["failed"] is None or t >= self.retry(a)):
                    self.used += 1
                    a["handed"] = t
                    out.append((a["date"], a["level"], a["probability"], self.used))
        times = [self.next_time(a, t) for a in waiting if a["handed"] is None]
        self.wake = min((x for x in times if x is not None), default=None)
        return out

    def next_time(self, a: dict, t: int) -> int | None:
        x = max(t + 1, self.retry(a) if a["failed"] is not None else 0)
        if self.used >= self.cap and self.local(x).date() == self.day:
            x = self.morning(x, 1)
        elif not self.waking(x):
            x = self.morning(x, 0 if self.local(x).hour < QUIET_UNTIL else 1)
        return x if self.local(x).date() <= a["date"] else None


class Outbox(StatefulProcessor):
    """Per block of subscriptions: an inbox of events ahead of the watermark, the open alerts, and each one's allowance of the day.

    Events wait until the watermark has passed them and are then applied in the order of their times, so what comes out does
    not depend on how the input was cut into micro-batches. A subscription has a ``Book`` of its own; a block only shares the
    calls to the state store, which cost more than the work. One timer a block stands at the next event or retry in it.
    """

    def __init__(self, cap: int, zone: str):
        self.cap, self.zone = cap, zone

    def init(self, handle) -> None:
        self.handle = handle
        self.inbox = handle.getListState("inbox", PACKED)  # the events of each micro-batch
        self.books = handle.getValueState("books", PACKED)  # by subscription: day, used, wake and the open alerts

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = [(r.subscription_id, r.at_ms, r.kind, r.date, r.level, r.probability, r.attempts) for r in rows]
        self.inbox.appendValue((pickle.dumps(events),))
        self.handle.registerTimer(min(e[1] for e in events))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        arrived = [EventRow(*e) for (part,) in (self.inbox.get() if self.inbox.exists() else ()) for e in pickle.loads(part)]
        books = pickle.loads(self.books.get()[0]) if self.books.exists() else {}
        events, made = {}, []
        for e in arrived:
            events.setdefault(e.subscription_id, []).append(e)
        for who in events.keys() | books.keys():
            # at one instant, reports come before decisions; equal instants in a fixed order
            now = sorted((e for e in events.get(who, ()) if e.at <= until),
                         key=lambda e: (e.at, e.kind, e.date, e.level, e.attempts or 0, e.probability or 0.0))
            day, used, wake, alerts = books.get(who, (None, 0, None, ()))
            if not now and (wake is None or wake > until):
                continue
            book, i = Book([dict(zip(ALERT_NAMES, a)) for a in alerts], day, used, wake, self.cap, self.zone), 0
            while True:
                t = min((x for x in (now[i].at if i < len(now) else None, book.wake) if x is not None), default=None)
                if t is None or t > until:
                    break
                while i < len(now) and now[i].at == t:
                    book.apply(now[i])
                    i += 1
                made += [DueRow(who, *a, dt.datetime.fromtimestamp(t / 1000, dt.timezone.utc)) for a in book.due(t)]
            books[who] = (book.day, book.used, book.wake, [tuple(a.values()) for a in book.alerts.values()])
        later = [tuple(e) for e in arrived if e.at > until]
        self.inbox.put([(pickle.dumps(later),)]) if later else self.inbox.clear()
        self.books.update((pickle.dumps(books),))
        ahead = min((x for x in (*(e[1] for e in later), *(b[2] for b in books.values())) if x is not None), default=None)
        if ahead is not None:
            self.handle.registerTimer(ahead)
        return iter(made)


def events(candidates: DataFrame, deliveries: DataFrame, issued) -> DataFrame:
    """One table of (subscription_id, at, kind, date, level, probability, attempts): forecasts that reach a subscriber
    (``alerts.candidates``), issued at ``issued``, and the reports on deliveries (as ``alerts.due`` takes them)."""
    none = F.lit(None)
    asked = candidates.select(F.col("subscription_id").cast("bigint").alias("subscription_id"), issued.cast("timestamp").alias("at"),
                              F.lit("candidate").alias("kind"), "date", "level", F.col("probability").cast("double").alias("probability"),
                              none.cast("int").alias("attempts"))
    told = deliveries.select(F.col("subscription_id").cast("bigint").alias("subscription_id"), F.col("created_at").alias("at"), F.col("status").alias("kind"),
                             "date", "level", none.cast("double").alias("probability"), F.col("attempts").cast("int").alias("attempts"))
    return asked.unionByName(told)


def due_alerts(stream: DataFrame, delay: str = "3 days", cap: int = DAILY_CAP, zone: str = ALERT_ZONE, blocks: int = BLOCKS) -> DataFrame:
    """Alerts to send, each when it is due, from a stream of ``events`` that are late by ``delay`` at most.

    An alert is handed out once; after a report of failure it comes again when its back-off is over. Quiet hours and the
    daily cap (reports of success and alerts handed out) put it off; past days are dropped. State is kept by ``blocks`` of
    subscriptions; a checkpoint goes on with the number that it began with. Rows without a subscription, time or
    date and rows of an unknown level or kind only move the watermark on. Equal events count once a report, as in the batch form.
    """
    known = (F.col("subscription_id").isNotNull() & F.col("date").isNotNull() & F.col("level").isin(*RISK_RANK)
             & F.col("kind").isin("candidate", "sent", "failed"))
    # The condition is on the time itself: the optimizer moves others below the watermark, which then would not see the rows.
    rows = stream.withWatermark("at", delay).withColumn("at_ms", F.when(known, F.unix_millis("at"))).filter("at_ms IS NOT NULL")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("subscription_id"), F.lit(blocks)))
    return rows.groupBy("block").transformWithState(
        statefulProcessor=Outbox(cap, zone), outputStructType=DUE, outputMode="Append", timeMode="EventTime")


def run_outbox(stream: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Process what is there; due alerts are appended to ``path``. The file sink's log makes each micro-batch count once."""
    with rocksdb(stream.sparkSession):
        (due_alerts(stream, **options).writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
