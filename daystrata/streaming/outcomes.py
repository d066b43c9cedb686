"""Forecasts and observations that wait for each other, with the state of many entities in one value.

A stream-stream join of Spark keeps every row of both sides as two entries of the state store and looks each of them up again; here a
block of entities has one value for each side, and a micro-batch meets it in one merge.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PACKED = "packed binary"
#: Groups of entities that share a value of the state, and with it its calls to the store. Part of a checkpoint.
BLOCKS = 512
#: Why a number is not there.
NULL, NAN = 1, 2


class _Field:
    """A column on its way through pandas, which knows no null numbers: a number and why it is not one; texts go as they are."""

    def __init__(self, field: T.StructField, name: str) -> None:
        self.type, self.name, kind = field.dataType, name, field.dataType
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        self.stored = next((s for types, s in ((whole, "bigint"), ((T.BooleanType, T.DateType), "int"), (T.TimestampType, "bigint"),
                                               ((T.FloatType, T.DoubleType), "double")) if isinstance(kind, types)), None)

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [(self.name, self.stored), (f"{self.name}_not", "int")] if self.stored else [(self.name, self.type.simpleString())]

    def encoded(self, column: Column | None) -> list[Column]:
        """``column`` is None where the side has no such column."""
        if column is None:
            values = [F.lit(0).cast(self.stored), F.lit(NULL)] if self.stored else [F.lit(None).cast(self.type)]
        elif not self.stored:
            values = [column]
        else:
            x = F.unix_date(column) if isinstance(self.type, T.DateType) else F.unix_micros(column) if isinstance(self.type, T.TimestampType) else column
            nan = F.isnan(column) if self.stored == "double" else F.lit(False)
            values = [F.when(column.isNull() | nan, F.lit(0).cast(self.stored)).otherwise(x.cast(self.stored)), F.when(column.isNull(), NULL).when(nan, NAN).otherwise(0)]
        return [v.alias(n) for v, (n, _) in zip(values, self.columns)]

    def decoded(self) -> Column:
        x = F.col(self.name)
        if not self.stored:
            return x
        x = F.date_from_unix_date(x) if isinstance(self.type, T.DateType) else F.timestamp_micros(x) if isinstance(self.type, T.TimestampType) else x.cast(self.type)
        why = F.col(f"{self.name}_not")
        return F.when(why == 0, x).when(why == NAN, F.lit(float("nan")).cast(self.type) if self.stored == "double" else None)


class Waiting(StatefulProcessor):
    """Per block: forecasts with whether they have met an observation, and observations, each until the watermark has passed it."""

    def __init__(self, asked: list[str], seen: list[str], entity: list[str], grace: int) -> None:
        self.asked, self.seen, self.entity, self.grace = asked, seen, entity, grace

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", PACKED)  # one value, as each call to the store waits for an answer

    def _both(self) -> tuple[pd.DataFrame | None, pd.DataFrame | None]:
        held = self.held.get()
        return (None, None) if held is None else pickle.loads(held[0])

    def _output(self, rows: pd.DataFrame) -> pd.DataFrame:
        missing = {c: NULL if c.endswith("_not") else 0 for c in self.seen if c not in rows}
        return rows.assign(**missing)[[*self.asked, *self.seen]]

    def _store(self, forecasts: pd.DataFrame, observed: pd.DataFrame) -> None:
        ends = [int(rows["ms"].min()) + more for rows, more in ((forecasts, self.grace), (observed, 0)) if len(rows)]
        if ends:
            self.held.update((pickle.dumps((forecasts, observed)),))
            self.handle.registerTimer(min(ends) + 1)
        else:
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        side = new["side"] == 0
        new_asked = new.loc[side, ["ms", *self.asked]].assign(met=False)
        new_seen = new.loc[~side, ["ms", *self.entity, *self.seen]]
        old_asked, old_seen = self._both()
        asked, seen = (pd.concat([x for x in both if x is not None and len(x)] or [both[1]], ignore_index=True)
                       for both in ((old_asked, new_asked), (old_seen, new_seen)))
        # what was here met already: only pairs with a new row
        asked_new, seen_new = len(asked) - len(new_asked), len(seen) - len(new_seen)
        on = ["ms", *self.entity]
        pairs = asked.assign(_i=asked.index).merge(seen.assign(_j=seen.index), on=on)
        if self.entity[1:]:
            pairs = pairs[pairs[self.entity[1]] == 0]  # no entity meets nothing
        pairs = pairs[(pairs["_i"] >= asked_new) | (pairs["_j"] >= seen_new)]
        if len(pairs):
            asked.loc[pairs["_i"].unique(), "met"] = True
        self._store(asked, seen)
        if len(pairs):
            yield self._output(pairs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        asked, seen = self._both()
        if asked is None:
            return
        gone = asked["ms"] + self.grace < until
        over, asked = asked[gone & ~asked["met"]], asked[~gone]
        self._store(asked, seen[seen["ms"] >= until])
        if len(over):
            yield self._output(over)


def left_outer(log: DataFrame, observed: DataFrame, delay: str, grace: str, blocks: int = BLOCKS) -> DataFrame:
    """Every row of the stream ``log`` (entity, date, ...) beside each ``observed`` of its entity and day, once ``grace`` and delay have
    passed it without one, beside null. Rows without a day wait for ever in a join and are left out."""
    fields = [_Field(f, f"c{i}") for i, f in enumerate(log.schema.fields)]
    value = _Field(observed.schema["observed"], "o")
    entity = fields[log.columns.index("entity")]

    def side(df: DataFrame, number: int, own: list[Column], other: list[Column]) -> DataFrame:
        day = F.col("date").cast("timestamp")
        rows = df.filter(F.col("date").isNotNull()).withColumn("at", day).withWatermark("at", delay)
        block = F.pmod(F.xxhash64(F.col("entity").cast("string")), F.lit(blocks))
        return rows.select("at", block.alias("block"), F.lit(number).alias("side"), F.unix_millis("at").alias("ms"), *own, *other)

    asked = side(log, 0, [c for f in fields for c in f.encoded(F.col(f"`{log.columns[int(f.name[1:])]}`"))], value.encoded(None))
    seen = side(observed.filter("entity IS NOT NULL"), 1, [c for f in fields for c in f.encoded(
        F.col("entity").cast(entity.type) if f is entity else None)], value.encoded(F.col("observed")))
    ours, theirs = [c for f in fields for c in f.columns], value.columns
    out = asked.unionByName(seen).groupBy("block").transformWithStateInPandas(
        statefulProcessor=Waiting([c for c, _ in ours], [c for c, _ in theirs], [c for c, _ in entity.columns], int(pd.Timedelta(grace).total_seconds() * 1000)),
        outputStructType=", ".join(f"{c} {t}" for c, t in [*ours, *theirs]), outputMode="Append", timeMode="EventTime")
    return out.select(*[f.decoded().alias(n) for f, n in zip(fields, log.columns)], value.decoded().alias("observed"))
