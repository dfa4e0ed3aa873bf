"""Joins of two streams: blackout windows around scheduled events, and the quote known at an event.

Both sides carry watermarks.  What can no longer find a partner leaves the state: an outer row is
given out once the other side's watermark has passed everything that could have matched it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barcraft.streaming.open_trades import CLOCK



def _real(column: str) -> Column:
    """Not a row that only moves the clock; it names the event time and so stays above the watermark."""
    return F.col(column) < F.lit(CLOCK).cast("timestamp")


def blackout_stream(instants: DataFrame, events: DataFrame, before: int, after: int, impacts: tuple[str, ...] = ("high",), delay_minutes: int = 15) -> DataFrame:
    """(symbol, as_of, event, event_at) of a stream of instants(symbol, as_of), as ``asof.blackout``:
    the first event of such an impact whose window holds as_of, null if none.

    The join is an outer equi-join on the hours that windows touch, with the window as its interval
    condition; the first of several windows is taken by an aggregation that ends with the
    watermark.  A (symbol, as_of) that comes twice is one row."""
    a = instants.select("symbol", F.col("as_of").cast("timestamp").alias("as_of")).withWatermark("as_of", f"{delay_minutes} minutes").where(_real("as_of")).withColumn("hour", F.date_trunc("hour", "as_of"))
    e = events.select("label", "impact", F.col("scheduled_at").cast("timestamp").alias("scheduled_at")).withWatermark("scheduled_at", f"{delay_minutes} minutes").where(F.when(_real("scheduled_at"), F.col("impact").isin(*impacts)).otherwise(F.lit(False)))
    lo, hi = F.col("scheduled_at") - F.expr(f"interval {before} minutes"), F.col("scheduled_at") + F.expr(f"interval {after} minutes")
    e = e.select("label", "scheduled_at", F.explode(F.sequence(F.date_trunc("hour", lo), F.date_trunc("hour", hi), F.expr("interval 1 hour"))).alias("touched"))
    within = (F.col("hour") == F.col("touched")) & (F.col("as_of") >= lo) & (F.col("as_of") <= hi)
    first = F.min(F.when(F.col("scheduled_at").isNotNull(), F.struct("scheduled_at", "label")))
    found = a.join(e, within, "left_outer").groupBy("symbol", "as_of").agg(first.alias("e"))
    return found.select("symbol", F.col("as_of").cast("timestamp_ntz").alias("as_of"), F.col("e.label").alias("event"), F.col("e.scheduled_at").cast("timestamp_ntz").alias("event_at"))


class QuoteAtEvent(StatefulProcessor):
    """Keyed by (symbol, lane).  State: the latest quote behind the watermark, what is ahead of it,
    and events that wait for the watermark."""

    def __init__(self, lifetime_us: int):
        self.lifetime_us = lifetime_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quotes = handle.getListState("quotes", "at long, price double")
        self.events = handle.getListState("events", "event_id long, at long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for frame in rows:
            for state, those, columns in ((self.quotes, frame[frame["is_quote"]], ["event_us", "value"]), (self.events, frame[~frame["is_quote"]], ["event_id", "event_us", "value"])):
                if len(those):
                    state.appendList([tuple(r) for r in those[columns].itertuples(index=False)])
            latest = max(latest, int(frame["event_us"].max()))
        self.handle.registerTimer(latest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        quotes = sorted(self.quotes.get(), key=lambda q: q[0]) if self.quotes.exists() else []
        events = list(self.events.get()) if self.events.exists() else []
        due, later = [e for e in events if e[1] < now], [e for e in events if e[1] >= now]
        known = np.array([q[0] for q in quotes], np.int64)
        at = np.searchsorted(known, [e[1] for e in due], "right") - 1
        passed = int(np.searchsorted(known, now, "left"))
        keep = quotes[max(passed - 1, 0) :]
        if keep and not later and keep[-1][0] + self.lifetime_us < now:
            keep = []  # the symbol has gone quiet
        for state, rows in ((self.quotes, keep), (self.events, later)):
            if rows:
                state.put(rows)
            elif state.exists():
                state.clear()
        if keep:
            self.handle.registerTimer((keep[-1][0] + self.lifetime_us) // 1000 + 1)
        if due:
            yield pd.DataFrame({
                "symbol": [key[0]] * len(due), "event_id": [e[0] for e in due], "value": [e[2] for e in due],
                "quote_us": pd.array([quotes[i][0] if i >= 0 else None for i in at], "Int64"), "quote": [quotes[i][1] if i >= 0 else np.nan for i in at],
            })

    def close(self) -> None:
        pass


def quote_stream(events: DataFrame, quotes: DataFrame, delay_minutes: int = 15, lifetime_days: int = 30, lanes: int = 1) -> DataFrame:
    """A stream of events(symbol, event_id, ts, value), each with the latest quote(symbol, time,
    price) of its symbol that was there at ts (null if none): quote_time, quote.

    The later watermark waits for the earlier, so a quote that comes late within the delay still
    counts.  Of quotes at one time that which came last counts.  ``lanes`` splits a symbol's events;
    each lane keeps its latest quote for ``lifetime_days`` after it."""
    e = events.select("symbol", F.col("ts").cast("timestamp").alias("event_time"), "event_id", "value").withWatermark("event_time", f"{delay_minutes} minutes").where(_real("event_time"))
    q = quotes.select("symbol", F.col("time").cast("timestamp").alias("event_time"), F.lit(0).cast("long").alias("event_id"), F.col("price").alias("value")).withWatermark("event_time", f"{delay_minutes} minutes").where(_real("event_time"))
    e = e.withColumns({"lane": F.pmod("event_id", F.lit(lanes)).cast("int"), "is_quote": F.lit(False)})
    q = q.withColumns({"lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))}).withColumn("is_quote", F.lit(True))
    both = e.unionByName(q).withColumn("event_us", F.unix_micros("event_time"))
    found = both.groupBy("symbol", "lane").transformWithStateInPandas(QuoteAtEvent(lifetime_days * 86_400_000_000), "symbol string, event_id long, value double, quote_us long, quote double", "append", "eventTime")
    return found.select("symbol", "event_id", "value", F.timestamp_micros("quote_us").cast("timestamp_ntz").alias("quote_time"), F.when(F.col("quote_us").isNotNull(), F.col("quote")).alias("quote"))
