"""Open trades as the state of a stream: bars and entries come in, outcomes go out.

Bars and entries wait in state until the watermark has passed them, so rows that come late or out
of order within the delay change nothing.  A timer of event time fires then: the bars that are due
are numbered on from those before, open trades are taken through them, and what is settled leaves
the state.  A trade that no bar ends within its lifetime leaves as still open by a timer of its own,
so the state of a symbol that goes quiet ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barcraft.operators.simulate import Costs, settle

_BAR = ["close_time", "open_time", "open", "high", "low", "close"]
_TRADE = ["trade_id", "run_id", "as_of", "opened_at", "direction", "entry_mid", "sl_price", "tp_price", "first_no"]
_BAR_TYPE = "close_time long, open_time long, open double, high double, low double, close double"
_TRADE_TYPE = "trade_id long, run_id string, as_of long, opened_at long, direction string, entry_mid double, sl_price double, tp_price double, first_no long"
_OUT_TYPE = "symbol string, trade_id long, run_id string, as_of long, opened_at long, direction string, entry_mid double, sl_price double, tp_price double, event string, bar_open double, bar_close double, bar_close_time long"
#: A row of this time or later only moves the clock: it lets a replay end.
CLOCK = "9000-01-01 00:00:00"


def first_event(trade: dict, bars: dict[str, np.ndarray], begin: int, end: int, last: int) -> tuple[str, int] | None:
    """(event, bar's index) that ends a trade among bars[begin:end]; ``last`` is the index of
    the bar at which it times out."""
    low, high = bars["low"][begin:end], bars["high"][begin:end]
    buy = trade["direction"] == "BUY"
    stop = low <= trade["sl_price"] if buy else high >= trade["sl_price"]
    target = high >= trade["tp_price"] if buy else low <= trade["tp_price"]
    target &= bars["open_time"][begin:end] >= trade["opened_at"]  # the bar that was open at entry only stops
    at = np.flatnonzero(stop | target)
    if len(at):
        i = int(at[0])
        if bars["open_time"][begin + i] < trade["opened_at"]:
            return "sl_partial", begin + i
        return ("ambiguous" if stop[i] and target[i] else "tp_hit" if target[i] else "sl_hit"), begin + i
    return ("timeout", last) if begin <= last < end else None


class OpenTrades(StatefulProcessor):
    """Keyed by (symbol, lane).  State: bars and trades not yet through, and the number of bars
    before those while a trade needs it."""

    def __init__(self, horizon: int, lifetime_us: int):
        self.horizon, self.lifetime_us = horizon, lifetime_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", _BAR_TYPE)
        self.trades = handle.getListState("trades", _TRADE_TYPE)
        self.passed = handle.getValueState("passed", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for frame in rows:
            bars, trades = frame[frame["is_bar"]], frame[~frame["is_bar"]]
            if len(bars):
                self.bars.appendList([tuple(r) for r in bars[_BAR].itertuples(index=False)])
            if len(trades):
                self.trades.appendList([tuple(r) for r in trades.assign(first_no=-1)[_TRADE].itertuples(index=False)])
            latest = max(latest, int(frame["event_us"].max()))
        self.handle.registerTimer(latest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = {r[0]: r for r in (self.bars.get() if self.bars.exists() else ())}
        due = sorted(t for t in waiting if t < now)
        bars = {name: np.array([waiting[t][i] for t in due]) for i, name in enumerate(_BAR)}
        before = self.passed.get()[0] if self.passed.exists() else 0
        held = {r[0]: dict(zip(_TRADE, r, strict=True)) for r in reversed(list(self.trades.get()))} if self.trades.exists() else {}
        out, still = [], []
        for trade in held.values():
            if trade["opened_at"] >= now:
                still.append(trade)
                continue
            if trade["first_no"] < 0:
                trade["first_no"] = before + int(np.searchsorted(bars["close_time"], trade["opened_at"], "right"))
            begin = trade["first_no"] - before
            last = begin + self.horizon - 1
            found = first_event(trade, bars, max(begin, 0), min(last + 1, len(due)), last) if due else None
            if found:
                event, i = found
                out.append((*key[:1], *(trade[c] for c in _TRADE[:-1]), event, bars["open"][i], bars["close"][i], int(bars["close_time"][i])))
            elif trade["opened_at"] + self.lifetime_us < now:
                out.append((*key[:1], *(trade[c] for c in _TRADE[:-1]), None, None, None, None))
            else:
                still.append(trade)
        self._keep(still, [waiting[t] for t in waiting if t >= now], before + len(due))
        if out:
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in _OUT_TYPE.split(", ")])
            yield frame.astype({"bar_close_time": "Int64", "bar_open": float, "bar_close": float})

    def _keep(self, trades: list[dict], bars: list[tuple], passed: int) -> None:
        """Puts back what is still needed; without trades no count of bars is."""
        for state, rows in ((self.bars, bars), (self.trades, [tuple(t[c] for c in _TRADE) for t in trades])):
            if rows:
                state.put(rows)
            elif state.exists():
                state.clear()
        if trades:
            self.passed.update((passed,))
            self.handle.registerTimer((min(t["opened_at"] for t in trades) + self.lifetime_us) // 1000 + 1)
        elif self.passed.exists():
            self.passed.clear()

    def close(self) -> None:
        pass


def _us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def with_clock(rows: DataFrame, time: str) -> DataFrame:
    """A table and, at its end, a row that only moves the clock: a replay then settles all."""
    last = rows.sparkSession.range(1).select(*[F.lit(CLOCK if f.name == time else None).cast(f.dataType).alias(f.name) for f in rows.schema])
    return rows.unionByName(last)


def open_trade_stream(bars: DataFrame, trades: DataFrame, timeout_bars: int, costs: Costs, delay_minutes: int = 15, lifetime_days: int = 30, lanes: int = 1) -> DataFrame:
    """A stream of outcomes, as ``simulate.reconcile`` gives them, from streams of
    bars(symbol, open_time, close_time, open, high, low, close) and trades(symbol, trade_id, run_id,
    as_of, opened_at, direction, entry_mid, sl_price, tp_price).

    Each side has a watermark of its own and the later one waits.  Rows that are later than the
    delay are dropped.  A trade that comes twice counts once, a bar that comes twice as it came
    last.  ``lanes`` splits the trades of a symbol over that many groups, which all get its bars.
    Trades that nothing ends within ``lifetime_days`` come out as open."""
    b = bars.select("symbol", F.col("close_time").cast("timestamp").alias("event_time"), *[_us(c).alias(c) for c in ("close_time", "open_time")], "open", "high", "low", "close")
    t = trades.select("symbol", F.col("opened_at").cast("timestamp").alias("event_time"), "trade_id", "run_id", *[_us(c).alias(c) for c in ("as_of", "opened_at")], "direction", "entry_mid", "sl_price", "tp_price")
    real = F.col("event_time") < F.lit(CLOCK).cast("timestamp")  # names the event time, so it stays above the watermark
    b = b.withWatermark("event_time", f"{delay_minutes} minutes").where(real).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    t = t.withWatermark("event_time", f"{delay_minutes} minutes").where(real).withColumn("lane", F.pmod("trade_id", F.lit(lanes)).cast("int"))
    both = b.withColumn("is_bar", F.lit(True)).unionByName(t.withColumn("is_bar", F.lit(False)), allowMissingColumns=True)
    whole = ("close_time", "open_time", "trade_id", "as_of", "opened_at")  # never null, so that pandas keeps every digit
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in whole}).withColumn("event_us", _us("event_time"))
    lifetime = lifetime_days * 86_400_000_000
    found = both.groupBy("symbol", "lane").transformWithStateInPandas(OpenTrades(timeout_bars, lifetime), _OUT_TYPE, "append", "eventTime")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    x = F.when(F.col("event").isNotNull(), F.struct("event", F.col("bar_open").alias("open"), F.col("bar_close").alias("close"), F.timestamp_micros("bar_close_time").cast("timestamp_ntz").alias("close_time")))
    return settle(found.select("symbol", at("as_of"), "run_id", "trade_id", at("opened_at"), "direction", "entry_mid", "sl_price", "tp_price", x.alias("x")), costs)

