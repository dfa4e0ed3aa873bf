"""Ordered-series functions over bars: windows where a window can say it, recurrences where
each value needs the one before.

Bars of one (symbol, tf) are one series; series are independent, so a table of bars is
partitioned by them and a recurrence is one pass over its sorted series in Arrow batches.
Warm-up is null, never NaN.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("symbol", "tf")


def ordered() -> "Window":
    return Window.partitionBy(*SERIES).orderBy("open_time")


def sma(column: str, period: int) -> Column:
    """Mean of the last ``period`` values as they are; a frame is summed in series order, so
    any plan agrees."""
    w = ordered().rowsBetween(-(period - 1), 0)
    return F.when(F.row_number().over(ordered()) >= period, F.sum(F.col(column).cast("double")).over(w) / period)


def true_range() -> Column:
    before = F.lag("close").over(ordered())
    return F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def linreg_slope(column: str, last: int = 20) -> Column:
    """Least-squares slope over the last values that are not null; 0 with fewer than two."""
    w = ordered().rowsBetween(-(last - 1), 0)
    return F.when(F.count(column).over(w) >= 2, F.regr_slope(F.col(column), F.col("rn")).over(w)).otherwise(F.lit(0.0))


def swing(column: str, high: bool, left: int = 2, right: int = 2) -> Column:
    """Whether the value is the strict extreme of its neighbourhood; edges are not."""
    sides = [F.lag(column, k).over(ordered()) for k in range(1, left + 1)] + [F.lead(column, k).over(ordered()) for k in range(1, right + 1)]
    out = F.lit(True)
    for side in sides:
        out = out & F.coalesce((F.col(column) > side) if high else (F.col(column) < side), F.lit(False))
    return out


# Recurrences: plain arithmetic in series order, the same on every engine.


def ema(values: Iterable[float | None], period: int) -> list[float | None]:
    """Seeded by the mean of the first ``period`` values."""
    out: list[float | None] = []
    k, total, last = 2.0 / (period + 1), 0.0, 0.0
    for n, v in enumerate(values, 1):
        if n < period:
            total += v
            out.append(None)
        else:
            last = (total + v) / period if n == period else v * k + last * (1.0 - k)
            out.append(last)
    return out


def rma(values: Iterable[float | None], period: int) -> list[float | None]:
    """Wilder's average from the first value on: leading nulls are skipped, the mean of
    ``period`` values is the seed, later nulls carry the last value; a null inside the seed
    block leaves all null."""
    out: list[float | None] = []
    total, seen, last, begun = 0.0, 0, None, False
    spoilt = False
    for v in values:
        if not begun and v is None:
            out.append(None)
            continue
        begun = True
        if spoilt:
            out.append(None)
        elif seen < period:
            if v is None:
                spoilt = True
                out.append(None)
                continue
            total += v
            seen += 1
            last = total / period if seen == period else None
            out.append(last)
        else:
            if v is not None:
                last = (last * (period - 1) + v) / period
            out.append(last)
    return out


def true_ranges(high, low, close) -> list[float]:
    return [h - lo if i == 0 else max(h - lo, abs(h - close[i - 1]), abs(lo - close[i - 1])) for i, (h, lo) in enumerate(zip(high, low, strict=True))]


def rsi(close: list[float], period: int = 14) -> list[float | None]:
    """100 when there was no loss, even with no gain either."""
    moves = [b - a for a, b in zip(close, close[1:], strict=False)]
    gain, loss = rma([max(m, 0.0) for m in moves], period), rma([max(-m, 0.0) for m in moves], period)
    return [None, *(None if g is None else 100.0 if lo == 0 else 100.0 - 100.0 / (1.0 + g / lo) for g, lo in zip(gain, loss, strict=True))] if close else []


def adx(high, low, close, period: int = 14) -> tuple[list, list, list]:
    """(adx, plus DI, minus DI); the first bar moves nowhere; DX is null where both DI are 0."""
    plus, minus = [0.0] * len(close), [0.0] * len(close)
    for i in range(1, len(close)):
        up, down = high[i] - high[i - 1], low[i - 1] - low[i]
        plus[i] = up if up > down and up > 0 else 0.0
        minus[i] = down if down > up and down > 0 else 0.0
    atr = rma(true_ranges(high, low, close), period)
    di = [[None if r is None or not r else 100.0 * s / r for s, r in zip(rma(side, period), atr, strict=True)] for side in (plus, minus)]
    dx = [None if p is None or m is None or p + m == 0 else 100.0 * abs(p - m) / (p + m) for p, m in zip(*di, strict=True)]
    return rma(dx, period), di[0], di[1]


def nearest_levels(high, low, close, lag: int = 2) -> tuple[list, list]:
    """Percent distance to the nearest confirmed swing high above and swing low below the
    close, rounded to 3; a swing is confirmed ``lag`` bars later."""
    from bisect import bisect_left, bisect_right, insort

    highs: list[float] = []
    lows: list[float] = []
    above, below = [], []
    for i, price in enumerate(close):
        j = i - lag
        if j >= lag and i < len(close):
            near = [k for k in range(j - lag, j + lag + 1) if k != j]
            if all(high[j] > high[k] for k in near):
                insort(highs, high[j])
            if all(low[j] < low[k] for k in near):
                insort(lows, low[j])
        a, b = bisect_right(highs, price), bisect_left(lows, price)
        above.append((highs[a] - price) / price * 100 if a < len(highs) and price else None)
        below.append((price - lows[b - 1]) / price * 100 if b and price else None)
    return above, below


INDICATORS = {"ema_fast": 21, "ema_slow": 50, "ema_trend": 200}
_ADDED = ["ema_fast", "ema_slow", "ema_trend", "atr", "rsi", "adx", "plus_di", "minus_di", "resistance_pct", "support_pct"]


def indicator_frame(bars: DataFrame, periods: dict[str, int] | None = None, wilder: int = 14) -> DataFrame:
    """bars with rn and every recurrence as a column, one pass per series."""
    used = INDICATORS | (periods or {})
    names = bars.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("open_time")
        high, low, close = (table.column(c).to_pylist() for c in ("high", "low", "close"))
        found: dict[str, list] = {k: ema(close, used[k]) for k in ("ema_fast", "ema_slow", "ema_trend")}
        found["atr"] = rma(true_ranges(high, low, close), wilder)
        found["rsi"] = rsi(close, wilder)
        found["adx"], found["plus_di"], found["minus_di"] = adx(high, low, close, wilder)
        found["resistance_pct"], found["support_pct"] = nearest_levels(high, low, close)
        out = table.select(names).append_column("rn", pa.array(range(1, len(close) + 1), pa.int64()))
        for k in _ADDED:
            out = out.append_column(k, pa.array(found[k], pa.float64()))
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema) + ", rn long, " + ", ".join(f"{k} double" for k in _ADDED)
    return bars.groupBy(*SERIES).applyInArrow(run, schema)
