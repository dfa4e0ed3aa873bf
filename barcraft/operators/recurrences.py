"""Averages that depend on the value before (EMA, Wilder, and what is built on them) over series of
any length, in slices.

Each step of such an average is an affine map of the value before, y -> a y + b, and so is a whole
slice of steps.  Slices are run from zero to get their map, one small row each; the maps are composed
along the series, which gives the value each slice starts from; then every slice is run again from
its start.  The first slice holds the seeds.  ADX averages what the first pass made, so it takes a
second one, from its own seed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcraft.operators.indicators import INDICATORS, SERIES, nearest_levels
from barcraft.operators.segments import running
from barcraft.sources.sinks import settled

SLICE_ROWS = 50_000
_MADE = ["ema_fast", "ema_slow", "ema_trend", "atr", "rsi", "plus_di", "minus_di", "dx"]


def _inputs(table: pa.Table) -> tuple[int, int, dict[str, np.ndarray]]:
    """(first row's number, rows before it that only give context, values to average by name)."""
    rn = table.column("rn").to_numpy()
    high, low, close = (table.column(c).to_numpy() for c in ("high", "low", "close"))
    context = 1 if rn[0] > 1 else 0
    before = np.concatenate((close[:1], close[:-1]))
    true = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    if not context:
        true[0] = high[0] - low[0]
    move = close - before
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    values = {"close": close, "tr": true, "gain": np.maximum(move, 0.0), "loss": np.maximum(-move, 0.0)}
    values |= {"plus": np.where((up > down) & (up > 0), up, 0.0), "minus": np.where((down > up) & (down > 0), down, 0.0)}
    return int(rn[context]), context, {k: v[context:] for k, v in values.items()}


def _filters(periods: dict[str, int], wilder: int) -> list[tuple[str, str, int, float, int]]:
    """(name, input, period, weight of a new value, number of the first row that counts)."""
    emas = [(k, "close", periods[k], 2.0 / (periods[k] + 1), 1) for k in ("ema_fast", "ema_slow", "ema_trend")]
    return emas + [(k, k, wilder, 1.0 / wilder, 2 if k in ("gain", "loss") else 1) for k in ("tr", "gain", "loss", "plus", "minus")]


def _run(values: list[float], weight: float, start: float | None, seed: int | None) -> list[float | None]:
    """The average from ``start`` on, or where there is none from the mean of the first ``seed``."""
    out: list[float | None] = []
    last = start
    if last is None:
        if len(values) < seed:
            return [None] * len(values)
        last = sum(values[:seed]) / seed
        out, values = [None] * (seed - 1) + [last], values[seed:]
    keep = 1.0 - weight
    for v in values:
        last = last * keep + v * weight
        out.append(last)
    return out


def _averages(table: pa.Table, filters, starts: list[float | None] | None) -> tuple[int, int, dict[str, list]]:
    """Each filter over a slice: from its start, or as the series begins (``starts`` None)."""
    first, context, values = _inputs(table)
    found = {}
    for i, (name, source, period, weight, begins) in enumerate(filters):
        skip = max(0, begins - first)
        run = _run(values[source][skip:].tolist(), weight, None if starts is None else starts[i], period)
        found[name] = [None] * skip + run
    return first, context, found


def _maps(filters):
    """A slice's map per filter: (0, its last value) of the first slice, else (decay, run from 0)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        part = table.column("__slice")[0].as_py()
        first, context, found = _averages(table, filters, None if part == 0 else [0.0] * len(filters))
        m = table.num_rows - context
        a = [0.0 if part == 0 else (1.0 - f[3]) ** m for f in filters]
        b = [found[f[0]][-1] for f in filters]
        return _slice_row(table, part, a, b)

    return run


def _slice_row(table: pa.Table, part: int, a: list[float], b: list[float | None]) -> pa.Table:
    keys = {c: pa.array([table.column(c)[0].as_py()], pa.string()) for c in SERIES}
    return pa.table(keys | {"__slice": pa.array([part], pa.int64()), "a": pa.array([a], pa.list_(pa.float64())), "b": pa.array([b], pa.list_(pa.float64()))})


def _composed(table: pa.Table) -> pa.Table:
    """What each slice starts from: the maps of the slices before it, one after another."""
    table = table.sort_by("__slice")
    starts, last = [], None
    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        starts.append(last)
        if last is None:
            last = b if any(x is not None for x in b) else None
        else:
            last = [None if y is None or z is None else x * y + z for x, y, z in zip(a, last, b, strict=True)]
    return table.drop_columns(["a", "b"]).append_column("__start", pa.array(starts, pa.list_(pa.float64())))


def _values(names: list[str], filters):
    """A slice's columns from its starts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        first, context, f = _averages(table, filters, table.column("__start")[0].as_py())
        n = table.num_rows - context
        rsi = [None if g is None else 100.0 if lo == 0 else 100.0 - 100.0 / (1.0 + g / lo) for g, lo in zip(f["gain"], f["loss"], strict=True)]
        di = [[None if r is None or not r else 100.0 * s / r for s, r in zip(f[side], f["tr"], strict=True)] for side in ("plus", "minus")]
        dx = [None if p is None or m is None or p + m == 0 else 100.0 * abs(p - m) / (p + m) for p, m in zip(*di, strict=True)]
        made = [f["ema_fast"], f["ema_slow"], f["ema_trend"], f["tr"], rsi, *di, dx]
        out = table.slice(context, n).select([*names, "rn", "__slice"])
        for name, column in zip(_MADE, made, strict=True):
            out = out.append_column(name, pa.array(column, pa.float64()))
        return out

    return run


def _dx_map(period: int):
    """The map of a slice of DX values after the seed; nulls carry the last value."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        rn, dx = table.column("rn").to_pylist(), table.column("dx").to_pylist()
        end, seed, part = (table.column(c)[0].as_py() for c in ("__end", "__seed", "__slice"))
        inside = rn[0] <= end <= rn[-1]
        values = [v for n, v in zip(rn, dx, strict=True) if n > end and v is not None]
        run_ = _run(values, 1.0 / period, seed if inside else 0.0, None)
        last = run_[-1] if run_ else (seed if inside else 0.0)
        before = rn[-1] < end
        return _slice_row(table, part, [0.0 if inside or before else (1.0 - 1.0 / period) ** len(values)], [None if before else last])

    return run


def _dx_values(names: list[str], period: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        end, seed, start = (table.column(c)[0].as_py() for c in ("__end", "__seed", "__start"))
        last, out = start[0] if start else None, []
        for n, v in zip(table.column("rn").to_pylist(), table.column("dx").to_pylist(), strict=True):
            if end is not None and n == end:
                last = seed
            elif end is not None and n > end and v is not None:
                last = last + (v - last) / period
            out.append(last)
        return table.select(names).append_column("adx", pa.array(out, pa.float64()))

    return run


def _levels(table: pa.Table) -> pa.Table:
    table = table.sort_by("open_time")
    above, below = nearest_levels(*(table.column(c).to_pylist() for c in ("high", "low", "close")))
    return table.select([*SERIES, "open_time"]).append_column("resistance_pct", pa.array(above, pa.float64())).append_column("support_pct", pa.array(below, pa.float64()))


def _types(df: DataFrame, names: list[str]) -> Iterator[str]:
    kinds = dict(df.dtypes)
    return (f"{c} {kinds[c]}" for c in names)


def sliced_indicators(bars: DataFrame, periods: dict[str, int] | None = None, wilder: int = 14, slice_rows: int = SLICE_ROWS, levels: bool = True) -> DataFrame:
    """bars with rn and the columns of ``indicator_frame``, within rounding, without a series in one
    task: symbol, tf, open_time, high, low and close are given, open_time once in a series.  The levels
    (``levels``) look back over all swings of a series: their three columns are one task a series."""
    used, names = INDICATORS | (periods or {}), bars.columns
    filters = _filters(used, wilder)
    if slice_rows <= max(*(f[2] for f in filters), 2 * wilder) + 2:
        raise ValueError("a slice must hold the seeds of all averages")
    rows = settled(running(bars.withColumn("rn", F.lit(1).cast("long")), list(SERIES), "open_time", [], sums=["rn"]), "numbered")
    part = F.floor((F.col("rn") - 1) / slice_rows)
    cut = rows.withColumn("__slice", part).unionByName(rows.where(F.col("rn") % slice_rows == 0).withColumn("__slice", part + 1))
    whole = rows.select(*SERIES, part.alias("__slice")).distinct()
    cut = cut.join(whole, [*SERIES, "__slice"], "left_semi")  # no slice of context alone
    keys, per = ", ".join(f"{c} string" for c in SERIES), [*SERIES, "__slice"]
    maps = cut.groupBy(*per).applyInArrow(_maps(filters), f"{keys}, __slice long, a array<double>, b array<double>")
    starts = maps.groupBy(*SERIES).applyInArrow(_composed, f"{keys}, __slice long, __start array<double>")
    schema = ", ".join([*_types(bars, names), "rn long", "__slice long", *(f"{c} double" for c in _MADE)])
    made = settled(cut.join(starts, per).groupBy(*per).applyInArrow(_values(names, filters), schema), "averages")
    first = made.where("dx is not null").groupBy(*SERIES).agg((F.min("rn") + wilder - 1).alias("__end"))
    block = made.join(first, [*SERIES]).where((F.col("rn") <= F.col("__end")) & (F.col("rn") > F.col("__end") - wilder))
    seeds = settled(block.groupBy(*SERIES, "__end").agg(F.count("dx").alias("n"), F.avg("dx").alias("__seed")).where(F.col("n") == wilder).drop("n"), "seeds")
    seeded = made.join(seeds, [*SERIES], "left")
    dx_maps = seeded.where("__end is not null").groupBy(*per).applyInArrow(_dx_map(wilder), f"{keys}, __slice long, a array<double>, b array<double>")
    dx_starts = dx_maps.groupBy(*SERIES).applyInArrow(_composed, f"{keys}, __slice long, __start array<double>")
    kept = [*names, "rn", *[c for c in _MADE if c != "dx"]]
    out = seeded.join(dx_starts, per, "left").groupBy(*per).applyInArrow(_dx_values(kept, wilder), ", ".join([*_types(made, kept), "adx double"]))
    if levels:
        narrow = rows.select(*SERIES, "open_time", "high", "low", "close")
        found = narrow.groupBy(*SERIES).applyInArrow(_levels, ", ".join([*_types(bars, [*SERIES, "open_time"]), "resistance_pct double", "support_pct double"]))
        out = out.join(found, [*SERIES, "open_time"])
    order = [*names, "rn", "ema_fast", "ema_slow", "ema_trend", "atr", "rsi", "adx", "plus_di", "minus_di", *(["resistance_pct", "support_pct"] if levels else [])]
    return out.select(*order)
