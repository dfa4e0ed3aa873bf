"""Indicators in slices against one pass over the whole series."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barcraft.operators.indicators import indicator_frame
from barcraft.operators.recurrences import sliced_indicators

START = datetime(2020, 1, 1)
SCHEMA = "symbol string, tf string, open_time timestamp_ntz, high double, low double, close double, note string"


def series(symbol, n, seed, flat=()):
    """A walk; in the ``flat`` stretches nothing moves, so that DX is null there."""
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        still = any(a <= i < b for a, b in flat)
        price += 0 if still else rng.gauss(0, 1)
        wide = 0 if still else rng.random()
        out.append((symbol, "15min", START + timedelta(minutes=15 * i), price + wide, price - wide, price, f"{symbol}{i}"))
    return out


def table(df):
    return {(r.symbol, r.open_time): r for r in df.collect()}


def same(got, want, columns):
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c in columns:
            a, b = got[k][c], w[c]
            assert (a is None) == (b is None), (k, c, a, b)
            if isinstance(b, float):
                assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (k, c, a, b)
            else:
                assert a == b, (k, c)


@pytest.mark.parametrize("slice_rows", [40, 64, 500, 10**6])
def test_slices_equal_one_pass(spark, slice_rows):
    """Series of several lengths, with stretches in which averages have nothing to go on."""
    rows = series("a", 1000, 1) + series("b", 700, 2, [(0, 130)]) + series("c", 400, 3, [(0, 20), (25, 32)]) + series("d", 320, 4, [(100, 210)])
    rows += series("e", 40, 5) + series("f", 41, 6) + series("g", 3, 7) + series("h", 80, 8) + series("i", 200, 9, [(0, 200)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    periods = {"ema_fast": 5, "ema_slow": 12, "ema_trend": 30}
    got, want = sliced_indicators(df, periods, 7, slice_rows), indicator_frame(df, periods, 7)
    assert sorted(got.columns) == sorted(want.columns)
    same(table(got), table(want), want.columns)


def test_a_slice_must_hold_the_seeds(spark):
    with pytest.raises(ValueError):
        sliced_indicators(spark.createDataFrame(series("a", 10, 1), SCHEMA), slice_rows=200)


def test_a_long_series(spark):
    """A hundred thousand bars in slices: the averages that matter stay within 1e-9."""
    rng = np.random.default_rng(11)
    n = 100_000
    close = 1000 + np.cumsum(rng.normal(size=n)) / 10
    frame = pd.DataFrame({"symbol": "x", "tf": "15min", "i": np.arange(n), "high": close + rng.random(n), "low": close - rng.random(n), "close": close})
    df = spark.createDataFrame(frame).withColumn("open_time", F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, cast(i * 15 as int))")).drop("i")
    got = sliced_indicators(df, slice_rows=7000, levels=False).toPandas().sort_values("rn")
    want = indicator_frame(df).toPandas().sort_values("rn")
    for c in ("ema_fast", "ema_slow", "ema_trend", "atr", "rsi", "adx", "plus_di", "minus_di"):
        a, b = got[c].to_numpy(), want[c].to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all() and np.nanmax(np.abs(a - b)) < 1e-9
