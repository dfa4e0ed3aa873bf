"""Streams in several batches, with late and unordered rows, against their batch forms."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barcraft.operators import asof, simulate
from barcraft.streaming import joins, open_trades, streams
from tests.conftest import rows_of

COSTS = simulate.Costs()
START = datetime(2024, 3, 4)
BAR = "symbol string, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double"
TRADE = "symbol string, trade_id long, run_id string, as_of timestamp_ntz, opened_at timestamp_ntz, direction string, entry_mid double, sl_price double, tp_price double"


def market(seed, n=120):
    """Bars with gaps of two symbols, and trades inside and on bars, each a list by time."""
    rng = random.Random(seed)
    bars, trades = [], []
    for s in ("X", "Y"):
        price, t = 100.0, START
        for i in range(n):
            t += timedelta(minutes=15 * rng.choice([1, 1, 1, 1, 5]))
            o, price = price, price + rng.gauss(0, 1)
            bars.append((s, t, t + timedelta(minutes=15), o, max(o, price) + rng.random(), min(o, price) - rng.random(), price))
            if rng.random() < 0.6:
                at, buy, wide = t + timedelta(minutes=15 + rng.choice([0, 0, 5]), microseconds=rng.choice([0, 1])), rng.random() < 0.5, rng.choice([0.5, 2.0, 50.0])
                sign = 1 if buy else -1
                trades.append((s, 2**60 + i * 2 + (s == "Y"), rng.choice(["a", None]), t, at, "BUY" if buy else "SELL", price, price - sign * wide, price + sign * wide * 1.5))
    return bars, trades


def files(spark, rows, schema, time, path, parts, seed):
    """Rows in files by time, unordered within a file and a little across; the last moves the clock."""
    rng = random.Random(seed)
    at = schema.split(", ").index(f"{time} timestamp_ntz")
    rows = sorted(rows, key=lambda r: (r[at] + timedelta(minutes=rng.random() * 20), rng.random()))
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    empty = spark.createDataFrame([], schema)
    open_trades.with_clock(empty, time).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)


def state_rows(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint").count()


@pytest.mark.parametrize(("parts", "lanes"), [(1, 1), (4, 3)])
def test_open_trades_stream_equals_batch(spark, tmp_path, parts, lanes):
    """Outcomes do not depend on how bars and entries arrive, and at the end the state is empty."""
    bars, trades = market(parts)
    want = rows_of(simulate.reconcile(spark.createDataFrame(trades, TRADE), spark.createDataFrame(bars, BAR), 12, COSTS))
    twice = trades + trades[:5]
    stream = open_trades.open_trade_stream(
        files(spark, bars, BAR, "close_time", f"{tmp_path}/bars", parts, 1), files(spark, twice, TRADE, "opened_at", f"{tmp_path}/trades", parts, 2), 12, COSTS, delay_minutes=40, lanes=lanes
    )
    got = streams.run_available(stream, f"file://{tmp_path}/run", **streams.STATE_STORE)
    assert rows_of(got) == want
    assert {r.status for r in got.select("status").distinct().collect()} == {"open", "closed", "expired"}
    with streams.settings(spark, **streams.STATE_STORE):
        assert [state_rows(spark, f"file://{tmp_path}/run", v) for v in ("bars", "trades", "passed")] == [0, 0, 0]


def test_open_trades_end_by_their_lifetime(spark, tmp_path):
    """A trade whose symbol gets no more bars comes out as open once others moved the clock on."""
    bars, _ = market(7, 30)
    bars = [b for b in bars if b[0] == "X"]
    trades = [("X", 1, "a", START, START, "BUY", 100.0, 1.0, 1000.0), ("quiet", 2, "a", START, START, "BUY", 100.0, 90.0, 110.0), ("quiet", 3, "a", START, START + timedelta(days=40), "SELL", 100.0, 110.0, 90.0)]
    stream = open_trades.open_trade_stream(files(spark, bars, BAR, "close_time", f"{tmp_path}/bars", 1, 1), files(spark, trades, TRADE, "opened_at", f"{tmp_path}/trades", 3, 2), 12, COSTS, lifetime_days=2)
    got = streams.run_available(stream, f"file://{tmp_path}/run", **streams.STATE_STORE).select("trade_id", "status")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "expired"), (2, "open"), (3, "open")]


def test_blackout_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    instants = [("X" if rng.random() < 0.5 else "Y", START + timedelta(minutes=7 * i)) for i in range(200)]
    events = [(f"e{i}", rng.choice(["high", "medium", "low"]), START + timedelta(minutes=rng.randrange(1400))) for i in range(14)] + [("tie", "high", START + timedelta(minutes=100)), ("also", "high", START + timedelta(minutes=100))]
    si, se = "symbol string, as_of timestamp_ntz", "label string, impact string, scheduled_at timestamp_ntz"
    want = rows_of(asof.blackout(spark.createDataFrame(instants, si), spark.createDataFrame(events, se), 90, 20, ("high", "medium")).select("symbol", "as_of", "event", "event_at"))
    a, e = files(spark, instants, si, "as_of", f"{tmp_path}/i", 3, 1), files(spark, events, se, "scheduled_at", f"{tmp_path}/e", 2, 2)
    assert rows_of(streams.run_available(joins.blackout_stream(a, e, 90, 20, ("high", "medium"), delay_minutes=40))) == want


@pytest.mark.parametrize("lanes", [1, 3])
def test_quote_stream_equals_asof_join(spark, tmp_path, lanes):
    rng = random.Random(4)
    at = lambda: START + timedelta(minutes=rng.randrange(2000))
    events = [(rng.choice("XYZ"), 2**60 + i, at(), rng.random()) for i in range(150)]
    quotes = list({(s, t): (s, t, rng.random()) for s, t in ((rng.choice("XY"), at()) for _ in range(80))}.values())
    se, sq = "symbol string, event_id long, ts timestamp_ntz, value double", "symbol string, time timestamp_ntz, price double"
    q = spark.createDataFrame(quotes, sq).withColumn("quote_time", F.col("time")).withColumnRenamed("price", "quote")
    want = rows_of(asof.asof_join(spark.createDataFrame(events, se), q, "ts", "time", ["symbol"]).select("symbol", "event_id", "value", "quote_time", "quote"))
    stream = joins.quote_stream(files(spark, events, se, "ts", f"{tmp_path}/e", 4, 1), files(spark, quotes, sq, "time", f"{tmp_path}/q", 3, 2), delay_minutes=40, lanes=lanes)
    assert rows_of(streams.run_available(stream, f"file://{tmp_path}/run", **streams.STATE_STORE)) == want
    with streams.settings(spark, **streams.STATE_STORE):
        assert state_rows(spark, f"file://{tmp_path}/run", "events") == 0 and state_rows(spark, f"file://{tmp_path}/run", "quotes") == 0


def test_ledger_batch_adds_null_keys_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b")], "k long, v string")
    write = streams.ledger_batch(f"{tmp_path}/ledger", ["k"])
    write(rows, 0)
    write(rows, 0)
    assert rows_of(spark.read.parquet(f"{tmp_path}/ledger")) == rows_of(rows.distinct())


def test_settings_come_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with streams.settings(spark, **{key: "x", "spark.barcraft.test": "y"}):
        assert spark.conf.get(key) == "x"
    assert spark.conf.get(key, None) == before and spark.conf.get("spark.barcraft.test", None) is None


def test_transient_failures_are_tried_again(spark):
    calls, waits = [], []

    def step(batch, epoch):
        calls.append(epoch)
        if len(calls) < 3:
            raise TimeoutError("later")

    streams.retried(step, (TimeoutError,), 3, 2.0, waits.append)(None, 7)
    assert calls == [7, 7, 7] and waits == [2.0, 4.0]
    calls.clear()
    with pytest.raises(TimeoutError):
        streams.retried(step, (TimeoutError,), 2, 0.0, waits.append)(None, 8)
    with pytest.raises(ZeroDivisionError):
        streams.retried(lambda b, e: 1 / 0, (TimeoutError,), 3, 0.0, waits.append)(None, 9)
    with pytest.raises(ValueError):
        streams.retried(step, (), 0)


def test_catching_up_by_the_ledger(spark, tmp_path):
    """The newest bar is judged online, those before it in replay, none twice, only so many back."""
    bars = spark.createDataFrame([(s, START + timedelta(minutes=15 * i)) for s in ("X", None) for i in range(30)], "symbol string, as_of timestamp_ntz")
    at = lambda i: START + timedelta(minutes=15 * i)
    path = f"{tmp_path}/ledger"
    step = streams.catch_up_batch(path, lambda df: df.withColumn("ok", F.minute("as_of") > 0), max_backfill=4)
    seen = lambda: {(r.symbol, (r.as_of - START) // timedelta(minutes=15), r.mode, r.ok) for r in spark.read.parquet(path).collect()}
    first, second = bars.where(F.col("as_of") <= F.lit(at(9))), bars.where(F.col("as_of") <= F.lit(at(12)))
    rows = lambda lo, hi: {(s, i, "online" if i == hi else "replay", i % 4 > 0) for s in ("X", None) for i in range(lo, hi + 1)}
    step(first, 0)
    assert seen() == rows(6, 9)
    step(first, 0)
    assert seen() == rows(6, 9)
    step(second.unionByName(second), 1)
    assert seen() == rows(6, 9) | rows(10, 12) and spark.read.parquet(path).count() == 14
    step(bars, 2)
    assert seen() == rows(6, 9) | rows(10, 12) | rows(26, 29)
