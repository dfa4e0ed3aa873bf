"""Indicators, calendars, validation and as-of joins on small cases with known answers."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barcraft.functions.market_calendar import CALENDARS, any_open, calendar_for
from barcraft.operators import asof, features, indicators, validate

BAR = "symbol string, tf string, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double, volume double"


def make_bars(spark, closes, tf="15min", start=datetime(2024, 1, 3), skip=(), wick=0.5, symbol="X"):
    step = timedelta(minutes={"15min": 15, "1h": 60, "1day": 1440}[tf])
    rows = [(symbol, tf, start + i * step, start + (i + 1) * step, c, c + wick, c - wick, c, 1.0) for i, c in enumerate(closes) if i not in skip]
    return spark.createDataFrame(rows, BAR)


def test_ema_of_a_constant_is_the_constant():
    out = indicators.ema([5.0] * 20, 10)
    assert out[:9] == [None] * 9 and out[9:] == [5.0] * 11


def test_sma(spark):
    b = make_bars(spark, [float(i) for i in range(1, 11)])
    got = [r["s"] for r in b.select("open_time", indicators.sma("close", 5).alias("s")).orderBy("open_time").collect()]
    assert got[:4] == [None] * 4 and got[4] == 3.0 and got[-1] == 8.0


def test_atr_of_a_constant_range():
    assert indicators.rma(indicators.true_ranges([11.0] * 20, [9.0] * 20, [10.0] * 20), 14)[-1] == 2.0


def test_rsi_without_losses_is_100_and_starts_at_the_period():
    out = indicators.rsi([1.0] * 20)
    assert out[13] is None and out[14] == 100.0
    assert indicators.rsi([]) == []


def test_adx_starts_late_and_a_flat_series_has_none():
    up = [float(i) for i in range(60)]
    adx, plus, minus = indicators.adx([x + 1 for x in up], [x - 1 for x in up], up)
    assert adx[25] is None and adx[26] is not None and plus[20] > minus[20]
    flat, _, _ = indicators.adx([1.0] * 40, [1.0] * 40, [1.0] * 40)
    assert set(flat) == {None}


def test_wilder_average_skips_leading_nulls_and_a_null_in_the_seed_spoils():
    assert indicators.rma([None, 2.0, 4.0, None], 2) == [None, None, 3.0, 3.0]
    assert indicators.rma([2.0, None, 4.0, 6.0], 2) == [None] * 4


def test_ema_agrees_with_pandas():
    import numpy as np

    x = np.random.default_rng(42).normal(size=400).cumsum() + 100
    ours = indicators.ema(list(x), 21)
    seeded = pd.Series([x[:21].mean(), *x[21:]]).ewm(span=21, adjust=False).mean()
    assert ours[-1] == pytest.approx(seeded.iloc[-1], rel=1e-9)


def test_nearest_levels_wait_for_confirmation():
    high = [1.0, 2.0, 9.0, 2.0, 1.0, 1.0]
    low = [x - 0.5 for x in high]
    above, below = indicators.nearest_levels(high, low, [1.0] * 6)
    assert above[:4] == [None] * 4 and above[4] == pytest.approx(800.0)
    assert below[4] is None


def test_prefix_gives_the_same_features(spark):
    closes = [100 + (i * 37 % 23) / 3 + i / 10 for i in range(90)]
    full = indicators.indicator_frame(make_bars(spark, closes), {"ema_fast": 3, "ema_slow": 5, "ema_trend": 8}, 4)
    part = indicators.indicator_frame(make_bars(spark, closes[:60]), {"ema_fast": 3, "ema_slow": 5, "ema_trend": 8}, 4)
    assert full.where("rn <= 60").orderBy("rn").collect() == part.orderBy("rn").collect()


OPEN = [("2026-07-01 12:00:00", True), ("2026-07-04 12:00:00", False), ("2026-07-05 20:00:00", False), ("2026-07-05 22:00:00", True), ("2026-07-01 21:00:00", False), ("2026-01-07 22:00:00", False), ("2026-07-03 18:30:00", False), ("2026-07-03 17:30:00", True)]


@pytest.mark.parametrize(("at", "is_open"), OPEN)
def test_session_instants(spark, at, is_open):
    row = spark.range(1).select(CALENDARS["polygon"].is_open(F.lit(at).cast("timestamp_ntz")).alias("x"), F.expr(CALENDARS["polygon"].is_open_sql(f"timestamp_ntz'{at}'")).alias("y")).first()
    assert (row["x"], row["y"]) == (is_open, is_open)


def test_unknown_provider_raises():
    with pytest.raises(ValueError, match="no calendar"):
        calendar_for("elsewhere")


def test_gap_over_a_weekend_is_expected(spark):
    g = spark.createDataFrame([("2026-07-10 21:00:00", "2026-07-12 21:00:00"), ("2026-07-08 12:00:00", "2026-07-08 12:15:00")], "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("after"), F.col("b").cast("timestamp_ntz").alias("before"))
    assert [r[0] for r in g.orderBy("after").select(any_open(CALENDARS["polygon"], "after", "before", 15)).collect()] == [True, False]


def test_gaps_and_errors(spark):
    b = make_bars(spark, [1.0] * 10, skip=(4, 5))
    gap = validate.gaps(b).first()
    assert gap["missing_bars"] == 2
    bad = b.withColumn("idx", F.row_number().over(indicators.ordered())).withColumn("close_time", F.when(F.col("idx") == 3, F.col("close_time") - F.expr("interval 5 minutes")).otherwise(F.col("close_time")))
    assert validate.series_errors(bad).first()["error"] == "wrong_duration"


def test_row_violations_of_nan_and_null(spark):
    rows = [("a", datetime(2024, 1, 1), datetime(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 1.0), ("b", datetime(2024, 1, 1), datetime(2024, 1, 2), float("nan"), 2.0, 0.5, 1.5, None)]
    df = spark.createDataFrame(rows, "id string, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double, volume double")
    got = {r["id"]: r["v"] for r in df.select("id", validate.row_violations().alias("v")).collect()}
    assert got["a"] == [] and got["b"][:2] == ["price_not_positive", "bad_volume"]


def test_recent_gap_before_the_window_is_not_seen(spark):
    b = make_bars(spark, [1.0] * 12, start=datetime(2026, 7, 8, 12), skip=(3,))
    got = [r["recent_gap"] for r in validate.recent_unexpected(b, CALENDARS["polygon"], {"15min": 4}).orderBy("open_time").collect()]
    assert got == [False] * 3 + [True] * 3 + [False] * 5


def test_asof_join_never_looks_ahead(spark):
    left = spark.createDataFrame([("X", 1), ("X", 5), ("X", 9), ("Y", 3)], "symbol string, t int")
    right = spark.createDataFrame([("X", 5, "a"), ("X", 8, "b"), ("Z", 1, "c")], "symbol string, rt int, v string")
    got = {(r["symbol"], r["t"]): r["v"] for r in asof.asof_join(left, right, "t", "rt", ["symbol"]).collect()}
    assert got == {("X", 1): None, ("X", 5): "a", ("X", 9): "b", ("Y", 3): None}


def test_news_revisions_as_of(spark):
    rows = [("s", "1", 0, datetime(2026, 1, 1, 8), datetime(2026, 1, 1, 9)), ("s", "1", 1, datetime(2026, 1, 1, 10), datetime(2026, 1, 1, 13))]
    n = spark.createDataFrame(rows, "source string, external_id string, revision int, publication_time timestamp_ntz, ingestion_time timestamp_ntz")
    assert [asof.latest_revisions(n, f"2026-01-01 {h}:00:00").first()["revision"] for h in (12, 14)] == [0, 1]


def test_blackout_is_inclusive_and_takes_the_first(spark):
    e = spark.createDataFrame([("B", "high", datetime(2026, 1, 1, 13)), ("A", "high", datetime(2026, 1, 1, 12, 30)), ("L", "low", datetime(2026, 1, 1, 11))], "label string, impact string, scheduled_at timestamp_ntz")
    i = spark.createDataFrame([(datetime(2026, 1, 1, 11, 30),), (datetime(2026, 1, 1, 13, 30),), (datetime(2026, 1, 1, 13, 31),)], "as_of timestamp_ntz")
    assert [r["event"] for r in asof.blackout(i, e, 60, 30).orderBy("as_of").collect()] == ["A", "B", None]


def test_sma_keeps_five_decimals(spark):
    closes = [1.08345, 1.08346, 1.08347, 1.08349, 1.08350]
    got = make_bars(spark, closes, wick=0.0).select(indicators.sma("close", 5).alias("s")).where("s is not null").first()["s"]
    assert got == pytest.approx(sum(closes) / 5, abs=1e-12)


def test_dataset_id_follows_every_digit_and_says_what_it_holds(spark):
    closes = [1.08345, 1.08346, 1.08347]
    one = make_bars(spark, closes, wick=0.0)
    row = features.dataset_id(one, "polygon", "C:EURUSD").first()
    assert len(row["dataset_id"]) == 16 and row["sha256"].startswith(row["dataset_id"])
    assert (row["timeframes"], row["bar_counts"], row["first_bar"], row["last_bar"]) == (["15min"], ["15min:3"], datetime(2024, 1, 3), datetime(2024, 1, 3, 0, 30))
    other = lambda *a, **k: features.dataset_id(*a, **k).first()["dataset_id"]
    assert row["dataset_id"] == other(one.repartition(3), "polygon", "C:EURUSD")
    assert row["dataset_id"] != other(make_bars(spark, [1.08345, 1.08346, 1.08348], wick=0.0), "polygon", "C:EURUSD")
    assert row["dataset_id"] != other(one, "csv", "C:EURUSD") != other(one, "polygon", "EURUSD")


def test_dataset_id_is_the_hash_of_hashes(spark):
    from hashlib import sha256

    b = make_bars(spark, [1.5, 2.25, 0.1], tf="1day", start=datetime(2024, 1, 30), wick=0.0)
    texts = {"2024-01": "2024-01-30T00:00:00.000000,1.5,1.5,1.5,1.5,1.0;2024-01-31T00:00:00.000000,2.25,2.25,2.25,2.25,1.0;", "2024-02": "2024-02-01T00:00:00.000000,0.1,0.1,0.1,0.1,1.0;"}
    months = "".join(sha256(texts[m].encode()).hexdigest() for m in sorted(texts))
    want = sha256(f"p|X|X|1day|{sha256(months.encode()).hexdigest()}".encode()).hexdigest()
    assert features.dataset_id(b, "p").first()["sha256"] == want


def test_decision_input_hash_is_that_of_sorted_compact_json(spark):
    import json
    from hashlib import sha256

    p = spark.createDataFrame([("X", datetime(2024, 1, 3, 12), 1.25, "range", "up", "bull_trend", "mixed", None, "up", 31.5, "choppy", "down", 12.0, "bull_trend", "up", 27.0, "range")], "symbol string, as_of timestamp_ntz, price double, structure_regime string, macro_align string, trend_regime string, confluence string, spread_pct double, structure_align string, structure_adx double, trigger_regime string, macro_regime_align string, macro_adx double, macro_regime string, trend_align string, trend_adx double, unused string")
    row = features.canonical_hash(features.decision_input(p, "replay")).first()
    made = {"symbol": "X", "as_of": "2024-01-03T12:00:00.000", "mode": "replay", "price": 1.25, "regime_h1": "range", "macro_bias": "up", "major_trend": "bull_trend", "confluence": "mixed", "spread_pct": None, "spread_provenance": "unavailable",
            "timeframes": {"1day": {"regime": "bull_trend", "ema_align": "up", "adx": 12.0}, "4h": {"regime": "bull_trend", "ema_align": "up", "adx": 27.0}, "1h": {"regime": "range", "ema_align": "up", "adx": 31.5}, "15min": {"regime": "choppy"}}}
    assert row["input_hash"] == sha256(json.dumps(made, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_decision_input_hash_query_equals_a_plain_hash_of_its_rows(spark, sf_dir):
    import json
    from hashlib import sha256

    from barcraft.plans import series

    given = features.decision_input(series.packets(spark, sf_dir).withColumn("spread_pct", F.lit(0.05)), "replay")
    names = given.columns
    texts = {(r["symbol"], r["as_of"]): r["j"] for r in given.select("symbol", "as_of", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("j")).collect()}
    got = {(r["symbol"], r["as_of"]): r["input_hash"] for r in series.decision_input_hash(spark, sf_dir).collect()}
    assert got and got == {k: sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")).encode()).hexdigest() for k, t in texts.items()}


NEWS = "source string, external_id string, revision int, publication_time timestamp_ntz, ingestion_time timestamp_ntz, headline string, impact string, sentiment_for_gold double"


def news(spark):
    at = lambda h, s=0, us=0: datetime(2026, 1, 1, h, 0, s, us)
    rows = [("s", "1", 0, at(8), at(9), "a", "low", 0.0), ("s", "1", 1, at(10), at(10), "a2", "high", -0.5), ("s", "2", 0, at(9, 5, 250), at(9), "b", "low", 0.0), ("s", "3", 0, at(11), at(11), "c", "low", 0.0), ("s", "4", 0, at(20), at(20), "late", "low", 0.0)]
    return spark.createDataFrame(rows, NEWS)


def test_news_digest(spark):
    got = {r["id"]: r for r in asof.news_digest(asof.latest_revisions(news(spark), "2026-01-01 12:00:00")).collect()}
    assert set(got) == {"s:1", "s:2", "s:3"} and (got["s:1"]["revision"], got["s:1"]["time"], got["s:1"]["sentiment_for_gold"]) == (1, "2026-01-01T10:00:00+00:00", -0.5)
    assert got["s:2"]["time"] == "2026-01-01T09:00:05.000250+00:00"


def test_static_news_takes_the_oldest_of_the_view(spark):
    got = [r["external_id"] for r in asof.static_news(news(spark), 2, ["source", "external_id"], "2026-01-01 12:00:00").orderBy("publication_time").collect()]
    assert got == ["2", "1"]
    assert asof.static_news(news(spark), 0, ["source", "external_id"]).count() == 5
    assert [r["external_id"] for r in asof.static_news(news(spark), 1, ["source", "external_id"]).collect()] == ["4"]


def test_minutes_until_round_half_to_even(spark):
    e = spark.createDataFrame([("A", "high", datetime(2026, 1, 1, 12, 2, 30)), ("B", "high", datetime(2026, 1, 1, 12, 3, 30))], "label string, impact string, scheduled_at timestamp_ntz")
    i = spark.createDataFrame([(datetime(2026, 1, 1, 12),)], "as_of timestamp_ntz")
    assert [(r["event"], r["in_minutes"]) for r in asof.event_digest(asof.upcoming(i, e, 60)).orderBy("event").collect()] == [("A", 2), ("B", 4)]
