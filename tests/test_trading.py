"""Decisions, simulation, metrics and ledgers on small cases with known answers."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barcraft.functions.market_calendar import CALENDARS
from barcraft.functions.numeric import round_to
from barcraft.operators import decide, ledger, lookup, metrics, simulate
from barcraft.streaming import streams
from tests.test_series import BAR, make_bars

T0 = datetime(2026, 7, 8, 12)
FREE = simulate.Costs(spread_pct=0.0, slippage_pct=0.0, commission_pct=0.0, swap_long_pct=0.0, swap_short_pct=0.0)


def trade(spark, direction="BUY", opened=T0):
    entry = spark.createDataFrame([("X", 1, opened, direction, 4000.0, 0.3, 0.6)], "symbol string, trade_id long, opened_at timestamp_ntz, direction string, entry_ref double, sl_pct double, tp_pct double")
    return simulate.open_trades(entry, FREE).select("symbol", "trade_id", "opened_at", "direction", "entry_mid", "sl_price", "tp_price")


def bar_rows(spark, rows, start=T0):
    step = timedelta(minutes=15)
    return spark.createDataFrame([("X", "15min", start + i * step, start + (i + 1) * step, o, h, lo, c, 1.0) for i, (o, h, lo, c) in enumerate(rows)], BAR)


def outcome(spark, rows, costs=FREE, timeout=96, direction="BUY", opened=T0):
    return simulate.reconcile(trade(spark, direction, opened), bar_rows(spark, rows), timeout, costs).first()


def test_stop_and_target_prices(spark):
    t = trade(spark).first()
    assert (t["sl_price"], t["tp_price"]) == (3988.0, 4024.0)


QUIET = (4000.0, 4001.0, 3999.0, 4000.0)


def test_first_touch(spark):
    spread = simulate.Costs(spread_pct=0.03, slippage_pct=0.0, commission_pct=0.0, swap_long_pct=0.0, swap_short_pct=0.0)
    up = outcome(spark, [QUIET, (4000.0, 4030.0, 3999.0, 4020.0)], spread)
    assert (up["exit_reason"], up["r_multiple"]) == ("tp_hit", 1.9)
    down = outcome(spark, [QUIET, (4000.0, 4001.0, 3980.0, 3990.0)], spread)
    assert (down["exit_reason"], down["r_multiple"]) == ("sl_hit", -1.1)
    both = outcome(spark, [(4000.0, 4030.0, 3980.0, 4000.0)], spread)
    assert both["ambiguous"] and (both["r_pessimistic"], both["r_optimistic"]) == (-1.1, 1.9)
    assert outcome(spark, [QUIET] * 3)["status"] == "open"
    late = outcome(spark, [QUIET] * 4, timeout=4)
    assert (late["status"], late["exit_reason"]) == ("expired", "timeout")


def test_gap_through_the_stop_fills_at_the_open(spark):
    assert outcome(spark, [QUIET, (3900.0, 3950.0, 3890.0, 3900.0)])["exit_price"] == 3900.0


def test_partial_entry_bar_counts_only_the_stop(spark):
    inside = T0 + timedelta(minutes=5)
    assert outcome(spark, [(4000.0, 4030.0, 3999.0, 4000.0)], opened=inside)["status"] == "open"
    hit = outcome(spark, [(3980.0, 4030.0, 3970.0, 4000.0)], opened=inside)
    assert (hit["exit_reason"], hit["exit_price"]) == ("sl_hit", 3988.0)


def test_bars_up_to_the_decision_do_not_count(spark):
    before = bar_rows(spark, [(4000.0, 9000.0, 1.0, 4000.0)], T0 - timedelta(minutes=15))
    assert simulate.reconcile(trade(spark), before, 96, FREE).first()["status"] == "open"


@pytest.mark.parametrize(("opened", "closed", "nights"), [("2026-07-07 12:00:00", "2026-07-07 15:00:00", 0.0), ("2026-07-06 12:00:00", "2026-07-07 12:00:00", 1.0), ("2026-07-08 12:00:00", "2026-07-09 12:00:00", 3.0), ("2026-07-10 12:00:00", "2026-07-13 12:00:00", 1.0), ("2026-07-07 12:00:00", "2026-07-07 12:00:00", 0.0)])
def test_rollover_nights(spark, opened, closed, nights):
    df = spark.createDataFrame([(opened, closed)], "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("o"), F.col("b").cast("timestamp_ntz").alias("c"))
    assert df.select(simulate.rollover_nights("o", "c", simulate.Costs())).first()[0] == nights


@pytest.mark.parametrize(("a", "b", "missed"), [("2026-07-08 12:00:00", "2026-07-08 13:00:00", 3), ("2026-07-08 12:00:00", "2026-07-08 12:15:00", 0), ("2026-07-10 21:00:00", "2026-07-12 21:15:00", 0)])
def test_missed_open_bars(spark, a, b, missed):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("p"), F.col("b").cast("timestamp_ntz").alias("c"))
    assert df.select(simulate.missed_open_bars("p", "c", CALENDARS["polygon"])).first()[0] == missed


def test_coverage_needs_the_entry_bar(spark):
    t = spark.createDataFrame([("X", 1, T0 + timedelta(minutes=20))], "symbol string, trade_id long, opened_at timestamp_ntz")
    full, holed = (make_bars(spark, [1.0] * 8, start=T0, skip=s) for s in ((), (1,)))
    now = str(T0 + timedelta(hours=2))
    assert [simulate.coverage(t, b, now, "15min", CALENDARS["polygon"]).first()["covered"] for b in (full, holed)] == [True, False]


OUT = "run_id string, symbol string, trade_id long, as_of timestamp_ntz, closed_at timestamp_ntz"


def gate_rows(spark):
    m = lambda k: T0 + timedelta(minutes=k)
    return spark.createDataFrame([("r", "X", 1, m(0), m(30)), ("r", "X", 2, m(15), m(20)), ("r", "X", 3, m(45), m(60)), ("r", "X", 4, m(75), None), ("r", "X", 5, m(600), m(700)), ("r", "Y", 6, m(0), m(5))], OUT)


def test_gate_admits_one_position_at_a_time(spark):
    got = {r["trade_id"]: r["admitted"] for r in simulate.position_gate(gate_rows(spark), 900, 1).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_gate_stream_equals_batch(spark, tmp_path):
    gate_rows(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OUT).parquet(str(tmp_path / "in"))
    got = {r["trade_id"]: r["admitted"] for r in streams.run_available(streams.gate_stream(stream, 900, 1)).collect()}
    assert got == {r["trade_id"]: r["admitted"] for r in simulate.position_gate(gate_rows(spark), 900, 1).collect()}


def test_ledger_sink_adds_a_batch_once(spark, tmp_path):
    sink, batch = streams.ledger_batch(str(tmp_path / "ledger"), ["k"]), spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def facts(spark, r, **columns):
    rows = [("x", i, None if v is None else int(v * 1000), "open" if v is None else "closed", False, None, None) for i, v in enumerate(r)]
    df = spark.createDataFrame(rows, "run_id string, i int, r_milli long, status string, ambiguous boolean, r_pess_milli long, r_opt_milli long")
    return df.withColumns({k: v for k, v in columns.items()})


@pytest.mark.parametrize(("r", "worst"), [([1.0, -0.5, -0.5, 1.0], 1.0), ([-1.0, -1.0], 2.0)])
def test_drawdown(spark, r, worst):
    assert metrics.max_drawdown(facts(spark, r), ["run_id"], ["i"]).first()["max_drawdown_r"] == worst


def dated(spark, n, seed=4, days=9):
    from random import Random

    rng = Random(seed)
    rows = [(rng.choice(["a", "b", None]), i, T0 + timedelta(hours=rng.randrange(24 * days)), rng.randrange(-3000, 3001) if rng.random() < 0.9 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "run_id string, i int, closed_at timestamp_ntz, r_milli long").repartition(5)


def test_drawdown_over_slices_equals_a_running_fold(spark):
    rows, df = dated(spark, 400)
    want = {}
    for run in ("a", "b", None):
        total = peak = worst = 0
        for _, _, _, r in sorted((r for r in rows if r[0] == run and r[3] is not None), key=lambda r: (r[2], r[1])):
            total += r
            peak = max(peak, total)
            worst = max(worst, peak - total)
        want[run] = worst / 1000
    got = {r["run_id"]: r["max_drawdown_r"] for r in metrics.max_drawdown(df, ["run_id"], ["closed_at", "i"]).collect()}
    assert got == want


def test_folds_over_slices_equal_places_in_order(spark):
    rows, df = dated(spark, 301)
    got = {r["i"]: r["fold"] for r in metrics.temporal_folds(df, ["run_id"], ["closed_at", "i"], 4).collect()}
    for run in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[1]))
        for at, r in enumerate(own):
            assert got[r[1]] == min(3, at // (len(own) // 4))
    assert len(got) == 301


def test_median_bar_length_is_the_upper_one(spark):
    b = make_bars(spark, [1.0] * 7, skip=(1, 3))  # distances 2, 2, 1 and 1 bars
    assert metrics.upper_median_seconds(b).first()["bar_seconds"] == 1800
    assert metrics.upper_median_seconds(make_bars(spark, [1.0])).first()["bar_seconds"] == 900


def test_feedback_knows_only_what_was_observed_before(spark):
    from random import Random

    rng = Random(3)
    at = lambda k: T0 + timedelta(minutes=k)
    rows = [(rng.choice("xy"), i, rng.choice(["open", "closed", "expired"]), rng.choice([None, *range(-900, 900, 7)]), rng.choice(["range", "bull_trend", None]), "BUY", "tp_hit", at(i), rng.choice([None, at(rng.randrange(60))])) for i in range(150)]
    t = spark.createDataFrame(rows, "run_id string, decision_id long, status string, r_milli long, regime string, direction string, exit_reason string, closed_at timestamp_ntz, observed_at timestamp_ntz").repartition(4)
    asked = spark.createDataFrame([(run, at(k)) for run in "xyz" for k in (0, 5, 30, 31, 90)], "run_id string, as_of timestamp_ntz")
    got = {(r["run_id"], r["as_of"]): r for r in metrics.feedback(t, asked, 3).collect()}
    assert len(got) == 15
    for (run, when), r in got.items():
        known = [x for x in rows if x[0] == run and x[2] != "open" and x[3] is not None and x[8] is not None and x[8] < when]
        newest = sorted(known, key=lambda x: (x[8], x[1]), reverse=True)[:3]
        assert [(x["r_multiple"], x["closed_at"]) for x in r["recent_trades"]] == [(x[3] / 1000, x[7]) for x in newest]
        groups = {}
        for x in known:
            groups.setdefault(x[4], []).append(x[3])
        order = sorted(groups, key=lambda g: (-len(groups[g]), g is None, g or ""))
        assert [(x["regime"], x["trades"]) for x in r["regime_performance"]] == [(g, len(groups[g])) for g in order]
        for x in r["regime_performance"]:
            assert x["win_rate"] == pytest.approx(sum(v > 0 for v in groups[x["regime"]]) / x["trades"], abs=6e-4)


def test_feedback_leaves_only_the_last_trades_to_the_sort_by_run(spark):
    """Trades are cut to k a run and instant before any of them meet in one task."""
    at = lambda k: T0 + timedelta(minutes=k)
    rows = [(None if i % 7 == 0 else "x", i, "closed", 100, "range", "BUY", "tp_hit", at(i), at(i % 40)) for i in range(400)]
    t = spark.createDataFrame(rows, "run_id string, decision_id long, status string, r_milli long, regime string, direction string, exit_reason string, closed_at timestamp_ntz, observed_at timestamp_ntz")
    asked = spark.createDataFrame([("x", at(20)), ("x", at(30)), (None, at(30))], "run_id string, as_of timestamp_ntz")
    out = metrics.feedback(t, asked, 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["run_id"], r["as_of"]): [x["closed_at"] for x in r["recent_trades"]] for r in out.collect()}
    for (run, when), closed in got.items():
        assert closed == [x[7] for x in sorted((x for x in rows if x[0] == run and x[8] < when), key=lambda x: (x[8], x[1]), reverse=True)[:3]]


def test_discrimination(spark):
    df = spark.createDataFrame([(60, -1000), (60, -1000), (90, 1000), (90, 1000)], "confidence_pct int, r_milli long")
    row = metrics.confidence_discrimination(df).first()
    assert (row["monotonic"], row["spread"]) == (True, 1.0)
    assert metrics.confidence_discrimination(df.where("confidence_pct = 60")).first()["monotonic"] is None


def test_folds_give_the_remainder_to_the_last(spark):
    f = metrics.temporal_folds(facts(spark, [1.0] * 11), ["run_id"], ["i"], 4)
    assert [r["count"] for r in f.groupBy("fold").count().orderBy("fold").collect()] == [2, 2, 2, 5]
    assert {r["fold"] for r in metrics.temporal_folds(facts(spark, [1.0] * 3), ["run_id"], ["i"], 4).collect()} == {0}


def test_summary_of_no_trades_has_counts_only(spark):
    row = metrics.summarize(facts(spark, [None, None]), ["run_id"]).first()
    assert (row["trades"], row["closed"], row["win_rate"], row["total_r"]) == (2, 0, None, None)


def test_bootstrap_repeats_and_blocks_widen():
    r = [1.0] * 20 + [-1.0] * 20
    assert metrics.bootstrap_means(r, 50).tolist() == metrics.bootstrap_means(r, 50).tolist()
    wide, narrow = metrics.bootstrap_means(r, 400, block=10), metrics.bootstrap_means(r, 400, block=1)
    assert wide[-20] - wide[20] > narrow[-20] - narrow[20]
    assert metrics.bootstrap_means([]).tolist() == []


@pytest.mark.parametrize("stop", [1, 2, 3, 7, 64, 1000, 65_537, 2**31 + 5])
def test_vectorised_draws_are_those_of_the_generator(stop):
    from random import Random

    import numpy as np

    rng = Random(77)
    assert np.concatenate(list(metrics._seeded_below(77, stop, 3000))).tolist() == [rng.randrange(stop) for _ in range(3000)]


def test_bootstrap_query_gives_the_reference_interval(spark, sf_dir):
    from itertools import groupby
    from random import Random

    from barcraft.plans import reports
    from barcraft.sources import adapters

    def interval(rs, iters=2000, alpha=0.05):
        n = len(rs)
        b = max(1, min(n, round(n ** (1 / 3))))
        rng, means = Random(12345), []
        for _ in range(iters):
            sample = []
            for _ in range(-(-n // b)):
                s = rng.randint(0, n - b)
                sample.extend(rs[s : s + b])
            means.append(sum(sample[:n]) / n)
        means.sort()
        return means[int((alpha / 2) * iters)], means[min(iters - 1, int((1 - alpha / 2) * iters))]

    rows = adapters.trade_facts(spark, sf_dir).where("r_milli is not null").orderBy("run_id", "regime", *reports.ORDER).collect()
    want = {k: interval([r["r_milli"] / 1000 for r in g]) for k, g in groupby(rows, lambda r: (r["run_id"], r["regime"]))}
    found = {(r["run_id"], r["regime"]): (r["low"], r["high"]) for r in reports.bootstrap_ci(spark, sf_dir).collect()}
    assert found.keys() == want.keys()
    for k, ends in want.items():
        assert found[k] == pytest.approx(ends, abs=1e-9)


def test_quarantined_trades_are_not_closed(spark):
    df = spark.createDataFrame([("x", "closed", 1500), ("x", "closed", -1000), ("x", "quarantined", None), ("x", "open", None)], "run_id string, status string, r_milli long").withColumn("ambiguous", F.lit(False))
    row = metrics.trade_metrics(df, ["run_id"]).first()
    assert (row["total"], row["closed"], row["wins"], row["quarantined"]) == (4, 2, 1, 1)


def test_first_failing_risk_gate_decides(spark):
    at = datetime(2026, 7, 8, 12)
    rows = [("NO_TRADE", 0.9, 0.01, at, 0.2), ("BUY", 0.5, 0.01, at, 0.2), ("BUY", 0.6, None, at, 0.2), ("BUY", 0.6, 0.01, datetime(2026, 7, 11, 12), 0.2), ("BUY", 0.6, 0.01, at, None), ("BUY", 0.6, 0.01, at, 0.01), ("BUY", 0.6, 0.2, at, 0.2), ("BUY", 0.6, 0.01, at, 0.2)]
    df = spark.createDataFrame(rows, "direction string, confidence double, spread_pct double, as_of timestamp_ntz, atr_pct double")
    got = [r["verdict"] for r in decide.risk(df, CALENDARS["polygon"]).collect()]
    assert got == ["no_trade", "low_confidence", "missing_spread", "market_closed", "no_atr", "sl_out_of_bounds", "spread_vs_sl", "approved"]


def test_policy_version_follows_the_policy():
    a, b = decide.EligibilityPolicy(), decide.EligibilityPolicy(max_feed_lag=60)
    assert len(a.version()) == 10 and a.version() == decide.EligibilityPolicy().version() != b.version()


def test_rounding_takes_the_double_as_it_is(spark):
    assert spark.range(1).select(round_to(F.lit(2.0235), 3)).first()[0] == 2.023


def test_reservation_leases(spark):
    s = lambda k: T0 + timedelta(seconds=k)
    rows = [("k", s(0), 1, "a", "reserve"), ("k", s(5), 2, "b", "reserve"), ("k", s(11), 3, "b", "reserve"), ("k", s(12), 4, "a", "complete"), ("k", s(13), 5, "b", "complete"), ("k", s(99), 6, "c", "reserve")]
    out = ledger.replay_reservations(spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq int, worker string, action string"), 10)
    assert [r["granted"] for r in out.orderBy("seq").collect()] == [True, False, True, False, True, False]


def test_refused_requests_spend_nothing(spark):
    rows = [("m", T0, 1, "r", 60), ("m", T0, 2, "r", 50), ("m", T0, 3, "r", 40)]
    out = ledger.budget_grants(spark.createDataFrame(rows, "month string, ts timestamp_ntz, seq int, run_id string, micro long"), 100, 1000, 1000)
    assert [r["granted"] for r in out.orderBy("seq").collect()] == [True, False, True]


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "q")], "id int, price double, quality string")
    new = spark.createDataFrame([(1, 9.0, "n"), (2, 9.0, "n"), (3, 3.0, None)], "id int, price double, quality string")
    once = ledger.upsert_snapshots(old, new, ["id"], "quality")
    assert {r["id"]: (r["price"], r["quality"], r["status"]) for r in once.collect()} == {1: (1.0, "n", "enriched"), 2: (2.0, "q", "unchanged"), 3: (3.0, None, "inserted")}
    again = ledger.upsert_snapshots(once.drop("status"), new, ["id"], "quality")
    assert {r["status"] for r in again.collect()} == {"unchanged"}


def test_archive_policy_fail_raises(spark):
    a, b = make_bars(spark, [1.0, 2.0]), make_bars(spark, [1.0, 3.0])
    with pytest.raises(ValueError, match="differ"):
        ledger.merge_archive(a, b, "fail")
    assert ledger.merge_archive(a, b, "replace").where("status = 'conflict'").first()["close"] == 3.0


def test_release_in_summer_and_winter(spark):
    d = spark.createDataFrame([("Consumer Price Index", "2026-07-14"), ("Consumer Price Index", "2026-01-13"), ("Research Consumer Price Index", "2026-01-13")], "release_name string, day string").withColumn("day", F.to_date("day"))
    assert [r["scheduled_at"].hour for r in lookup.classify_releases(d, "2026-01-01", "2026-12-31").orderBy("scheduled_at").collect()] == [13, 12]


def test_execution_hash_follows_the_rules():
    one = simulate.execution_hash(simulate.execution_manifest(FREE, timeout_bars=96))
    assert len(one) == 16 and one == simulate.execution_hash(simulate.execution_manifest(FREE, timeout_bars=96))
    assert one != simulate.execution_hash(simulate.execution_manifest(FREE, timeout_bars=97)) != simulate.execution_hash(simulate.execution_manifest(simulate.Costs(), timeout_bars=97))


def test_random_maker_draws_only_for_free_bars(spark):
    from random import Random

    m = lambda k: T0 + timedelta(minutes=k)
    rows = [("r", "X", i, m(15 * i), m(15 * i + 40), m(15 * i + 5)) for i in range(12)]
    sides = spark.createDataFrame(rows, "run_id string, symbol string, trade_id long, as_of timestamp_ntz, closed_buy timestamp_ntz, closed_sell timestamp_ntz").repartition(3)
    got = [r["direction"] for r in simulate.seeded_maker(sides, 3, 900, 0).orderBy("trade_id").collect()]
    rng, busy, want = Random(3), -1, []
    for i in range(12):
        if 15 * i < busy:
            want.append(None)
            continue
        buy = rng.random() < 0.5
        want.append("BUY" if buy else "SELL")
        busy = 15 * i + (40 if buy else 5)
    assert got == want


def test_random_maker_query_replays_its_generator(spark, sf_dir):
    """The registered query against one fold in plain Python over the same outcomes."""
    from itertools import groupby
    from random import Random

    from barcraft.plans import simulation

    rows = simulation.seeded_random_maker(spark, sf_dir).orderBy("run_id", "symbol", "as_of", "trade_id").collect()
    drawn = 0
    for _, own in groupby(rows, lambda r: (r["run_id"], r["symbol"])):
        rng, busy = Random(7), None
        for r in own:
            if busy is not None and r["as_of"] < busy:
                assert r["direction"] is None
                continue
            side = "BUY" if rng.random() < 0.5 else "SELL"
            assert r["direction"] == side
            end = r[f"closed_{side.lower()}"]
            busy = datetime.max if end is None else end + timedelta(seconds=900 * 2)
            drawn += 1
    assert drawn > 20


def test_feed_alerts_name_each_fault(spark):
    from barcraft.operators import alerts

    h = lambda k: T0 + timedelta(minutes=k)
    rows = [("ok", True, True, True, True, h(-10), h(-20), 5, 5, "verified"), ("behind", True, True, True, True, h(-10), h(-50), 0, 0, "verified"), ("stale", True, True, True, True, h(-40), h(-45), 0, 0, "verified"), ("none", True, True, None, False, None, None, 0, 0, "unverified"), ("shut", False, True, False, False, None, h(-5), 3, 0, None), ("down", True, False, None, None, None, h(-5), 0, 0, None)]
    feeds = spark.createDataFrame(rows, "symbol string, market_open boolean, session_ok boolean, quote_ok boolean, candles_ok boolean, feed_last timestamp_ntz, snapshot_last timestamp_ntz, paid_decisions long, paid_calls long, run_validity string")
    got = {}
    for r in alerts.feed_alerts(str(T0), feeds, 1800).collect():
        got.setdefault(r["symbol"], set()).add(r["code"])
    assert got == {"behind": {"BRAIN_BEHIND_FEED"}, "stale": {"FEED_STALE"}, "none": {"NO_MARKET_SNAPSHOT", "FEED_STALE", "QUOTE_UNAVAILABLE", "CANDLES_UNAVAILABLE", "UNVERIFIED_RUN_SELECTED"}, "shut": {"LLM_AUDIT_GAP"}}


def test_redaction_of_messages_and_documents(spark):
    from barcraft.functions import redaction

    texts = ["postgres://u:pa ss@h", "https://u:pw@h/x", "Token:\u00a0abc,x", "API-KEY = k1;rest", "bearer\u2003abc.def", "x?token=1", "tokens=5", "a" * 400, None]
    got = [r["m"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", redaction.redact_message(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got == ["postgres://u:pa ss@h", "https://u:<redacted>@h/x", "Token:\u00a0<redacted>,x", "API-KEY = <redacted>;rest", "Bearer <redacted>", "x", "tokens=5", "a" * 300, None]
    made = redaction.hide_sensitive({"Auth": None, "my_Token": [1], "list": [{"account_id": 1, "n": [[{"cookie": {}}]]}, "auth"], "ok": {"deep": {"DSN": "x", "y": 1}}})
    assert made == {"Auth": None, "my_Token": "[redactat]", "list": [{"account_id": "[redactat]", "n": [[{"cookie": "[redactat]"}]]}, "auth"], "ok": {"deep": {"DSN": "[redactat]", "y": 1}}}
    assert redaction.hide_sensitive("token") == "token" and redaction.hide_sensitive([]) == []
