"""Segmented scans: the result of one scan over a whole key, whatever the length of a slice."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from barcraft.functions.market_calendar import CALENDARS
from barcraft.operators import asof, features, simulate
from barcraft.operators.segments import running
from tests.conftest import rows_of

START = datetime(2026, 1, 5)
LENGTHS = [1, 60, 24 * 60, 10**6]


def rows(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = rng.choice(["hot"] * 8 + ["cold", None])
        at = START + timedelta(minutes=rng.randrange(5000) if rng.random() < 0.9 else 0)
        out.append((key, at, i, rng.choice([None, None, i]), rng.choice([None, 1, 2])))
    return out


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("minutes", LENGTHS)
def test_running_values(spark, minutes, backward):
    data = rows(minutes)
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, n long, v long, c long").repartition(5)
    got = {r.n: (r.v, r.c) for r in running(df, ["k"], "t", ["n"], last=["v"], sums=["c"], backward=backward, slice_minutes=minutes).collect()}
    want, state = {}, {}
    for k, t, n, v, c in sorted(data, key=lambda r: (r[1], r[2]), reverse=backward):
        last, total = state.get(k, (None, None))
        state[k] = (last if v is None else v, total if c is None else (total or 0) + c)
        want[n] = state[k]
    assert got == want
    one = running(df, ["k"], "t", ["n"], last=["v"], sums=["c"], backward=backward, one_scan_rows=10**6)
    assert {r.n: (r.v, r.c) for r in one.collect()} == want and one.columns == df.columns


def test_slices_have_no_window_over_a_bare_key(spark):
    """Rows are sorted by key and slice; only a row a slice is sorted by key."""
    df = spark.createDataFrame(rows(1), "k string, t timestamp_ntz, n long, v long, c long")
    plan = running(df, ["k"], "t", ["n"], last=["v"], one_scan_rows=299)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("__slot" in line.split("], [")[1] for line in windows) == 1


BAR = "symbol string, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double"


def bars(seed, n=250):
    rng, out, price, t = random.Random(seed), [], 100.0, START
    for _ in range(n):
        t += timedelta(minutes=15 * rng.choice([1, 1, 1, 3, 40]))
        o, price = price, price + rng.gauss(0, 1)
        out.append(("X", t, t + timedelta(minutes=15), o, max(o, price) + 0.3, min(o, price) - 0.3, price))
    return out


@pytest.mark.parametrize("minutes", LENGTHS)
def test_entries_and_exits_do_not_depend_on_slices(spark, minutes):
    b = bars(2)
    table = spark.createDataFrame(b, BAR)
    cands = [("X", x[2] + timedelta(minutes=m), x[6], i, "r", x[2] + timedelta(minutes=m), "BUY" if i % 2 else "SELL", 1.0, 2.0) for i, x in enumerate(b[:: 3]) for m in ((0,) if i % 4 else (0, 7))]
    c = spark.createDataFrame([(*x[:3], n, *x[4:]) for n, x in enumerate(cands)], "symbol string, as_of timestamp_ntz, price double, trade_id long, run_id string, opened_at timestamp_ntz, direction string, sl_pct double, tp_pct double")
    entered = simulate.entry_bars(c, table, slice_minutes=minutes)
    refs = {r.trade_id: r.entry_ref for r in entered.collect()}
    assert refs == {n: next((y[3] for y in b if y[1] >= x[1]), x[2]) for n, x in enumerate(cands)}
    trades = simulate.open_trades(entered, simulate.Costs()).select("symbol", "as_of", "run_id", "trade_id", "opened_at", "direction", "entry_mid", "sl_price", "tp_price")
    out = rows_of(simulate.reconcile(trades, table, 8, simulate.Costs(), slice_minutes=minutes))
    assert out == rows_of(simulate.reconcile(trades, table, 8, simulate.Costs(), slice_minutes=10**7))
    covered = rows_of(simulate.coverage(trades, table, "2026-02-20 00:00:00", "15min", CALENDARS["polygon"], slice_minutes=minutes))
    assert covered == rows_of(simulate.coverage(trades, table, "2026-02-20 00:00:00", "15min", CALENDARS["polygon"], slice_minutes=10**7)) and len(covered) == len(cands)


@pytest.mark.parametrize("minutes", LENGTHS)
def test_asof_join_and_packets_do_not_depend_on_slices(spark, minutes):
    rng = random.Random(5)
    at = lambda: START + timedelta(minutes=rng.randrange(4000))
    left = spark.createDataFrame([(rng.choice(["a", "b", None]), at(), i) for i in range(200)], "k string, t timestamp_ntz, i long")
    right = [(rng.choice(["a", "a", None]), START + timedelta(minutes=97 * j), None if j % 7 == 0 else j) for j in range(40)]
    got = {r.i: r.v for r in asof.asof_join(left, spark.createDataFrame(right, "k string, rt timestamp_ntz, v long"), "t", "rt", ["k"], slice_minutes=minutes).collect()}
    want = {}
    for r in left.collect():
        known = [(t, v) for k, t, v in right if k == r.k and t <= r.t]
        want[r.i] = max(known, key=lambda x: x[0])[1] if known else None
    assert got == want
    tfs = {"1day": 1440, "4h": 240, "1h": 60, "15min": 15}
    made = [("X", tf, START + timedelta(minutes=m * i), START + timedelta(minutes=m * (i + 1)), "range", "up", 1.0 * i, 2.0, 3.0, 100.0 + i) for tf, m in tfs.items() for i in range(4320 // m)]
    f = spark.createDataFrame(made, "symbol string, tf string, open_time timestamp_ntz, close_time timestamp_ntz, regime string, ema_align string, adx double, atr_pct double, rsi double, close double")
    packets = {r.as_of: (r.macro_close, r.trend_close, r.structure_close) for r in features.feature_packets(f, slice_minutes=minutes).collect()}
    closed = lambda t, m: START + timedelta(minutes=(t - START) // timedelta(minutes=m) * m)
    assert packets == {t: tuple(closed(t, m) for m in (1440, 240, 60)) for t in (START + timedelta(minutes=15 * i) for i in range(96, 289))}


OUTCOME = "run_id string, symbol string, trade_id long, as_of timestamp_ntz, closed_at timestamp_ntz, note string"


def outcomes(seed, n, keys=("a", None), ends=40, never=0.0):
    rng = random.Random(seed)
    t = [START + timedelta(minutes=15 * i) for i in range(n)]
    return [(rng.choice(keys), "X", rng.randrange(10**6), x, None if rng.random() < never else x + timedelta(minutes=15 * rng.randrange(ends)), f"n{i}") for i, x in enumerate(t) for _ in range(rng.choice([1, 1, 2]))]


def plain_gate(rows, cooldown):
    admitted, busy = set(), {}
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        if busy.get(r[0]) is None or r[3] >= busy[r[0]]:
            admitted.add(r)
            busy[r[0]] = datetime.max if r[4] is None else r[4] + cooldown
    return admitted


@pytest.mark.parametrize(("n", "slice_rows", "fold_rows", "ends", "never"), [(300, 7, 10, 40, 0.0), (300, 1, 5, 3, 0.0), (300, 50, 10, 90, 0.01), (40, 3, 10**6, 9, 0.0), (5, 2, 1, 1, 0.0)])
def test_gate_in_slices_equals_the_fold(spark, n, slice_rows, fold_rows, ends, never):
    data = outcomes(n + slice_rows, n, ends=ends, never=never)
    df = spark.createDataFrame(data, OUTCOME).repartition(4)
    got = {(r.run_id, r.symbol, r.trade_id, r.as_of, r.closed_at, r.note) for r in simulate.position_gate(df, 900, 2, fold_rows=fold_rows, slice_rows=slice_rows).where("admitted").collect()}
    assert got == plain_gate(data, timedelta(minutes=30))
    sized = simulate.position_gate(df, 900, 2, fold_rows=fold_rows, slice_rows=slice_rows, sized=df.select("run_id", "symbol"))
    assert sized.columns == [*df.columns, "admitted"] and sized.where("admitted").count() == len(got)


def test_gate_of_one_large_key(spark):
    """10^5 outcomes of one key in slices; few chains are followed beyond their slice."""
    data = outcomes(1, 70_000, keys=("a",), ends=30)
    df = spark.createDataFrame(data, OUTCOME)
    got = simulate.position_gate(df, 900, 2, fold_rows=1000, slice_rows=3000).where("admitted").select("trade_id", "note")
    assert len(data) > 90_000 and {(r.trade_id, r.note) for r in got.collect()} == {(r[2], r[5]) for r in plain_gate(data, timedelta(minutes=30))}


def plain_budget(rows, run_budget, day_budget, month_budget):
    runs, days, months, out = {}, {}, {}, {}
    for m, ts, seq, run, micro in sorted(rows, key=lambda r: (r[1], r[2])):
        day = m, ts.date()
        ok = runs.get((m, run), 0) + micro <= run_budget and days.get(day, 0) + micro <= day_budget and months.get(m, 0) + micro <= month_budget
        out[seq] = ok
        if ok:
            for d, k in ((runs, (m, run)), (days, day), (months, m)):
                d[k] = d.get(k, 0) + micro
    return out


@pytest.mark.parametrize("budgets", [(400, 10**6, 10**6), (10**6, 300, 10**6), (10**6, 10**6, 1500), (700, 300, 2500), (10**6, 10**6, 10**6), (5, 5, 5)])
def test_budgets_equal_the_fold(spark, budgets, monkeypatch):
    from barcraft.operators import ledger

    rng = random.Random(budgets[0])
    rows = []
    for i in range(400):
        at = START + timedelta(minutes=rng.randrange(60 * 24 * 70))
        rows.append((None if at.month == 3 else f"{at:%Y-%m}", at, i, rng.choice(["a", "b", None]), rng.choice([0, 5, 20, 90])))
    df = spark.createDataFrame(rows, "month string, ts timestamp_ntz, seq long, run_id string, micro long").repartition(4)
    want = plain_budget(rows, *budgets)
    if all(want.values()):  # what is granted whole never enters Python
        monkeypatch.setattr(ledger.pa, "array", None)
    for minutes in (600, 10**6):
        got = ledger.budget_grants(df, *budgets, slice_minutes=minutes)
        assert got.columns == [*df.columns, "granted"] and {r.seq: r.granted for r in got.collect()} == want


@pytest.mark.parametrize("least", [1, -20])
def test_a_month_of_refusals_is_a_stream(spark, least):
    """Most of 20,000 requests are refused: no month is one table in Python, and few are folded."""
    import pyarrow as pa

    from barcraft.operators import ledger

    rng = random.Random(4)
    rows = []
    for i in range(20_000):
        at = START + timedelta(minutes=rng.randrange(60 * 24 * 20))
        rows.append((f"{at:%Y-%m}", at, i, rng.choice(["a", "b", None]), rng.randrange(least, 900)))
    budgets = 9000, 3000, 20_000
    want = plain_budget(rows, *budgets)
    out = ledger.budget_grants(spark.createDataFrame(rows, "month string, ts timestamp_ntz, seq long, run_id string, micro long").repartition(4), *budgets)
    assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().toString()
    assert {r.seq: r.granted for r in out.collect()} == want
    # one run and day: what the sieve leaves holds all that is granted
    day = [r for r in sorted(rows, key=lambda r: (r[1], r[2])) if r[3] == "a" and r[1].date() == rows[0][1].date()]
    batch = pa.RecordBatch.from_pylist([{"month": m, "run_id": run, "day": 1, "cost": max(micro, 1), "refunds": False, "id": i} for m, _, i, run, micro in day])
    left = {i for b in ledger._possible(3000)(iter([batch.slice(0, 100), batch.slice(100)])) for i in b.column("id").to_pylist()}
    if least > 0:
        assert {r[2] for r in day if want[r[2]]} <= left and len(left) < len(day) / 2
