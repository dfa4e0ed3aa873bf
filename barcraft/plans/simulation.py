"""Simulation queries: entries, first touch, financing, gate, coverage, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcraft.functions.market_calendar import EVENTS_CALENDAR
from barcraft.operators import decide, simulate
from barcraft.plans.decisions import _FILTER, DECIDABLE_CTE, _decidable, _risk_sql
from barcraft.plans.registry import query
from barcraft.sources import adapters as a
from barcraft.sources.sinks import settled

COSTS = simulate.Costs()
#: Bars that a trade is held at most: one trading day.
TIMEOUT = 96


def candidates(b: DataFrame) -> DataFrame:
    """Every 15-minute bar opens a trade, some of them inside the following bar."""
    k = (F.unix_seconds(F.col("close_time").cast("timestamp")) / 900).cast("long")
    c = b.select("symbol", F.col("close_time").alias("as_of"), F.col("close").alias("price"), k.alias("trade_id"))
    late = F.when(F.col("trade_id") % 6 == 0, 5).otherwise(0)
    return c.withColumns({
        "opened_at": F.col("as_of") + F.make_dt_interval(F.lit(0), F.lit(0), late), "direction": F.when(F.col("trade_id") % 4 == 0, "BUY").otherwise("SELL"),
        "sl_pct": F.lit(60.0), "tp_pct": F.when(F.col("trade_id") % 4 == 0, 250.0).otherwise(70.0), "run_id": F.when(F.col("trade_id") % 10 < 6, "main").otherwise("probe"),
    })


_CAND = f"""SELECT symbol, close_time AS as_of, close AS price, k AS trade_id, close_time + CASE WHEN k % 6 = 0 THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END AS opened_at, CASE WHEN k % 4 = 0 THEN 'BUY' ELSE 'SELL' END AS direction,
  60.0::DOUBLE AS sl_pct, CASE WHEN k % 4 = 0 THEN 250.0::DOUBLE ELSE 70.0::DOUBLE END AS tp_pct, CASE WHEN k % 10 < 6 THEN 'main' ELSE 'probe' END AS run_id
  FROM (SELECT *, (epoch(close_time) // 900)::BIGINT AS k FROM ({a.bars_sql('15min')}))"""
_S = COSTS.slippage_pct / 100
def sim_cte(cand: str) -> str:
    return f"""b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS bar_no FROM ({a.bars_sql('15min')})),
e AS MATERIALIZED (SELECT c.*, coalesce(b.open, c.price) AS entry_ref FROM ({cand}) c ASOF LEFT JOIN b ON b.symbol = c.symbol AND c.as_of <= b.open_time),
t AS MATERIALIZED (SELECT *, round(fill, 4) AS entry_mid, round(CASE WHEN direction = 'BUY' THEN fill * (1 - sl_pct / 100) ELSE fill * (1 + sl_pct / 100) END, 4) AS sl_price, round(CASE WHEN direction = 'BUY' THEN fill * (1 + tp_pct / 100) ELSE fill * (1 - tp_pct / 100) END, 4) AS tp_price
  FROM (SELECT *, CASE WHEN direction = 'BUY' THEN entry_ref * (1 + {_S!r}::DOUBLE) ELSE entry_ref * (1 - {_S!r}::DOUBLE) END AS fill FROM e))"""


_SIM = sim_cte(_CAND)
_EVENT = f"""CASE WHEN open_time < opened_at THEN CASE WHEN stop THEN 'sl_partial' WHEN bar_no - first_no + 1 >= {TIMEOUT} THEN 'timeout' END
  WHEN stop AND target THEN 'ambiguous' WHEN target THEN 'tp_hit' WHEN stop THEN 'sl_hit' WHEN bar_no - first_no + 1 >= {TIMEOUT} THEN 'timeout' END"""


def nights_sql(opened: str, closed: str) -> str:
    local = lambda c: f"(({c} AT TIME ZONE 'UTC') AT TIME ZONE '{COSTS.rollover_tz}')"
    days = f"generate_series(date_trunc('day', {local(opened)})::TIMESTAMP, date_trunc('day', {local(closed)})::TIMESTAMP, INTERVAL 1 DAY)"
    w = f"CASE WHEN d + INTERVAL {COSTS.rollover_hour} HOUR > {local(opened)} AND d + INTERVAL {COSTS.rollover_hour} HOUR < {local(closed)} THEN CASE WHEN isodow(d) >= 6 THEN 0.0 WHEN isodow(d) = {COSTS.triple_weekday + 1} THEN 3.0 ELSE 1.0 END ELSE 0.0 END"
    return f"(CASE WHEN {closed} > {opened} THEN coalesce(list_sum(list_transform({days}, lambda d: ({w})::DOUBLE)), 0.0) WHEN {closed} IS NOT NULL THEN 0.0 END)"


_NET = "CASE WHEN {f} IS NOT NULL THEN round((CASE WHEN direction = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * ({f} - entry_mid) - entry_mid * " + repr(COSTS.spread_pct) + "::DOUBLE / 100 - extra) / abs(entry_mid - sl_price), 3) END"
def outcomes_cte(cand: str) -> str:
    return f"""{sim_cte(cand)}, f AS (SELECT t.symbol, t.trade_id, min(bar_no) AS first_no FROM t JOIN b ON b.symbol = t.symbol AND b.close_time > t.opened_at GROUP BY 1, 2),
h AS (SELECT *, {_EVENT} AS event FROM (SELECT t.*, f.first_no, b.bar_no, b.open_time, b.close_time, b.open AS bo, b.close AS bc, CASE WHEN direction = 'BUY' THEN b.low <= sl_price ELSE b.high >= sl_price END AS stop, CASE WHEN direction = 'BUY' THEN b.high >= tp_price ELSE b.low <= tp_price END AS target
  FROM t JOIN f USING (symbol, trade_id) JOIN b ON b.symbol = t.symbol AND b.bar_no BETWEEN first_no AND first_no + {TIMEOUT - 1})),
x AS (SELECT symbol, trade_id, arg_min(event, bar_no) AS event, arg_min(bo, bar_no) AS bo, arg_min(bc, bar_no) AS bc, arg_min(close_time, bar_no) AS closed_at FROM h WHERE event IS NOT NULL GROUP BY 1, 2),
y AS (SELECT t.*, x.event, x.closed_at, ref * CASE WHEN direction = 'BUY' THEN 1 - {_S!r}::DOUBLE ELSE 1 + {_S!r}::DOUBLE END AS xfill, CASE WHEN event = 'ambiguous' THEN tp_price * CASE WHEN direction = 'BUY' THEN 1 - {_S!r}::DOUBLE ELSE 1 + {_S!r}::DOUBLE END END AS best
  FROM t LEFT JOIN (SELECT x.*, CASE WHEN event = 'sl_partial' THEN sl_price WHEN event IN ('sl_hit', 'ambiguous') THEN CASE WHEN direction = 'BUY' THEN least(sl_price, bo) ELSE greatest(sl_price, bo) END WHEN event = 'tp_hit' THEN tp_price ELSE bc END AS ref FROM x JOIN t USING (symbol, trade_id)) x USING (symbol, trade_id)),
z AS (SELECT *, entry_mid * {COSTS.commission_pct!r}::DOUBLE / 100 + {nights_sql('opened_at', 'closed_at')} * entry_mid * CASE WHEN direction = 'BUY' THEN {COSTS.swap_long_pct!r}::DOUBLE ELSE {COSTS.swap_short_pct!r}::DOUBLE END / 100 AS extra FROM y),
outcomes AS MATERIALIZED (SELECT symbol, as_of, run_id, trade_id, opened_at, direction, entry_mid, sl_price, tp_price, CASE WHEN event IS NULL THEN 'open' WHEN event = 'timeout' THEN 'expired' ELSE 'closed' END AS status, CASE WHEN event = 'sl_partial' THEN 'sl_hit' ELSE event END AS exit_reason, round(xfill, 4) AS exit_price, closed_at,
  {_NET.format(f='xfill')} AS r_multiple, {_NET.format(f='xfill')} AS r_pessimistic, CASE WHEN event = 'ambiguous' THEN {_NET.format(f='best')} ELSE {_NET.format(f='xfill')} END AS r_optimistic, coalesce(event = 'ambiguous', false) AS ambiguous FROM z)"""


OUTCOMES_CTE = outcomes_cte(_CAND)


def fine_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The 15-minute bars, made once: candidates, entries and exits all look at them."""
    return settled(a.bars(spark, sf, "15min"), "bars")


def trades(b: DataFrame) -> DataFrame:
    return simulate.open_trades(simulate.entry_bars(candidates(b), b), COSTS)


def entries(t: DataFrame) -> DataFrame:
    """What reconciling needs of trades, made once: they are looked at to find their bars and to
    take their exits."""
    return settled(t.select("symbol", "as_of", "run_id", "trade_id", "opened_at", "direction", "entry_mid", "sl_price", "tp_price"), "entries")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    b = fine_bars(spark, sf)
    return simulate.reconcile(entries(trades(b)), b, TIMEOUT, COSTS)


@query(f"WITH {_SIM} SELECT symbol, as_of, trade_id, entry_ref, entry_mid, sl_price, tp_price FROM t")
def entry_next_bar(spark: SparkSession, sf: str) -> DataFrame:
    return trades(fine_bars(spark, sf)).select("symbol", "as_of", "trade_id", "entry_ref", "entry_mid", "sl_price", "tp_price")


@query(f"WITH {OUTCOMES_CTE} SELECT * FROM outcomes")
def reconcile_first_touch(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf)


@query(f"SELECT decision_id, part, opened_at, closed_at, {nights_sql('opened_at', 'closed_at')} AS nights FROM ({a.TRADES_SQL})")
def rollover_nights(spark: SparkSession, sf: str) -> DataFrame:
    t = a.trade_facts(spark, sf)
    return t.select("decision_id", "part", "opened_at", "closed_at", simulate.rollover_nights("opened_at", "closed_at", COSTS).alias("nights"))


_BAR, _COOL = 900, 2
def gate_cte(outcomes: str) -> str:
    return f"""WITH RECURSIVE {outcomes}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id, symbol ORDER BY as_of, trade_id) AS n, coalesce(closed_at + INTERVAL {_BAR * _COOL} SECOND, TIMESTAMP '9999-12-31') AS free_at FROM outcomes),
nxt AS MATERIALIZED (SELECT c.run_id, c.symbol, c.n, min(d.n) AS next_n FROM o c LEFT JOIN o d ON d.run_id = c.run_id AND d.symbol = c.symbol AND d.n > c.n AND d.as_of >= c.free_at GROUP BY 1, 2, 3),
g AS (SELECT run_id, symbol, n FROM o WHERE n = 1 UNION ALL SELECT g.run_id, g.symbol, x.next_n FROM g JOIN nxt x ON x.run_id = g.run_id AND x.symbol = g.symbol AND x.n = g.n WHERE x.next_n IS NOT NULL)"""


_GATE = gate_cte(OUTCOMES_CTE)


def gated(spark: SparkSession, sf: str) -> DataFrame:
    b = fine_bars(spark, sf)
    t = entries(trades(b))
    return simulate.position_gate(simulate.reconcile(t, b, TIMEOUT, COSTS), _BAR, _COOL, sized=t)


@query(f"{_GATE} SELECT o.run_id, o.symbol, o.trade_id, o.as_of, g.n IS NOT NULL AS admitted FROM o LEFT JOIN g USING (run_id, symbol, n)")
def position_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gated(spark, sf).select("run_id", "symbol", "trade_id", "as_of", "admitted")


_REPORT = """SELECT run_id, symbol, count(*) AS candidates, count(g.n) AS trades, count(*) FILTER (WHERE g.n IS NOT NULL AND status = 'closed') AS closed, count(*) FILTER (WHERE g.n IS NOT NULL AND status = 'expired') AS expired,
  count(*) FILTER (WHERE g.n IS NOT NULL AND ambiguous) AS ambiguous, sum(CASE WHEN g.n IS NOT NULL THEN r_multiple::DECIMAL(18,3) END)::DOUBLE AS total_r FROM o LEFT JOIN g USING (run_id, symbol, n) GROUP BY 1, 2"""


def report(gate: DataFrame) -> DataFrame:
    on = F.col("admitted")
    return gate.groupBy("run_id", "symbol").agg(
        F.count("*").alias("candidates"), F.count_if(on).alias("trades"), F.count_if(on & (F.col("status") == "closed")).alias("closed"), F.count_if(on & (F.col("status") == "expired")).alias("expired"),
        F.count_if(on & F.col("ambiguous")).alias("ambiguous"), F.sum(F.when(on, F.col("r_multiple").cast("decimal(18,3)"))).cast("double").alias("total_r"),
    )


@query(f"{_GATE} {_REPORT}")
def backtest_report(spark: SparkSession, sf: str) -> DataFrame:
    return report(gated(spark, sf))


_APPROVED = f"""SELECT symbol, as_of, price, k AS trade_id, as_of AS opened_at, 'BUY' AS direction, sl_pct * 20 AS sl_pct, round(sl_pct * 2.0, 3) * 20 AS tp_pct, 'always_buy' AS run_id
  FROM (SELECT *, round(atr_pct * 1.5::DOUBLE, 3) AS sl_pct, len({_FILTER}) = 0 AS passed FROM decidable) WHERE passed AND {_risk_sql('sl_pct', "'BUY'", '0.6::DOUBLE')} = 'approved'"""


@query(f"{gate_cte(DECIDABLE_CTE + ', ' + outcomes_cte(_APPROVED))} {_REPORT}")
def backtest_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """The whole backtest: bars of four timeframes, indicators, packets, eligibility, filter,
    maker, risk, entry, first touch, position gate and report."""
    b = fine_bars(spark, sf)
    d = decide.run_decisions(_decidable(spark, sf, b), "always_buy", EVENTS_CALENDAR).where("verdict = 'approved'")
    c = d.select("symbol", "as_of", "price", F.col("k").alias("trade_id"), F.col("as_of").alias("opened_at"), "direction", (F.col("sl_pct") * 20).alias("sl_pct"), (F.col("tp_pct") * 20).alias("tp_pct"), F.lit("always_buy").alias("run_id"))
    c = settled(c, "approved")  # entries look at them twice
    t = entries(simulate.open_trades(simulate.entry_bars(c, b), COSTS))
    return report(simulate.position_gate(simulate.reconcile(t, b, TIMEOUT, COSTS), _BAR, _COOL, sized=t))


@query(f"""SELECT symbol, close_time, CASE WHEN pc IS NULL THEN 0 ELSE coalesce(len(list_filter(generate_series(pc + INTERVAL 15 MINUTE, close_time - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE), lambda t: {EVENTS_CALENDAR.duckdb('(t - INTERVAL 15 MINUTE)')})), 0) END AS missed
FROM (SELECT symbol, close_time, lag(close_time) OVER (PARTITION BY symbol ORDER BY close_time) AS pc FROM ({a.bars_sql('15min')}))""")
def missed_open_bars(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    b = a.bars(spark, sf, "15min").select("symbol", "close_time").withColumn("pc", F.lag("close_time").over(Window.partitionBy("symbol").orderBy("close_time")))
    return b.select("symbol", "close_time", simulate.missed_open_bars("pc", "close_time", EVENTS_CALENDAR).alias("missed"))


_NOW = "2024-01-20 00:00:00"


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(a.bars(spark, sf, "15min")).select("symbol", "trade_id", "opened_at")


def _coverage_sql(tf: str, m: int) -> str:
    return f"""SELECT c.symbol, c.trade_id, count(s.t) FILTER (WHERE s.is_open) AS expected, count(s.t) FILTER (WHERE s.is_open AND b.open_time IS NULL) AS missing, count(s.t) FILTER (WHERE s.is_open AND b.open_time IS NULL) = 0 AS covered
  FROM (SELECT symbol, trade_id, opened_at FROM ({_CAND})) c LEFT JOIN (SELECT t, {EVENTS_CALENDAR.duckdb('t')} AS is_open FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '{_NOW}' - INTERVAL {m} MINUTE, INTERVAL {m} MINUTE)) AS t)) s ON s.t >= time_bucket(INTERVAL {m} MINUTE, c.opened_at)
  LEFT JOIN ({a.bars_sql(tf)}) b ON b.symbol = c.symbol AND b.open_time = s.t GROUP BY 1, 2"""


@query(_coverage_sql("1h", 60))
def window_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.coverage(_windows(spark, sf), a.bars(spark, sf, "1h"), _NOW, "1h", EVENTS_CALENDAR)


@query(f"""SELECT c.symbol, c.trade_id, CASE WHEN f.covered THEN '15min' ELSE '1h' END AS tf, NOT f.covered AS fell_back, f.covered OR c.covered AS covered
FROM ({_coverage_sql('1h', 60)}) c JOIN ({_coverage_sql('15min', 15)}) f USING (symbol, trade_id)""")
def reconcile_timeframe(spark: SparkSession, sf: str) -> DataFrame:
    t = _windows(spark, sf)
    fine = simulate.coverage(t, a.bars(spark, sf, "15min"), _NOW, "15min", EVENTS_CALENDAR)
    return simulate.choose_timeframe(fine, simulate.coverage(t, a.bars(spark, sf, "1h"), _NOW, "1h", EVENTS_CALENDAR), "15min", "1h")


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN l_suppkey % 9 = 0 OR l_returnflag = 'N' THEN 'quarantine' WHEN l_partkey % 4 = 0 OR l_linenumber = 3 THEN 'untouched' ELSE 'reconcile' END AS action FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1""")
def open_trade_action(spark: SparkSession, sf: str) -> DataFrame:
    x = a.table(spark, sf, "lineitem").where("l_linestatus = 'O'").select(
        F.when(F.col("l_suppkey") % 9 == 0, "other").otherwise("csv").alias("provider"), F.when(F.col("l_returnflag") != "N", "csv").alias("bars_provider"), F.when(F.col("l_linenumber") != 3, F.col("l_partkey") % 4 != 0).alias("covered"),
    )
    return x.groupBy(simulate.open_action().alias("action")).agg(F.count("*").alias("n"))


@query(f"""WITH {_SIM}, q AS (SELECT symbol, arg_max(bid, time) AS bid, arg_max(ask, time) AS ask FROM (SELECT symbol, close_time AS time, close - 0.5::DOUBLE AS bid, CASE WHEN symbol = 'view' THEN close - 1.0::DOUBLE ELSE close + 0.5::DOUBLE END AS ask FROM b) GROUP BY 1),
m AS (SELECT t.*, CASE WHEN q.bid > 0 AND q.ask >= q.bid THEN (q.bid + q.ask) / 2 END AS mid, CASE WHEN direction = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM t JOIN q USING (symbol))
SELECT symbol, trade_id, mid, round(sg * (mid - entry_mid) / entry_mid * 100, 4) AS unrealized_pct, round(sg * (mid - entry_mid) / abs(entry_mid - sl_price), 4) AS unrealized_r, round(sg * (mid - sl_price), 4) AS to_stop, round(sg * (tp_price - mid), 4) AS to_target, opened_at + INTERVAL 1440 MINUTE AS times_out_at FROM m""")
def mark_to_market(spark: SparkSession, sf: str) -> DataFrame:
    b = fine_bars(spark, sf)
    q = b.select("symbol", F.col("close_time").alias("time"), (F.col("close") - 0.5).alias("bid"), F.when(F.col("symbol") == "view", F.col("close") - 1.0).otherwise(F.col("close") + 0.5).alias("ask"))
    m = simulate.mark_to_market(trades(b), q)
    return m.select("symbol", "trade_id", "mid", "unrealized_pct", "unrealized_r", "to_stop", "to_target", "times_out_at")


@query(f"WITH {OUTCOMES_CTE} SELECT symbol, trade_id, round(CASE WHEN direction = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (exit_price - entry_mid) / abs(entry_mid - sl_price), 4) AS r FROM outcomes WHERE exit_price IS NOT NULL")
def r_from_prices(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).where("exit_price is not null").select("symbol", "trade_id", simulate.r_from_prices().alias("r"))


@query("""SELECT external_id, trade_id, CASE WHEN trade_id IS NULL THEN 'orphan' WHEN p.external_id IS NULL THEN 'closed_by_broker' WHEN opened_at + INTERVAL 1440 MINUTE <= TIMESTAMP '2000-01-01' THEN 'closed_timeout' ELSE 'held' END AS action
FROM (SELECT o_orderkey AS external_id, o_custkey AS trade_id, o_orderdate AS opened_at FROM orders WHERE o_orderstatus <> 'P') t FULL JOIN (SELECT o_orderkey AS external_id FROM orders WHERE o_orderpriority <> '5-LOW') p USING (external_id)""")
def live_sweep(spark: SparkSession, sf: str) -> DataFrame:
    o = a.table(spark, sf, "orders")
    t = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("external_id"), F.col("o_custkey").alias("trade_id"), F.col("o_orderdate").alias("opened_at"))
    return simulate.sweep(t, o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("external_id")), "2000-01-01 00:00:00", 1440)


@query(f"""WITH {_SIM} SELECT direction, modeled, not_modeled, count(*) AS n FROM (SELECT direction, 'spread,gap_through_stop,latency,slippage,commission' || CASE WHEN direction = 'BUY' THEN ',swap' ELSE '' END AS modeled, CASE WHEN direction = 'BUY' THEN '' ELSE 'swap' END AS not_modeled FROM t) GROUP BY ALL""")
def cost_manifest(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(fine_bars(spark, sf)).select("direction", *simulate.cost_manifest(simulate.Costs(swap_short_pct=0.0)))
    return t.select("direction", F.array_join("modeled", ",").alias("modeled"), F.array_join("not_modeled", ",").alias("not_modeled")).groupBy("direction", "modeled", "not_modeled").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS trade_id, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 10) / 100.0::DOUBLE END, 0.05::DOUBLE) AS spread_pct, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 7) / 100.0::DOUBLE END, 0.02::DOUBLE) AS commission_pct,
coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'terms-' || o_orderpriority END, 'unset') AS terms_version FROM orders""")
def frozen_costs(spark: SparkSession, sf: str) -> DataFrame:
    o = a.table(spark, sf, "orders")
    stored = {"spread_pct": "case when o_orderkey % 3 <> 0 then (o_custkey % 10) / 100D end", "commission_pct": "case when o_orderkey % 5 <> 0 then (o_custkey % 7) / 100D end", "terms_version": "case when o_orderkey % 4 = 0 then concat('terms-', o_orderpriority) end"}
    return simulate.with_frozen_costs(o, stored, COSTS).select(F.col("o_orderkey").alias("trade_id"), *stored)


@query(f"SELECT symbol, run_id, count(*) FILTER (WHERE run_id = 'main') AS resumed, count(*) FILTER (WHERE run_id <> 'main') AS to_do FROM ({_CAND}) GROUP BY 1, 2")
def resume_backtest(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(a.bars(spark, sf, "15min")).select("symbol", "trade_id", "run_id")
    done, left = simulate.resume(c, c.where("run_id = 'main'"), ["symbol", "trade_id"])
    both = done.withColumn("s", F.lit("resumed")).unionByName(left.withColumn("s", F.lit("to_do")))
    return both.groupBy("symbol", "run_id").agg(F.count_if(F.col("s") == "resumed").alias("resumed"), F.count_if(F.col("s") == "to_do").alias("to_do"))


@query()
def seeded_random_maker(spark: SparkSession, sf: str) -> DataFrame:
    b = fine_bars(spark, sf)
    c = simulate.entry_bars(candidates(b), b)
    ends = {}
    for side in ("BUY", "SELL"):
        t = entries(simulate.open_trades(c.withColumn("direction", F.lit(side)), COSTS))
        ends[side] = simulate.reconcile(t, b, TIMEOUT, COSTS).select("symbol", "as_of", "run_id", "trade_id", F.col("closed_at").alias(f"closed_{side.lower()}"))
    sides = ends["BUY"].join(ends["SELL"], ["symbol", "as_of", "run_id", "trade_id"])
    return simulate.seeded_maker(sides, 7, _BAR, _COOL)
