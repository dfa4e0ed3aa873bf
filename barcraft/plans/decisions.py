"""Eligibility, prefilter, maker, risk and order queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcraft.functions.numeric import round_to
from barcraft.functions.market_calendar import EVENTS_CALENDAR
from barcraft.operators import asof, decide
from barcraft.operators.features import ROLES
from barcraft.plans.bars import _kinds_sql
from barcraft.plans.registry import query
from barcraft.plans.series import PACKETS_CTE, packets
from barcraft.sources import adapters as a

RECENT = dict(decide.EligibilityPolicy().recent_bars)


def _flags(spark: SparkSession, sf: str, fine: DataFrame | None = None) -> DataFrame:
    """Packets with gap flags as of each bar, a clock and a quote that sometimes lags."""
    out = packets(spark, sf, True, fine).withColumn("feed_close", F.col("as_of"))
    out = out.withColumns({f"gap_{tf}": F.coalesce(f"{role}_gap", F.lit(False)) for role, tf in ROLES.items()})
    k = (F.unix_seconds(F.col("as_of").cast("timestamp")) / 900).cast("long")
    sec = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)
    now = F.col("as_of") + sec((k % 37) * 60)
    return out.withColumns({"k": k, "now": now}).withColumn("quote_time", F.when(k % 13 != 5, F.col("now") - sec((k % 29) * 6 - 10)))


def _gap_cte(tf: str, n: int) -> str:
    t = tf.replace("min", "m")
    frame = f"ROWS BETWEEN {n - 2} PRECEDING AND CURRENT ROW"
    return f"""g{t} AS MATERIALIZED (SELECT symbol, close_time, coalesce(max(gap) OVER (PARTITION BY symbol ORDER BY open_time {frame}), false) AS gap_{t}
  FROM (SELECT b.symbol, open_time, close_time, k.before IS NOT NULL AS gap FROM ({a.bars_sql(tf)}) b LEFT JOIN (SELECT * FROM ({_kinds_sql(tf)}) WHERE kind = 'unexpected_missing_bar') k ON k.symbol = b.symbol AND k.before = b.open_time))"""


_T = [tf.replace("min", "m") for tf in RECENT]
FLAGS_CTE = f"""{PACKETS_CTE}, {", ".join(_gap_cte(tf, n) for tf, n in RECENT.items())},
flags AS MATERIALIZED (SELECT *, now - to_seconds(CASE WHEN k % 13 <> 5 THEN (k % 29) * 6 - 10 END) AS quote_time FROM (SELECT *, as_of + to_seconds((k % 37) * 60) AS now FROM (
  SELECT p.*, (epoch(p.as_of) // 900)::BIGINT AS k, {", ".join(f"gap_{t}" for t in _T)} FROM packets p {" ".join(f"ASOF JOIN g{t} ON g{t}.symbol = p.symbol AND p.as_of >= g{t}.close_time" for t in _T)})))"""
_GAP_REASONS = ", ".join(f"CASE WHEN gap_{t} THEN 'recent_unexpected_gap:{tf}' END" for tf, t in zip(RECENT, _T, strict=True))
_KEEP = "lambda x: x IS NOT NULL"


@query(f"WITH {FLAGS_CTE} SELECT symbol, as_of, array_to_string(list_filter([{_GAP_REASONS}], {_KEEP}), ';') AS reasons, len(list_filter([{_GAP_REASONS}], {_KEEP})) = 0 AS eligible FROM flags")
def eligibility_replay(spark: SparkSession, sf: str) -> DataFrame:
    e = decide.eligibility(_flags(spark, sf), "replay")
    return e.select("symbol", "as_of", F.array_join("reasons", ";").alias("reasons"), "eligible")


_ONLINE = f"""list_filter([CASE WHEN date_diff('second', as_of, now) > 1800 THEN 'stale_feed:' || date_diff('second', as_of, now) END,
  CASE WHEN quote_time IS NULL THEN 'missing_quote' WHEN date_diff('second', quote_time, now) < -5 THEN 'future_quote:' || date_diff('second', quote_time, now) WHEN date_diff('second', quote_time, now) > 120 THEN 'stale_quote:' || date_diff('second', quote_time, now) END, {_GAP_REASONS}], {_KEEP})"""


@query(f"WITH {FLAGS_CTE} SELECT symbol, as_of, array_to_string({_ONLINE}, ';') AS reasons, date_diff('second', as_of, now)::DOUBLE AS feed_lag, date_diff('second', quote_time, now)::DOUBLE AS quote_lag FROM flags")
def eligibility_online(spark: SparkSession, sf: str) -> DataFrame:
    e = decide.eligibility(_flags(spark, sf), "online")
    return e.select("symbol", "as_of", F.array_join("reasons", ";").alias("reasons"), "feed_lag", "quote_lag")


def _decidable(spark: SparkSession, sf: str, fine: DataFrame | None = None) -> DataFrame:
    f = decide.eligibility(_flags(spark, sf, fine), "replay")
    f = f.withColumns({
        "spread_pct": F.when(F.col("k") % 15 != 7, (F.col("k") % 15) / 100), "regime": F.col("structure_regime"), "atr_pct": F.col("atr_pct_trigger") / 50,
        "insufficient": F.when(F.col("k") % 53 == 3, F.array(F.lit("1day"))),
        "proposed_sl": F.when(F.col("k") % 4 != 1, (F.col("k") % 30 + 1) / 10), "proposed_tp": F.when(F.col("k") % 4 != 2, (F.col("k") % 70 + 1) / 10),
    })
    return asof.blackout(f, a.scheduled_events(spark), 60, 30)


DECIDABLE_CTE = f"""{FLAGS_CTE}, decidable AS MATERIALIZED (SELECT f.*, list_filter([{_GAP_REASONS}], {_KEEP}) AS reasons, CASE WHEN k % 15 <> 7 THEN (k % 15) / 100.0::DOUBLE END AS spread_pct, structure_regime AS regime, atr_pct_trigger / 50 AS atr_pct,
  k % 53 = 3 AS short, CASE WHEN k % 4 <> 1 THEN (k % 30 + 1) / 10.0::DOUBLE END AS proposed_sl, CASE WHEN k % 4 <> 2 THEN (k % 70 + 1) / 10.0::DOUBLE END AS proposed_tp, event
  FROM flags f LEFT JOIN (SELECT as_of AS at_, arg_min(label, scheduled_at) AS event FROM (SELECT DISTINCT as_of FROM packets) JOIN ({a.EVENTS_SQL}) ON impact = 'high' AND as_of BETWEEN scheduled_at - INTERVAL 60 MINUTE AND scheduled_at + INTERVAL 30 MINUTE GROUP BY 1) e ON e.at_ = f.as_of)"""
_FILTER = f"""list_filter([CASE WHEN len(reasons) > 0 THEN 'ineligible:' || array_to_string(reasons, ';') END, CASE WHEN short THEN 'insufficient_data:1day' END, CASE WHEN spread_pct > 0.10 THEN 'spread_too_wide' END,
  CASE WHEN regime = 'choppy' THEN 'blocked_regime:choppy' END, CASE WHEN event IS NOT NULL THEN 'news_blackout:' || event END], {_KEEP})"""


@query(f"WITH {DECIDABLE_CTE} SELECT symbol, as_of, array_to_string({_FILTER}, ',') AS filter_reasons, len({_FILTER}) = 0 AS passed FROM decidable")
def prefilter(spark: SparkSession, sf: str) -> DataFrame:
    f = _decidable(spark, sf).withColumn("__r", decide.prefilter())
    return f.select("symbol", "as_of", F.array_join("__r", ",").alias("filter_reasons"), (F.size("__r") == 0).alias("passed"))


_COIN = "CASE WHEN k % 3 = 0 THEN 'BUY' WHEN k % 3 = 1 THEN 'SELL' ELSE 'NO_TRADE' END"
_CONF = "((k * 7) % 101) / 100.0::DOUBLE"


def _sides(f: DataFrame) -> DataFrame:
    return f.withColumns({"direction": F.when(F.col("k") % 3 == 0, "BUY").when(F.col("k") % 3 == 1, "SELL").otherwise("NO_TRADE"), "confidence": ((F.col("k") * 7) % 101) / 100})


def _risk_sql(sl: str, direction: str, conf: str) -> str:
    return f"""CASE WHEN {direction} = 'NO_TRADE' THEN 'no_trade' WHEN {conf} < 0.55 THEN 'low_confidence' WHEN spread_pct IS NULL THEN 'missing_spread' WHEN NOT {EVENTS_CALENDAR.duckdb('as_of')} THEN 'market_closed'
  WHEN atr_pct IS NULL OR atr_pct <= 0 THEN 'no_atr' WHEN NOT {sl} BETWEEN 0.05 AND 3.0 THEN 'sl_out_of_bounds' WHEN spread_pct > {sl} * 0.33::DOUBLE THEN 'spread_vs_sl' ELSE 'approved' END"""


@query(f"WITH {DECIDABLE_CTE} SELECT symbol, as_of, {_COIN} AS direction, sl_pct, round(sl_pct * 2.0, 3) AS tp_pct, {_risk_sql('sl_pct', _COIN, _CONF)} AS verdict FROM (SELECT *, round(atr_pct * 1.5::DOUBLE, 3) AS sl_pct FROM decidable)")
def risk_gate(spark: SparkSession, sf: str) -> DataFrame:
    return decide.risk(_sides(_decidable(spark, sf)), EVENTS_CALENDAR).select("symbol", "as_of", "direction", "sl_pct", "tp_pct", "verdict")


@query(f"""WITH {DECIDABLE_CTE}, s AS (SELECT *, CASE WHEN proposed_sl IS NULL OR proposed_tp IS NULL THEN 'atr_fallback:no_proposal' WHEN proposed_tp < proposed_sl * 2.0 THEN 'atr_fallback:rr_too_low' WHEN proposed_sl > atr_sl * 2.5::DOUBLE THEN 'atr_fallback:sl_too_wide' ELSE 'model' END AS sl_source
  FROM (SELECT *, round(atr_pct * 1.5::DOUBLE, 3) AS atr_sl FROM decidable))
SELECT symbol, as_of, sl_source, CASE WHEN sl_source = 'model' THEN round(proposed_sl, 3) ELSE atr_sl END AS sl_pct, CASE WHEN sl_source = 'model' THEN round(proposed_tp, 3) ELSE round(atr_sl * 2.0, 3) END AS tp_pct FROM s""")
def sl_tp_resolve(spark: SparkSession, sf: str) -> DataFrame:
    sl, tp, source = decide.stops(decide.RiskPolicy(source="model"))
    return _decidable(spark, sf).select("symbol", "as_of", source.alias("sl_source"), sl.alias("sl_pct"), tp.alias("tp_pct"))


@query(f"""WITH {DECIDABLE_CTE}, d AS (SELECT *, len({_FILTER}) = 0 AS passed, CASE confluence WHEN 'aligned_bull' THEN 'BUY' WHEN 'aligned_bear' THEN 'SELL' ELSE 'NO_TRADE' END AS dir FROM decidable),
e AS (SELECT *, CASE WHEN dir = 'NO_TRADE' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS conf, round(atr_pct * 1.5::DOUBLE, 3) AS sl FROM d)
SELECT symbol, as_of, CASE WHEN passed THEN 'decided' ELSE 'prefiltered_out' END AS stage, CASE WHEN passed THEN dir END AS direction, CASE WHEN passed THEN conf END AS confidence, CASE WHEN passed THEN {_risk_sql('sl', 'dir', 'conf')} END AS verdict FROM e""")
def decision_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return decide.run_decisions(_decidable(spark, sf), "confluence", EVENTS_CALENDAR).select("symbol", "as_of", "stage", "direction", "confidence", "verdict")


@query(f"""WITH {PACKETS_CTE} SELECT symbol, as_of, CASE confluence WHEN 'aligned_bull' THEN 'BUY' WHEN 'aligned_bear' THEN 'SELL' ELSE 'NO_TRADE' END AS confluence, 'NO_TRADE' AS flat, 'BUY' AS always_buy FROM packets""")
def makers(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf)
    return p.select("symbol", "as_of", *[decide.MAKERS[m]()[0].alias(m) for m in ("confluence", "flat", "always_buy")])


_DEC = "l_orderkey AS id, l_linenumber AS n, CASE WHEN l_partkey % 29 = 0 THEN 'HOLD' WHEN l_partkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS direction, l_quantity / 45 AS confidence, repeat('x', (l_suppkey % 7)::INT) AS rationale, (l_partkey % 15)::INT AS n_factors, l_discount * 150 - 1 AS proposed_sl, l_tax * 300 AS proposed_tp"


@query(f"""SELECT faults, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN direction NOT IN ('BUY', 'SELL', 'NO_TRADE') THEN 'direction' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN length(rationale) NOT BETWEEN 1 AND 4000 THEN 'rationale' END,
  CASE WHEN n_factors > 12 THEN 'key_factors' END, CASE WHEN proposed_sl <= 0 OR proposed_sl > 10 THEN 'proposed_sl' END, CASE WHEN proposed_tp <= 0 OR proposed_tp > 20 THEN 'proposed_tp' END], {_KEEP}), ',') AS faults FROM (SELECT {_DEC} FROM lineitem)) GROUP BY 1""")
def decision_validation(spark: SparkSession, sf: str) -> DataFrame:
    d = a.table(spark, sf, "lineitem").select(
        F.when(F.col("l_partkey") % 29 == 0, "HOLD").when(F.col("l_partkey") % 3 == 0, "SELL").otherwise("BUY").alias("direction"), (F.col("l_quantity") / 45).alias("confidence"),
        F.expr("repeat('x', cast(l_suppkey % 7 as int))").alias("rationale"), (F.col("l_partkey") % 15).cast("int").alias("n_factors"), (F.col("l_discount") * 150 - 1).alias("proposed_sl"), (F.col("l_tax") * 300).alias("proposed_tp"),
    )
    return d.select(F.array_join(decide.decision_faults(), ",").alias("faults")).groupBy("faults").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, mode, o_orderdate AS as_of FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'online' WHEN '2-HIGH' THEN 'replay' WHEN '3-MEDIUM' THEN 'audit' ELSE 'other' END AS mode FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_shipdate = o.o_orderdate AND CASE l_returnflag WHEN 'R' THEN 'online' WHEN 'N' THEN 'replay' ELSE 'audit' END = o.mode)")
def evaluation_binding(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'online' WHEN '2-HIGH' THEN 'replay' WHEN '3-MEDIUM' THEN 'audit' ELSE 'other' END")
    p = a.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("mode"), F.col("o_orderdate").alias("as_of"))
    e = a.table(spark, sf, "lineitem").select(F.expr("CASE l_returnflag WHEN 'R' THEN 'online' WHEN 'N' THEN 'replay' ELSE 'audit' END").alias("mode"), F.col("l_shipdate").alias("as_of"))
    return decide.binding_errors(p, e)


@query("""SELECT refusal, count(*) AS n FROM (SELECT CASE WHEN l_suppkey % 20 = 0 THEN 'disabled' WHEN l_partkey % 5 = 0 THEN 'not_approved' WHEN l_linenumber = 7 THEN 'missing_sl_tp' WHEN l_discount <= 0 OR l_discount > 0.08 THEN 'volume' WHEN l_quantity < 10 THEN 'cooldown'
  WHEN l_suppkey % 7 = 0 THEN 'trading_disabled' WHEN l_returnflag = 'R' THEN 'not_demo' WHEN l_discount <> l_tax THEN 'broker_volume' WHEN l_partkey % 2 = 1 THEN 'position_exists' WHEN l_linenumber >= 3 THEN 'max_positions' END AS refusal FROM lineitem) GROUP BY 1""")
def live_gate_chain(spark: SparkSession, sf: str) -> DataFrame:
    x = a.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 20 != 0).alias("enabled"), (F.col("l_partkey") % 5 != 0).alias("approved"), F.when(F.col("l_linenumber") != 7, F.lit(1.0)).alias("sl_pct"), F.lit(2.0).alias("tp_pct"), F.col("l_discount").alias("volume"),
        (F.col("l_quantity") * 3).alias("minutes_since_last"), (F.col("l_suppkey") % 7 != 0).alias("trading_enabled"), F.when(F.col("l_returnflag") == "R", "live").otherwise("demo").alias("environment"), F.col("l_tax").alias("broker_volume"),
        (F.col("l_partkey") % 2).alias("own_positions"), F.col("l_linenumber").alias("open_positions"),
    )
    return x.groupBy(decide.live_refusal(0.08).alias("refusal")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, greatest(l_quantity / 50, 0.5::DOUBLE) AS probability, l_discount - 0.02::DOUBLE AS stop_loss, (CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * l_tax AS take_profit,
  CASE WHEN l_returnflag = 'N' THEN 'not_an_order' WHEN l_discount - 0.02::DOUBLE <= 0 THEN 'stop_loss' WHEN l_tax <= 0 THEN 'take_profit' END AS fault FROM lineitem""")
def order_validation(spark: SparkSession, sf: str) -> DataFrame:
    x = a.table(spark, sf, "lineitem").select("*", F.when(F.col("l_returnflag") == "R", "SELL").when(F.col("l_returnflag") == "A", "BUY").otherwise("NO_TRADE").alias("direction"), (F.col("l_quantity") / 50).alias("confidence"), (F.col("l_discount") - 0.02).alias("sl_pct"), F.col("l_tax").alias("tp_pct"))
    return x.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), *decide.order_fields())


@query("""WITH w AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE p_brand || '?' END AS query FROM part), c AS (SELECT DISTINCT query, p_brand AS symbol FROM w JOIN (SELECT DISTINCT p_brand FROM part) ON left(lower(p_brand), 7) = left(lower(query), 7))
SELECT query, CASE WHEN coalesce(n_exact, 0) = 1 THEN hit WHEN n = 1 THEN sole END AS resolved, CASE WHEN coalesce(n_exact, 0) = 1 OR n = 1 THEN 'ok' WHEN n IS NULL THEN 'unknown' ELSE 'ambiguous' END AS outcome
FROM w LEFT JOIN (SELECT query, count(*) AS n, count(*) FILTER (WHERE lower(symbol) = lower(query)) AS n_exact, min(symbol) FILTER (WHERE lower(symbol) = lower(query)) AS hit, min(symbol) AS sole FROM c GROUP BY 1) USING (query)""")
def symbol_resolution(spark: SparkSession, sf: str) -> DataFrame:
    p = a.table(spark, sf, "part")
    w = p.select(F.when(F.col("p_partkey") % 3 == 0, F.lower("p_brand")).otherwise(F.concat("p_brand", F.lit("?"))).alias("query")).distinct()
    head = lambda c: F.substring(F.lower(c), 1, 7)
    c = w.withColumn("h", head("query")).join(p.select(F.col("p_brand").alias("symbol")).distinct().withColumn("h", head("symbol")), "h").select("query", "symbol")
    return decide.resolve_symbols(w, c)


@query(f"""SELECT symbol, bar_close, mid, round(CASE WHEN ask <> 0 THEN (ask - bid) / ask * 100 ELSE 0.0 END, 6) AS spread_pct, lag_seconds, lag_seconds <= 90 AS reliable, round(CASE WHEN lag_seconds <= 90 THEN mid - close END, 6) AS basis
FROM (SELECT *, (bid + ask) / 2 AS mid, abs(qs)::DOUBLE AS lag_seconds FROM (SELECT symbol, close_time AS bar_close, close, close - 0.25::DOUBLE AS bid, close + 0.5::DOUBLE AS ask, (epoch(close_time)::BIGINT // 900) % 200 - 60 AS qs FROM ({a.bars_sql('15min')})))""")
def quote_basis(spark: SparkSession, sf: str) -> DataFrame:
    b = a.bars(spark, sf, "15min").withColumn("bar_close", F.col("close_time"))
    q = F.pmod((F.unix_seconds(F.col("bar_close").cast("timestamp")) / 900).cast("long"), F.lit(200)) - 60
    x = b.select("symbol", "bar_close", F.col("close").alias("feed_price"), (F.col("close") - 0.25).alias("bid"), (F.col("close") + 0.5).alias("ask"), (F.col("bar_close") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), q)).alias("quote_time"))
    r = x.select("symbol", "bar_close", *decide.basis())
    return r.withColumns({"spread_pct": round_to("spread_pct", 6), "basis": round_to("basis", 6)})


#: Prices per token of made-up models (parameters of the estimate).
PRICES = {"small": (1e-6, 5e-6), "small-v2": (2e-6, 6e-6), "large": (4e-6, 2e-5)}


@query("""SELECT id, model, round(CASE WHEN model = 'small' THEN i * 1e-6::DOUBLE + o * 5e-6::DOUBLE WHEN model = 'small-v2' THEN i * 2e-6::DOUBLE + o * 6e-6::DOUBLE WHEN model = 'large' THEN i * 4e-6::DOUBLE + o * 2e-5::DOUBLE WHEN starts_with(model, 'small') THEN i * 1e-6::DOUBLE + o * 5e-6::DOUBLE WHEN starts_with(model, 'large') THEN i * 4e-6::DOUBLE + o * 2e-5::DOUBLE END, 6) AS cost
FROM (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'small' WHEN 1 THEN 'small-v2' WHEN 2 THEN 'large-2024' WHEN 3 THEN 'small-v2-b' ELSE 'other' END AS model, o_custkey AS i, o_orderkey % 900 AS o FROM orders)""")
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    c = a.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, "small").when(k == 1, "small-v2").when(k == 2, "large-2024").when(k == 3, "small-v2-b").otherwise("other").alias("model"), F.col("o_custkey").alias("tokens_in"), (F.col("o_orderkey") % 900).alias("tokens_out"))
    return decide.estimate_cost(c, PRICES).select("id", "model", "cost")


@query("SELECT doc_id, round(t * 1e-6::DOUBLE + 0.005::DOUBLE + t * 1e-6::DOUBLE * 0.25::DOUBLE, 6) AS estimate FROM (SELECT doc_id, floor(n_chars / 4 * 1.2::DOUBLE)::BIGINT AS t FROM documents)")
def attempt_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return a.table(spark, sf, "documents").select("doc_id", decide.attempt_estimate("n_chars", 1e-6, 5e-6, 1000).alias("estimate"))


@query("SELECT direction, external, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 3 = 0 THEN 'SELL' WHEN l_partkey % 3 = 1 THEN 'BUY' ELSE 'NO_TRADE' END AS direction, CASE WHEN l_partkey % 3 = 0 THEN 'Sell' WHEN l_partkey % 3 = 1 THEN 'Buy' ELSE 'NoTrade' END AS external FROM lineitem) GROUP BY ALL")
def direction_names(spark: SparkSession, sf: str) -> DataFrame:
    x = a.table(spark, sf, "lineitem").select(F.when(F.col("l_partkey") % 3 == 0, "SELL").when(F.col("l_partkey") % 3 == 1, "BUY").otherwise("NO_TRADE").alias("direction"))
    return x.withColumn("external", decide.external_direction()).groupBy("direction", "external").agg(F.count("*").alias("n"))
