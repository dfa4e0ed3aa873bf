"""Indicator, feature, as-of and news queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcraft.functions.numeric import round_to
from barcraft.functions.market_calendar import EVENTS_CALENDAR
from barcraft.operators import asof, features, indicators, validate
from barcraft.operators.decide import EligibilityPolicy
from barcraft.operators.recurrences import sliced_indicators
from barcraft.plans.registry import query
from barcraft.sources import adapters as a
from barcraft.sources.sinks import settled

# One recursion over the daily series gives every recurrence in the same order of operations.
_DAILY = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS rn, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS pc, lag(high) OVER (PARTITION BY symbol ORDER BY open_time) AS ph, lag(low) OVER (PARTITION BY symbol ORDER BY open_time) AS pl FROM ({a.DAILY_SQL})"


def _moves(bars: str) -> str:
    return f"""SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, greatest(close - pc, 0.0) AS gain, greatest(pc - close, 0.0) AS loss,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS mdm FROM ({bars})"""


def _ema(col: str, p: int, x: str = "b.close") -> str:
    return f"CASE WHEN b.rn < {p} THEN r.{col} + {x} WHEN b.rn = {p} THEN (r.{col} + {x}) / {p} ELSE {x} * {2.0 / (p + 1)!r}::DOUBLE + r.{col} * (1.0 - {2.0 / (p + 1)!r}::DOUBLE) END"


def _rma(col: str, x: str, p: int = 14, skip: int = 0) -> str:
    """Wilder's average whose values begin at row 1 + skip."""
    first = f"WHEN b.rn <= {skip} THEN 0.0 " if skip else ""
    return f"CASE {first}WHEN b.rn - {skip} < {p} THEN r.{col} + {x} WHEN b.rn - {skip} = {p} THEN (r.{col} + {x}) / {p} ELSE (r.{col} * {p - 1} + {x}) / {p} END"


def recurrence_sql(bars: str, fast: int = 21, slow: int = 50, trend: int = 200, p: int = 14) -> str:
    """CTEs m (moves) and v (values per bar; null in warm-up)."""
    dx = lambda pd, md: f"CASE WHEN {pd} + {md} = 0 THEN NULL ELSE 100.0 * abs({pd} - {md}) / ({pd} + {md}) END"
    nxt = {"ef": _ema("ef", fast), "es": _ema("es", slow), "et": _ema("et", trend), "atr": _rma("atr", "b.tr", p), "ag": _rma("ag", "b.gain", p, 1), "al": _rma("al", "b.loss", p, 1), "ap": _rma("ap", "b.pdm", p), "am": _rma("am", "b.mdm", p)}
    n = f"({nxt['atr']})"
    pd, md = f"(100.0 * ({nxt['ap']}) / {n})", f"(100.0 * ({nxt['am']}) / {n})"
    x = dx(pd, md)
    first = 1 + p  # dx has a value from row p on
    ax = f"CASE WHEN b.rn < {p} THEN 0.0 WHEN b.rn - {p - 1} < {p} THEN r.ax + {x} WHEN b.rn - {p - 1} = {p} THEN (r.ax + {x}) / {p} ELSE coalesce((r.ax * {p - 1} + {x}) / {p}, r.ax) END"
    del first
    return f"""m AS MATERIALIZED ({_moves(bars)}),
r AS (SELECT symbol, rn, close AS ef, close AS es, close AS et, tr AS atr, 0.0::DOUBLE AS ag, 0.0::DOUBLE AS al, pdm::DOUBLE AS ap, mdm::DOUBLE AS am, 0.0::DOUBLE AS ax FROM m WHERE rn = 1
  UNION ALL SELECT b.symbol, b.rn, {nxt['ef']}, {nxt['es']}, {nxt['et']}, {nxt['atr']}, {nxt['ag']}, {nxt['al']}, {nxt['ap']}, {nxt['am']}, {ax} FROM r JOIN m b ON b.symbol = r.symbol AND b.rn = r.rn + 1),
v AS MATERIALIZED (SELECT m.*, CASE WHEN rn >= {fast} THEN ef END AS ema_fast, CASE WHEN rn >= {slow} THEN es END AS ema_slow, CASE WHEN rn >= {trend} THEN et END AS ema_trend, CASE WHEN rn >= {p} THEN r.atr END AS atr,
  CASE WHEN rn > {p} THEN CASE WHEN al = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + ag / al) END END AS rsi, CASE WHEN rn >= {2 * p - 1} THEN ax END AS adx,
  CASE WHEN rn >= {p} THEN 100.0 * ap / r.atr END AS plus_di, CASE WHEN rn >= {p} THEN 100.0 * am / r.atr END AS minus_di FROM m JOIN r USING (symbol, rn))"""


_REC = "WITH RECURSIVE " + recurrence_sql(_DAILY)
_KEYS = ["symbol", "open_time"]


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.indicator_frame(a.daily_bars(spark, sf))


@query(f"""SELECT symbol, open_time, round(CASE WHEN count(*) OVER w >= 20 THEN sum(close) OVER w / 20 END, 6) AS sma20, round(CASE WHEN count(*) OVER w >= 20 THEN sum(close / 1000) OVER w / 20 END, 8) AS sma20_fine
FROM ({a.DAILY_SQL}) WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def sma(spark: SparkSession, sf: str) -> DataFrame:
    """Of the closes and of the closes as quotes with five decimals."""
    fine = a.daily_bars(spark, sf).withColumn("fine", F.col("close") / 1000)
    return fine.select(*_KEYS, round_to(indicators.sma("close", 20), 6).alias("sma20"), round_to(indicators.sma("fine", 20), 8).alias("sma20_fine"))


@query(f"SELECT symbol, open_time, round(tr, 6) AS tr FROM ({_moves(_DAILY)})")
def true_range(spark: SparkSession, sf: str) -> DataFrame:
    return a.daily_bars(spark, sf).select(*_KEYS, round_to(indicators.true_range(), 6).alias("tr"))


@query(f"{_REC} SELECT symbol, open_time, round(ema_fast, 6) AS ema21, round(ema_slow, 6) AS ema50, round(ema_trend, 6) AS ema200 FROM v")
def ema(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select(*_KEYS, round_to("ema_fast", 6).alias("ema21"), round_to("ema_slow", 6).alias("ema50"), round_to("ema_trend", 6).alias("ema200"))


@query(f"{_REC} SELECT symbol, open_time, round(atr, 6) AS atr, round(atr / close * 100, 3) AS atr_pct FROM v")
def rma_atr(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select(*_KEYS, round_to("atr", 6).alias("atr"), round_to(F.col("atr") / F.col("close") * 100, 3).alias("atr_pct"))


@query(f"{_REC} SELECT symbol, open_time, round(rsi, 6) AS rsi FROM v")
def rsi(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select(*_KEYS, round_to("rsi", 6).alias("rsi"))


@query(f"{_REC} SELECT symbol, open_time, round(adx, 6) AS adx, round(plus_di, 6) AS plus_di, round(minus_di, 6) AS minus_di FROM v")
def adx(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select(*_KEYS, *[round_to(c, 6).alias(c) for c in ("adx", "plus_di", "minus_di")])


_SLICED = ("ema_fast", "ema_slow", "ema_trend", "atr", "rsi", "adx", "plus_di", "minus_di")


@query(f"{_REC} SELECT symbol, open_time, " + ", ".join(f"round({c}, 3) AS {c}" for c in _SLICED) + " FROM v")
def averages_in_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The same averages with series cut into slices of 400 bars, as long ones would be."""
    found = sliced_indicators(a.daily_bars(spark, sf), slice_rows=400, levels=False)
    return found.select(*_KEYS, *[round_to(c, 3).alias(c) for c in _SLICED])


_SLOPE = "CASE WHEN count({c}) OVER w20 >= 2 THEN regr_slope({c}, rn) OVER w20 ELSE 0.0 END"
_W20 = "WINDOW w20 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(f"SELECT symbol, open_time, round({_SLOPE.format(c='close')}, 4) AS slope FROM ({_DAILY}) {_W20}")
def linreg_slope(spark: SparkSession, sf: str) -> DataFrame:
    b = a.daily_bars(spark, sf).withColumn("rn", F.row_number().over(indicators.ordered()))
    return b.select(*_KEYS, round_to(indicators.linreg_slope("close"), 4).alias("slope"))


def _swings_sql(bars: str) -> str:
    side = lambda c, op: " AND ".join(f"coalesce({c} {op} {f}({c}, {k}) OVER w, false)" for f in ("lag", "lead") for k in (1, 2))
    return f"SELECT *, {side('high', '>')} AS swing_high, {side('low', '<')} AS swing_low FROM ({bars}) WINDOW w AS (PARTITION BY symbol ORDER BY open_time)"


@query(f"SELECT symbol, open_time, swing_high, swing_low FROM ({_swings_sql(_DAILY)})")
def swing_points(spark: SparkSession, sf: str) -> DataFrame:
    return a.daily_bars(spark, sf).select(*_KEYS, indicators.swing("high", True).alias("swing_high"), indicators.swing("low", False).alias("swing_low"))


def _levels_sql(swings: str) -> str:
    return f"""SELECT b.symbol, b.rn, min(s.high) FILTER (WHERE s.swing_high AND s.high > b.close) AS above, max(s.low) FILTER (WHERE s.swing_low AND s.low < b.close) AS below
  FROM {swings} b LEFT JOIN {swings} s ON s.symbol = b.symbol AND s.rn <= b.rn - 2 AND (s.swing_high OR s.swing_low) GROUP BY 1, 2"""


@query(f"""WITH s AS MATERIALIZED ({_swings_sql(_DAILY)}), l AS ({_levels_sql('s')})
SELECT symbol, open_time, round((above - close) / close * 100, 3) AS resistance_pct, round((close - below) / close * 100, 3) AS support_pct FROM s JOIN l USING (symbol, rn)""")
def nearest_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select(*_KEYS, round_to("resistance_pct", 3).alias("resistance_pct"), round_to("support_pct", 3).alias("support_pct"))


_ALIGN = "CASE WHEN ema_fast > ema_slow AND ema_slow > ema_trend THEN 'up' WHEN ema_fast < ema_slow AND ema_slow < ema_trend THEN 'down' ELSE 'mixed' END"
_REGIME = "CASE WHEN adx >= 25 AND ema_align = 'up' AND slope > 0 THEN 'bull_trend' WHEN adx >= 25 AND ema_align = 'down' AND slope < 0 THEN 'bear_trend' WHEN adx < 20 THEN 'range' ELSE 'choppy' END"


def features_sql(v: str = "v", min_bars: int = 200) -> str:
    return f"""SELECT symbol, tf, open_time, close_time, rn, {_REGIME} AS regime, ema_align, round(adx, 1) AS adx, round(rsi, 1) AS rsi, round(atr / close * 100, 3) AS atr_pct, round(slope * 100, 4) AS slope_pct, round(close, 4) AS close
  FROM (SELECT *, {_ALIGN} AS ema_align, {_SLOPE.format(c='ema_slow')} / close AS slope FROM {v} {_W20}) WHERE rn >= {min_bars}"""


@query(f"{_REC}, f AS ({features_sql()}), s AS MATERIALIZED ({_swings_sql('SELECT symbol, open_time, rn, high, low, close FROM m')}), l AS ({_levels_sql('s')}) SELECT f.*, round((above - close) / close * 100, 3) AS resistance_pct, round((close - below) / close * 100, 3) AS support_pct FROM f JOIN l USING (symbol, rn)")
def timeframe_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.timeframe_features(a.daily_bars(spark, sf))


@query(f"{_REC} SELECT symbol, regime, ema_align, count(*) AS bars FROM ({features_sql()}) GROUP BY ALL")
def regime_profile(spark: SparkSession, sf: str) -> DataFrame:
    return features.timeframe_features(a.daily_bars(spark, sf)).groupBy("symbol", "regime", "ema_align").agg(F.count("*").alias("bars"))


#: The events cover one month, so packets use short periods on every timeframe.
SHORT, SHORT_WILDER, SHORT_BARS = {"ema_fast": 3, "ema_slow": 5, "ema_trend": 8}, 4, 12


def packets(spark: SparkSession, sf: str, flagged: bool = False, fine: DataFrame | None = None) -> DataFrame:
    """Packets of the events; with ``flagged`` each role's recent-gap flag goes along."""
    b = a.bars_of(spark, sf, list(features.ROLES.values()), fine)
    if flagged:
        b = validate.recent_unexpected(b, EVENTS_CALENDAR, dict(EligibilityPolicy().recent_bars))
    found = features.timeframe_features(b, SHORT_BARS, SHORT, SHORT_WILDER, ("recent_gap",) if flagged else ())
    return features.feature_packets(settled(found, "features"))  # carried in slices: looked at twice


def _short(tf: str) -> str:
    bars = f"SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM ({a.bars_sql(tf)}) WINDOW w AS (PARTITION BY symbol ORDER BY open_time)"
    return f"(WITH RECURSIVE {recurrence_sql(bars, 3, 5, 8, SHORT_WILDER)} {features_sql('v', SHORT_BARS)})"


_CONFLUENCE = """CASE WHEN macro_align = 'up' AND trend_regime = 'bull_trend' AND structure_regime = 'bull_trend' THEN 'aligned_bull'
  WHEN macro_align = 'down' AND trend_regime = 'bear_trend' AND structure_regime = 'bear_trend' THEN 'aligned_bear'
  WHEN trend_regime = 'bull_trend' AND trigger_regime IN ('range', 'choppy') THEN 'bull_pullback'
  WHEN trend_regime = 'bear_trend' AND trigger_regime IN ('range', 'choppy') THEN 'bear_pullback' ELSE 'mixed' END"""

PACKETS_CTE = f"""f15 AS MATERIALIZED (SELECT * FROM {_short('15min')}), f60 AS MATERIALIZED (SELECT * FROM {_short('1h')}), f240 AS MATERIALIZED (SELECT * FROM {_short('4h')}), fd AS MATERIALIZED (SELECT * FROM {_short('1day')}),
packets AS MATERIALIZED (SELECT *, {_CONFLUENCE} AS confluence FROM (
  SELECT t.symbol, t.close_time AS as_of, t.close AS price, t.regime AS trigger_regime, t.atr_pct AS atr_pct_trigger, t.rsi AS rsi_trigger, s.close_time AS structure_close, s.regime AS structure_regime, s.ema_align AS structure_align, s.adx AS structure_adx,
    r.close_time AS trend_close, r.regime AS trend_regime, r.ema_align AS trend_align, r.adx AS trend_adx, m.close_time AS macro_close, m.regime AS macro_regime, m.ema_align AS macro_align, m.adx AS macro_adx
  FROM f15 t ASOF JOIN f60 s ON s.symbol = t.symbol AND t.close_time >= s.close_time ASOF JOIN f240 r ON r.symbol = t.symbol AND t.close_time >= r.close_time ASOF JOIN fd m ON m.symbol = t.symbol AND t.close_time >= m.close_time))"""


@query(f"WITH {PACKETS_CTE} SELECT * FROM packets")
def mtf_asof_packet(spark: SparkSession, sf: str) -> DataFrame:
    return packets(spark, sf)


@query(f"WITH {PACKETS_CTE} SELECT symbol, confluence, count(*) AS n FROM packets GROUP BY ALL")
def confluence(spark: SparkSession, sf: str) -> DataFrame:
    return packets(spark, sf).groupBy("symbol", "confluence").agg(F.count("*").alias("n"))


_AS_OF = "2024-01-20 12:00:00"


@query(f"SELECT * FROM ({a.NEWS_SQL}) WHERE publication_time <= TIMESTAMP '{_AS_OF}' AND ingestion_time <= TIMESTAMP '{_AS_OF}'")
def news_visible(spark: SparkSession, sf: str) -> DataFrame:
    return asof.visible(a.news_revisions(spark, sf), _AS_OF)


@query(f"SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY revision DESC, ingestion_time DESC, publication_time DESC) AS n FROM ({a.NEWS_SQL}) WHERE publication_time <= TIMESTAMP '{_AS_OF}' AND ingestion_time <= TIMESTAMP '{_AS_OF}') WHERE n = 1")
def news_asof_view(spark: SparkSession, sf: str) -> DataFrame:
    return asof.latest_revisions(a.news_revisions(spark, sf), _AS_OF)


def _instants(spark: SparkSession, sf: str) -> DataFrame:
    return a.bars(spark, sf, "15min").select("symbol", F.col("close_time").alias("as_of"))


_INSTANTS = f"SELECT symbol, close_time AS as_of FROM ({a.bars_sql('15min')})"


BLACKOUT_SQL = f"""SELECT symbol, as_of, arg_min(label, scheduled_at) AS event, min(scheduled_at) AS event_at FROM ({_INSTANTS}) i
LEFT JOIN (SELECT * FROM ({a.EVENTS_SQL}) WHERE impact IN ('high', 'medium')) e ON as_of BETWEEN scheduled_at - INTERVAL 60 MINUTE AND scheduled_at + INTERVAL 30 MINUTE GROUP BY 1, 2"""


@query(BLACKOUT_SQL)
def blackout(spark: SparkSession, sf: str) -> DataFrame:
    return asof.blackout(_instants(spark, sf), a.scheduled_events(spark), 60, 30, ("high", "medium"))


@query(f"""SELECT * FROM (SELECT as_of, label, impact, scheduled_at, row_number() OVER (PARTITION BY as_of ORDER BY scheduled_at, label) AS nth, round_even((epoch_us(scheduled_at) - epoch_us(as_of)) / 60000000.0, 0)::BIGINT AS minutes_until
  FROM (SELECT DISTINCT as_of FROM ({_INSTANTS})) JOIN ({a.EVENTS_SQL}) ON scheduled_at > as_of AND scheduled_at <= as_of + INTERVAL 7 DAY) WHERE nth <= 3""")
def upcoming_events(spark: SparkSession, sf: str) -> DataFrame:
    return asof.upcoming(_instants(spark, sf), a.scheduled_events(spark), 7 * 1440)


@query(f"WITH {PACKETS_CTE} SELECT symbol, as_of, sha256(symbol || '|' || strftime(as_of, '%Y-%m-%dT%H:%M:%S') || '|' || confluence || '|v1') AS fingerprint FROM packets")
def decision_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return packets(spark, sf).select("symbol", "as_of", features.fingerprint("symbol", F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss"), "confluence", F.lit("v1")).alias("fingerprint"))


@query()
def decision_input_hash(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf).withColumn("spread_pct", F.lit(0.05))
    return features.canonical_hash(features.decision_input(p, "replay")).select("symbol", "as_of", "input_hash")


_FIELDS = "strftime(open_time, '%Y-%m-%dT%H:%M:%S.%f') || ',' || concat_ws(',', open + 0.00345::DOUBLE, high + 0.00345::DOUBLE, low + 0.00345::DOUBLE, close + 0.00345::DOUBLE, volume) || ';'"


@query(f"""WITH b AS ({a.bars_sql('15min')} UNION ALL {a.bars_sql('1h')}),
m AS (SELECT symbol, tf, strftime(open_time, '%Y-%m') AS month, sha256(string_agg({_FIELDS}, '' ORDER BY open_time)) AS h, count(*) AS n, min(open_time) AS f, max(open_time) AS l FROM b GROUP BY 1, 2, 3),
t AS (SELECT symbol, tf, sha256(string_agg(h, '' ORDER BY month)) AS h, sum(n)::BIGINT AS n, min(f) AS f, max(l) AS l FROM m GROUP BY 1, 2),
d AS (SELECT symbol, sha256('events|' || symbol || '|' || symbol || string_agg('|' || tf || '|' || h, '' ORDER BY tf)) AS sha256, string_agg(tf, ',' ORDER BY tf) AS timeframes, string_agg(tf || ':' || n, ',' ORDER BY tf) AS bar_counts, min(f) AS first_bar, max(l) AS last_bar FROM t GROUP BY 1)
SELECT symbol, left(sha256, 16) AS dataset_id, sha256, timeframes, bar_counts, first_bar, last_bar FROM d""")
def dataset_id(spark: SparkSession, sf: str) -> DataFrame:
    """Of bars whose prices have five decimals."""
    b = a.bars(spark, sf, "15min").unionByName(a.bars(spark, sf, "1h"))
    fine = b.withColumns({c: F.col(c) + 0.00345 for c in ("open", "high", "low", "close")})
    d = features.dataset_id(fine, "events")
    return d.withColumns({c: F.array_join(c, ",") for c in ("timeframes", "bar_counts")})


@query(f"SELECT as_of, label AS event, impact, round_even((epoch_us(scheduled_at) - epoch_us(as_of)) / 60000000.0, 0)::BIGINT AS in_minutes FROM (SELECT DISTINCT as_of FROM ({_INSTANTS})) JOIN ({a.EVENTS_SQL}) ON scheduled_at > as_of AND scheduled_at <= as_of + INTERVAL 7 DAY")
def event_digest(spark: SparkSession, sf: str) -> DataFrame:
    return asof.event_digest(asof.upcoming(_instants(spark, sf), a.scheduled_events(spark), 7 * 1440, len(a.EVENTS)))


_ITEMS = "SELECT source, external_id, revision, publication_time, ingestion_time, 'value ' || round(value)::BIGINT AS headline, CASE WHEN value > 300 THEN 'high' WHEN value > 100 THEN 'medium' ELSE 'low' END AS impact, CASE WHEN value < 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS sentiment_for_gold"


def _items(news: DataFrame) -> DataFrame:
    impact = F.when(F.col("value") > 300, "high").when(F.col("value") > 100, "medium").otherwise("low")
    return news.select("source", "external_id", "revision", "publication_time", "ingestion_time", F.concat(F.lit("value "), F.round("value").cast("long").cast("string")).alias("headline"), impact.alias("impact"), F.when(F.col("value") < 0, -0.5).otherwise(0.5).alias("sentiment_for_gold"))


@query(f"""SELECT source || ':' || external_id AS id, revision, strftime(publication_time, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(publication_time) % 1000000 <> 0 THEN '.' || lpad((epoch_us(publication_time) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS time, headline, impact, sentiment_for_gold FROM ({_ITEMS} FROM (
  SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY revision DESC, ingestion_time DESC, publication_time DESC) AS n FROM ({a.NEWS_SQL}) WHERE publication_time <= TIMESTAMP '{_AS_OF}' AND ingestion_time <= TIMESTAMP '{_AS_OF}') WHERE n = 1)""")
def news_digest(spark: SparkSession, sf: str) -> DataFrame:
    return asof.news_digest(_items(asof.latest_revisions(a.news_revisions(spark, sf), _AS_OF)))


@query(f"""SELECT source, external_id, revision, publication_time FROM (SELECT *, row_number() OVER (ORDER BY publication_time, source DESC, external_id DESC) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY revision DESC, ingestion_time DESC, publication_time DESC) AS n FROM ({a.NEWS_SQL}) WHERE publication_time <= TIMESTAMP '{_AS_OF}' AND ingestion_time <= TIMESTAMP '{_AS_OF}') WHERE n = 1) WHERE k <= 20""")
def static_news(spark: SparkSession, sf: str) -> DataFrame:
    return asof.static_news(a.news_revisions(spark, sf), 20, ["source", "external_id"], _AS_OF).select("source", "external_id", "revision", "publication_time")
