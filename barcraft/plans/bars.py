"""Bars, validation and calendar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcraft.functions.market_calendar import CALENDARS, EVENTS_CALENDAR
from barcraft.operators import validate
from barcraft.plans.registry import query
from barcraft.sources import adapters as a
from barcraft.sources.readers import tail
from barcraft.sources.schemas import TIMEFRAMES

_OUT = ["symbol", "tf", "open_time", "close_time", "open", "high", "low", "close", "volume"]


@query(a.bars_sql("15min"))
def bars_15min(spark: SparkSession, sf: str) -> DataFrame:
    return a.bars(spark, sf, "15min")


@query(" UNION ALL ".join(f"SELECT tf, symbol, count(*) AS bars, sum(volume) AS volume, min(low) AS low, max(high) AS high FROM ({a.bars_sql(tf)}) GROUP BY 1, 2" for tf in ("15min", "1h", "4h", "1day")))
def bars_multi_tf(spark: SparkSession, sf: str) -> DataFrame:
    b = a.bars_of(spark, sf, ["15min", "1h", "4h", "1day"])
    return b.groupBy("tf", "symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"), F.min("low").alias("low"), F.max("high").alias("high"))


@query(a.DAILY_SQL)
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return a.daily_bars(spark, sf)


@query("""SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS slot15, time_bucket(INTERVAL 4 HOUR, ts) AS slot4h,
  epoch_us(ts) % 900000000 = 0 AS aligned15, epoch_us(date_trunc('minute', ts)) % 300000000 = 0 AS on_five FROM events""")
def grid_floor(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events")
    five = F.unix_micros(F.date_trunc("minute", F.col("ts").cast("timestamp"))) % 300_000_000 == 0
    return e.select("event_id", validate.floor_to_grid("ts", "15min").alias("slot15"), validate.floor_to_grid("ts", "4h").alias("slot4h"), validate.is_grid_aligned("ts", "15min").alias("aligned15"), five.alias("on_five"))


@query(f"SELECT * FROM ({a.bars_sql('1h')}) WHERE close_time <= TIMESTAMP '2024-01-15 12:30:00'")
def closed_bars(spark: SparkSession, sf: str) -> DataFrame:
    return validate.only_closed(a.bars(spark, sf, "1h"), "2024-01-15 12:30:00")


@query(f"SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY open_time DESC) AS n FROM ({a.bars_sql('15min')})) WHERE n <= 250")
def tail_window(spark: SparkSession, sf: str) -> DataFrame:
    return tail(a.bars(spark, sf, "15min"), 250)


# Order rows as bars of which some break each rule: the events are sound, so the faults come
# from the key.
_ROUGH_SQL = """SELECT o_orderkey AS id, o_orderdate AS open_time, o_orderdate + CASE WHEN o_orderkey % 11 = 0 THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END AS close_time,
  CASE WHEN o_orderkey % 13 = 0 THEN -o_totalprice ELSE o_totalprice END AS open, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice - 1 ELSE o_totalprice + 5 END AS high,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 2 ELSE o_totalprice - 5 END AS low, o_totalprice + 1 AS close,
  CASE WHEN o_orderkey % 17 = 0 THEN -1.0::DOUBLE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 1.0::DOUBLE END AS volume FROM orders"""


@query(f"""SELECT id, array_to_string(list_filter([
  CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'price_not_positive' END, CASE WHEN volume IS NULL OR volume < 0 THEN 'bad_volume' END,
  CASE WHEN close_time <= open_time THEN 'close_not_after_open' END, CASE WHEN high < greatest(open, close) THEN 'high_below_body' END,
  CASE WHEN low > least(open, close) THEN 'low_above_body' END], lambda x: x IS NOT NULL), ',') AS violations FROM ({_ROUGH_SQL})""")
def bar_validation(spark: SparkSession, sf: str) -> DataFrame:
    o, k, p = a.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    rough = o.select(
        k.alias("id"), F.col("o_orderdate").alias("open_time"), F.when(k % 11 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("interval 1 day")).alias("close_time"),
        F.when(k % 13 == 0, -p).otherwise(p).alias("open"), F.when(k % 7 == 0, p - 1).otherwise(p + 5).alias("high"), F.when(k % 5 == 0, p + 2).otherwise(p - 5).alias("low"), (p + 1).alias("close"),
        F.when(k % 17 == 0, F.lit(-1.0)).when(k % 19 != 0, F.lit(1.0)).alias("volume"),
    )
    return rough.select("id", F.concat_ws(",", validate.row_violations()).alias("violations"))


# The 15-minute series with some bars moved off the grid, cut short or repeated.
_SHIFTED_SQL = f"""SELECT symbol, tf, idx, open_time + CASE WHEN idx % 101 = 7 THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END - CASE WHEN idx % 89 = 5 THEN INTERVAL 45 MINUTE ELSE INTERVAL 0 MINUTE END AS open_time,
  close_time - CASE WHEN idx % 97 = 11 THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END + CASE WHEN idx % 101 = 7 THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END - CASE WHEN idx % 89 = 5 THEN INTERVAL 45 MINUTE ELSE INTERVAL 0 MINUTE END AS close_time
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS idx FROM ({a.bars_sql('15min')}))"""


@query(f"""WITH s AS (SELECT *, lag(open_time) OVER w AS po, lag(close_time) OVER w AS pc FROM ({_SHIFTED_SQL}) WINDOW w AS (PARTITION BY symbol, tf ORDER BY idx)),
e AS (SELECT *, CASE WHEN epoch_us(open_time) % 900000000 <> 0 THEN 'off_grid' WHEN epoch_us(close_time) - epoch_us(open_time) <> 900000000 THEN 'wrong_duration'
  WHEN open_time <= po THEN 'not_increasing' WHEN open_time < pc THEN 'overlap' END AS error FROM s)
SELECT symbol, tf, arg_min(error, idx) AS error, min(idx) AS idx, count(*) AS n_errors FROM e WHERE error IS NOT NULL GROUP BY 1, 2""")
def series_validation(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    b = a.bars(spark, sf, "15min").withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("open_time")))
    moved = F.expr("case when idx % 101 = 7 then 1 else 0 end - case when idx % 89 = 5 then 45 else 0 end")
    shift = lambda c, m: F.col(c) + F.make_dt_interval(F.lit(0), F.lit(0), m)
    s = b.select("symbol", "tf", "idx", shift("open_time", moved).alias("open_time"), shift("close_time", moved - F.expr("case when idx % 97 = 11 then 5 else 0 end")).alias("close_time"))
    return validate.series_errors(s)


def _gaps_sql(tf: str) -> str:
    m = TIMEFRAMES[tf]
    return f"""SELECT symbol, tf, after, before, round((epoch_us(before) - epoch_us(after)) / {m * 60_000_000}.0)::BIGINT AS missing_bars
  FROM (SELECT symbol, tf, lag(close_time) OVER (PARTITION BY symbol, tf ORDER BY open_time) AS after, open_time AS before FROM ({a.bars_sql(tf)})) WHERE before > after"""


def _kinds_sql(tf: str) -> str:
    m = TIMEFRAMES[tf]
    return f"""SELECT symbol, tf, after, before, missing_bars, CASE WHEN bool_or({EVENTS_CALENDAR.duckdb('t')}) THEN 'unexpected_missing_bar' ELSE 'expected_session_gap' END AS kind
  FROM (SELECT *, unnest(generate_series(after, before - INTERVAL {m} MINUTE, INTERVAL {m} MINUTE)) AS t FROM ({_gaps_sql(tf)})) GROUP BY ALL"""


@query(_gaps_sql("15min"))
def bar_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return validate.gaps(a.bars(spark, sf, "15min"))


@query(_kinds_sql("15min"))
def gap_session_class(spark: SparkSession, sf: str) -> DataFrame:
    return validate.classify_gaps(validate.gaps(a.bars(spark, sf, "15min")), EVENTS_CALENDAR)


@query(" UNION ALL ".join(f"""SELECT b.symbol, b.tf, b.bars, coalesce(k.gaps, 0) AS gaps, coalesce(k.unexpected, 0) AS unexpected,
  CASE WHEN bars < 200 THEN 'insufficient' WHEN coalesce(unexpected, 0) > 0 THEN 'degraded' WHEN coalesce(gaps, 0) > 0 THEN 'expected_gaps' ELSE 'ok' END AS verdict
  FROM (SELECT symbol, tf, count(*) AS bars FROM ({a.bars_sql(tf)}) GROUP BY 1, 2) b
  LEFT JOIN (SELECT symbol, tf, count(*) AS gaps, count(*) FILTER (WHERE kind = 'unexpected_missing_bar') AS unexpected FROM ({_kinds_sql(tf)}) GROUP BY 1, 2) k USING (symbol, tf)""" for tf in ("15min", "1h", "4h", "1day")))
def tf_quality(spark: SparkSession, sf: str) -> DataFrame:
    return validate.quality(a.bars_of(spark, sf, ["15min", "1h", "4h", "1day"]), EVENTS_CALENDAR, 200)


#: Times of the year that the provider calendars know: those of orders, 28 years on (the same weekdays).
_ORDER_TIMES = "SELECT o_orderkey AS id, o_orderdate + INTERVAL 28 YEAR + to_minutes(((o_orderkey % 96) * 15)::INT) AS ts FROM orders UNION ALL SELECT event_id, ts FROM events"
_PROFILE = " UNION ALL ".join(f"SELECT '{p}' AS provider, id, ts, {CALENDARS[p].duckdb('ts')} AS is_open FROM times" for p in ("polygon", "xtb"))


@query(f"WITH times AS ({_ORDER_TIMES}) {_PROFILE}")
def session_open_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each provider's market was open at the times of all orders and events."""
    o = a.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_orderdate + interval 28 years + make_dt_interval(0, 0, cast(o_orderkey % 96 as int) * 15)").alias("ts"))
    times = o.unionByName(a.table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts"))
    each = [times.select(F.lit(p).alias("provider"), "id", "ts", CALENDARS[p].is_open("ts").alias("is_open")) for p in ("polygon", "xtb")]
    return each[0].unionByName(each[1])


@query(f"SELECT symbol, dayofweek(ts) AS dow, count(*) AS ticks, count(*) FILTER (WHERE {EVENTS_CALENDAR.duckdb('ts')}) AS in_session FROM ({a.TICKS_SQL}) GROUP BY 1, 2")
def ticks_in_session(spark: SparkSession, sf: str) -> DataFrame:
    t = a.ticks(spark, sf)
    return t.groupBy("symbol", (F.dayofweek("ts") - 1).cast("long").alias("dow")).agg(F.count("*").alias("ticks"), F.count_if(EVENTS_CALENDAR.is_open("ts")).alias("in_session"))


@query(f"""WITH b AS (SELECT * FROM ({a.bars_sql('1h')})), k AS (SELECT symbol, before FROM ({_kinds_sql('1h')}) WHERE kind = 'unexpected_missing_bar')
SELECT symbol, open_time, close_time, coalesce(max(gap) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), false) AS recent_gap
FROM (SELECT b.symbol, open_time, close_time, k.before IS NOT NULL AS gap FROM b LEFT JOIN k ON k.symbol = b.symbol AND k.before = b.open_time)""")
def recent_unexpected_gap(spark: SparkSession, sf: str) -> DataFrame:
    return validate.recent_unexpected(a.bars(spark, sf, "1h"), EVENTS_CALENDAR, {"1h": 6}).select("symbol", "open_time", "close_time", "recent_gap")
