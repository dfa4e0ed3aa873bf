"""Logical inputs of the engine, made from the driver's tables.

Every query and its SQL counterpart start from these: ``*_SQL`` is the same relation for
DuckDB.  They are plain column expressions, so filters and column selection reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcraft.sources.schemas import minutes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive prices of events, one symbol per event type."""
    e = table(spark, sf_dir, "events").where("value > 0")
    return e.select(F.col("event_type").alias("symbol"), F.col("value").cast("decimal(12,2)").cast("double").alias("price"), "ts", F.col("event_id").alias("tick_id"))


TICKS_SQL = "SELECT event_type AS symbol, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS price, ts, event_id AS tick_id FROM events WHERE value > 0"


def ticks_to_bars(source: DataFrame, tf: str) -> DataFrame:
    """Tumbling bars on the epoch grid; partial sums are combined before the shuffle."""
    start = F.window("ts", f"{minutes(tf)} minutes")["start"]
    order = F.struct("ts", "tick_id")
    made = source.groupBy("symbol", start.alias("open_time")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return made.select("symbol", F.lit(tf).alias("tf"), "open_time", (F.col("open_time") + F.expr(f"interval {minutes(tf)} minutes")).alias("close_time"), "open", "high", "low", "close", "volume")


def bars_sql(tf: str) -> str:
    m = minutes(tf)
    return f"""SELECT symbol, '{tf}' AS tf, time_bucket(INTERVAL {m} MINUTE, ts) AS open_time, time_bucket(INTERVAL {m} MINUTE, ts) + INTERVAL {m} MINUTE AS close_time,
  arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, count(*)::DOUBLE AS volume
  FROM ({TICKS_SQL}) GROUP BY 1, 2, 3, 4"""


def bars(spark: SparkSession, sf_dir: str, tf: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), tf)


def rollup(fine: DataFrame, tfs: list[str]) -> DataFrame:
    """Coarser bars of several timeframes from fine ones in one pass and one shuffle: ticks
    are read once and the fine bars, already small, are regrouped per timeframe."""
    listed = ", ".join(f"named_struct('tf', '{tf}', 'us', {minutes(tf) * 60_000_000}L)" for tf in tfs)
    each = fine.withColumn("__k", F.explode(F.expr(f"array({listed})")))
    us = F.unix_micros(F.col("open_time").cast("timestamp"))
    slot = F.timestamp_micros(us - F.pmod(us, F.col("__k.us"))).cast("timestamp_ntz")
    made = each.groupBy("symbol", F.col("__k.tf").alias("tf"), F.col("__k.us").alias("__us"), slot.alias("open_time")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume")
    )
    end = F.timestamp_micros(F.unix_micros(F.col("open_time").cast("timestamp")) + F.col("__us")).cast("timestamp_ntz")
    return made.select("symbol", "tf", "open_time", end.alias("close_time"), "open", "high", "low", "close", "volume")


def bars_of(spark: SparkSession, sf_dir: str, tfs: list[str], fine: DataFrame | None = None) -> DataFrame:
    """Bars of several timeframes in one frame, all from the finest (``fine``, where it is at
    hand)."""
    finest = min(tfs, key=minutes)
    return rollup(bars(spark, sf_dir, finest) if fine is None else fine, tfs)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily series: orders per status and day, in key order within the day."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(14,2)").cast("double")
    made = o.select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("open_time"), price.alias("price"), "o_orderkey").groupBy("symbol", "open_time").agg(
        F.min_by("price", "o_orderkey").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return made.select("symbol", F.lit("1day").alias("tf"), "open_time", (F.col("open_time") + F.expr("interval 1 day")).alias("close_time"), "open", "high", "low", "close", "volume")


DAILY_SQL = """SELECT symbol, '1day' AS tf, open_time, open_time + INTERVAL 1 DAY AS close_time, arg_min(price, o_orderkey) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, o_orderkey) AS close, count(*)::DOUBLE AS volume
  FROM (SELECT o_orderstatus AS symbol, o_orderdate AS open_time, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS price, o_orderkey FROM orders)
  GROUP BY symbol, open_time"""


def trade_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades for report queries, from lineitem; R in thousandths is an exact integer."""
    line = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    closed = (F.col("l_partkey") % 17 != 0) & (F.col("l_linestatus") == "F")
    rows = line.select(
        F.col("l_returnflag").alias("run_id"), F.col("l_orderkey").alias("snapshot_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("decision_id"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.when(F.col("l_partkey") % 17 == 0, "quarantined").when(F.col("l_linestatus") == "O", "open").when(F.col("l_suppkey") % 11 == 0, "expired").otherwise("closed").alias("status"),
        F.when(closed, (cents + F.col("l_partkey") * 7) % 4001 - 1800).alias("r_milli"),
        (F.col("l_quantity") > 45).alias("ambiguous"), ((F.col("l_linenumber") * 13 + F.col("l_quantity").cast("int")) % 101).cast("int").alias("confidence_pct"),
        F.when(F.col("l_suppkey") % 4 == 0, "bull_trend").when(F.col("l_suppkey") % 4 == 1, "bear_trend").when(F.col("l_suppkey") % 4 == 2, "range").alias("regime"),
        F.when(F.col("l_linenumber") % 4 == 0, "tp_hit").when(F.col("l_linenumber") % 4 == 1, "sl_hit").when(F.col("l_linenumber") % 4 == 2, "timeout").otherwise("").alias("exit_reason"),
        F.when(F.col("l_partkey") % 3 == 0, "SELL").otherwise("BUY").alias("direction"),
        F.col("l_shipdate").alias("closed_at"), F.col("l_quantity").alias("quantity"), cents.alias("cents"),
    )
    return rows.withColumns({
        "observed_at": F.expr("closed_at + make_dt_interval(cast(part % 5 as int))"), "opened_at": F.expr("closed_at - make_dt_interval(cast(decision_id % 100 as int))"),
        "r_pess_milli": F.expr("case when ambiguous then r_milli - 500 end"), "r_opt_milli": F.expr("case when ambiguous then r_milli + 300 end"),
    })


TRADES_SQL = """SELECT *, closed_at + to_days((part % 5)::INT) AS observed_at, closed_at - to_days((decision_id % 100)::INT) AS opened_at,
  CASE WHEN ambiguous THEN r_milli - 500 END AS r_pess_milli, CASE WHEN ambiguous THEN r_milli + 300 END AS r_opt_milli
  FROM (SELECT l_returnflag AS run_id, l_orderkey AS snapshot_id, l_orderkey * 100 + l_linenumber AS decision_id, l_partkey AS part, l_suppkey AS supp,
    CASE WHEN l_partkey % 17 = 0 THEN 'quarantined' WHEN l_linestatus = 'O' THEN 'open' WHEN l_suppkey % 11 = 0 THEN 'expired' ELSE 'closed' END AS status,
    CASE WHEN l_partkey % 17 <> 0 AND l_linestatus = 'F' THEN (round(l_extendedprice * 100)::BIGINT + l_partkey * 7) % 4001 - 1800 END AS r_milli,
    l_quantity > 45 AS ambiguous, ((l_linenumber * 13 + l_quantity::INT) % 101)::INT AS confidence_pct,
    CASE WHEN l_suppkey % 4 = 0 THEN 'bull_trend' WHEN l_suppkey % 4 = 1 THEN 'bear_trend' WHEN l_suppkey % 4 = 2 THEN 'range' END AS regime,
    CASE WHEN l_linenumber % 4 = 0 THEN 'tp_hit' WHEN l_linenumber % 4 = 1 THEN 'sl_hit' WHEN l_linenumber % 4 = 2 THEN 'timeout' ELSE '' END AS exit_reason,
    CASE WHEN l_partkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS direction, l_shipdate AS closed_at, l_quantity AS quantity, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)"""

#: A total order of trade facts.
TRADE_ORDER = ("decision_id", "part", "supp", "cents")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderstatus").alias("symbol"), F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("bar_close"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("custkey"))


SNAPSHOTS_SQL = "SELECT o_orderkey AS snapshot_id, o_orderstatus AS symbol, o_orderpriority AS provider, o_orderdate AS bar_close, o_totalprice AS price, o_custkey AS custkey FROM orders"


def news_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal news: events of a type and user are the revisions of one item."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    nth = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("source"), F.col("user_id").alias("external_id"), nth.cast("long").alias("revision"), F.col("ts").alias("publication_time"), F.expr("ts + make_dt_interval(0, cast(event_id % 7 as int))").alias("ingestion_time"), "value")


NEWS_SQL = """SELECT event_type AS source, user_id AS external_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS revision,
  ts AS publication_time, ts + to_hours((event_id % 7)::INT) AS ingestion_time, value FROM events"""

#: Scheduled events inside the events table's month (fixed values of the adapter).
EVENTS = [("NFP", "high", "2024-01-05 13:30:00"), ("CPI", "high", "2024-01-11 13:30:00"), ("PPI", "medium", "2024-01-12 13:30:00"), ("RetailSales", "medium", "2024-01-17 13:30:00"), ("GDP", "medium", "2024-01-25 13:30:00"), ("PCE", "high", "2024-01-26 13:30:00")]


def scheduled_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENTS, "label string, impact string, due string").select("label", "impact", F.col("due").cast("timestamp_ntz").alias("scheduled_at"))


EVENTS_SQL = "SELECT label, impact, due::TIMESTAMP AS scheduled_at FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in EVENTS) + ") v(label, impact, due)"
