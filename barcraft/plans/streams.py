"""Streams over the same inputs, compared with their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcraft.plans import lookups, series
from barcraft.plans import simulation as sim
from barcraft.plans.registry import query
from barcraft.session import passing_folder
from barcraft.sources import adapters as a
from barcraft.streaming import joins, open_trades, streams


def _replayed(rows: DataFrame, time: str) -> DataFrame:
    """A table written as files and read as a stream, with a last row that lets the clock run out."""
    spark, path = rows.sparkSession, passing_folder(rows.sparkSession, "replay")
    open_trades.with_clock(rows, time).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query(f"SELECT * FROM ({a.bars_sql('1h')}) WHERE close_time <= (SELECT max(ts) - INTERVAL 15 MINUTE FROM ({a.TICKS_SQL}))")
def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars closed by the watermark, from the event files read as a stream."""
    return streams.run_available(streams.bar_stream(streams.tick_stream(spark, f"{sf}/events*.parquet"), "1h"))


@query("SELECT symbol, count(*) AS n FROM (SELECT DISTINCT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS slot FROM events WHERE value > 0) GROUP BY 1")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Slots seen at least once; the delay covers the month, so no key is forgotten."""
    t = streams.tick_stream(spark, f"{sf}/events*.parquet").withColumn("slot", F.date_trunc("hour", "ts"))
    return streams.run_available(streams.once_per_key(t, ["symbol", "slot"], "ts", 60 * 24 * 60)).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"WITH {sim.OUTCOMES_CTE} SELECT * FROM outcomes")
def stream_open_trades(spark: SparkSession, sf: str) -> DataFrame:
    """``reconcile_first_touch`` as a stream: bars and entries are replayed, open trades are state."""
    b = sim.fine_bars(spark, sf)
    entries = sim.trades(b).select("symbol", "as_of", "run_id", "trade_id", "opened_at", "direction", "entry_mid", "sl_price", "tp_price")
    stream = open_trades.open_trade_stream(_replayed(b, "close_time"), _replayed(entries, "opened_at"), sim.TIMEOUT, sim.COSTS, lanes=4)
    return streams.run_available(stream, **streams.STATE_STORE)


@query(series.BLACKOUT_SQL)
def stream_blackout(spark: SparkSession, sf: str) -> DataFrame:
    """``blackout`` as an outer join of two streams."""
    instants, events = series._instants(spark, sf), a.scheduled_events(spark)
    stream = joins.blackout_stream(_replayed(instants, "as_of"), _replayed(events, "scheduled_at"), 60, 30, ("high", "medium"))
    return streams.run_available(stream)


@query(lookups.QUOTE_SQL)
def stream_quote_at_event(spark: SparkSession, sf: str) -> DataFrame:
    """``quote_at_event`` as a join of two streams whose state is the latest quote."""
    events, quotes = lookups.priced_events(spark, sf), lookups.hourly_quotes(spark, sf)
    return streams.run_available(joins.quote_stream(_replayed(events, "ts"), _replayed(quotes, "time"), lanes=4), **streams.STATE_STORE)
