"""Sources and sinks as queries: what is written in a source's format is read back by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barcraft.plans.registry import query
from barcraft.session import passing_folder
from barcraft.sources import adapters as a
from barcraft.sources import pages, readers, sinks
from barcraft.streaming import streams

_BAR = "symbol, tf, open_time, close_time, open, high, low, close, volume"


def _of(spark: SparkSession, sf: str, tf: str, symbol: str) -> DataFrame:
    return a.bars(spark, sf, tf).where(F.col("symbol") == symbol)


@query(f"SELECT {_BAR} FROM (SELECT *, row_number() OVER (ORDER BY open_time DESC) AS n FROM ({a.bars_sql('15min')}) WHERE symbol = 'click') WHERE n <= 300")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The newest bars of a CSV archive, its order checked."""
    path = passing_folder(spark, "csv")
    sinks.write_archive(_of(spark, sf, "15min", "click"), path)
    return readers.read_bars(spark, "csv", path, "click", "15min", 300)


def _aggregate_pages(spark: SparkSession, sf: str) -> str:
    """A page per symbol and day; all but a symbol's last name the next."""
    one = F.struct(F.unix_millis(F.col("open_time").cast("timestamp")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    p = a.bars(spark, sf, "15min").groupBy("symbol", F.to_date("open_time").alias("day")).agg(F.sort_array(F.collect_list(one)).alias("results"))
    following = F.lead("day").over(Window.partitionBy("symbol").orderBy("day"))
    url = F.concat(F.lit("https://host/v2/symbol="), "symbol", F.lit("/day="), following.cast("string"), F.lit("?cursor=1"))
    fields = F.struct(F.col("symbol").alias("ticker"), F.when(F.dayofmonth("day") % 2 == 0, "OK").otherwise("DELAYED").alias("status"), F.col("url").alias("next_url"), "results")
    return pages.write_pages(p.withColumn("url", url).withColumn("page", F.to_json(fields)), ["symbol", "day"], "page", passing_folder(spark, "pages"))


@query(f"SELECT {_BAR} FROM ({a.bars_sql('15min')})")
def aggregate_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All symbols' pages through the data source, their chains checked."""
    return pages.read_pages(spark, "aggregate_pages", _aggregate_pages(spark, sf), tf="15min")


@query(f"SELECT {_BAR} FROM ({a.bars_sql('15min')}) WHERE symbol IN ('view', 'click') AND open_time >= TIMESTAMP '2024-01-10 06:00:00'")
def aggregate_scan_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same of some symbols from a time on: other pages are not opened."""
    return pages.read_pages(spark, "aggregate_pages", _aggregate_pages(spark, sf), symbols=["view", "click"], since="2024-01-10 06:00:00", tf="15min")


@query(f"SELECT {_BAR} FROM ({a.bars_sql('15min')})")
def stream_aggregate_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The same pages as a stream."""
    return streams.run_available(pages.stream_pages(spark, "aggregate_pages", _aggregate_pages(spark, sf), tf="15min"))


@query(f"SELECT {_BAR} FROM ({a.bars_sql('1h')})")
def candle_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes of candles, a line for each day, in files by symbol."""
    c = a.bars(spark, sf, "1h").withColumn("day", F.to_date("open_time"))
    one = F.struct(F.unix_seconds(F.col("open_time").cast("timestamp")).alias("time"), "open", "high", "low", "close", "volume")
    texts = c.groupBy("symbol", "day").agg(F.to_json(F.struct(F.collect_list(one).alias("candles"))).alias("value"))
    path = passing_folder(spark, "candles")
    texts.select("symbol", "value").write.partitionBy("symbol").text(path)
    return readers.parse_candles(spark.read.text(path), "value", F.col("symbol"), "1h")


@query(f"SELECT open_time, close_time, open, high, low, close, volume FROM ({a.bars_sql('1h')}) WHERE symbol = 'click' AND open_time >= TIMESTAMP '2024-01-05'")
def archive_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """An archive that is read and replaced by a part of itself."""
    path = passing_folder(spark, "archive")
    sinks.write_archive(_of(spark, sf, "1h", "click"), path)
    sinks.write_archive(readers.read_archive(spark, path).where("open_time >= timestamp_ntz'2024-01-05'"), path)
    return readers.read_archive(spark, path)


@query(f"SELECT {_BAR} FROM ({a.bars_sql('1h')}) WHERE symbol <> 'error' OR open_time >= TIMESTAMP '2024-01-05'")
def published_archive(spark: SparkSession, sf: str) -> DataFrame:
    """All symbols' bars published, then replaced by a part of themselves."""
    path = passing_folder(spark, "published")
    sinks.publish(a.bars(spark, sf, "1h"), path)
    sinks.publish(sinks.read_published(spark, path).where("symbol <> 'error' or open_time >= timestamp_ntz'2024-01-05'"), path)
    return sinks.read_published(spark, path).select(*_BAR.split(", "))


@query(f"SELECT source, external_id::VARCHAR AS external_id, revision::INT AS revision, date_trunc('second', publication_time) AS publication_time, date_trunc('second', ingestion_time) AS ingestion_time, 'item ' || external_id AS headline, 'low' AS impact FROM ({a.NEWS_SQL})")
def news_scan(spark: SparkSession, sf: str) -> DataFrame:
    second = lambda c: F.date_trunc("second", F.col(c)).cast("timestamp_ntz")
    n = a.news_revisions(spark, sf).select("source", F.col("external_id").cast("string").alias("external_id"), F.col("revision").cast("int").alias("revision"), second("publication_time").alias("publication_time"), second("ingestion_time").alias("first_seen_at"), F.concat(F.lit("item "), F.col("external_id")).alias("headline"), F.lit("low").alias("impact"))
    path = passing_folder(spark, "news")
    n.write.json(path)
    return readers.read_news(spark, path)


@query("SELECT DISTINCT 'release ' || (o_custkey % 40)::VARCHAR AS release_name, o_orderdate::DATE AS day FROM orders")
def release_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a release calendar, a month each, that follow each other by offset."""
    o = a.table(spark, sf, "orders")
    dates = o.select(F.concat(F.lit("release "), (F.col("o_custkey") % 40).cast("string")).alias("release_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).distinct()
    months = dates.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.collect_list(F.struct("release_name", "date")).alias("release_dates"))
    size, up_to = F.size("release_dates"), Window.orderBy("month")  # a row a month
    months = months.withColumns({"offset": F.sum(size).over(up_to) - size, "count": F.sum(size).over(Window.partitionBy())})
    path = pages.write_pages(months.withColumn("page", F.to_json(F.struct("count", "offset", "release_dates"))), ["month"], "page", passing_folder(spark, "releases"))
    return pages.read_pages(spark, "release_pages", path)


@query("SELECT DISTINCT user_id AS k, event_type AS v FROM events")
def ledger_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches that overlap, the second run twice: each key is in the table once."""
    e = a.table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), "event_id")
    path = passing_folder(spark, "ledger")
    write = streams.ledger_batch(path, ["k", "v"])
    for epoch, part in enumerate(("event_id % 3 <> 0", "event_id % 2 = 0 or event_id % 3 = 0", "event_id % 2 = 0 or event_id % 3 = 0")):
        write(e.where(part).drop("event_id"), epoch)
    return spark.read.parquet(path)
