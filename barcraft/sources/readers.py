"""Scans of bar archives, aggregate pages, candle envelopes, news and release calendars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barcraft.sources import schemas


_CSV = schemas.BAR.replace("open_time timestamp_ntz, close_time timestamp_ntz", "open_time string, close_time string")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a bar CSV with their line order (file by name, split, row, since tasks get splits in
    the order of their sizes); times are ISO texts, UTC unless they say."""
    line = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("row"))
    raw = spark.read.schema(_CSV).csv(path, header=True).withColumn("__line", line)
    return raw.withColumns({c: F.col(c).cast("timestamp").cast("timestamp_ntz") for c in ("open_time", "close_time")})


def _ascending(bars: DataFrame) -> bool:
    """Whether open_time never falls in line order.  Each split of a file is looked at on its
    own; between splits, and files by name, their first and last times decide, one row a split."""
    placed = bars.select(F.struct("__line.file", "__line.at").alias("split"), "__line", "open_time")
    falls = F.lag("open_time").over(Window.partitionBy("split").orderBy("__line")) > F.col("open_time")
    ends = placed.withColumn("falls", falls).groupBy("split").agg(F.bool_or("falls").alias("falls"), F.min_by("open_time", "__line").alias("first"), F.max_by("open_time", "__line").alias("last"))
    between = F.lag("last").over(Window.orderBy("split")) > F.col("first")  # a row per split
    return ends.withColumn("between", between).where("falls or between").isEmpty()


def read_bar_csv(spark: SparkSession, path: str, symbol: str, tf: str, count: int = 0) -> DataFrame:
    """Bars of one ``{symbol}_{tf}.csv`` archive; empty volume is 0; ``count`` newest (0: all).

    Raises if the file is not ascending by open_time (equal times are allowed)."""
    bars = _csv(spark, path).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    if not _ascending(bars):
        raise ValueError(f"{path} is not sorted by open_time")
    bars = bars.drop("__line").select(F.lit(symbol).alias("symbol"), F.lit(tf).alias("tf"), "*")
    return tail(bars, count) if count else bars


def tail(bars: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` bars of each (symbol, tf)."""
    newest = Window.partitionBy("symbol", "tf").orderBy(F.desc("open_time"))
    return bars.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= count).drop("__n")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A bar archive keyed by open_time, the last of duplicates winning; empty if missing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schemas.BAR)
    raw = _csv(spark, path)
    last = F.row_number().over(Window.partitionBy("open_time").orderBy(F.desc("__line")))
    return raw.withColumn("__n", last).where("__n = 1").drop("__n", "__line")


def read_aggregates(spark: SparkSession, path: str, symbol: str, tf: str) -> DataFrame:
    """Bars from aggregate pages (epoch milliseconds); refuses pages whose status is not
    OK or DELAYED, and a set of pages whose last one still names a next page."""
    pages = spark.read.schema(schemas.AGGREGATE_PAGE).option("multiLine", True).json(path)
    bad = pages.where("status is null or status not in ('OK', 'DELAYED')").count()
    total, following = pages.count(), pages.where("next_url is not null").count()
    if bad:
        raise ValueError(f"{bad} pages with a refused status")
    if total and following >= total:
        raise ValueError("the pages end before the last one")
    step = schemas.minutes(tf) * 60_000
    rows = pages.select(F.explode("results").alias("r"))
    to_time = lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz")
    return rows.select(
        F.lit(symbol).alias("symbol"), F.lit(tf).alias("tf"), to_time(F.col("r.t")).alias("open_time"), to_time(F.col("r.t") + step).alias("close_time"),
        F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"), F.coalesce("r.v", F.lit(0.0)).alias("volume"),
    )


def parse_candles(texts: DataFrame, column: str, symbol: str | Column, tf: str) -> DataFrame:
    """Bars from JSON texts, an envelope ``{"candles": [...]}`` or a bare array, of one symbol or
    of the symbol that each text's row says."""
    array = f"array<{schemas.CANDLE}>"
    both = F.coalesce(F.from_json(column, f"struct<candles: {array}>")["candles"], F.from_json(column, array))
    rows = texts.select((F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), F.explode(both).alias("c"))
    step = schemas.minutes(tf) * 60
    to_time = lambda s: F.timestamp_seconds(s).cast("timestamp_ntz")
    return rows.select("symbol", F.lit(tf).alias("tf"), to_time(F.col("c.time")).alias("open_time"), to_time(F.col("c.time") + step).alias("close_time"), "c.open", "c.high", "c.low", "c.close", F.coalesce("c.volume", F.lit(0.0)).alias("volume"))


def read_news(spark: SparkSession, path: str, need_first_seen: bool = True) -> DataFrame:
    """News revisions, one object per line; ``first_seen_at`` is mandatory for as-of use."""
    news = spark.read.schema(schemas.NEWS).json(path)
    if need_first_seen and not news.where("first_seen_at is null").isEmpty():
        raise ValueError("news rows without first_seen_at can't be used as of a time")
    return news.withColumnRenamed("first_seen_at", "ingestion_time")


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """(release_name, day) from release-calendar pages; raises on a page without the list."""
    pages = spark.read.schema(schemas.RELEASES).option("multiLine", True).json(path)
    if not pages.where("release_dates is null").isEmpty():
        raise ValueError("a page has no release_dates")
    return pages.select(F.explode("release_dates").alias("r")).select("r.release_name", F.to_date("r.date").alias("day"))


def _read_parquet(spark: SparkSession, path: str, symbol: str, tf: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("symbol") == symbol) & (F.col("tf") == tf))


def _read_candles(spark: SparkSession, path: str, symbol: str, tf: str) -> DataFrame:
    return parse_candles(spark.read.text(path, wholetext=True), "value", symbol, tf)


def _read_static(spark: SparkSession, rows: DataFrame, symbol: str, tf: str) -> DataFrame:
    return rows.where((F.col("symbol") == symbol) & (F.col("tf") == tf))


#: Bars by format name; each takes (spark, source, symbol, tf).
BAR_FORMATS: dict[str, Callable[..., DataFrame]] = {"csv": read_bar_csv, "aggregates": read_aggregates, "candles": _read_candles, "parquet": _read_parquet, "static": _read_static}


def register_bar_format(name: str, reader: Callable[..., DataFrame]) -> None:
    """Adds a format; a name that is taken raises."""
    if name in BAR_FORMATS:
        raise ValueError(f"bar format {name!r} is taken")
    BAR_FORMATS[name] = reader


def read_bars(spark: SparkSession, fmt: str, source: str | DataFrame, symbol: str, tf: str, count: int = 0) -> DataFrame:
    """Bars by format name (``csv``, ``aggregates``, ``candles``: JSON envelopes or arrays,
    ``parquet``, ``static``: a frame at hand, or a registered one), the ``count`` newest (0:
    all); unknown names raise."""
    if fmt not in BAR_FORMATS:
        raise ValueError(f"unknown bar format {fmt!r}")
    bars = BAR_FORMATS[fmt](spark, source, symbol, tf)
    return tail(bars, count) if count else bars
