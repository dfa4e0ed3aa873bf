"""Structured Streaming forms of the engine's steps.

Each is a DataFrame transformation that runs on a stream; ``run_available`` drives one to
completion over the files there are now, for replays and tests.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barcraft.session import passing_folder, settings
from barcraft.sources.schemas import minutes


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Ticks from event files as a stream; a path without the symbol's type can't be read."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    e = spark.readStream.schema(schema).parquet(path).where("value > 0")
    return e.select(F.col("event_type").alias("symbol"), F.col("value").cast("decimal(12,2)").cast("double").alias("price"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"))


def bar_stream(ticks: DataFrame, tf: str, late_minutes: int = 15) -> DataFrame:
    """Closed bars only: a window is given out once the watermark has passed it."""
    order = F.struct("ts", "tick_id")
    made = ticks.withWatermark("ts", f"{late_minutes} minutes").groupBy("symbol", F.window("ts", f"{minutes(tf)} minutes").alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"))
    return made.select("symbol", F.lit(tf).alias("tf"), F.col("w.start").cast("timestamp_ntz").alias("open_time"), F.col("w.end").cast("timestamp_ntz").alias("close_time"), "open", "high", "low", "close", "volume")


def once_per_key(rows: DataFrame, key: list[str], ts: str, late_minutes: int) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return rows.withWatermark(ts, f"{late_minutes} minutes").dropDuplicatesWithinWatermark(key)


def gate_stream(outcomes: DataFrame, bar_seconds: int, cooldown_bars: int) -> DataFrame:
    """The position gate on a stream of outcomes(run_id, symbol, trade_id, as_of, closed_at):
    busy_until of each (run, symbol) is state, rows of a batch are taken in as_of order.

    A row that comes in a later batch than rows after it is judged by the positions taken so
    far: what was admitted stays.  The state is one number per (run, symbol) and never ends,
    since a position may stay open for any time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        busy = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["as_of", "trade_id"])
        admitted = []
        for a, e in zip(rows["as_of"], rows["closed_at"], strict=True):
            free = busy is None or a.value >= busy
            admitted.append(free)
            if free:
                busy = 2**62 if pd.isna(e) else e.value + bar_seconds * cooldown_bars * 1_000_000_000
        if busy is not None:
            state.update((busy,))
        yield pd.DataFrame({"run_id": key[0], "symbol": key[1], "trade_id": rows["trade_id"], "admitted": admitted})

    return outcomes.groupBy("run_id", "symbol").applyInPandasWithState(step, "run_id string, symbol string, trade_id long, admitted boolean", "busy long", "append", GroupStateTimeout.NoTimeout)


def ledger_batch(existing_path: str, key: list[str]):
    """A foreachBatch sink that appends only rows whose key the table does not have: a batch
    that is run again adds nothing.  Keys are compared null-safe, so rows whose key holds nulls
    are one row per combination, too."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(existing_path)
        fresh = batch.dropDuplicates(key)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            had = spark.read.schema(batch.schema).parquet(existing_path).select(*[F.col(k).alias(f"__{k}") for k in key])
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
            fresh = fresh.join(had, same, "left_anti")
        fresh.write.mode("append").parquet(existing_path)

    return write


def retried(step: Callable[[DataFrame, int], None], transient: tuple[type[Exception], ...], attempts: int = 3, base_delay: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that is tried again after a transient failure, up to ``attempts`` times in
    all with a delay that grows by ``base_delay``; other failures and the last one are raised.  The
    step must add nothing when it is run again, as ``ledger_batch`` does."""
    if attempts < 1:
        raise ValueError("at least one attempt")

    def run(batch: DataFrame, epoch: int) -> None:
        for attempt in range(1, attempts + 1):
            try:
                return step(batch, epoch)
            except transient:
                if attempt == attempts:
                    raise
                sleep(base_delay * attempt)

    return run


def catch_up_batch(ledger_path: str, evaluate: Callable[[DataFrame], DataFrame], key: tuple[str, ...] = ("symbol",), max_backfill: int = 8, market_mode: str = "online") -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that brings a ledger of evaluated bars up to date.

    Of a batch of closed bars (key, as_of, ...) the newest ``max_backfill`` of a key that are later
    than its last one in the ledger are taken; the newest gets ``mode`` = ``market_mode``, the ones
    before it are ``replay``.  ``evaluate`` turns them into verdict rows, which keep key, as_of and mode
    and are appended once each: evaluations are facts, so a bar that comes again as the newest of a
    later batch can have a row of either mode.  With an empty ledger all bars count as later."""
    by = [*key]

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
        bars = batch.dropDuplicates([*by, "as_of"])
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            done = spark.read.parquet(ledger_path).where(F.col("mode").isin(market_mode, "replay")).groupBy(*[F.col(k).alias(f"__{k}") for k in by]).agg(F.max("as_of").alias("__done"))
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])
            bars = bars.join(done, same, "left").where("__done is null or as_of > __done").select(*batch.columns)
        newest = Window.partitionBy(*by).orderBy(F.desc("as_of"))
        targets = bars.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= max_backfill)
        verdicts = evaluate(targets.withColumn("mode", F.when(F.col("__n") == 1, market_mode).otherwise("replay")).drop("__n"))
        ledger_batch(ledger_path, [*by, "as_of", "mode"])(verdicts, epoch)

    return run


#: State with timers and several variables needs this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_available(stream: DataFrame, folder: str | None = None, **conf: str) -> DataFrame:
    """The rows that a stream gives out over the input there is now, from a Parquet sink in
    the shared folder, with the checkpoint beside it: nothing passes through the driver."""
    spark = stream.sparkSession
    folder = folder or passing_folder(spark, "stream")
    with settings(spark, **conf):
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
