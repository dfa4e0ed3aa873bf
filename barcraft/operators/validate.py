"""Validation of bars: row checks, grid, series order, gaps and their session class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcraft.functions.market_calendar import EXPECTED, UNEXPECTED, SessionCalendar, any_open
from barcraft.sources.schemas import GRID_CHECKED, TIMEFRAMES, minutes

#: Duckable and Spark-readable minutes of a tf column.
TF_MINUTES = "CASE tf " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TIMEFRAMES.items()) + " END"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def floor_to_grid(ts: str | Column, tf: str) -> Column:
    """The epoch-anchored slot that a timestamp_ntz falls in."""
    column = F.col(ts) if isinstance(ts, str) else ts
    step = minutes(tf) * 60_000_000
    return F.timestamp_micros(F.floor(_micros(column) / step) * step).cast("timestamp_ntz")


def is_grid_aligned(ts: str | Column, tf: str) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return _micros(column) % (minutes(tf) * 60_000_000) == 0


def only_closed(bars: DataFrame, now: str) -> DataFrame:
    return bars.where(F.col("close_time") <= F.lit(now).cast("timestamp_ntz"))


def row_violations() -> Column:
    """Names of the row rules that a bar breaks, in a fixed order; empty for a sound bar.
    Null or NaN prices count as not finite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    rules = [
        ("price_not_positive", F.greatest(*[F.when(bad(c) | (F.col(c) <= 0), 1).otherwise(0) for c in ("open", "high", "low", "close")]) == 1),
        ("bad_volume", bad("volume") | (F.col("volume") < 0)),
        ("close_not_after_open", F.col("close_time") <= F.col("open_time")),
        ("high_below_body", F.col("high") < F.greatest("open", "close")),
        ("low_above_body", F.col("low") > F.least("open", "close")),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def series_errors(bars: DataFrame) -> DataFrame:
    """The first error of each (symbol, tf) with its bar: off_grid, wrong_duration,
    not_increasing or overlap.  The series is taken in the order of ``idx``."""
    w = Window.partitionBy("symbol", "tf").orderBy("idx")
    step = F.expr(TF_MINUTES) * 60_000_000
    checked = F.col("tf").isin(*GRID_CHECKED)
    seen = bars.withColumns({"__open": F.lag("open_time").over(w), "__close": F.lag("close_time").over(w)})
    error = (
        F.when(checked & (_micros(F.col("open_time")) % step != 0), "off_grid")
        .when(_micros(F.col("close_time")) - _micros(F.col("open_time")) != step, "wrong_duration")
        .when(F.col("open_time") <= F.col("__open"), "not_increasing")
        .when(F.col("open_time") < F.col("__close"), "overlap")
    )
    return seen.withColumn("error", error).where("error is not null").groupBy("symbol", "tf").agg(F.min_by("error", "idx").alias("error"), F.min("idx").cast("long").alias("idx"), F.count("*").alias("n_errors"))


def gaps(bars: DataFrame) -> DataFrame:
    """(symbol, tf, after, before, missing_bars): from a bar's close to the next one's later
    open."""
    w = Window.partitionBy("symbol", "tf").orderBy("open_time")
    step = F.expr(TF_MINUTES) * 60_000_000
    before = bars.select("symbol", "tf", F.lag("close_time").over(w).alias("after"), F.col("open_time").alias("before"))
    missing = F.round((_micros(F.col("before")) - _micros(F.col("after"))) / step).cast("long")
    return before.where("before > after").withColumn("missing_bars", missing)


def classify_gaps(found: DataFrame, calendar: SessionCalendar) -> DataFrame:
    """Adds ``kind``: unexpected if any missing slot opens in session."""
    return found.withColumn("kind", F.when(any_open(calendar, "after", "before", TF_MINUTES), UNEXPECTED).otherwise(EXPECTED))


def quality(bars: DataFrame, calendar: SessionCalendar, min_bars: int) -> DataFrame:
    """(symbol, tf, bars, gaps, unexpected, verdict): insufficient before degraded before
    expected_gaps before ok."""
    kinds = classify_gaps(gaps(bars), calendar).groupBy("symbol", "tf").agg(F.count("*").alias("gaps"), F.count_if(F.col("kind") == UNEXPECTED).alias("unexpected"))
    counts = bars.groupBy("symbol", "tf").agg(F.count("*").alias("bars"))
    joined = counts.join(kinds, ["symbol", "tf"], "left").fillna(0, ["gaps", "unexpected"])
    verdict = F.when(F.col("bars") < min_bars, "insufficient").when(F.col("unexpected") > 0, "degraded").when(F.col("gaps") > 0, "expected_gaps").otherwise("ok")
    return joined.withColumn("verdict", verdict)


def recent_unexpected(bars: DataFrame, calendar: SessionCalendar, recent: dict[str, int]) -> DataFrame:
    """bars with ``recent_gap``: whether an unexpected gap lies inside the last bars that end
    here, as many as ``recent`` says for the timeframe (the gap before the first of them is
    not seen).  All timeframes share one shuffle and sort."""
    w = Window.partitionBy("symbol", "tf").orderBy("open_time")
    after = bars.withColumn("__after", F.lag("close_time").over(w))
    flagged = after.withColumn("__gap", F.coalesce(any_open(calendar, "__after", "open_time", TF_MINUTES), F.lit(False)))
    out = F.lit(False)
    for tf, n in recent.items():
        if n > 1:
            out = F.when(F.col("tf") == tf, F.max("__gap").over(w.rowsBetween(-(n - 2), 0))).otherwise(out)
    return flagged.withColumn("recent_gap", out).drop("__after", "__gap")
