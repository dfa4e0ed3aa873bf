"""Per-timeframe features, regimes, multi-timeframe packets and decision inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcraft.functions.numeric import round_to
from barcraft.operators.indicators import indicator_frame, linreg_slope
from barcraft.operators.segments import SLICE_MINUTES, running

ADX_TREND, ADX_RANGE, MIN_BARS = 25.0, 20.0, 200
ROLES = {"macro": "1day", "trend": "4h", "structure": "1h", "trigger": "15min"}


def ema_alignment() -> Column:
    up = (F.col("ema_fast") > F.col("ema_slow")) & (F.col("ema_slow") > F.col("ema_trend"))
    down = (F.col("ema_fast") < F.col("ema_slow")) & (F.col("ema_slow") < F.col("ema_trend"))
    return F.when(up, "up").when(down, "down").otherwise("mixed")


def regime() -> Column:
    """From adx, ema_align and slope: a trend needs strength, alignment and slope together."""
    trending = F.col("adx") >= ADX_TREND
    return (
        F.when(trending & (F.col("ema_align") == "up") & (F.col("slope") > 0), "bull_trend")
        .when(trending & (F.col("ema_align") == "down") & (F.col("slope") < 0), "bear_trend")
        .when(F.col("adx") < ADX_RANGE, "range")
        .otherwise("choppy")
    )


def timeframe_features(bars: DataFrame, min_bars: int = MIN_BARS, periods: dict[str, int] | None = None, wilder: int = 14, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per bar from the ``min_bars``-th of its series on; ``keep`` names columns of
    bars that go along."""
    f = indicator_frame(bars, periods, wilder)
    f = f.withColumn("slope", F.when(F.col("close") != 0, linreg_slope("ema_slow") / F.col("close")).otherwise(F.lit(0.0))).withColumn("ema_align", ema_alignment()).withColumn("regime", regime())
    return f.where(F.col("rn") >= min_bars).select(
        "symbol", "tf", "open_time", "close_time", "rn", "regime", "ema_align", round_to("adx", 1).alias("adx"), round_to("rsi", 1).alias("rsi"),
        F.when(F.col("close") != 0, round_to(F.col("atr") / F.col("close") * 100, 3)).alias("atr_pct"), F.when(F.col("close") != 0, round_to(F.col("slope") * 100, 4)).alias("slope_pct"),
        round_to("close", 4).alias("close"), round_to("resistance_pct", 3).alias("resistance_pct"), round_to("support_pct", 3).alias("support_pct"), *keep,
    )


def confluence() -> Column:
    """Agreement label of a packet; the macro bias gates the aligned calls."""
    calm = F.col("trigger_regime").isin("range", "choppy")
    return (
        F.when((F.col("macro_align") == "up") & (F.col("trend_regime") == "bull_trend") & (F.col("structure_regime") == "bull_trend"), "aligned_bull")
        .when((F.col("macro_align") == "down") & (F.col("trend_regime") == "bear_trend") & (F.col("structure_regime") == "bear_trend"), "aligned_bear")
        .when((F.col("trend_regime") == "bull_trend") & calm, "bull_pullback")
        .when((F.col("trend_regime") == "bear_trend") & calm, "bear_pullback")
        .otherwise("mixed")
    )


def feature_packets(features: DataFrame, slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """One row per trigger bar: for each role the latest features closed by then, no later
    one.  ``features`` holds all timeframes; every role is carried forward at once, in slices of
    time.  Rows that lack a role are left out."""
    taken = [("close", "close_time"), ("regime", "regime"), ("align", "ema_align"), ("adx", "adx"), *([("gap", "recent_gap")] if "recent_gap" in features.columns else [])]
    trigger = F.col("tf") == ROLES["trigger"]
    out = features.where(F.col("tf").isin(*ROLES.values())).withColumn("__trigger", trigger)
    held = [r for r in ROLES if r != "trigger"]
    out = out.withColumns({f"__{r}": F.when(F.col("tf") == ROLES[r], F.struct(*[F.col(c).alias(n) for n, c in taken])) for r in held})
    out = running(out, ["symbol"], "close_time", ["__trigger"], last=[f"__{r}" for r in held], slice_minutes=slice_minutes)
    out = out.where(trigger & F.col("__macro").isNotNull() & F.col("__trend").isNotNull() & F.col("__structure").isNotNull())
    own = [F.col("close_time").alias("as_of"), F.col("close").alias("price"), F.col("regime").alias("trigger_regime"), F.col("atr_pct").alias("atr_pct_trigger"), F.col("rsi").alias("rsi_trigger"), *([F.col("recent_gap").alias("trigger_gap")] if len(taken) > 4 else [])]
    packets = out.select("symbol", *own, *[F.col(f"__{r}.{n}").alias(f"{r}_{n}") for r in held for n, _ in taken])
    return packets.withColumn("confluence", confluence())


def decision_input(packets: DataFrame, mode: str) -> DataFrame:
    """The nested projection that a decision maker sees; a live run observes its spread, a
    replay models it."""
    provenance = F.when(F.col("spread_pct").isNull(), "unavailable").otherwise("observed" if mode == "online" else "modeled")
    view = lambda r: F.struct(F.col(f"{r}_regime").alias("regime"), *([F.col(f"{r}_align").alias("ema_align"), F.col(f"{r}_adx").alias("adx")] if r != "trigger" else []))
    return packets.select("symbol", "as_of", F.lit(mode).alias("mode"), "price", F.col("structure_regime").alias("regime_h1"), F.col("macro_align").alias("macro_bias"), F.col("trend_regime").alias("major_trend"), "confluence", "spread_pct", provenance.alias("spread_provenance"), F.struct(*[view(r).alias(ROLES[r]) for r in ROLES]).alias("timeframes"))


def canonical_hash(df: DataFrame, name: str = "input_hash") -> DataFrame:
    """Adds the SHA-256 of each row as compact JSON with sorted keys (Spark's to_json does
    not sort); timestamps as ISO texts."""
    packed = df.select("*", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("__json"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")) for x in batch.column("__json").to_pylist()]
            kept = batch.drop_columns(["__json"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])], [*kept.schema.names, name])

    return packed.mapInArrow(run, schema)


def fingerprint(*parts: str | Column) -> Column:
    """SHA-256 of the parts joined by a pipe; a null part makes it null."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    joined = F.concat(*[x for c in columns for x in (F.lit("|"), c.cast("string"))][1:])
    return F.sha2(joined, 256)


def dataset_id(bars: DataFrame, provider: str, provider_symbol: str | None = None) -> DataFrame:
    """Per symbol (symbol, dataset_id, sha256, timeframes, bar_counts, first_bar, last_bar): a
    content hash over provider, names and every bar in (tf, open_time) order, its first sixteen
    digits as the id, and what the set holds.  Numbers enter as the shortest text that gives
    the same double.  A month of bars is hashed first, then the months of a timeframe, then
    the timeframes, so no task holds a whole series."""
    number = [F.col(c).cast("double").cast("string") for c in ("open", "high", "low", "close", "volume")]
    text = F.concat_ws(",", F.date_format("open_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), *[F.coalesce(n, F.lit("")) for n in number])
    joined = lambda rows, value: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(rows)), value), ""), 256)
    rows = bars.select("symbol", "tf", "open_time", F.date_format("open_time", "yyyy-MM").alias("month"), text.alias("text"))
    months = rows.groupBy("symbol", "tf", "month").agg(joined(F.struct("open_time", "text"), lambda x: F.concat(x["text"], F.lit(";"))).alias("h"), F.count("*").alias("n"), F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    frames = months.groupBy("symbol", "tf").agg(joined(F.struct("month", "h"), lambda x: x["h"]).alias("h"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    head = F.concat_ws("|", F.lit(provider), F.coalesce(F.lit(provider_symbol), F.col("symbol")), F.col("symbol"))
    listed = F.sort_array(F.collect_list(F.struct("tf", "h", "n")))
    whole = frames.groupBy("symbol").agg(listed.alias("all"), F.min("first").alias("first_bar"), F.max("last").alias("last_bar"))
    sha = F.sha2(F.concat(head, F.array_join(F.transform("all", lambda x: F.concat(F.lit("|"), x["tf"], F.lit("|"), x["h"])), "")), 256)
    whole = whole.withColumn("sha256", sha)
    counts = F.transform("all", lambda x: F.concat(x["tf"], F.lit(":"), x["n"].cast("string")))
    return whole.select("symbol", F.substring("sha256", 1, 16).alias("dataset_id"), "sha256", F.transform("all", lambda x: x["tf"]).alias("timeframes"), counts.alias("bar_counts"), "first_bar", "last_bar")
