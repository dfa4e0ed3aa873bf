"""Point lookups, listings and report sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barcraft.operators.metrics import mean_r


def newest(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The k rows with the greatest ``by``, nulls last, ties by the given columns; planned as
    one top-k per partition and a merge."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]).limit(k)


def latest_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def with_exists(df: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """Adds whether a row of ``other`` has the key (EXISTS as a column)."""
    keys = other.select(*on).distinct().withColumn(f"__{name}", F.lit(True))
    return df.join(keys, on, "left").withColumn(name, F.coalesce(f"__{name}", F.lit(False))).drop(f"__{name}")


def difference(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """(key, side): keys of a not in b (only_left) and of b not in a (only_right)."""
    left = a.select(on).join(b.select(on), on, "left_anti").withColumn("side", F.lit("only_left"))
    return left.unionByName(b.select(on).join(a.select(on), on, "left_anti").withColumn("side", F.lit("only_right")))


def trade_by_input(wanted: DataFrame, decisions: DataFrame, trades: DataFrame) -> DataFrame:
    """wanted(input_hash, model, run_id) with trade_id: the least trade of a decision on that
    input by that model within the run, null where there is none."""
    key = ["input_hash", "model", "run_id"]
    made = decisions.select("decision_id", "input_hash", "model").join(trades.select("decision_id", "run_id", "trade_id"), "decision_id")
    return wanted.join(made.groupBy(*key).agg(F.min("trade_id").alias("trade_id")), key, "left")


def verified_scope(trades: DataFrame, manifests: DataFrame) -> DataFrame:
    """Trades of runs whose kind counts, whose tree was clean and whose commit is known, and
    whose id does not look like a test's."""
    good = manifests.where("run_kind in ('shadow_online', 'executable_backtest') and git_dirty = 'false' and commit is not null and run_id not like 'TST_%'").select("run_id")
    return trades.join(good, "run_id", "left_semi")


def run_validity() -> Column:
    """Class of a run from its manifest's columns."""
    return (
        F.when(F.col("run_kind").isNull(), "unregistered").when(~F.col("run_kind").isin("shadow_online", "executable_backtest"), "exploratory").when(~F.col("git_dirty").eqNullSafe(F.lit("false")), "dirty_tree").when(F.col("commit").isNull(), "unknown_commit").otherwise("verified")
    )


def runs_report(decisions: DataFrame, trades: DataFrame, manifests: DataFrame, k: int = 50) -> DataFrame:
    """Per run: decisions (distinct snapshots, newest), trades and R, validity; runs that
    appear on one side only are there too; newest activity first, nulls last."""
    d = decisions.groupBy("run_id").agg(F.count_distinct("snapshot_id").alias("snapshots"), F.count("*").alias("decisions"), F.max("at").alias("last_decision"), F.bool_or(F.col("approved")).alias("any_approved"))
    t = trades.groupBy("run_id").agg(F.count("*").alias("trades"), F.count_if(F.col("status") == "open").alias("open"), F.max("closed_at").alias("last_close"), F.sum("r_milli").alias("__s"), F.count("r_milli").alias("__n"))
    j = d.join(t, "run_id", "full").join(manifests, "run_id", "left")
    out = j.select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("snapshots", "decisions", "trades", "open")], F.coalesce("any_approved", F.lit(False)).alias("any_approved"), mean_r(F.col("__s"), F.coalesce("__n", F.lit(0))).alias("expectancy_r"), run_validity().alias("validity"), F.greatest("last_decision", "last_close").alias("last_activity"))
    return newest(out, "last_activity", k, "run_id")


def timeline(snapshots: DataFrame, evaluations: DataFrame, spreads: DataFrame, decisions: DataFrame, trades: DataFrame, k: int) -> DataFrame:
    """The newest k snapshots, each with its latest evaluation, spread and decision, and the
    latest trade of that decision.  The k snapshots are chosen first, so the right sides are
    reduced to them before they are ranked."""
    s = newest(snapshots, "bar_close", k, "snapshot_id")
    ids = s.select("snapshot_id")
    last = lambda df, tie: latest_per(df.join(ids, "snapshot_id", "left_semi"), ["snapshot_id"], [F.desc("at"), F.desc(tie)])
    e = last(evaluations, "evaluation_id").select("snapshot_id", F.col("evaluation_id"), "verdict")
    p = last(spreads, "spread_id").select("snapshot_id", "spread_id", "spread")
    d = last(decisions, "decision_id").select("snapshot_id", "decision_id", "direction")
    t = latest_per(trades.join(d.select("decision_id"), "decision_id", "left_semi"), ["decision_id"], [F.desc("at"), F.desc("trade_id")]).select("decision_id", "trade_id", F.col("status").alias("trade_status"))
    return s.join(e, "snapshot_id", "left").join(p, "snapshot_id", "left").join(d, "snapshot_id", "left").join(t, "decision_id", "left")


#: Releases that count, by exact name: (label, local publication hour, minute, impact), New York
#: (fixed values).
RELEASES = {
    "Consumer Price Index": ("CPI", 8, 30, "high"),
    "Employment Situation": ("NFP", 8, 30, "high"),
    "Personal Income and Outlays": ("PCE", 8, 30, "high"),
    "Producer Price Index": ("PPI", 8, 30, "medium"),
    "Advance Monthly Sales for Retail and Food Services": ("RetailSales", 8, 30, "medium"),
    "Gross Domestic Product": ("GDP", 8, 30, "medium"),
    "Job Openings and Labor Turnover Survey": ("JOLTS", 10, 0, "medium"),
}


#: Rate decisions, 14:00 New York; the list ends with its last date (fixed values).
FOMC = ("2026-01-28", "2026-03-18", "2026-04-29", "2026-06-17", "2026-07-29", "2026-09-16", "2026-11-04", "2026-12-16")


def fomc_events(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Rate decisions in [start, end] as high-impact events."""
    days = spark.createDataFrame([(d,) for d in FOMC], "day string").where(F.col("day").between(start, end))
    local = F.col("day").cast("timestamp_ntz") + F.expr("interval 14 hours")
    return days.select(F.lit("FOMC").alias("label"), F.lit("FOMC decision").alias("release_name"), F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), local).alias("scheduled_at"), F.lit("high").alias("impact"))


def classify_releases(dates: DataFrame, start: str, end: str) -> DataFrame:
    """dates(release_name, day) of known releases in [start, end] as events at their UTC
    instant; other names are dropped."""
    spec = dates.sparkSession.createDataFrame([(k, *v) for k, v in RELEASES.items()], "release_name string, label string, hour int, minute int, impact string")
    local = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour"), F.col("minute"))
    known = dates.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(F.broadcast(spec), "release_name")
    return known.select("label", "release_name", F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), local).alias("scheduled_at"), "impact")


def repair_costs(trades: DataFrame) -> DataFrame:
    """Moves slippage out of the modeled costs (a string array) where its rate is 0 or
    unknown, as a repair of manifests that claimed it."""
    wrong = F.array_contains("modeled", "slippage") & (F.coalesce("slippage_pct", F.lit(0.0)) == 0)
    return trades.withColumns({"modeled": F.when(wrong, F.array_remove("modeled", "slippage")).otherwise(F.col("modeled")), "not_modeled": F.when(wrong, F.array_append("not_modeled", F.lit("slippage"))).otherwise(F.col("not_modeled"))})


def backfill_targets(closes: DataFrame, last_done: DataFrame, most: int = 8) -> DataFrame:
    """Per symbol the newest ``most`` bar closes after the last one that was done (all are
    new where none was); older ones are given up."""
    fresh = closes.join(last_done.select("symbol", F.col("bar_close").alias("__done")), "symbol", "left").where("__done is null or bar_close > __done").drop("__done")
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_close")))
    return fresh.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")
