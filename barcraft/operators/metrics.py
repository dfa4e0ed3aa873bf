"""Report metrics over trades: summaries, drawdown, discrimination, folds, bootstrap.

R-multiples are integers of thousandths (``r_milli``): sums are exact and commute, so any
partitioning gives the same figures; division to doubles comes last.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcraft.functions.numeric import round_to
from barcraft.operators.segments import running
from barcraft.sources.sinks import settled


def mean_r(total: Column, n: Column, digits: int = 6) -> Column:
    return F.when(n > 0, round_to(total / 1000.0 / n, digits))


def summarize(trades: DataFrame, by: list[str]) -> DataFrame:
    """Per group: counts, win rate, expectancy, total, best and worst R, ambiguity rate and
    the mean R with ambiguous exits read pessimistically and optimistically.  A trade counts
    as closed if it has an R."""
    r = F.col("r_milli")
    closed = r.isNotNull()
    n = F.count_if(closed)
    agg = trades.groupBy(*by).agg(
        F.count("*").alias("trades"), n.alias("closed"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(r > 0).alias("wins"), F.sum(r).alias("__sum"), F.max(r).alias("__best"), F.min(r).alias("__worst"),
        F.count_if(closed & F.col("ambiguous")).alias("ambiguous"), F.sum(F.when(closed, F.coalesce("r_pess_milli", r))).alias("__pess"), F.sum(F.when(closed, F.coalesce("r_opt_milli", r))).alias("__opt"),
    )
    c = F.col("closed")
    return agg.select(
        *by, "trades", "closed", "open", F.when(c > 0, round_to(F.col("wins") / c, 6)).alias("win_rate"), mean_r(F.col("__sum"), c).alias("expectancy_r"), (F.col("__sum") / 1000.0).alias("total_r"),
        (F.col("__best") / 1000.0).alias("best_r"), (F.col("__worst") / 1000.0).alias("worst_r"), F.when(c > 0, round_to(F.col("ambiguous") / c, 6)).alias("ambiguity_rate"), mean_r(F.col("__pess"), c).alias("expectancy_pess"), mean_r(F.col("__opt"), c).alias("expectancy_opt"),
    )


def trade_rows(trades: DataFrame, symbol: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The trades that ``summarize`` counts, one row each, of one symbol or of all, with the columns
    of ``keep`` before what a report shows."""
    chosen = trades if symbol is None else trades.where(F.col("symbol") == symbol)
    named = {"r_milli": "r_multiple", "r_pess_milli": "r_pessimistic", "r_opt_milli": "r_optimistic"}
    return chosen.select(*keep, "status", "exit_reason", *[(F.col(c) / 1000.0).alias(n) for c, n in named.items()], "ambiguous")


def exit_reasons(trades: DataFrame, by: list[str]) -> DataFrame:
    """Closed trades per exit reason; an empty or null reason is unknown."""
    reason = F.when(F.coalesce(F.col("exit_reason"), F.lit("")) == "", "unknown").otherwise(F.col("exit_reason"))
    return trades.where("r_milli is not null").groupBy(*by, reason.alias("exit_reason")).agg(F.count("*").alias("n"))


def regime_performance(trades: DataFrame, run_id: str, before: str) -> DataFrame:
    """Per regime what was known before an instant: trades, win rate and mean R to 3."""
    t = F.lit(before).cast("timestamp_ntz")
    known = trades.where((F.col("run_id") == run_id) & (F.col("status") != "open") & F.col("r_milli").isNotNull() & (F.col("observed_at") < t))
    g = known.groupBy("regime").agg(F.count("*").alias("trades"), F.count_if(F.col("r_milli") > 0).alias("__wins"), F.sum("r_milli").alias("__sum"))
    return g.select("regime", "trades", round_to(F.col("__wins") / F.col("trades"), 3).alias("win_rate"), mean_r(F.col("__sum"), F.col("trades"), 3).alias("avg_r"))


def trade_metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    """Counts by status; here closed means closed or expired, and any R enters the mean."""
    done = F.col("status").isin("closed", "expired")
    g = trades.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(done).alias("closed"), F.count_if(F.col("status") == "quarantined").alias("quarantined"), F.count_if(done & (F.col("r_milli") > 0)).alias("wins"), F.count_if(F.col("ambiguous")).alias("ambiguous"), F.sum("r_milli").alias("__s"), F.count("r_milli").alias("__n"))
    return g.select(*by, "total", "open", "closed", "quarantined", "wins", "ambiguous", mean_r(F.col("__s"), F.col("__n")).alias("expectancy_r"))


def _sliced(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``__slice``, ascending with the first column of ``order``: its day, or the value
    itself where it is no time.  A slice's rows are one task, not a group's."""
    first = F.col(order[0])
    timed = rows.schema[order[0]].dataType.simpleString().startswith("timestamp")
    return rows.withColumn("__slice", F.date_trunc("day", first.cast("timestamp")) if timed else first)


def max_drawdown(trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Greatest fall of the running sum below its peak so far, the peak starting at 0.

    Slices of time are summed on their own: each gives its total, its greatest and least
    running sum and its own greatest fall; the slices, few per group, then combine in order."""
    w = Window.partitionBy(*by, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = _sliced(trades.where("r_milli is not null"), order).withColumn("__eq", F.sum("r_milli").over(w))
    inside = inside.withColumn("__fall", F.greatest(F.lit(0), F.max("__eq").over(w)) - F.col("__eq"))
    parts = inside.groupBy(*by, "__slice").agg(F.sum("r_milli").alias("__sum"), F.max("__eq").alias("__top"), F.min("__eq").alias("__low"), F.max("__fall").alias("__fall"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__from", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    peak = F.greatest(F.lit(0), F.coalesce(F.max(F.greatest("__from", F.col("__from") + F.col("__top"))).over(before), F.lit(0)))
    across = parts.withColumn("__peak", peak).withColumn("__across", F.greatest("__peak", "__from") - F.col("__from") - F.col("__low"))
    return across.groupBy(*by).agg((F.greatest(F.max("__fall"), F.max("__across"), F.lit(0)) / 1000.0).alias("max_drawdown_r"))


def confidence_buckets(trades: DataFrame, bins: int = 10) -> DataFrame:
    """Half-open buckets of confidence_pct (0 to 100), the last including 100: count, mean
    confidence and win rate."""
    width = 100 // bins
    bucket = F.least(F.floor(F.col("confidence_pct") / width), F.lit(bins - 1)).cast("int")
    return trades.where("r_milli is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), round_to(F.sum("confidence_pct") / F.count("*") / 100, 6).alias("avg_confidence"), round_to(F.count_if(F.col("r_milli") > 0) / F.count("*"), 6).alias("win_rate"))


def confidence_discrimination(trades: DataFrame, bins: int = 10) -> DataFrame:
    """(buckets, monotonic, spread): whether the win rate never falls from one occupied bucket
    to the next, and top minus bottom; null with one bucket or none."""
    b = confidence_buckets(trades, bins)
    drop = F.col("win_rate") - F.lag("win_rate").over(Window.orderBy("bucket"))  # at most ``bins`` rows
    g = b.withColumn("__d", drop).agg(F.count("*").alias("buckets"), F.min(F.coalesce(F.col("__d"), F.lit(0.0))).alias("__m"), (F.max_by("win_rate", "bucket") - F.min_by("win_rate", "bucket")).alias("__s"))
    some = F.col("buckets") > 1
    return g.select("buckets", F.when(some, F.col("__m") >= 0).alias("monotonic"), F.when(some, round_to("__s", 6)).alias("spread"))


def regime_coverage(trades: DataFrame) -> DataFrame:
    return trades.where("r_milli is not null").groupBy(F.coalesce("regime", F.lit("unknown")).alias("regime")).agg(F.count("*").alias("n"))


def temporal_folds(trades: DataFrame, by: list[str], order: list[str], folds: int) -> DataFrame:
    """trades with ``fold``: equal runs in time order, the last taking the remainder; fewer
    rows than folds are one fold.  A row's place is its place in its slice of time and the
    number of rows in the slices before."""
    rows = _sliced(trades, order)
    sizes = rows.groupBy(*by, "__slice").agg(F.count("*").alias("__k"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__slice").alias("__s"), F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__before"), F.sum("__k").over(Window.partitionBy(*by)).alias("__n"))
    same = F.col("__slice").eqNullSafe(F.col("__s"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    at = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(*order)) - 1
    placed = rows.withColumn("__at", at).join(sizes, same)
    size = F.greatest(F.floor(F.col("__n") / folds), F.lit(1))
    fold = F.when(F.col("__n") < folds, F.lit(0)).otherwise(F.least(F.lit(folds - 1), F.floor((F.col("__before") + F.col("__at")) / size))).cast("int")
    return placed.select(*trades.columns, fold.alias("fold"))


def maker_comparison(trades: DataFrame, folds: int, order: list[str]) -> DataFrame:
    """Trades, win rate and expectancy per run and per run and fold (fold null: all folds)."""
    done = temporal_folds(trades.where("r_milli is not null"), ["run_id"], order, folds)
    g = done.groupingSets([["run_id"], ["run_id", "fold"]], "run_id", "fold").agg(F.count("*").alias("trades"), F.count_if(F.col("r_milli") > 0).alias("wins"), F.sum("r_milli").alias("__s"))
    return g.select("run_id", "fold", "trades", round_to(F.col("wins") / F.col("trades"), 6).alias("win_rate"), mean_r(F.col("__s"), F.col("trades")).alias("expectancy_r"))


def _seeded_below(seed: int, stop: int, count: int) -> Iterator[np.ndarray]:
    """The first ``count`` results of ``Random(seed).randrange(stop)``, in pieces: the same
    Mersenne Twister words, shifted to as many bits as ``stop`` has, those below it kept."""
    words = np.random.MT19937()
    *key, at = Random(seed).getstate()[1]
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}
    shift = np.uint64(32 - stop.bit_length())
    while count > 0:
        raw = words.random_raw(min(1 << 20, 2 * count + 64)) >> shift
        kept = raw[raw < stop][:count].astype(np.int64)
        count -= len(kept)
        yield kept


def bootstrap_means(values: Sequence[float], iters: int = 2000, seed: int = 12345, block: int | None = None) -> np.ndarray:
    """Sorted means of moving-block resamples; the block length is about the cube root.

    A resample is so many blocks from drawn starts, the last one cut to the length; its sum is
    a sum of differences of prefix sums (exact for integers below 2**53)."""
    n = len(values)
    if not n:
        return np.zeros(0)
    size = block or max(1, min(n, round(n ** (1 / 3))))
    blocks = -(-n // size)
    short = n - (blocks - 1) * size
    total = np.concatenate((np.zeros(1), np.cumsum(np.asarray(values, float))))
    width = np.full(blocks, size)
    width[-1] = short
    out, left = [], np.zeros(0, np.int64)
    for drawn in _seeded_below(seed, n - size + 1, iters * blocks):
        left = np.concatenate((left, drawn))
        whole = len(left) // blocks
        starts = left[: whole * blocks].reshape(whole, blocks)
        out.append((total[starts + width] - total[starts]).sum(axis=1) / n)
        left = left[whole * blocks :]
    return np.sort(np.concatenate(out))


def bootstrap_ci(trades: DataFrame, by: list[str], order: list[str], iters: int = 2000, alpha: float = 0.05, seed: int = 12345) -> DataFrame:
    """Confidence interval of the expectancy per group.  A group's R values must be resampled
    together, in order; each group is one task and only its R column travels."""

    def run(table: pa.Table) -> pa.Table:
        values = table.sort_by([(c, "ascending") for c in order]).column("r_milli").to_numpy()
        means = bootstrap_means(values, iters, seed) / 1000
        at = lambda q: float(means[min(len(means) - 1, max(0, int(q * len(means))))])
        keys = {c: pa.array([table.column(c)[0].as_py()], table.schema.field(c).type) for c in by}
        return pa.table(keys | {"n": [len(values)], "mean_r": [int(values.sum()) / 1000 / len(values)], "low": [at(alpha / 2)], "high": [at(1 - alpha / 2)]})

    rows = trades.where("r_milli is not null").select(*by, *[c for c in order if c not in by], "r_milli")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by).applyInArrow(run, f"{kinds}, n long, mean_r double, low double, high double")


def upper_median_seconds(bars: DataFrame, default: int = 900) -> DataFrame:
    """Per series the element len/2 of the sorted distances between opens, from the counts of
    the distinct distances."""
    w = Window.partitionBy("symbol", "tf").orderBy("open_time")
    d = bars.withColumn("__d", F.unix_seconds(F.col("open_time").cast("timestamp")) - F.unix_seconds(F.lag("open_time").over(w).cast("timestamp")))
    counts = d.groupBy("symbol", "tf", "__d").agg(F.count("__d").alias("__k"))  # the first bar has no distance: 0 of null
    upto = Window.partitionBy("symbol", "tf").orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"__upto": F.sum("__k").over(upto), "__n": F.sum("__k").over(Window.partitionBy("symbol", "tf"))})
    middle = F.min(F.when(F.col("__upto") > F.floor(F.col("__n") / 2), F.col("__d")))
    return ranked.groupBy("symbol", "tf").agg(F.coalesce(middle, F.lit(default)).alias("bar_seconds"))


def noisy_releases(releases: DataFrame, start: str, end: str, most: float = 6.0) -> DataFrame:
    """Release names with more than ``most`` dates a quarter of 91 days (one at least)."""
    quarters = F.greatest(F.lit(1.0), F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) / 91)
    return releases.where("release_name is not null").groupBy("release_name").agg(F.count("*").alias("n")).where(F.col("n") / quarters > most)


def evaluable_bars(bars: DataFrame, trigger_tf: str, min_bars: int) -> DataFrame:
    """Per symbol (warm_up_end, evaluable, short_tf): trigger bars from the instant at which
    every timeframe has ``min_bars`` bars; a timeframe that never has is named and gives 0."""
    w = Window.partitionBy("symbol", "tf").orderBy("open_time")
    warm = bars.withColumn("__n", F.row_number().over(w)).groupBy("symbol", "tf").agg(F.max(F.when(F.col("__n") == min_bars, F.col("open_time"))).alias("__at"))
    per = warm.groupBy("symbol").agg(F.max("__at").alias("__end"), F.min(F.when(F.col("__at").isNull(), F.col("tf"))).alias("short_tf"))
    trig = bars.where(F.col("tf") == trigger_tf).join(per, "symbol")
    n = trig.groupBy("symbol").agg(F.count_if((F.col("open_time") >= F.col("__end")) & F.col("short_tf").isNull()).alias("evaluable"))
    return per.join(n, "symbol", "left").select("symbol", F.when(F.col("short_tf").isNull(), F.col("__end")).alias("warm_up_end"), F.coalesce("evaluable", F.lit(0)).alias("evaluable"), "short_tf")


def median_of(values: Iterable[float]) -> float:
    ordered = sorted(values)
    return ordered[len(ordered) // 2]


def feedback(trades: DataFrame, instants: DataFrame, k: int = 5, ties: Sequence[str] = ("decision_id",)) -> DataFrame:
    """Per instants(run_id, as_of) one nested row of what was known strictly before it:
    regime_performance (regime, trades, win_rate, expectancy_r; most trades first, then by
    name, null last) and recent_trades (the last ``k`` by observed_at, newest first:
    direction, regime, r_multiple, exit_reason, closed_at).  Trades that are open, have no R
    or no observed_at are never known.  Empty arrays where nothing was.

    A trade counts from the first instant after it, found by the distinct times of a run, which are
    scanned in slices.  Trades are then added up by run, regime and that instant, and of each run
    and instant the last ``k`` go on: what is sorted along time after that is no larger than k rows an
    instant.  Trades observed at one instant are in the order of ``ties``."""
    known = trades.where("status <> 'open' and r_milli is not null and observed_at is not null")
    asked = instants.select("run_id", "as_of").distinct()
    times = known.select("run_id", F.col("observed_at").alias("t")).distinct().withColumns({"side": F.lit(1), "as_of": F.lit(None).cast(asked.schema["as_of"].dataType)})
    stack = times.unionByName(asked.select("run_id", F.col("as_of").alias("t"), F.lit(0).alias("side"), "as_of"))
    after = running(stack, ["run_id"], "t", ["side"], last=["as_of"], backward=True).where("side = 1 and as_of is not null")
    after = settled(after.select(F.col("run_id").alias("__run"), F.col("t").alias("__t"), F.col("as_of").alias("t")), "known_from")
    known = known.join(after, F.col("run_id").eqNullSafe(F.col("__run")) & (F.col("observed_at") == F.col("__t"))).drop("__run", "__t")
    sums = known.groupBy("run_id", "regime", "t").agg(F.count("*").alias("n"), F.count_if(F.col("r_milli") > 0).alias("wins"), F.sum("r_milli").alias("s"))
    sums = settled(sums, "known_sums")
    grid = asked.withColumnRenamed("as_of", "t").join(sums.select("run_id", "regime").distinct(), "run_id").withColumns({c: F.lit(0).cast("long") for c in ("n", "wins", "s")} | {"asked": F.lit(True)})
    w = Window.partitionBy("run_id", "regime").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    sums = grid.unionByName(sums.withColumn("asked", F.lit(False))).withColumns({c: F.sum(c).over(w) for c in ("n", "wins", "s")}).where("asked and n > 0")
    ranked = F.struct((-F.col("n")).alias("o"), F.col("regime").isNull().alias("p"), "regime", F.col("n").alias("trades"), round_to(F.col("wins") / F.col("n"), 3).alias("win_rate"), mean_r(F.col("s"), F.col("n"), 3).alias("expectancy_r"))
    drop = lambda x: F.struct(x["regime"].alias("regime"), x["trades"].alias("trades"), x["win_rate"].alias("win_rate"), x["expectancy_r"].alias("expectancy_r"))
    regimes = sums.groupBy("run_id", F.col("t").alias("as_of")).agg(F.transform(F.sort_array(F.collect_list(ranked)), drop).alias("regime_performance"))

    one = F.struct("direction", "regime", (F.col("r_milli") / 1000.0).alias("r_multiple"), "exit_reason", "closed_at")
    newest = Window.partitionBy("run_id", "t").orderBy(F.desc("observed_at"), *[F.desc(c) for c in ties])
    known = known.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= k)
    last = Window.partitionBy("run_id").orderBy("observed_at", *ties).rowsBetween(-(k - 1), 0)
    lists = known.select("run_id", F.col("observed_at").alias("t"), F.lit(1).alias("side"), F.struct(*ties).alias("tie"), F.reverse(F.collect_list(one).over(last)).alias("recent_trades"))
    points = asked.select("run_id", F.col("as_of").alias("t"), F.lit(0).alias("side"), F.lit(None).cast(lists.schema["tie"].dataType).alias("tie"), F.lit(None).cast(lists.schema["recent_trades"].dataType).alias("recent_trades"))
    carried = points.unionByName(lists).withColumn("recent_trades", F.last("recent_trades", ignorenulls=True).over(Window.partitionBy("run_id").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0))).where("side = 0")
    out = carried.select("run_id", F.col("t").alias("as_of"), "recent_trades").join(regimes, ["run_id", "as_of"], "left")
    none = lambda c, frame: F.coalesce(c, F.array().cast(frame.schema[c].dataType)).alias(c)
    return out.select("run_id", "as_of", none("regime_performance", regimes), none("recent_trades", lists))
