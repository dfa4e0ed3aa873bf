"""Idempotent writes and ledgers as pure functions of tables.

Parquet has no MERGE, so a write is ``(existing, incoming) -> new state with a status per
row``; sequential ledgers, where what was refused before decides what is granted next, are
ordered folds over one key's small event rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcraft.operators.segments import SLICE_MINUTES, running
from barcraft.sources.sinks import settled


def _latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def upsert_snapshots(existing: DataFrame, incoming: DataFrame, key: list[str], enrich: str) -> DataFrame:
    """Insert if absent; of a present row only a null ``enrich`` is filled.  Status: inserted,
    enriched, unchanged, or kept (not in incoming).  Keys are not null."""
    a = existing.select(*key, F.struct(*[c for c in existing.columns if c not in key]).alias("__a"))
    b = incoming.select(*key, F.struct(*[c for c in existing.columns if c not in key]).alias("__b"))
    both = a.join(b, key, "full")
    old, new = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    fills = old & new & F.col(f"__a.{enrich}").isNull() & F.col(f"__b.{enrich}").isNotNull()
    rest = [c for c in existing.columns if c not in key]
    return both.select(
        *key, *[(F.coalesce(F.col(f"__a.{c}"), F.col(f"__b.{c}")) if c == enrich else F.when(old, F.col(f"__a.{c}")).otherwise(F.col(f"__b.{c}"))).alias(c) for c in rest],
        F.when(~old, "inserted").when(fills, "enriched").when(new, "unchanged").otherwise("kept").alias("status"),
    )


def latest_evaluations(evaluations: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key of an append-only table."""
    return _latest(evaluations, key, [F.desc(at), F.desc(tie)])


def insert_absent(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """existing plus the incoming rows whose key is new, first of equals by the whole row; a
    row with a null in its key is not constrained and always goes in."""
    constrained = F.lit(True)
    for k in key:
        constrained = constrained & F.col(k).isNotNull()
    one = _latest(incoming.where(constrained), key, [F.col(c).asc() for c in incoming.columns if c not in key] or [F.lit(1)])
    fresh = one.join(existing.select(*key), key, "left_anti").select(*incoming.columns)
    return existing.withColumn("outcome", F.lit("existing")).unionByName(fresh.unionByName(incoming.where(~constrained)).withColumn("outcome", F.lit("inserted")))


def upsert_trades(existing: DataFrame, incoming: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Open rows take the incoming fields (keeping a known external_id); closed ones are
    terminal.  Outcome: inserted, updated, terminal or kept."""
    a = existing.select(*key, F.struct(*fields).alias("__a"))
    b = incoming.select(*key, F.struct(*fields).alias("__b"))
    both = a.join(b, key, "full")
    outcome = F.when(F.col("__a").isNull(), "inserted").when(F.col("__b").isNull(), "kept").when(F.col("__a.status") == "open", "updated").otherwise("terminal")
    take = outcome.isin("inserted", "updated")
    pick = lambda f: F.when(take, F.coalesce(F.col(f"__b.{f}"), F.col(f"__a.{f}")) if f == "external_id" else F.col(f"__b.{f}")).otherwise(F.col(f"__a.{f}"))
    return both.select(*key, *[pick(f).alias(f) for f in fields], outcome.alias("outcome"))


def replay_reservations(events: DataFrame, lease_seconds: int) -> DataFrame:
    """events(key, ts, seq, worker, action) in (ts, seq) order, action reserve, complete or
    fail: granted says whether a reserve got the key (new, failed before, or lease run out)
    or a worker's completion found its own live claim.  done is terminal."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ts", "ascending"), ("seq", "ascending")])
        at = table.column("ts").cast(pa.int64()).to_pylist()
        state, owner, until, granted, after = "new", None, 0, [], []
        for t, worker, action in zip(at, table.column("worker").to_pylist(), table.column("action").to_pylist(), strict=True):
            if action == "reserve":
                ok = state in ("new", "failed") or (state == "reserved" and t >= until)
                if ok:
                    state, owner, until = "reserved", worker, t + lease_seconds * 1_000_000
            else:
                ok = state == "reserved" and owner == worker
                if ok:
                    state = "done" if action == "complete" else "failed"
            granted.append(ok)
            after.append(state)
        return table.append_column("granted", pa.array(granted, pa.bool_())).append_column("state", pa.array(after, pa.string()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema) + ", granted boolean, state string"
    return events.groupBy("key").applyInArrow(run, schema)


def pin_manifests(rows: DataFrame) -> DataFrame:
    """rows(run_id, hash, created_at): the first hash of a run is pinned, others are counted."""
    first = rows.groupBy("run_id").agg(F.min_by("hash", F.struct("created_at", "hash")).alias("pinned"), F.collect_set("hash").alias("__all"))
    return first.select("run_id", "pinned", (F.size("__all") - 1).cast("long").alias("mismatches"))


def processed_bars(rows: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """Last write of each key wins."""
    return _latest(rows, key, [F.desc(at), F.desc(tie)])


def last_processed(rows: DataFrame) -> DataFrame:
    """Per (symbol, provider) the newest bar that went well."""
    return rows.where("ok").groupBy("symbol", "provider").agg(F.max("bar_close").alias("last_ok"))


def downtime_gaps(ok_bars: DataFrame, missed: Column) -> DataFrame:
    """Rows of ok_bars(symbol, bar_close) before which open-market bars were missed; ``missed``
    counts them from prev_close to bar_close."""
    w = Window.partitionBy("symbol").orderBy("bar_close")
    return ok_bars.withColumn("prev_close", F.lag("bar_close").over(w)).withColumn("missed", missed).where("missed > 0")


def _possible(budget: int):
    """Rows(month, run_id, day, cost, refunds, ...) in time order by run and day, less those that are refused for certain.

    Where a request is refused, later ones of its run and day that cost as much or more are refused,
    too.  So if the earlier ones up to a cost pass the least budget together with it, it is refused,
    whether they were granted or one of them was not.  Kept are the costs that still fit together,
    dearest on top: no more of them than the budget holds.  That is true of any part of the rows, but
    not of a month with refunds, which is passed on whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, dearest, total, most = None, [], 0, None
        for batch in batches:
            keep = []
            for *now, cost, refunds in zip(*(batch.column(c).to_pylist() for c in ("month", "run_id", "day", "cost", "refunds")), strict=True):
                if now != key:
                    key, dearest, total, most = now, [], 0, budget + 1
                if refunds or cost < most:
                    keep.append(True)
                    if not refunds:
                        heapq.heappush(dearest, -cost)
                        total += cost
                        while total > budget:
                            most = -heapq.heappop(dearest)
                            total -= most
                        keep[-1] = cost < most
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _grants(run_budget: int, day_budget: int, month_budget: int):
    """The ids of granted rows; what was spent before (id null) comes first in a month."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs, days, spent = (), {}, {}, 0
        for batch in batches:
            granted = []
            for month, r, day, cost, i in zip(*(batch.column(c).to_pylist() for c in ("month", "run_id", "day", "cost", "id")), strict=True):
                if key != (month,):
                    key, runs, days, spent = (month,), {}, {}, 0
                if i is None or (runs.get(r, 0) + cost <= run_budget and days.get(day, 0) + cost <= day_budget and spent + cost <= month_budget):
                    runs[r], days[day], spent = runs.get(r, 0) + cost, days.get(day, 0) + cost, spent + cost
                    if i is not None:
                        granted.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(granted, pa.int64())], ["__granted"])

    return run


def budget_grants(requests: DataFrame, run_budget: int, day_budget: int, month_budget: int, slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """requests(month, ts, seq, run_id, micro) with ``granted``: refused if it would pass a
    run's, a UTC day's or the month's budget; a refused request spends nothing.

    Running sums of what all requests would spend show how far a month is granted whole: up to the
    first that passes a budget, sums are what was spent, so all before it are granted.  From there
    on a month is folded (budgets span its runs and days), from what was spent by run and day, but
    only over requests that costs of their own run and day leave possible, found in slices of time,
    then by run and day.  Python sees rows as a stream in order and holds sums by run and day, never a
    month.  A month that never refuses is not folded; requests of no cost are granted unfolded."""
    names = requests.columns
    rows = requests.withColumns({"__day": F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000), "__micro": F.col("micro").cast("long")})
    for by, name in ((["run_id"], "__run"), (["__day"], "__of_day"), ([], "__month")):
        rows = running(rows.withColumn(name, F.col("__micro")), ["month", *by], "ts", ["seq"], sums=[name], slice_minutes=slice_minutes)
    over = (F.col("__run") > run_budget) | (F.col("__of_day") > day_budget) | (F.col("__month") > month_budget)
    rows = settled(rows.select(*names, "__day", "__micro", over.alias("__over"), F.monotonically_increasing_id().alias("__id")), "requests")
    first = rows.groupBy("month").agg(F.min(F.when(F.col("__over"), F.struct("ts", "seq"))).alias("__first"), (F.min("__micro") < 0).alias("__refunds")).where("__first is not null")
    first = settled(first.withColumnRenamed("month", "__m"), "refusals")
    if first.isEmpty():
        return rows.select(*names, F.lit(True).alias("granted"))
    marked = rows.join(first, F.col("month").eqNullSafe(F.col("__m")), "left").drop("__m")
    early = F.col("__first").isNull() | (F.struct("ts", "seq") < F.col("__first"))
    free = (F.col("__micro") == 0) & F.lit(min(run_budget, day_budget, month_budget) >= 0)
    spent = marked.where(early & F.col("__first").isNotNull()).groupBy("month", "run_id", F.col("__day").alias("day")).agg(F.sum("__micro").alias("cost"))
    open_ = marked.where(~early & ~free).select("month", "run_id", F.col("__day").alias("day"), "ts", "seq", F.col("__micro").alias("cost"), F.col("__refunds").alias("refunds"), F.col("__id").alias("id"))
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (max(1, slice_minutes // 168) * 60_000_000))  # an hour by default
    sieve, shape = _possible(min(run_budget, day_budget, month_budget)), open_.schema
    for by in (["month", "run_id", "day", slot], ["month", "run_id", "day"]):
        open_ = open_.repartition(*by).sortWithinPartitions("month", "run_id", "day", "ts", "seq", "id").mapInArrow(sieve, shape)
    fold = open_.drop("refunds").unionByName(spent, allowMissingColumns=True).repartition("month").sortWithinPartitions("month", F.col("id").isNotNull(), "ts", "seq", "id")
    granted = settled(fold.select("month", "run_id", "day", "cost", "id").mapInArrow(_grants(run_budget, day_budget, month_budget), "__granted long"), "grants")
    out = marked.join(granted, F.col("__id") == F.col("__granted"), "left")
    return out.select(*names, (early | free | F.col("__granted").isNotNull()).alias("granted"))


def spend(attempts: DataFrame, now: str, run_id: str) -> DataFrame:
    """Spent millionths of a run, of now's UTC day and of its month; errors cost nothing."""
    t = F.lit(now).cast("timestamp_ntz")
    since = lambda unit: F.col("ts") >= F.date_trunc(unit, t.cast("timestamp")).cast("timestamp_ntz")
    cost = F.coalesce("actual_micro", "est_micro")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, cost)), F.lit(0)).cast("long")
    return attempts.where((F.col("status") != "error") & (F.col("ts") <= t)).agg(part(F.col("run_id") == run_id).alias("run_micro"), part(since("day")).alias("day_micro"), part(since("month")).alias("month_micro"))


def backlog(attempts: DataFrame, now: str, stale_seconds: int = 300) -> DataFrame:
    """Per run: completed attempts to reconcile and started ones older than the limit."""
    old = F.col("ts") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {stale_seconds} seconds")
    return attempts.groupBy("run_id").agg(F.count_if((F.col("status") == "completed") & ~F.col("reconciled")).alias("to_reconcile"), F.count_if((F.col("status") == "started") & old).alias("orphans"))


def sweep_attempts(attempts: DataFrame, now: str, stale_seconds: int = 300) -> DataFrame:
    """Started attempts older than the limit become unknown."""
    old = F.col("ts") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {stale_seconds} seconds")
    return attempts.withColumn("status", F.when((F.col("status") == "started") & old, "unknown").otherwise(F.col("status")))


def finalize_attempts(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """Started attempts take the status and cost of their result(attempt_id, outcome, cost)."""
    j = attempts.join(results, "attempt_id", "left")
    hit = (F.col("status") == "started") & F.col("outcome").isNotNull()
    return j.select("attempt_id", F.when(hit, F.col("outcome")).otherwise(F.col("status")).alias("status"), F.when(hit, F.col("cost")).otherwise(F.col("actual_micro")).alias("actual_micro"))


def merge_archive(existing: DataFrame, fetched: DataFrame, policy: str, values: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Full outer merge by (symbol, tf, open_time) with status added, conflict, same or kept;
    a conflict keeps or replaces by policy, and policy fail raises if there is one."""
    key = ["symbol", "tf", "open_time"]
    a = existing.select(*key, F.struct(*values).alias("__a"))
    b = fetched.select(*key, F.struct(*values).alias("__b"))
    both = a.join(b, key, "full")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"__a.{v}").eqNullSafe(F.col(f"__b.{v}"))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "kept").when(differs, "conflict").otherwise("same")
    merged = both.withColumn("status", status)
    if policy == "fail":
        if not merged.where("status = 'conflict'").isEmpty():
            raise ValueError("fetched bars differ from the archive")
    elif policy not in ("keep", "replace"):
        raise ValueError(f"unknown policy {policy!r}")
    take = (F.col("status") == "added") | ((F.col("status") == "conflict") & F.lit(policy == "replace"))
    return merged.select(*key, *[F.when(take, F.col(f"__b.{v}")).otherwise(F.col(f"__a.{v}")).alias(v) for v in values], "status")


def close_trades(trades: DataFrame, exits: DataFrame) -> DataFrame:
    """Open trades take their exit(trade_id, exit_price, quarantine_reason): quarantined with
    a reason, closed with a price, expired without one.  Others stay as they are."""
    j = trades.join(exits, "trade_id", "left")
    hit = (F.col("status") == "open") & F.col("hit")
    status = F.when(~F.coalesce(hit, F.lit(False)), F.col("status")).when(F.col("quarantine_reason").isNotNull(), "quarantined").when(F.col("exit_price").isNotNull(), "closed").otherwise("expired")
    return j.select("trade_id", status.alias("status"), F.when(F.coalesce(hit, F.lit(False)), F.col("exit_price")).alias("exit_price"))


def heartbeats(beats: DataFrame) -> DataFrame:
    """beats(service, instance, ts, seq, status, success) -> one row per service: started_at of
    the present unbroken run of one instance, last status and last success."""
    w = Window.partitionBy("service").orderBy("ts", "seq")
    changed = F.coalesce(F.lag("instance").over(w) != F.col("instance"), F.lit(True))
    runs = beats.withColumn("__run", F.sum(changed.cast("int")).over(w))
    per = runs.groupBy("service", "__run").agg(F.min("ts").alias("started_at"), F.max_by("instance", F.struct("ts", "seq")).alias("instance"), F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("last_seen"))
    last = per.groupBy("service").agg(F.max_by(F.struct("started_at", "instance", "status", "last_seen"), "__run").alias("x"))
    good = beats.groupBy("service").agg(F.max(F.when(F.col("success"), F.col("ts"))).alias("last_success_at"))
    return last.join(good, "service").select("service", "x.started_at", "x.instance", "x.status", "x.last_seen", "last_success_at")


def finish_runs(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """A run ends once, by its owner's first finish(run_id, owner, ts, status); later and
    foreign ones are refused."""
    own = finishes.join(starts.select("run_id", F.col("owner").alias("__owner"), F.col("ts").alias("__start")), "run_id").where("owner = __owner and ts >= __start")
    first = own.groupBy("run_id").agg(F.min_by(F.struct("ts", "status"), F.struct("ts", "status")).alias("f"))
    return starts.join(first, "run_id", "left").select("run_id", F.coalesce("f.status", F.lit("running")).alias("status"), F.col("f.ts").alias("finished_at"))
