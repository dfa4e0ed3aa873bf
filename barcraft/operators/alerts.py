"""Operator alerts from the engine's own tables: one conditional count per rule, one pass per
table, rules that found nothing left out, the gravest first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the rules in seconds (fixed values).
STALE_TRADE, STALE_BEAT, STUCK_RUN = 48 * 3600, 20 * 60, 20 * 60
RANK = {"critical": 0, "warning": 1, "info": 2}


def _older(column: str, now: str, seconds: int) -> Column:
    t = F.lit(now).cast("timestamp_ntz")
    return F.col(column) < t - F.expr(f"interval {seconds} seconds")


def _counts(table: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Rows (severity, code, n) with how many rows of table a rule concerns."""
    row = table.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(code) for code, (_, c) in rules.items()])
    listed = ", ".join(f"'{severity}', '{code}', `{code}`" for code, (severity, _) in rules.items())
    return row.selectExpr(f"stack({len(rules)}, {listed}) as (severity, code, n)")


def state_alerts(now: str, open_trades: DataFrame, reservations: DataFrame, services: DataFrame, pipeline_runs: DataFrame, snapshots: DataFrame, trades: DataFrame, attempts: DataFrame, downtime: DataFrame, wanted: tuple[str, ...] = ("collector_scheduler", "shadow_online")) -> DataFrame:
    """(severity, code, n) of the rules that concern any row (or, for services that should
    run and the track record, of those that lack one), by severity and code."""
    t = F.lit(now).cast("timestamp_ntz")
    status = F.col("status")
    parts = [
        _counts(open_trades, {"STALE_OPEN_SHADOW": ("warning", _older("opened_at", now, STALE_TRADE)), "SHADOW_TIMEOUT_OVERDUE": ("warning", F.col("timeout_at") < t)}),
        _counts(reservations, {"EXPIRED_RESERVATION": ("warning", (status == "in_progress") & (F.col("lease_expires_at") < t))}),
        _counts(services, {
            "SERVICE_ERROR": ("critical", status == "error"), "SERVICE_DEGRADED": ("warning", status == "degraded"), "SERVICE_STOPPED": ("warning", (status == "stopped") & ~F.col("service_name").endswith("_once")),
            "SERVICE_HEARTBEAT_STALE": ("critical", (status != "stopped") & _older("last_seen_at", now, STALE_BEAT)),
        }),
        _counts(pipeline_runs, {"PIPELINE_RUN_STUCK": ("warning", (status == "running") & _older("started_at", now, STUCK_RUN))}),
        _counts(snapshots, {"TEST_DATA_IN_DB": ("warning", F.col("symbol").startswith("TST_"))}),
        _counts(trades, {"QUARANTINED_TRADES": ("warning", status == "quarantined")}),
        _counts(attempts, {"PAID_ORPHANS": ("warning", (status == "started") & _older("ts", now, 300)), "PAID_UNRECONCILED": ("info", (status == "completed") & ~F.col("reconciled"))}),
        _counts(downtime, {"DOWNTIME_GAPS": ("info", F.lit(True))}),
    ]
    absent = {"collector_scheduler": ("warning", "COLLECTOR_NOT_RUNNING"), "shadow_online": ("info", "SHADOW_NOT_RUNNING")}
    for name in wanted:
        severity, code = absent[name]
        parts.append(services.agg(F.count_if(F.col("service_name") == name).alias("k")).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.when(F.col("k") == 0, 1).otherwise(0).cast("long").alias("n")))
    parts.append(snapshots.agg(F.count("*").alias("k")).select(F.lit("warning").alias("severity"), F.lit("NO_MARKET_SNAPSHOT").alias("code"), F.when(F.col("k") == 0, 1).otherwise(0).cast("long").alias("n")))
    parts.append(trades.agg(F.count("*").alias("k")).select(F.lit("info").alias("severity"), F.lit("NO_VERIFIED_TRACK_RECORD").alias("code"), F.when(F.col("k") == 0, 1).otherwise(0).cast("long").alias("n")))
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("severity")]
    return reduce(DataFrame.unionByName, parts).where("n > 0").orderBy(rank, "code")


#: Seconds by which the last snapshot may lag the feed (fixed value).
BRAIN_LAG = 1800


def _raised(rules: dict[str, tuple[str, Column]]) -> Column:
    """Array of (severity, code) of the rules that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for code, (severity, c) in rules.items()]))


def _listed(states: DataFrame, rules: dict[str, tuple[str, Column]], *keys: str) -> DataFrame:
    return states.select(*keys, F.explode(_raised(rules)).alias("a")).select(*keys, "a.severity", "a.code")


def feed_alerts(now: str, feeds: DataFrame, max_lag: int) -> DataFrame:
    """(symbol, severity, code) of feeds(symbol, market_open, session_ok, quote_ok, candles_ok,
    feed_last, snapshot_last, paid_decisions, paid_calls, run_validity): a row per symbol watched.

    Each alert has a condition of its own; several can be raised at once.  Quotes and candles are
    only asked for while the market is open and the session up.  Without any bar the feed counts
    as stale exactly then; with one, by its age."""
    t = F.lit(now).cast("timestamp_ntz")
    seconds = lambda a, b: F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))
    feed, snapshot, open_, up = F.col("feed_last"), F.col("snapshot_last"), F.col("market_open"), F.col("session_ok")
    return _listed(feeds, {
        "BRAIN_BEHIND_FEED": ("warning", seconds(feed, snapshot) > BRAIN_LAG),
        "NO_MARKET_SNAPSHOT": ("warning", snapshot.isNull()),
        "FEED_STALE": ("critical", open_ & F.when(feed.isNotNull(), seconds(t, feed) > max_lag).otherwise(up)),
        "QUOTE_UNAVAILABLE": ("warning", up & open_ & ~F.coalesce("quote_ok", F.lit(False))),
        "CANDLES_UNAVAILABLE": ("critical", up & open_ & ~F.coalesce("candles_ok", F.lit(False))),
        "LLM_AUDIT_GAP": ("warning", (F.col("paid_decisions") > 0) & (F.col("paid_calls") == 0)),
        "UNVERIFIED_RUN_SELECTED": ("warning", F.col("run_validity") == "unverified"),
    }, "symbol")


def system_alerts(states: DataFrame) -> DataFrame:
    """(host, severity, code) of states(host, repo_dirty, repo_state, db_ok, schema_current,
    broker_ok, environment, trading_enabled, has_status): code, store and broker of a host."""
    status = F.col("has_status")
    dirty, db = F.coalesce("repo_dirty", F.lit(False)), F.coalesce("db_ok", F.lit(False))
    return _listed(states, {
        "REPO_DIRTY": ("warning", dirty),
        "REPO_PROVENANCE_UNKNOWN": ("warning", ~dirty & (F.col("repo_state") == "unknown")),
        "DATABASE_DOWN": ("critical", ~db),
        "DB_SCHEMA_MISMATCH": ("critical", db & ~F.coalesce("schema_current", F.lit(False))),
        "XTB_DISCONNECTED": ("critical", ~F.coalesce("broker_ok", F.lit(False))),
        "NOT_DEMO": ("critical", status & ~F.col("environment").eqNullSafe(F.lit("demo"))),
        "REAL_ORDERS_ENABLED": ("critical", F.col("trading_enabled")),
        "TRADING_FLAG_UNKNOWN": ("warning", status & F.col("trading_enabled").isNull()),
    }, "host")
