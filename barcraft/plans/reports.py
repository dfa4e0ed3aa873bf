"""Metric, spend, alert and text-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcraft.functions import redaction
from barcraft.functions.numeric import round_to
from barcraft.operators import ledger, lookup, metrics
from barcraft.plans.registry import query
from barcraft.sources import adapters as a
from barcraft.sources import footers

T = a.TRADES_SQL
ORDER = ["closed_at", *a.TRADE_ORDER]
_ORDER = ", ".join(ORDER)
_MEAN = "round({s} / 1000.0::DOUBLE / {n}, {d})"


def _m(s: str, n: str, d: int = 6) -> str:
    return f"CASE WHEN {n} > 0 THEN round({s} / 1000.0::DOUBLE / {n}, {d}) END"


@query(f"""SELECT run_id, regime, trades, closed, "open", CASE WHEN closed > 0 THEN round(wins / closed, 6) END AS win_rate, {_m('s', 'closed')} AS expectancy_r, s / 1000.0::DOUBLE AS total_r, best / 1000.0::DOUBLE AS best_r, worst / 1000.0::DOUBLE AS worst_r, CASE WHEN closed > 0 THEN round(amb / closed, 6) END AS ambiguity_rate, {_m('p', 'closed')} AS expectancy_pess, {_m('o', 'closed')} AS expectancy_opt
FROM (SELECT run_id, regime, count(*) AS trades, count(r_milli) AS closed, count(*) FILTER (WHERE status = 'open') AS "open", count(*) FILTER (WHERE r_milli > 0) AS wins, sum(r_milli)::BIGINT AS s, max(r_milli) AS best, min(r_milli) AS worst, count(*) FILTER (WHERE r_milli IS NOT NULL AND ambiguous) AS amb,
  sum(CASE WHEN r_milli IS NOT NULL THEN coalesce(r_pess_milli, r_milli) END)::BIGINT AS p, sum(CASE WHEN r_milli IS NOT NULL THEN coalesce(r_opt_milli, r_milli) END)::BIGINT AS o FROM ({T}) GROUP BY 1, 2)""")
def summarize(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.summarize(a.trade_facts(spark, sf), ["run_id", "regime"])


@query(f"SELECT decision_id, part, status, exit_reason, r_milli / 1000.0::DOUBLE AS r_multiple, r_pess_milli / 1000.0::DOUBLE AS r_pessimistic, r_opt_milli / 1000.0::DOUBLE AS r_optimistic, ambiguous FROM ({T}) WHERE run_id = 'R'")
def trade_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The listing behind the report of one symbol (runs stand for symbols in the test tables)."""
    t = a.trade_facts(spark, sf).withColumn("symbol", F.col("run_id"))
    return metrics.trade_rows(t, "R", keep=("decision_id", "part"))


@query(f"SELECT run_id, CASE WHEN exit_reason = '' THEN 'unknown' ELSE exit_reason END AS exit_reason, count(*) AS n FROM ({T}) WHERE r_milli IS NOT NULL GROUP BY 1, 2")
def exit_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.exit_reasons(a.trade_facts(spark, sf), ["run_id"])


@query(f"SELECT regime, count(*) AS trades, round(count(*) FILTER (WHERE r_milli > 0) / count(*), 3) AS win_rate, {_m('sum(r_milli)::BIGINT', 'count(*)', 3)} AS avg_r FROM ({T}) WHERE run_id = 'R' AND status <> 'open' AND r_milli IS NOT NULL AND observed_at < TIMESTAMP '1999-06-01' GROUP BY 1")
def regime_performance(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.regime_performance(a.trade_facts(spark, sf), "R", "1999-06-01 00:00:00")


@query(f"""SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'open') AS "open", count(*) FILTER (WHERE status IN ('closed', 'expired')) AS closed, count(*) FILTER (WHERE status = 'quarantined') AS quarantined, count(*) FILTER (WHERE status IN ('closed', 'expired') AND r_milli > 0) AS wins, count(*) FILTER (WHERE ambiguous) AS ambiguous, {_m('sum(r_milli)::BIGINT', 'count(r_milli)')} AS expectancy_r FROM ({T}) GROUP BY 1""")
def dashboard_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.trade_metrics(a.trade_facts(spark, sf), ["run_id"])


@query(f"""WITH e AS (SELECT *, sum(r_milli) OVER (PARTITION BY run_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS eq FROM ({T}) WHERE r_milli IS NOT NULL)
SELECT run_id, max(fall) / 1000.0::DOUBLE AS max_drawdown_r FROM (SELECT run_id, greatest(0, max(eq) OVER (PARTITION BY run_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)) - eq AS fall FROM e) GROUP BY 1""")
def max_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.max_drawdown(a.trade_facts(spark, sf), ["run_id"], ORDER)


_BUCKETS = f"SELECT least(confidence_pct // 10, 9)::INT AS bucket, count(*) AS n, round(sum(confidence_pct)::BIGINT / count(*) / 100, 6) AS avg_confidence, round(count(*) FILTER (WHERE r_milli > 0) / count(*), 6) AS win_rate FROM ({T}) WHERE r_milli IS NOT NULL GROUP BY 1"


@query(_BUCKETS)
def confidence_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confidence_buckets(a.trade_facts(spark, sf))


@query(f"SELECT count(*) AS buckets, CASE WHEN count(*) > 1 THEN min(coalesce(d, 0.0)) >= 0 END AS monotonic, CASE WHEN count(*) > 1 THEN round(arg_max(win_rate, bucket) - arg_min(win_rate, bucket), 6) END AS spread FROM (SELECT *, win_rate - lag(win_rate) OVER (ORDER BY bucket) AS d FROM ({_BUCKETS}))")
def confidence_discrimination(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confidence_discrimination(a.trade_facts(spark, sf))


@query(f"SELECT coalesce(regime, 'unknown') AS regime, count(*) AS n FROM ({T}) WHERE r_milli IS NOT NULL GROUP BY 1")
def regime_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.regime_coverage(a.trade_facts(spark, sf))


_FOLDS = f"SELECT *, CASE WHEN n < 4 THEN 0 ELSE least(3, (pos - 1) // greatest(n // 4, 1)) END::INT AS fold FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY {_ORDER}) AS pos FROM ({T}) WHERE r_milli IS NOT NULL)"


@query(f"SELECT run_id, fold, count(*) AS n, min(closed_at) AS first_at, max(closed_at) AS last_at, sum(r_milli)::BIGINT AS total_milli FROM ({_FOLDS}) GROUP BY 1, 2")
def temporal_folds(spark: SparkSession, sf: str) -> DataFrame:
    f = metrics.temporal_folds(a.trade_facts(spark, sf).where("r_milli is not null"), ["run_id"], ORDER, 4)
    return f.groupBy("run_id", "fold").agg(F.count("*").alias("n"), F.min("closed_at").alias("first_at"), F.max("closed_at").alias("last_at"), F.sum("r_milli").alias("total_milli"))


@query(f"SELECT run_id, fold, count(*) AS trades, round(count(*) FILTER (WHERE r_milli > 0) / count(*), 6) AS win_rate, {_m('sum(r_milli)::BIGINT', 'count(*)')} AS expectancy_r FROM ({_FOLDS}) GROUP BY GROUPING SETS ((run_id), (run_id, fold))")
def maker_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.maker_comparison(a.trade_facts(spark, sf), 4, ORDER)


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bootstrap_ci(a.trade_facts(spark, sf), ["run_id", "regime"], ORDER, iters=2000)


@query(f"SELECT symbol, tf, coalesce(list_sort(list(d) FILTER (WHERE d IS NOT NULL))[(count(d) // 2 + 1)::INT], 900) AS bar_seconds FROM (SELECT symbol, tf, (epoch(open_time) - epoch(lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time)))::BIGINT AS d FROM ({a.bars_sql('15min')})) GROUP BY 1, 2")
def median_bar_length(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.upper_median_seconds(a.bars(spark, sf, "15min"))


@query("SELECT o_clerk AS release_name, n FROM (SELECT 'release ' || (o_custkey % 40)::VARCHAR AS o_clerk, count(*) AS n FROM orders GROUP BY 1) WHERE n / greatest(1.0::DOUBLE, date_diff('day', DATE '1995-01-01', DATE '2001-08-01') / 91) > 14.0::DOUBLE")
def noisy_releases(spark: SparkSession, sf: str) -> DataFrame:
    r = a.table(spark, sf, "orders").select(F.concat(F.lit("release "), (F.col("o_custkey") % 40).cast("string")).alias("release_name"))
    return metrics.noisy_releases(r, "1995-01-01", "2001-08-01", 14.0)


@query(f"""WITH b AS (SELECT symbol, tf, open_time, row_number() OVER (PARTITION BY symbol, tf ORDER BY open_time) AS n FROM ({a.bars_sql('15min')} UNION ALL {a.bars_sql('1h')} UNION ALL {a.bars_sql('4h')})),
w AS (SELECT symbol, tf, max(open_time) FILTER (WHERE n = CASE WHEN symbol = 'error' THEN 999999 ELSE 120 END) AS at_ FROM b GROUP BY 1, 2), p AS (SELECT symbol, max(at_) AS e, min(tf) FILTER (WHERE at_ IS NULL) AS short_tf FROM w GROUP BY 1)
SELECT p.symbol, CASE WHEN short_tf IS NULL THEN e END AS warm_up_end, count(b.open_time) FILTER (WHERE short_tf IS NULL AND b.open_time >= e) AS evaluable, short_tf FROM p JOIN b ON b.symbol = p.symbol AND b.tf = '15min' GROUP BY 1, 2, 4""")
def evaluable_bars(spark: SparkSession, sf: str) -> DataFrame:
    b = a.bars(spark, sf, "15min").unionByName(a.bars(spark, sf, "1h")).unionByName(a.bars(spark, sf, "4h"))
    long = metrics.evaluable_bars(b.where("symbol <> 'error'"), "15min", 120)
    return long.unionByName(metrics.evaluable_bars(b.where("symbol = 'error'"), "15min", 999_999))


@query(f"""SELECT 'snapshots' AS name, count(*) AS n FROM ({a.SNAPSHOTS_SQL}) UNION ALL SELECT 'trades', count(*) FROM ({T}) UNION ALL SELECT 'decisions', count(DISTINCT decision_id) FROM ({T}) UNION ALL SELECT 'runs', count(DISTINCT run_id) FROM ({T})
UNION ALL SELECT 'approved', count(*) FILTER (WHERE confidence_pct >= 55) FROM ({T}) UNION ALL SELECT 'open', count(*) FILTER (WHERE status = 'open') FROM ({T})""")
def scalar_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = a.trade_facts(spark, sf).agg(F.count("*").alias("trades"), F.count_distinct("decision_id").alias("decisions"), F.count_distinct("run_id").alias("runs"), F.count_if(F.col("confidence_pct") >= 55).alias("approved"), F.count_if(F.col("status") == "open").alias("open"))
    s = a.snapshots(spark, sf).agg(F.count("*").alias("snapshots"))
    stacked = t.selectExpr("stack(5, 'trades', trades, 'decisions', decisions, 'runs', runs, 'approved', approved, 'open', open) as (name, n)")
    return stacked.unionByName(s.selectExpr("'snapshots' as name", "snapshots as n"))


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Row numbers of all tables from their files' footers."""
    return footers.row_counts(spark, {t: f"{sf}/{t}.parquet" for t in _COUNTED})


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Paid attempts from events: costs in millionths are exact integers."""
    e = a.table(spark, sf, "events")
    status = F.when(F.col("event_id") % 7 == 0, "error").when(F.col("event_id") % 7 == 1, "started").when(F.col("event_id") % 7 == 2, "timeout").otherwise("completed")
    return e.select(F.col("event_id").alias("attempt_id"), F.col("event_type").alias("run_id"), "ts", status.alias("status"), (F.col("user_id") * 100).alias("est_micro"), F.when(F.col("event_id") % 3 != 0, F.round(F.abs(F.col("value")) * 100).cast("long")).alias("actual_micro"), (F.col("event_id") % 4 == 0).alias("reconciled"))


ATTEMPTS = "SELECT event_id AS attempt_id, event_type AS run_id, ts, CASE event_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'started' WHEN 2 THEN 'timeout' ELSE 'completed' END AS status, user_id * 100 AS est_micro, CASE WHEN event_id % 3 <> 0 THEN round(abs(value) * 100)::BIGINT END AS actual_micro, event_id % 4 = 0 AS reconciled FROM events"
_NOW = "2024-01-20 09:30:00"


@query(f"""SELECT coalesce(sum(c) FILTER (WHERE run_id = 'click'), 0)::BIGINT AS run_micro, coalesce(sum(c) FILTER (WHERE ts >= date_trunc('day', TIMESTAMP '{_NOW}')), 0)::BIGINT AS day_micro, coalesce(sum(c) FILTER (WHERE ts >= date_trunc('month', TIMESTAMP '{_NOW}')), 0)::BIGINT AS month_micro
FROM (SELECT *, coalesce(actual_micro, est_micro) AS c FROM ({ATTEMPTS}) WHERE status <> 'error' AND ts <= TIMESTAMP '{_NOW}')""")
def spend_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.spend(attempts(spark, sf), _NOW, "click")


@query(f"SELECT run_id, count(*) FILTER (WHERE status = 'completed' AND NOT reconciled) AS to_reconcile, count(*) FILTER (WHERE status = 'started' AND ts < TIMESTAMP '{_NOW}' - INTERVAL 300 SECOND) AS orphans FROM ({ATTEMPTS}) GROUP BY 1")
def attempt_backlog(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.backlog(attempts(spark, sf), _NOW)


@query(f"SELECT symbol, provider, max(bar_close) AS last_bar, arg_max(snapshot_id, (bar_close, snapshot_id)) AS last_id FROM ({a.SNAPSHOTS_SQL}) GROUP BY 1, 2")
def latest_bar(spark: SparkSession, sf: str) -> DataFrame:
    return a.snapshots(spark, sf).groupBy("symbol", "provider").agg(F.max("bar_close").alias("last_bar"), F.max_by("snapshot_id", F.struct("bar_close", "snapshot_id")).alias("last_id"))


_CHECKS = [("open_trades", "critical", "status = 'open' AND cents > 8000000"), ("quarantined_trades", "warning", "status = 'quarantined'"), ("ambiguous_exits", "info", "ambiguous AND r_milli IS NOT NULL"), ("missing_regime", "warning", "regime IS NULL AND r_milli IS NOT NULL"), ("impossible_confidence", "critical", "confidence_pct > 100"), ("late_outcomes", "info", "observed_at > closed_at + INTERVAL 3 DAY")]


@query(f"SELECT * FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS code, {chr(39)}{s}{chr(39)} AS severity, count(*) AS n FROM ({T}) WHERE {p}' for c, s, p in _CHECKS)}) WHERE n > 0")
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """All rules in one pass over the trades: a conditional count per rule."""
    counted = a.trade_facts(spark, sf).agg(*[F.count_if(F.expr(p)).alias(c) for c, _, p in _CHECKS])
    rows = ", ".join(f"'{c}', '{s}', {c}" for c, s, _ in _CHECKS)
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return counted.selectExpr(f"stack({len(_CHECKS)}, {rows}) as (code, severity, n)").where("n > 0").orderBy(rank, "code")


_RULES = [("r_without_close", "r_milli IS NOT NULL AND status NOT IN ('closed', 'expired')"), ("closed_without_r", "status IN ('closed', 'expired') AND r_milli IS NULL"), ("confidence_range", "confidence_pct NOT BETWEEN 0 AND 100"), ("price_not_positive", "cents <= 0"), ("regime_vocabulary", "regime NOT IN ('bull_trend', 'bear_trend', 'range', 'choppy')"), ("opened_after_close", "opened_at > closed_at")]


@query(f"SELECT * FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS rule, count(*) AS violations FROM ({T}) WHERE {p}' for n, p in _RULES)})")
def constraint_audit(spark: SparkSession, sf: str) -> DataFrame:
    counted = a.trade_facts(spark, sf).agg(*[F.count_if(F.expr(p)).alias(n) for n, p in _RULES])
    return counted.selectExpr(f"stack({len(_RULES)}, " + ", ".join(f"'{n}', {n}" for n, _ in _RULES) + ") as (rule, violations)")


_MESSAGE = "'https://user' || doc_id || ':pw@host/x token=' || doc_id || ' Bearer abc.' || doc_id || ' ' || text || '?q=1'"


#: Unicode white space, which \\s is not in this dialect.
_WS = r"\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(rf"""SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(string_split(m, '?')[1], '(://[^{_WS}:/@]+:)[^{_WS}@]+(@)', '\1<redacted>\2', 'g'), '(?i)\b(api[_-]?key|token|authorization|password|secret)\b([{_WS}]*[:=][{_WS}]*)([^{_WS},;&]+)', '\1\2<redacted>', 'g'), '(?i)\bBearer[{_WS}]+[A-Za-z0-9._~+/-]+', 'Bearer <redacted>', 'g'), 300) AS message
FROM (SELECT doc_id, {_MESSAGE} AS m FROM documents)""")
def redaction_messages(spark: SparkSession, sf: str) -> DataFrame:
    d = a.table(spark, sf, "documents")
    m = F.concat(F.lit("https://user"), F.col("doc_id"), F.lit(":pw@host/x token="), F.col("doc_id"), F.lit(" Bearer abc."), F.col("doc_id"), F.lit(" "), F.col("text"), F.lit("?q=1"))
    return d.select("doc_id", redaction.redact_message(m).alias("message"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[redactat]' ELSE event_type END AS api_key, '[redactat]' AS password_hint, event_type AS kind FROM events")
def redaction_keys(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events")
    name = F.when(F.col("event_id") % 3 == 0, "api_key").otherwise("api_name")
    made = F.create_map(name, F.col("event_type"), F.lit("password_hint"), F.lit("x"), F.lit("kind"), F.col("event_type"))
    m = redaction.redact_map(made)
    return e.select("event_id", F.coalesce(m["api_key"], m["api_name"]).alias("api_key"), m["password_hint"].alias("password_hint"), m["kind"].alias("kind"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total_k, count(*) FILTER (WHERE nullif(json_extract_string(props, '$.missing'), '') IS NULL) AS missing FROM events GROUP BY 1")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events")
    missing = F.nullif(F.get_json_object("props", "$.missing"), F.lit(""))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total_k"), F.count_if(missing.isNull()).alias("missing"))


@query("SELECT p_brand, round(sum(p_retailprice::DECIMAL(12,2))::DOUBLE / count(*), 4) AS mean_price, count(*) AS n FROM part GROUP BY 1")
def exact_means(spark: SparkSession, sf: str) -> DataFrame:
    p = a.table(spark, sf, "part")
    return p.groupBy("p_brand").agg(round_to(F.sum(F.col("p_retailprice").cast("decimal(12,2)")).cast("double") / F.count("*"), 4).alias("mean_price"), F.count("*").alias("n"))


@query("""SELECT event_id, '{"k":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',"auth":"[redactat]","in":[{"name":"' || event_type || '","api_key":"[redactat]","note":null}]}' AS details FROM events""")
def redaction_json(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long").cast("string")
    text = F.concat(F.lit('{"k": '), k, F.lit(', "auth": {"user": 1}, "in": [{"name": "'), F.col("event_type"), F.lit('", "api_key": "x", "note": null}]}'))
    return redaction.redact_json(e.select("event_id", text.alias("details")), "details")


_STATUS = "CASE WHEN value > 400 THEN 'error' WHEN value > 300 THEN 'degraded' WHEN value > 250 THEN 'stopped' ELSE 'ok' END"


@query(f"""WITH s AS (SELECT event_type || CASE WHEN user_id % 50 = 0 THEN '_once' ELSE '' END || user_id AS service_name, arg_max({_STATUS}, (ts, event_id)) AS status, max(ts) AS last_seen_at FROM events GROUP BY 1)
SELECT * FROM (SELECT 'warning' AS severity, 'STALE_OPEN_SHADOW' AS code, count(*) AS n FROM ({T}) WHERE status = 'open' AND opened_at < TIMESTAMP '2000-01-01' - INTERVAL 48 HOUR
UNION ALL SELECT 'warning', 'SHADOW_TIMEOUT_OVERDUE', count(*) FROM ({T}) WHERE status = 'open' AND opened_at + INTERVAL 24 HOUR < TIMESTAMP '2000-01-01'
UNION ALL SELECT 'warning', 'EXPIRED_RESERVATION', count(*) FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2000-01-01'
UNION ALL SELECT 'critical', 'SERVICE_ERROR', count(*) FROM s WHERE status = 'error' UNION ALL SELECT 'warning', 'SERVICE_DEGRADED', count(*) FROM s WHERE status = 'degraded'
UNION ALL SELECT 'warning', 'SERVICE_STOPPED', count(*) FROM s WHERE status = 'stopped' AND NOT ends_with(service_name, '_once') UNION ALL SELECT 'critical', 'SERVICE_HEARTBEAT_STALE', count(*) FROM s WHERE status <> 'stopped' AND last_seen_at < TIMESTAMP '2000-01-01' - INTERVAL 20 MINUTE
UNION ALL SELECT 'warning', 'PIPELINE_RUN_STUCK', count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 20 MINUTE
UNION ALL SELECT 'warning', 'QUARANTINED_TRADES', count(*) FROM ({T}) WHERE status = 'quarantined'
UNION ALL SELECT 'warning', 'PAID_ORPHANS', count(*) FROM ({ATTEMPTS}) WHERE status = 'started' AND ts < TIMESTAMP '2000-01-01' - INTERVAL 300 SECOND UNION ALL SELECT 'info', 'PAID_UNRECONCILED', count(*) FROM ({ATTEMPTS}) WHERE status = 'completed' AND NOT reconciled
UNION ALL SELECT 'info', 'DOWNTIME_GAPS', count(*) FROM nation UNION ALL SELECT 'warning', 'COLLECTOR_NOT_RUNNING', 1 UNION ALL SELECT 'info', 'SHADOW_NOT_RUNNING', 1) WHERE n > 0""")
def state_alerts(spark: SparkSession, sf: str) -> DataFrame:
    from barcraft.operators import alerts as rules

    o, e, t = a.table(spark, sf, "orders"), a.table(spark, sf, "events"), a.trade_facts(spark, sf)
    name = F.concat("event_type", F.when(F.col("user_id") % 50 == 0, "_once").otherwise(""), "user_id")
    services = e.withColumn("status", F.expr(_STATUS)).groupBy(name.alias("service_name")).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("last_seen_at"))
    reservations = o.select(F.when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done").alias("status"), F.col("o_orderdate").alias("lease_expires_at"))
    runs = o.select(F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.col("o_orderdate").alias("started_at"))
    open_trades = t.where("status = 'open'").withColumn("timeout_at", F.col("opened_at") + F.expr("interval 24 hours"))
    return rules.state_alerts("2000-01-01 00:00:00", open_trades, reservations, services, runs, a.snapshots(spark, sf), t, attempts(spark, sf), a.table(spark, sf, "nation"))


_FEED_NOW, _FEED_LAG = "2024-01-30 22:00:00", 7200
_FEEDS = """SELECT 'u' || user_id AS symbol, user_id % 3 <> 0 AS market_open, user_id % 5 <> 0 AS session_ok, CASE WHEN user_id % 7 <> 0 THEN user_id % 2 = 0 END AS quote_ok, user_id % 4 <> 0 AS candles_ok, max(ts) FILTER (WHERE value > 200) AS feed_last, max(ts) FILTER (WHERE event_id % 9 = 0) AS snapshot_last,
  count(*) FILTER (WHERE event_type = 'click') AS paid_decisions, count(*) FILTER (WHERE event_type = 'error' AND value > 150) AS paid_calls, CASE WHEN user_id % 6 = 1 THEN 'unverified' ELSE 'verified' END AS run_validity FROM events GROUP BY user_id"""


@query(f"""SELECT symbol, severity, code FROM (SELECT *, coalesce(epoch(feed_last), 0) AS e FROM ({_FEEDS})) CROSS JOIN (VALUES ('warning', 'BRAIN_BEHIND_FEED'), ('warning', 'NO_MARKET_SNAPSHOT'), ('critical', 'FEED_STALE'), ('warning', 'QUOTE_UNAVAILABLE'), ('critical', 'CANDLES_UNAVAILABLE'), ('warning', 'LLM_AUDIT_GAP'), ('warning', 'UNVERIFIED_RUN_SELECTED')) v(severity, code)
WHERE CASE code WHEN 'BRAIN_BEHIND_FEED' THEN floor(epoch(feed_last)) - floor(epoch(snapshot_last)) > 1800 WHEN 'NO_MARKET_SNAPSHOT' THEN snapshot_last IS NULL
  WHEN 'FEED_STALE' THEN market_open AND CASE WHEN feed_last IS NOT NULL THEN epoch(TIMESTAMP '{_FEED_NOW}') - floor(epoch(feed_last)) > {_FEED_LAG} ELSE session_ok END
  WHEN 'QUOTE_UNAVAILABLE' THEN session_ok AND market_open AND NOT coalesce(quote_ok, false) WHEN 'CANDLES_UNAVAILABLE' THEN session_ok AND market_open AND NOT candles_ok
  WHEN 'LLM_AUDIT_GAP' THEN paid_decisions > 0 AND paid_calls = 0 ELSE run_validity = 'unverified' END""")
def feed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    from barcraft.operators import alerts as rules

    u = F.col("user_id")
    feeds = a.table(spark, sf, "events").groupBy("user_id").agg(
        F.max(F.when(F.col("value") > 200, F.col("ts"))).alias("feed_last"), F.max(F.when(F.col("event_id") % 9 == 0, F.col("ts"))).alias("snapshot_last"),
        F.count_if(F.col("event_type") == "click").alias("paid_decisions"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 150)).alias("paid_calls"),
    ).withColumns({"symbol": F.concat(F.lit("u"), u), "market_open": u % 3 != 0, "session_ok": u % 5 != 0, "quote_ok": F.when(u % 7 != 0, u % 2 == 0), "candles_ok": u % 4 != 0, "run_validity": F.when(u % 6 == 1, "unverified").otherwise("verified")})
    return rules.feed_alerts(_FEED_NOW, feeds, _FEED_LAG)


@query("""SELECT host, severity, code FROM (SELECT s_suppkey AS host, s_suppkey % 3 = 0 AS dirty, s_suppkey % 5 = 0 AS unknown, s_suppkey % 7 <> 0 AS db, s_suppkey % 4 <> 0 AS sch, s_suppkey % 6 <> 0 AS broker, s_suppkey % 9 <> 0 AS st, CASE WHEN s_suppkey % 2 = 0 THEN 'demo' END AS env, CASE s_suppkey % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS te FROM supplier)
CROSS JOIN (VALUES ('warning', 'REPO_DIRTY'), ('warning', 'REPO_PROVENANCE_UNKNOWN'), ('critical', 'DATABASE_DOWN'), ('critical', 'DB_SCHEMA_MISMATCH'), ('critical', 'XTB_DISCONNECTED'), ('critical', 'NOT_DEMO'), ('critical', 'REAL_ORDERS_ENABLED'), ('warning', 'TRADING_FLAG_UNKNOWN')) v(severity, code)
WHERE CASE code WHEN 'REPO_DIRTY' THEN dirty WHEN 'REPO_PROVENANCE_UNKNOWN' THEN NOT dirty AND unknown WHEN 'DATABASE_DOWN' THEN NOT db WHEN 'DB_SCHEMA_MISMATCH' THEN db AND NOT sch WHEN 'XTB_DISCONNECTED' THEN NOT broker WHEN 'NOT_DEMO' THEN st AND env IS DISTINCT FROM 'demo' WHEN 'REAL_ORDERS_ENABLED' THEN te ELSE st AND te IS NULL END""")
def system_alerts(spark: SparkSession, sf: str) -> DataFrame:
    from barcraft.operators import alerts as rules

    k = F.col("s_suppkey")
    states = a.table(spark, sf, "supplier").select(
        k.alias("host"), (k % 3 == 0).alias("repo_dirty"), F.when(k % 5 == 0, "unknown").otherwise("known").alias("repo_state"), (k % 7 != 0).alias("db_ok"), (k % 4 != 0).alias("schema_current"), (k % 6 != 0).alias("broker_ok"),
        F.when(k % 2 == 0, "demo").alias("environment"), F.when(k % 8 == 0, True).when(k % 8 <= 2, False).alias("trading_enabled"), (k % 9 != 0).alias("has_status"),
    )
    return rules.system_alerts(states)


_FEEDBACK_AT = ("1992-01-15", "1993-06-01", "1995-03-10", "1999-06-01")
_KNOWN = f"(SELECT * FROM ({T}) WHERE status <> 'open' AND r_milli IS NOT NULL)"
_ASKED = "(SELECT run_id, as_of FROM (SELECT DISTINCT l_returnflag AS run_id FROM lineitem) CROSS JOIN (SELECT unnest([" + ", ".join(f"TIMESTAMP '{t}'" for t in _FEEDBACK_AT) + "]) AS as_of))"
_FEEDBACK_ORDER = "observed_at DESC, decision_id DESC, part DESC, supp DESC, cents DESC"


@query(f"""WITH g AS (SELECT q.run_id, as_of, regime, count(*) AS n, round(count(*) FILTER (WHERE r_milli > 0) / count(*), 3) AS w, round(sum(r_milli)::BIGINT / 1000.0::DOUBLE / count(*), 3) AS e FROM {_ASKED} q JOIN {_KNOWN} k ON k.run_id = q.run_id AND observed_at < as_of GROUP BY 1, 2, 3),
l AS (SELECT run_id, as_of, string_agg(coalesce(regime, 'null') || ':' || n || ':' || w || ':' || e, ',' ORDER BY n DESC, regime NULLS LAST) AS regimes FROM g GROUP BY 1, 2),
r AS (SELECT run_id, as_of, string_agg(direction || ':' || coalesce(regime, 'null') || ':' || r_milli / 1000.0::DOUBLE || ':' || exit_reason || ':' || strftime(closed_at, '%Y-%m-%d'), ',' ORDER BY k) AS recent FROM (SELECT q.run_id, as_of, k.* EXCLUDE run_id, row_number() OVER (PARTITION BY q.run_id, as_of ORDER BY {_FEEDBACK_ORDER}) AS k FROM {_ASKED} q JOIN {_KNOWN} k ON k.run_id = q.run_id AND observed_at < as_of) WHERE k <= 5 GROUP BY 1, 2)
SELECT q.run_id, q.as_of, coalesce(regimes, '') AS regimes, coalesce(recent, '') AS recent FROM {_ASKED} q LEFT JOIN l USING (run_id, as_of) LEFT JOIN r USING (run_id, as_of)""")
def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """What each run knew at some instants; the nested row is printed as two texts."""
    t = a.trade_facts(spark, sf)
    at = spark.createDataFrame([(x,) for x in _FEEDBACK_AT], "at string").select(F.col("at").cast("timestamp_ntz").alias("as_of"))
    f = metrics.feedback(t, t.select("run_id").distinct().join(F.broadcast(at)), 5, a.TRADE_ORDER)
    text = lambda *parts: F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    regimes = F.transform("regime_performance", lambda x: text(x["regime"], x["trades"], x["win_rate"], x["expectancy_r"]))
    recent = F.transform("recent_trades", lambda x: text(x["direction"], x["regime"], x["r_multiple"], x["exit_reason"], F.date_format(x["closed_at"], "yyyy-MM-dd")))
    return f.select("run_id", "as_of", F.array_join(regimes, ",").alias("regimes"), F.array_join(recent, ",").alias("recent"))


@query(f"SELECT attempt_id, run_id, ts, status, actual_micro FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, attempt_id) AS k FROM ({ATTEMPTS})) WHERE k <= 50")
def paid_attempts_section(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.newest(attempts(spark, sf), "ts", 50, "attempt_id").select("attempt_id", "run_id", "ts", "status", "actual_micro")
