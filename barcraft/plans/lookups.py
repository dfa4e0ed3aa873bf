"""Joins, point lookups and report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcraft.operators import asof, ledger, lookup
from barcraft.plans.ledgers import DOWNTIME, _PROCESSED, downtime, processed
from barcraft.plans.registry import query
from barcraft.plans.reports import ATTEMPTS, attempts
from barcraft.sources import adapters as a

T, S = a.TRADES_SQL, a.SNAPSHOTS_SQL


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    return a.trade_facts(spark, sf).join(a.snapshots(spark, sf), "snapshot_id")


_J = f"SELECT * FROM ({T}) t JOIN ({S}) s USING (snapshot_id)"


@query(f"SELECT decision_id, part, supp, cents, symbol, regime, r_milli, observed_at FROM (SELECT j.*, row_number() OVER (ORDER BY observed_at DESC, decision_id, part, supp, cents) AS n FROM ({_J}) j JOIN customer ON c_custkey = custkey WHERE run_id = 'R' AND status IN ('closed', 'expired') AND observed_at < TIMESTAMP '1999-06-01') WHERE n <= 25")
def recent_trades_topk(spark: SparkSession, sf: str) -> DataFrame:
    c = a.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    t = _joined(spark, sf).join(c, "custkey").where("run_id = 'R' and status in ('closed', 'expired') and observed_at < timestamp_ntz'1999-06-01'")
    return lookup.newest(t, "observed_at", 25, *a.TRADE_ORDER).select(*a.TRADE_ORDER, "symbol", "regime", "r_milli", "observed_at")


@query(f"SELECT s.snapshot_id, s.symbol, t.decision_id, t.part, t.status, t.r_milli FROM ({S}) s LEFT JOIN (SELECT * FROM ({T}) WHERE run_id = 'A') t USING (snapshot_id)")
def decided_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return a.snapshots(spark, sf).join(a.trade_facts(spark, sf).where("run_id = 'A'"), "snapshot_id", "left").select("snapshot_id", "symbol", "decision_id", "part", "status", "r_milli")


@query(f"SELECT fp, min(decision_id) AS decision_id, count(*) AS n FROM (SELECT decision_id, sha256(decision_id::VARCHAR || '|' || run_id || '|' || direction) AS fp FROM ({T})) GROUP BY 1")
def decision_by_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    from barcraft.operators.features import fingerprint

    d = a.trade_facts(spark, sf).select("decision_id", fingerprint("decision_id", "run_id", "direction").alias("fp"))
    return d.groupBy("fp").agg(F.min("decision_id").alias("decision_id"), F.count("*").alias("n"))


@query(f"SELECT decision_id, part, supp, cents, symbol, opened_at FROM ({_J}) WHERE status = 'open' AND symbol = 'P'")
def open_trades(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf).where("status = 'open' and symbol = 'P'").select(*a.TRADE_ORDER, "symbol", "opened_at")


@query(f"SELECT decision_id, part, supp, cents, symbol, closed_at FROM (SELECT *, row_number() OVER (ORDER BY closed_at DESC, decision_id, part, supp, cents) AS n FROM ({_J}) WHERE status = 'quarantined') WHERE n <= 50")
def quarantined_trades(spark: SparkSession, sf: str) -> DataFrame:
    t = _joined(spark, sf).where("status = 'quarantined'")
    return lookup.newest(t, "closed_at", 50, *a.TRADE_ORDER).select(*a.TRADE_ORDER, "symbol", "closed_at")


@query(f"SELECT decision_id, part, supp, cents, closed_n FROM (SELECT *, CASE WHEN status IN ('closed', 'expired') THEN closed_at END AS closed_n, row_number() OVER (ORDER BY CASE WHEN status IN ('closed', 'expired') THEN closed_at END DESC NULLS LAST, decision_id, part, supp, cents) AS n FROM ({T}) WHERE run_id = 'N') WHERE n <= 50")
def closed_trades_section(spark: SparkSession, sf: str) -> DataFrame:
    t = a.trade_facts(spark, sf).where("run_id = 'N'").withColumn("closed_n", F.when(F.col("status").isin("closed", "expired"), F.col("closed_at")))
    return lookup.newest(t, "closed_n", 50, *a.TRADE_ORDER).select(*a.TRADE_ORDER, "closed_n")


@query(f"SELECT symbol, provider, snapshot_id, bar_close, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_close DESC, snapshot_id DESC) AS n FROM ({S})) WHERE n = 1")
def latest_market(spark: SparkSession, sf: str) -> DataFrame:
    s = lookup.latest_per(a.snapshots(spark, sf), ["symbol"], [F.desc("bar_close"), F.desc("snapshot_id")])
    return s.select("symbol", "provider", "snapshot_id", "bar_close", "price")


@query(f"SELECT s.snapshot_id, symbol, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.snapshot_id AND l_returnflag = 'R') AS has_spread FROM ({S}) s")
def snapshot_spread_status(spark: SparkSession, sf: str) -> DataFrame:
    line = a.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("snapshot_id"))
    return lookup.with_exists(a.snapshots(spark, sf).select("snapshot_id", "symbol"), line, ["snapshot_id"], "has_spread")


@query(f"SELECT symbol, max(bar_close) AS last_bar, arg_max(run_id, (bar_close, decision_id, part, supp, cents)) AS run_id FROM ({_J}) GROUP BY 1")
def last_decision_bar(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf).groupBy("symbol").agg(F.max("bar_close").alias("last_bar"), F.max_by("run_id", F.struct("bar_close", *a.TRADE_ORDER)).alias("run_id"))


@query("SELECT event_id, ts, value FROM events WHERE user_id = 7 AND event_type = 'click'")
def evaluations_for(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events").where("user_id = 7 and event_type = 'click'").select("event_id", "ts", "value")
    return e.orderBy(F.desc("ts"), F.desc("event_id"))


@query(f"SELECT attempt_id, run_id, ts FROM ({ATTEMPTS}) WHERE status = 'completed' AND NOT reconciled")
def attempts_to_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).where("status = 'completed' and not reconciled").select("attempt_id", "run_id", "ts").orderBy("ts", "attempt_id")


_MANIFESTS = "SELECT 'run' || s_suppkey AS run_id, CASE s_suppkey % 4 WHEN 0 THEN 'shadow_online' WHEN 1 THEN 'executable_backtest' WHEN 2 THEN 'notebook' END AS run_kind, CASE WHEN s_suppkey % 5 = 0 THEN 'true' WHEN s_suppkey % 7 <> 0 THEN 'false' END AS git_dirty, CASE WHEN s_suppkey % 11 <> 0 THEN 'abc' END AS commit FROM supplier WHERE s_acctbal > 0"


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    s, k = a.table(spark, sf, "supplier").where("s_acctbal > 0"), F.col("s_suppkey")
    return s.select(F.concat(F.lit("run"), k).alias("run_id"), F.when(k % 4 == 0, "shadow_online").when(k % 4 == 1, "executable_backtest").when(k % 4 == 2, "notebook").alias("run_kind"), F.when(k % 5 == 0, "true").when(k % 7 != 0, "false").alias("git_dirty"), F.when(k % 11 != 0, "abc").alias("commit"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return a.trade_facts(spark, sf).withColumn("run_id", F.concat(F.lit("run"), F.col("supp")))


_R = f"SELECT * REPLACE ('run' || supp AS run_id) FROM ({T})"


@query(f"SELECT count(*) AS trades, count(DISTINCT run_id) AS runs, sum(r_milli)::BIGINT AS total_milli FROM ({_R}) t WHERE run_id IN (SELECT run_id FROM ({_MANIFESTS}) WHERE run_kind IN ('shadow_online', 'executable_backtest') AND git_dirty = 'false' AND commit IS NOT NULL AND run_id NOT LIKE 'TST_%')")
def verified_scope(spark: SparkSession, sf: str) -> DataFrame:
    t = lookup.verified_scope(_runs(spark, sf), manifests(spark, sf))
    return t.agg(F.count("*").alias("trades"), F.count_distinct("run_id").alias("runs"), F.sum("r_milli").alias("total_milli"))


_VALID = "CASE WHEN run_kind IS NULL THEN 'unregistered' WHEN run_kind NOT IN ('shadow_online', 'executable_backtest') THEN 'exploratory' WHEN git_dirty IS DISTINCT FROM 'false' THEN 'dirty_tree' WHEN commit IS NULL THEN 'unknown_commit' ELSE 'verified' END"


@query(f"""WITH d AS (SELECT run_id, count(DISTINCT snapshot_id) AS snapshots, count(*) AS decisions, max(opened_at) AS ld, bool_or(confidence_pct >= 55) AS aa FROM ({_R}) WHERE regime IS NOT NULL GROUP BY 1),
t AS (SELECT run_id, count(*) AS trades, count(*) FILTER (WHERE status = 'open') AS o, max(closed_at) AS lc, sum(r_milli)::BIGINT AS s, count(r_milli) AS n FROM ({_R}) WHERE regime IS DISTINCT FROM 'range' GROUP BY 1),
j AS (SELECT run_id, coalesce(snapshots, 0) AS snapshots, coalesce(decisions, 0) AS decisions, coalesce(trades, 0) AS trades, coalesce(o, 0) AS "open", coalesce(aa, false) AS any_approved, CASE WHEN n > 0 THEN round(s / 1000.0::DOUBLE / n, 6) END AS expectancy_r, {_VALID} AS validity, greatest(ld, lc) AS last_activity FROM d FULL JOIN t USING (run_id) LEFT JOIN ({_MANIFESTS}) m USING (run_id))
SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (ORDER BY last_activity DESC NULLS LAST, run_id) AS k FROM j) WHERE k <= 50""")
def runs_report(spark: SparkSession, sf: str) -> DataFrame:
    t = _runs(spark, sf)
    d = t.where("regime is not null").select("run_id", "snapshot_id", F.col("opened_at").alias("at"), (F.col("confidence_pct") >= 55).alias("approved"))
    return lookup.runs_report(d, t.where("regime is distinct from 'range'"), manifests(spark, sf))


def _side(n: int, name: str, extra: str) -> str:
    return f"SELECT l_orderkey AS snapshot_id, l_shipdate AS at_, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS {name}, {extra} FROM lineitem WHERE l_linenumber = {n}"


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY at_ DESC, {t} DESC) AS n FROM ({s})) WHERE n = 1"


@query(f"""WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY bar_close DESC, snapshot_id) AS n FROM ({S})) WHERE n <= 200),
e AS ({_LAST.format(k='snapshot_id', t='evaluation_id', s=_side(1, 'evaluation_id', 'l_returnflag AS verdict'))}), p AS ({_LAST.format(k='snapshot_id', t='spread_id', s=_side(2, 'spread_id', 'l_discount AS spread'))}),
d AS ({_LAST.format(k='snapshot_id', t='decision_id', s=_side(3, 'decision_id', 'l_linestatus AS direction'))}), t AS ({_LAST.format(k='decision_id', t='trade_id', s="SELECT l_partkey * 1000000 + l_suppkey * 10 + 3 AS decision_id, l_shipdate AS at_, l_orderkey AS trade_id, l_returnflag AS trade_status FROM lineitem WHERE l_linenumber IN (3, 4)")})
SELECT s.snapshot_id, s.symbol, s.bar_close, e.evaluation_id, e.verdict, p.spread_id, p.spread, d.decision_id, d.direction, t.trade_id, t.trade_status FROM s LEFT JOIN e USING (snapshot_id) LEFT JOIN p USING (snapshot_id) LEFT JOIN d USING (snapshot_id) LEFT JOIN t USING (decision_id)""")
def timeline_latest(spark: SparkSession, sf: str) -> DataFrame:
    line = a.table(spark, sf, "lineitem")
    num = F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 10
    base = [F.col("l_orderkey").alias("snapshot_id"), F.col("l_shipdate").alias("at")]
    of = lambda n, name, col: line.where(F.col("l_linenumber") == n).select(*base, (num + n).alias(name), col)
    t = line.where("l_linenumber in (3, 4)").select((num + 3).alias("decision_id"), F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("trade_id"), F.col("l_returnflag").alias("status"))
    out = lookup.timeline(a.snapshots(spark, sf), of(1, "evaluation_id", F.col("l_returnflag").alias("verdict")), of(2, "spread_id", F.col("l_discount").alias("spread")), of(3, "decision_id", F.col("l_linestatus").alias("direction")), t, 200)
    return out.select("snapshot_id", "symbol", "bar_close", "evaluation_id", "verdict", "spread_id", "spread", "decision_id", "direction", "trade_id", "trade_status")


@query(f"SELECT event_id, event_type, symbol, decision_id, part FROM events e LEFT JOIN ({S}) s ON s.snapshot_id = e.event_id LEFT JOIN (SELECT decision_id, min(part) AS part FROM ({T}) GROUP BY 1) d ON d.decision_id = e.event_id * 100 + 1 WHERE event_type IN (SELECT event_type FROM events WHERE value > 300)")
def call_log(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events")
    d = a.trade_facts(spark, sf).groupBy("decision_id").agg(F.min("part").alias("part"))
    runs = e.where("value > 300").select("event_type").distinct()
    j = e.join(runs, "event_type", "left_semi").join(a.snapshots(spark, sf).select(F.col("snapshot_id").alias("event_id"), "symbol"), "event_id", "left")
    return j.join(d, F.col("decision_id") == F.col("event_id") * 100 + 1, "left").select("event_id", "event_type", "symbol", "decision_id", "part")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O')
SELECT id, 'only_left' AS side FROM f WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT id, 'only_right' FROM o WHERE id NOT IN (SELECT id FROM f)""")
def position_difference(spark: SparkSession, sf: str) -> DataFrame:
    o = a.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return lookup.difference(o.where("s = 'F'").select("id").distinct(), o.where("s = 'O'").select("id").distinct(), "id")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def reservations_without_decision(spark: SparkSession, sf: str) -> DataFrame:
    line = a.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return a.table(spark, sf, "orders").select("o_orderkey").join(line, "o_orderkey", "left_anti")


@query(f"SELECT e.event_id, e.value - q.close AS distance FROM events e JOIN (SELECT symbol, arg_max(close, open_time) AS close FROM ({a.bars_sql('1h')}) GROUP BY 1) q ON q.symbol = e.event_type")
def stream_with_quote(spark: SparkSession, sf: str) -> DataFrame:
    """Events beside the newest quote of their symbol (one row a symbol, joined by it)."""
    q = a.bars(spark, sf, "1h").groupBy("symbol").agg(F.max_by("close", "open_time").alias("close"))
    e = a.table(spark, sf, "events").withColumnRenamed("event_type", "symbol")
    return e.join(q, "symbol").select("event_id", (F.col("value") - F.col("close")).alias("distance"))


def priced_events(spark: SparkSession, sf: str) -> DataFrame:
    return a.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "event_id", "ts", "value")


def hourly_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """The close of each hour, known from its end on."""
    return a.bars(spark, sf, "1h").select("symbol", F.col("close_time").alias("time"), F.col("close").alias("price"))


QUOTE_SQL = f"""SELECT e.event_type AS symbol, event_id, value, q.close_time AS quote_time, q.close AS quote
FROM events e ASOF LEFT JOIN ({a.bars_sql('1h')}) q ON q.symbol = e.event_type AND q.close_time <= e.ts"""


@query(QUOTE_SQL)
def quote_at_event(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with the latest quote that its symbol had by then."""
    e, q = priced_events(spark, sf), hourly_quotes(spark, sf).withColumn("quote_time", F.col("time")).withColumnRenamed("price", "quote")
    return asof.asof_join(e, q, "ts", "time", ["symbol"]).select("symbol", "event_id", "value", "quote_time", "quote")


_NAMES = list(lookup.RELEASES)
_PICK = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " WHEN 7 THEN 'Research Consumer Price Index' ELSE 'Debt to Gross Domestic Product Ratios' END"
_SPEC = "(VALUES " + ", ".join(f"('{k}', '{v[0]}', {v[1]}, {v[2]}, '{v[3]}')" for k, v in lookup.RELEASES.items()) + ") v(release_name, label, h, m, impact)"


@query(f"SELECT label, release_name, (((o_orderdate + to_hours(h) + to_minutes(m)) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS scheduled_at, impact FROM (SELECT o_orderdate, {_PICK} AS release_name FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1997-12-31') JOIN {_SPEC} USING (release_name)")
def release_events(spark: SparkSession, sf: str) -> DataFrame:
    o = a.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.expr(_PICK).alias("release_name"))
    return lookup.classify_releases(o, "1996-01-01", "1997-12-31")


@query("""SELECT id, array_to_string(CASE WHEN wrong THEN list_filter(m, lambda x: x <> 'slippage') ELSE m END, ',') AS modeled, array_to_string(CASE WHEN wrong THEN list_append(n, 'slippage') ELSE n END, ',') AS not_modeled
FROM (SELECT *, list_contains(m, 'slippage') AND coalesce(rate, 0) = 0 AS wrong FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN ['spread', 'slippage'] ELSE ['spread'] END AS m, ['swap'] AS n, CASE o_orderkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.1 END AS rate FROM orders))""")
def manifest_repair(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = a.table(spark, sf, "orders").select(k.alias("id"), F.when(k % 2 == 0, F.array(F.lit("spread"), F.lit("slippage"))).otherwise(F.array(F.lit("spread"))).alias("modeled"), F.array(F.lit("swap")).alias("not_modeled"), F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 0.1).alias("slippage_pct"))
    return lookup.repair_costs(x).select("id", F.array_join("modeled", ",").alias("modeled"), F.array_join("not_modeled", ",").alias("not_modeled"))


@query(f"SELECT dataset, min(symbol) AS symbol, count(*) AS bars FROM (SELECT symbol, md5(symbol || strftime(open_time, '%Y-%m')) AS dataset FROM ({a.bars_sql('1h')})) GROUP BY 1")
def dataset_lookup(spark: SparkSession, sf: str) -> DataFrame:
    b = a.bars(spark, sf, "1h").select("symbol", F.md5(F.concat("symbol", F.date_format("open_time", "yyyy-MM"))).alias("dataset"))
    return b.groupBy("dataset").agg(F.min("symbol").alias("symbol"), F.count("*").alias("bars"))


@query(f"SELECT key, state, n FROM (SELECT user_id AS key, CASE WHEN event_id % 4 = 0 THEN 'done' ELSE 'reserved' END AS state, count(*) AS n FROM events GROUP BY ALL) WHERE state <> 'done'")
def open_reservations(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 4 == 0, "done").otherwise("reserved").alias("state"))
    return e.where("state <> 'done'").groupBy("key", "state").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS snapshot_id, o_custkey AS key, 'existing' AS outcome FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT min(o_orderkey), o_custkey, 'inserted' FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderstatus = 'F' AND e.o_custkey = o.o_custkey) GROUP BY 2")
def spread_insert(spark: SparkSession, sf: str) -> DataFrame:
    o = a.table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("s"))
    return ledger.insert_absent(o.where("s = 'F'").drop("s"), o.where("s = 'O'").drop("s"), ["key"])


@query("""WITH d AS (SELECT o_orderstatus AS symbol, max(o_orderdate) AS done FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate < '2000-01-01' GROUP BY 1)
SELECT symbol, bar_close FROM (SELECT c.*, row_number() OVER (PARTITION BY symbol ORDER BY bar_close DESC) AS n FROM (SELECT DISTINCT o_orderstatus AS symbol, o_orderdate AS bar_close FROM orders) c LEFT JOIN d USING (symbol) WHERE done IS NULL OR bar_close > done) WHERE n <= 8""")
def backfill_targets(spark: SparkSession, sf: str) -> DataFrame:
    o = a.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("bar_close"), "o_orderpriority")
    done = o.where("o_orderpriority = '1-URGENT' and bar_close < timestamp_ntz'2000-01-01'").groupBy("symbol").agg(F.max("bar_close").alias("bar_close"))
    return lookup.backfill_targets(o.select("symbol", "bar_close").distinct(), done)


@query("SELECT 'FOMC' AS label, 'FOMC decision' AS release_name, ((d::TIMESTAMP + INTERVAL 14 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS scheduled_at, 'high' AS impact, count(*) AS orders FROM (SELECT unnest(['" + "', '".join(lookup.FOMC) + "']) AS d) JOIN orders ON (o_orderdate + INTERVAL 28 YEAR)::DATE = d::DATE GROUP BY ALL")
def fomc_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rate decisions with the orders of their days (28 years on: the same weekdays)."""
    days = a.table(spark, sf, "orders").groupBy(F.to_date(F.expr("o_orderdate + interval 28 years")).alias("day")).agg(F.count("*").alias("orders"))
    decided = lookup.fomc_events(spark, "2020-01-01", "2030-12-31")
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("scheduled_at")))
    return decided.withColumn("day", local).join(days, "day").drop("day")


_BY_INPUT = f"SELECT decision_id, sha256('input ' || (decision_id % 5000)) AS input_hash, CASE WHEN part % 2 = 0 THEN 'small' ELSE 'large' END AS model, run_id, cents AS trade_id FROM ({T})"


@query(f"SELECT w.input_hash, w.model, w.run_id, min(x.trade_id) AS trade_id FROM (SELECT sha256('input ' || o_orderkey) AS input_hash, CASE WHEN o_custkey % 2 = 0 THEN 'small' ELSE 'large' END AS model, o_orderstatus AS run_id FROM orders WHERE o_orderkey < 8000) w LEFT JOIN (SELECT * REPLACE (CASE run_id WHEN 'R' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END AS run_id) FROM ({_BY_INPUT})) x USING (input_hash, model, run_id) GROUP BY ALL")
def trade_by_input(spark: SparkSession, sf: str) -> DataFrame:
    """The trade that an input already led to, by input hash, model and run."""
    digest = lambda k: F.sha2(F.concat(F.lit("input "), k.cast("string")), 256)
    model = lambda k: F.when(k % 2 == 0, "small").otherwise("large")
    o = a.table(spark, sf, "orders").where("o_orderkey < 8000").select(digest(F.col("o_orderkey")).alias("input_hash"), model(F.col("o_custkey")).alias("model"), F.col("o_orderstatus").alias("run_id"))
    t = a.trade_facts(spark, sf).withColumn("run_id", F.when(F.col("run_id") == "R", "F").when(F.col("run_id") == "N", "O").otherwise("P"))
    # the key of a fact is decision and part: decisions repeat in the test table
    key = F.struct("decision_id", "part", "supp", "cents").cast("string")
    d = t.select(key.alias("decision_id"), digest(F.col("decision_id") % 5000).alias("input_hash"), model(F.col("part")).alias("model")).distinct()
    return lookup.trade_by_input(o, d, t.select(key.alias("decision_id"), "run_id", F.col("cents").alias("trade_id")))


@query(f"SELECT symbol, provider, bar_close, seq, ok FROM (SELECT *, row_number() OVER (ORDER BY bar_close DESC, symbol, provider) AS k FROM ({_PROCESSED})) WHERE k <= 50")
def processed_bars_section(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.newest(processed(spark, sf), "bar_close", 50, "symbol", "provider").select("symbol", "provider", "bar_close", "seq", "ok")


@query(f"SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (ORDER BY bar_close DESC, symbol) AS k FROM ({DOWNTIME})) WHERE k <= 50")
def downtime_section(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.newest(downtime(spark, sf), "bar_close", 50, "symbol")
