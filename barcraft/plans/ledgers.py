"""Upsert and ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcraft.functions.market_calendar import EVENTS_CALENDAR
from barcraft.operators import ledger, simulate
from barcraft.plans.registry import query
from barcraft.plans.reports import ATTEMPTS, attempts
from barcraft.sources import adapters as a

_LINE = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT)"


@query("""SELECT coalesce(x.id, y.id) AS id, coalesce(x.price, y.price) AS price, coalesce(x.quality, y.quality) AS quality, CASE WHEN x.id IS NULL THEN 'inserted' WHEN y.id IS NOT NULL AND x.quality IS NULL AND y.quality IS NOT NULL THEN 'enriched' WHEN y.id IS NOT NULL THEN 'unchanged' ELSE 'kept' END AS status
FROM (SELECT o_orderkey AS id, o_totalprice AS price, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS quality FROM orders WHERE o_orderstatus <> 'O') x
FULL JOIN (SELECT o_orderkey AS id, o_totalprice + 1 AS price, CASE WHEN o_orderkey % 5 <> 0 THEN 'new' END AS quality FROM orders WHERE o_orderpriority < '3') y USING (id)""")
def snapshot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o, k = a.table(spark, sf, "orders"), F.col("o_orderkey")
    old = o.where("o_orderstatus <> 'O'").select(k.alias("id"), F.col("o_totalprice").alias("price"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("quality"))
    new = o.where("o_orderpriority < '3'").select(k.alias("id"), (F.col("o_totalprice") + 1).alias("price"), F.when(k % 5 != 0, "new").alias("quality"))
    return ledger.upsert_snapshots(old, new, ["id"], "quality")


@query("SELECT event_type, user_id, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.latest_evaluations(a.table(spark, sf, "events"), ["event_type", "user_id"], "ts", "event_id").select("event_type", "user_id", "ts", "event_id", "value")


_KEYED = "SELECT {k} AS k, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS run, o_orderkey AS v FROM orders WHERE {w}"


@query(f"""WITH e AS ({_KEYED.format(k='o_custkey', w="o_orderstatus = 'F'")}), i AS ({_KEYED.format(k='o_custkey', w="o_orderstatus = 'O'")})
SELECT k, run, v, 'existing' AS outcome FROM e UNION ALL SELECT k, run, v, 'inserted' FROM i WHERE run IS NULL
UNION ALL SELECT k, run, min(v), 'inserted' FROM i WHERE run IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.k = i.k AND e.run = i.run) GROUP BY k, run""")
def idempotent_insert(spark: SparkSession, sf: str) -> DataFrame:
    o = a.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("run"), F.col("o_orderkey").alias("v"), F.col("o_orderstatus").alias("s"))
    return ledger.insert_absent(o.where("s = 'F'").drop("s"), o.where("s = 'O'").drop("s"), ["k", "run"])


@query("""SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL OR (y.id IS NOT NULL AND x.status = 'open') THEN y.status ELSE x.status END AS status, CASE WHEN x.id IS NULL OR (y.id IS NOT NULL AND x.status = 'open') THEN coalesce(y.external_id, x.external_id) ELSE x.external_id END AS external_id,
CASE WHEN x.id IS NULL THEN 'inserted' WHEN y.id IS NULL THEN 'kept' WHEN x.status = 'open' THEN 'updated' ELSE 'terminal' END AS outcome
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'closed' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS external_id FROM orders WHERE o_orderstatus <> 'O') x
FULL JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'open' ELSE 'expired' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey + 1 END AS external_id FROM orders WHERE o_orderpriority < '3') y USING (id)""")
def trade_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o, k = a.table(spark, sf, "orders"), F.col("o_orderkey")
    old = o.where("o_orderstatus <> 'O'").select(k.alias("id"), F.when(F.col("o_orderstatus") == "P", "open").otherwise("closed").alias("status"), F.when(k % 4 == 0, F.col("o_custkey")).alias("external_id"))
    new = o.where("o_orderpriority < '3'").select(k.alias("id"), F.when(k % 5 == 0, "open").otherwise("expired").alias("status"), F.when(k % 6 == 0, F.col("o_custkey") + 1).alias("external_id"))
    return ledger.upsert_trades(old, new, ["id"], ["status", "external_id"])


_ACTION = "CASE event_type WHEN 'click' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'reserve' END"
_RESERVE = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS key, ts, event_id AS seq, event_id % 3 AS worker, {_ACTION} AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
step AS (SELECT key, n, action = 'reserve' AS granted, CASE WHEN action = 'reserve' THEN 'reserved' ELSE 'new' END AS state, CASE WHEN action = 'reserve' THEN worker END AS owner, CASE WHEN action = 'reserve' THEN ts + INTERVAL 36000 SECOND END AS until FROM e WHERE n = 1
  UNION ALL SELECT key, n, ok, CASE WHEN NOT ok THEN state WHEN action = 'reserve' THEN 'reserved' WHEN action = 'complete' THEN 'done' ELSE 'failed' END, CASE WHEN ok AND action = 'reserve' THEN worker ELSE owner END, CASE WHEN ok AND action = 'reserve' THEN ts + INTERVAL 36000 SECOND ELSE until END
  FROM (SELECT e.*, s.state, s.owner, s.until, CASE WHEN action = 'reserve' THEN s.state IN ('new', 'failed') OR (s.state = 'reserved' AND e.ts >= s.until) ELSE s.state = 'reserved' AND s.owner = e.worker END AS ok FROM step s JOIN e ON e.key = s.key AND e.n = s.n + 1))"""


@query(f"{_RESERVE} SELECT key, seq, action, coalesce(granted, false) AS granted, state FROM step JOIN e USING (key, n)")
def reservation_replay(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events")
    action = F.when(F.col("event_type") == "click", "complete").when(F.col("event_type") == "error", "fail").otherwise("reserve")
    x = e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("worker"), action.alias("action"))
    return ledger.replay_reservations(x, 36000).select("key", "seq", "action", "granted", "state")


@query("SELECT run_id, arg_min(h, (ts, h)) AS pinned, count(DISTINCT h) - 1 AS mismatches FROM (SELECT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN 'same' ELSE event_type END AS h, ts FROM events) GROUP BY 1")
def manifest_pin(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events")
    return ledger.pin_manifests(e.select(F.col("user_id").alias("run_id"), F.when(F.col("user_id") % 3 == 0, "same").otherwise(F.col("event_type")).alias("hash"), F.col("ts").alias("created_at")))


_PROC = "SELECT o_orderstatus AS symbol, o_orderpriority AS provider, o_orderdate AS bar_close, o_orderkey AS seq, o_custkey % 4 <> 0 AS ok FROM orders"


def processed(spark: SparkSession, sf: str) -> DataFrame:
    o = a.table(spark, sf, "orders")
    x = o.select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("bar_close"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 4 != 0).alias("ok"))
    return ledger.processed_bars(x, ["symbol", "provider", "bar_close"], "seq", "ok")


_PROCESSED = f"SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY symbol, provider, bar_close ORDER BY seq DESC) AS n FROM ({_PROC})) WHERE n = 1"


@query(_PROCESSED)
def processed_bars(spark: SparkSession, sf: str) -> DataFrame:
    return processed(spark, sf)


@query(f"SELECT symbol, provider, max(bar_close) AS last_ok FROM ({_PROCESSED}) WHERE ok GROUP BY 1, 2")
def last_processed_bar(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.last_processed(processed(spark, sf))


DOWNTIME = f"""SELECT * FROM (SELECT symbol, prev_close, bar_close, CASE WHEN prev_close IS NULL THEN 0 ELSE coalesce(len(list_filter(generate_series(prev_close + INTERVAL 60 MINUTE, bar_close - INTERVAL 60 MINUTE, INTERVAL 60 MINUTE), lambda t: {EVENTS_CALENDAR.duckdb('(t - INTERVAL 60 MINUTE)')})), 0) END AS missed
FROM (SELECT symbol, close_time AS bar_close, lag(close_time) OVER (PARTITION BY symbol ORDER BY close_time) AS prev_close FROM ({a.bars_sql('1h')}))) WHERE missed > 0"""


def downtime(spark: SparkSession, sf: str) -> DataFrame:
    b = a.bars(spark, sf, "1h").select("symbol", F.col("close_time").alias("bar_close"))
    return ledger.downtime_gaps(b, simulate.missed_open_bars("prev_close", "bar_close", EVENTS_CALENDAR, 60)).select("symbol", "prev_close", "bar_close", "missed")


@query(DOWNTIME)
def downtime_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return downtime(spark, sf)


_RUN, _DAY, _MONTH = 5_000_000, 2_000_000, 20_000_000
_BUDGET = f"""WITH RECURSIVE q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, seq) AS n FROM (SELECT event_type AS run_id, ts, event_id AS seq, user_id * 100 AS micro FROM events)),
names AS (SELECT list_sort(list(DISTINCT run_id)) AS all_runs FROM q),
g AS (SELECT 0::BIGINT AS n, false AS granted, map(all_runs, list_transform(all_runs, lambda x: 0::BIGINT)) AS runs, DATE '1970-01-01' AS day, 0::BIGINT AS spent_day, 0::BIGINT AS spent FROM names
  UNION ALL SELECT n, ok, CASE WHEN ok THEN map_concat(runs, MAP {{run_id: runs[run_id] + micro}}) ELSE runs END, d, CASE WHEN ok THEN before + micro ELSE before END, CASE WHEN ok THEN spent + micro ELSE spent END
  FROM (SELECT *, runs[run_id] + micro <= {_RUN} AND before + micro <= {_DAY} AND spent + micro <= {_MONTH} AS ok FROM (SELECT q.n, q.run_id, q.micro, q.ts::DATE AS d, g.runs, g.spent, CASE WHEN q.ts::DATE = g.day THEN g.spent_day ELSE 0 END AS before FROM g JOIN q ON q.n = g.n + 1)))"""


@query(f"{_BUDGET} SELECT q.seq, q.run_id, q.micro, g.granted FROM g JOIN q USING (n)")
def budget_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events")
    r = e.select(F.date_format("ts", "yyyy-MM").alias("month"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("run_id"), (F.col("user_id") * 100).alias("micro"))
    return ledger.budget_grants(r, _RUN, _DAY, _MONTH).select("seq", "run_id", "micro", "granted")


_NOW = "2024-01-20 09:30:00"


@query(f"SELECT run_id, CASE WHEN status = 'started' AND ts < TIMESTAMP '{_NOW}' - INTERVAL 300 SECOND THEN 'unknown' ELSE status END AS status, count(*) AS n FROM ({ATTEMPTS}) GROUP BY ALL")
def attempt_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.sweep_attempts(attempts(spark, sf), _NOW).groupBy("run_id", "status").agg(F.count("*").alias("n"))


@query(f"SELECT x.attempt_id, CASE WHEN status = 'started' AND run_id IN ('click', 'view') THEN 'completed' ELSE status END AS status, CASE WHEN status = 'started' AND run_id IN ('click', 'view') THEN x.attempt_id * 3 ELSE actual_micro END AS actual_micro FROM ({ATTEMPTS}) x")
def attempt_finalize(spark: SparkSession, sf: str) -> DataFrame:
    t = attempts(spark, sf)
    r = t.where("run_id in ('click', 'view')").select("attempt_id", F.lit("completed").alias("outcome"), (F.col("attempt_id") * 3).alias("cost"))
    return ledger.finalize_attempts(t, r)


def _archive(policy: str) -> str:
    take = "status = 'added'" + (" OR status = 'conflict'" if policy == "replace" else "")
    return f"""WITH e AS (SELECT * FROM ({a.bars_sql('1h')}) WHERE open_time < TIMESTAMP '2024-01-20'), f AS (SELECT symbol, tf, open_time, open, high, low, CASE WHEN hour(open_time) = 5 THEN close + 1 ELSE close END AS close, volume FROM ({a.bars_sql('1h')}) WHERE open_time >= TIMESTAMP '2024-01-15'),
j AS (SELECT coalesce(e.symbol, f.symbol) AS symbol, coalesce(e.tf, f.tf) AS tf, coalesce(e.open_time, f.open_time) AS open_time, e.close AS ec, f.close AS fc, e.volume AS ev, f.volume AS fv, CASE WHEN e.symbol IS NULL THEN 'added' WHEN f.symbol IS NULL THEN 'kept' WHEN e.close <> f.close THEN 'conflict' ELSE 'same' END AS status
  FROM e FULL JOIN f ON e.symbol = f.symbol AND e.tf = f.tf AND e.open_time = f.open_time)
SELECT symbol, tf, open_time, CASE WHEN {take} THEN fc ELSE ec END AS close, CASE WHEN {take} THEN fv ELSE ev END AS volume, status FROM j"""


def _merge(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    b = a.bars(spark, sf, "1h")
    old = b.where("open_time < timestamp_ntz'2024-01-20'")
    new = b.where("open_time >= timestamp_ntz'2024-01-15'").withColumn("close", F.when(F.hour("open_time") == 5, F.col("close") + 1).otherwise(F.col("close")))
    return ledger.merge_archive(old, new, policy).select("symbol", "tf", "open_time", "close", "volume", "status")


@query(_archive("keep"))
def archive_merge_keep(spark: SparkSession, sf: str) -> DataFrame:
    return _merge(spark, sf, "keep")


@query(_archive("replace"))
def archive_merge_replace(spark: SparkSession, sf: str) -> DataFrame:
    return _merge(spark, sf, "replace")


@query("""SELECT o_orderkey AS trade_id, CASE WHEN o_orderstatus <> 'O' OR o_orderpriority = '5-LOW' THEN CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END WHEN o_orderkey % 12 = 0 THEN 'quarantined' WHEN o_orderkey % 8 = 0 THEN 'closed' ELSE 'expired' END AS status,
CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND o_orderkey % 8 = 0 THEN o_totalprice END AS exit_price FROM orders""")
def trade_close(spark: SparkSession, sf: str) -> DataFrame:
    o, k = a.table(spark, sf, "orders"), F.col("o_orderkey")
    t = o.select(k.alias("trade_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    x = o.where("o_orderpriority <> '5-LOW'").select(k.alias("trade_id"), F.when(k % 8 == 0, F.col("o_totalprice")).alias("exit_price"), F.when(k % 12 == 0, "provider").alias("quarantine_reason"), F.lit(True).alias("hit"))
    return ledger.close_trades(t, x)


_BEATS = "SELECT event_type AS service, user_id // 60 AS instance, ts, event_id AS seq, CASE WHEN value > 100 THEN 'busy' ELSE 'idle' END AS status, value < 200 AS success FROM events"


@query(f"""WITH b AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY ts, seq) AS run FROM (SELECT *, coalesce(lag(instance) OVER (PARTITION BY service ORDER BY ts, seq) <> instance, true) AS changed FROM ({_BEATS}))),
l AS (SELECT service, max(run) AS run FROM b GROUP BY 1), g AS (SELECT service, max(ts) FILTER (WHERE success) AS last_success_at FROM b GROUP BY 1)
SELECT b.service, min(ts) AS started_at, arg_max(instance, (ts, seq)) AS instance, arg_max(status, (ts, seq)) AS status, max(ts) AS last_seen, any_value(last_success_at) AS last_success_at FROM b JOIN l USING (service, run) JOIN g USING (service) GROUP BY 1""")
def heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    e = a.table(spark, sf, "events")
    b = e.select(F.col("event_type").alias("service"), F.floor(F.col("user_id") / 60).alias("instance"), "ts", F.col("event_id").alias("seq"), F.when(F.col("value") > 100, "busy").otherwise("idle").alias("status"), (F.col("value") < 200).alias("success"))
    return ledger.heartbeats(b)


@query("""WITH s AS (SELECT o_orderkey AS run_id, o_custkey % 5 AS owner, o_orderdate AS ts FROM orders), f AS (SELECT l_orderkey AS run_id, l_suppkey % 5 AS owner, l_shipdate AS ts, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'done' END AS status FROM lineitem),
x AS (SELECT f.run_id, arg_min(f.status, (f.ts, f.status)) AS status, min(f.ts) AS at_ FROM f JOIN s ON s.run_id = f.run_id AND s.owner = f.owner AND f.ts >= s.ts GROUP BY 1)
SELECT s.run_id, coalesce(x.status, 'running') AS status, x.at_ AS finished_at FROM s LEFT JOIN x USING (run_id)""")
def run_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    s = a.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 5).alias("owner"), F.col("o_orderdate").alias("ts"))
    f = a.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 5).alias("owner"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("status"))
    return ledger.finish_runs(s, f)
