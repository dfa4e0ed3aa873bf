"""Simulated trades: entry, first touch of stop or target, financing, position gate.

Outcomes don't depend on which trades the gate admits, so all candidates are reconciled in
one bounded range join (an equi-join on a bucket of bar numbers) and the gate is an ordered
fold over their small result rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcraft.functions.market_calendar import SessionCalendar
from barcraft.functions.numeric import round_to
from barcraft.operators.segments import SLICE_MINUTES, running
from barcraft.sources.schemas import minutes
from barcraft.sources.sinks import settled

FOREVER = "9999-12-31 00:00:00"


@dataclass(frozen=True)
class Costs:
    """Rates in percent of the entry price; a triple weekday (Monday 0) counts three nights."""

    spread_pct: float = 0.05
    slippage_pct: float = 0.1
    commission_pct: float = 0.02
    swap_pct: float = 0.0
    swap_long_pct: float | None = 0.03
    swap_short_pct: float | None = 0.01
    triple_weekday: int | None = 2
    rollover_hour: int = 17
    rollover_tz: str = "America/New_York"
    terms_version: str = "unset"


def entry_bars(candidates: DataFrame, bars: DataFrame, slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """candidates(symbol, as_of, price, ...) with entry_ref: the open of the first bar that
    opens at or after as_of, else the packet's price.  Both sides are stacked and scanned from
    the end, in slices of time, so that a running value says which bar comes next."""
    a = candidates.select("symbol", F.col("as_of").alias("__t"), F.lit(0).alias("__side"), F.struct(*candidates.columns).alias("__c"), F.lit(None).cast("double").alias("__open"))
    b = bars.select("symbol", F.col("open_time").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(a.schema["__c"].dataType).alias("__c"), F.col("open").alias("__open"))
    found = running(a.unionByName(b), ["symbol"], "__t", ["__side"], last=["__open"], backward=True, slice_minutes=slice_minutes).where("__side = 0")
    return found.select("__c.*", F.coalesce("__open", F.col("__c.price")).alias("entry_ref"))


def open_trades(entries: DataFrame, costs: Costs) -> DataFrame:
    """entries(direction, entry_ref, sl_pct, tp_pct, ...) with the fill after adverse slippage
    and its stop and target, rounded to 4."""
    s = costs.slippage_pct / 100
    buy = F.col("direction") == "BUY"
    fill = F.when(buy, F.col("entry_ref") * (1 + s)).otherwise(F.col("entry_ref") * (1 - s))
    sl, tp = F.col("sl_pct") / 100, F.col("tp_pct") / 100
    return entries.withColumns({
        "entry_mid": round_to(fill, 4),
        "sl_price": round_to(F.when(buy, fill * (1 - sl)).otherwise(fill * (1 + sl)), 4),
        "tp_price": round_to(F.when(buy, fill * (1 + tp)).otherwise(fill * (1 - tp)), 4),
    })


def rollover_nights(opened: str, closed: str, costs: Costs) -> Column:
    """Weighted rollovers strictly between two UTC instants, by the local clock: none on
    Saturday and Sunday, three on the triple weekday."""
    local = lambda c: f"convert_timezone('UTC', '{costs.rollover_tz}', {c})"
    b = f"(cast(d as timestamp_ntz) + interval {costs.rollover_hour} hours)"
    triple = f"WHEN weekday(d) = {costs.triple_weekday} THEN 3D" if costs.triple_weekday is not None else ""
    weight = f"CASE WHEN weekday(d) >= 5 THEN 0D {triple} ELSE 1D END"
    days = f"sequence(cast({local(opened)} as date), cast({local(closed)} as date), interval 1 day)"
    total = f"aggregate({days}, 0D, (acc, d) -> acc + CASE WHEN {b} > {local(opened)} AND {b} < {local(closed)} THEN {weight} ELSE 0D END)"
    return F.expr(f"CASE WHEN {closed} > {opened} THEN {total} ELSE 0D END")


def swap_rate(costs: Costs) -> Column:
    long, short = (costs.swap_pct if x is None else x for x in (costs.swap_long_pct, costs.swap_short_pct))
    return F.when(F.col("direction") == "BUY", F.lit(long)).otherwise(F.lit(short))


def reconcile(trades: DataFrame, bars: DataFrame, timeout_bars: int, costs: Costs, trigger_tf: str = "15min", tf: str = "15min", slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """trades(symbol, trade_id, opened_at, direction, entry_mid, sl_price, tp_price) with
    status, exit_reason, exit_price, closed_at, r_multiple, r_pessimistic, r_optimistic and
    ambiguous.

    Bars that close after opened_at are taken in order.  On the bar that was open at entry
    only the stop counts, filled at its level.  Stop and target in one bar are ambiguous and
    the stop is taken.  A stop passed at the open fills at the open.  After ``timeout_bars``
    bars of the trigger timeframe the trade expires at the close; without enough bars it
    stays open."""
    horizon = -(-timeout_bars * minutes(trigger_tf) // minutes(tf))
    # Bars by close and trades by entry in one order: a running count numbers the bars and
    # says how many had closed by each entry, so the next one is the first that counts.
    columns = ["open_time", "close_time", "open", "high", "low", "close"]
    ends = bars.select("symbol", F.col("close_time").alias("__t"), F.lit(0).alias("__side"), F.lit(1).alias("__bar"), F.struct(*columns).alias("__b"), F.lit(None).cast(trades.select(F.struct(*trades.columns)).schema[0].dataType).alias("__trade"))
    keyed = trades.select("symbol", F.col("opened_at").alias("__t"), F.lit(1).alias("__side"), F.lit(0).alias("__bar"), F.lit(None).cast(ends.schema["__b"].dataType).alias("__b"), F.struct(*trades.columns).alias("__trade"))
    both = ends.unionByName(keyed).withColumn("__n", F.col("__bar").cast("long"))
    stacked = running(both, ["symbol"], "__t", ["__side"], sums=["__n"], slice_minutes=slice_minutes)
    b = stacked.where("__side = 0").select("symbol", F.col("__n").alias("bar_no"), "__b.*")
    t = stacked.where("__side = 1").select("__trade.*", (F.col("__n") + 1).alias("first_no"))
    # two buckets of `horizon` bars hold every bar in reach
    spread = t.withColumn("__bucket", F.explode(F.array(F.floor(F.col("first_no") / horizon), F.floor(F.col("first_no") / horizon) + 1)))
    reach = b.withColumn("__bucket", F.floor(F.col("bar_no") / horizon))
    buy = F.col("direction") == "BUY"
    stop = F.when(buy, F.col("low") <= F.col("sl_price")).otherwise(F.col("high") >= F.col("sl_price"))
    target = F.when(buy, F.col("high") >= F.col("tp_price")).otherwise(F.col("low") <= F.col("tp_price"))
    partial = F.col("open_time") < F.col("opened_at")
    last = F.col("bar_no") - F.col("first_no") + 1 >= horizon
    event = F.when(partial, F.when(stop, "sl_partial").when(last, "timeout")).when(stop & target, "ambiguous").when(target, "tp_hit").when(stop, "sl_hit").when(last, "timeout")
    hits = spread.join(reach, ["symbol", "__bucket"]).where((F.col("bar_no") >= F.col("first_no")) & (F.col("bar_no") < F.col("first_no") + horizon)).withColumn("event", event).where("event is not null")
    exits = hits.groupBy("symbol", "trade_id").agg(F.min_by(F.struct("event", "open", "close", "close_time"), "bar_no").alias("x"))
    return settle(trades.join(exits, ["symbol", "trade_id"], "left"), costs)


def settle(exits: DataFrame, costs: Costs) -> DataFrame:
    """Trades with the bar that ended each, ``x`` (event, open, close, close_time; null: still
    open), as outcomes: fills, financing and R multiples in place of ``x``."""
    buy = F.col("direction") == "BUY"
    s = costs.slippage_pct / 100
    slip = lambda ref: F.when(buy, ref * (1 - s)).otherwise(ref * (1 + s))
    gap = F.when(buy, F.least("sl_price", "x.open")).otherwise(F.greatest("sl_price", "x.open"))
    kind = F.col("x.event")
    ref = F.when(kind == "sl_partial", F.col("sl_price")).when(kind.isin("sl_hit", "ambiguous"), gap).when(kind == "tp_hit", F.col("tp_price")).when(kind == "timeout", F.col("x.close"))
    out = exits.withColumns({"closed_at": F.col("x.close_time"), "__fill": slip(ref), "__best": F.when(kind == "ambiguous", slip(F.col("tp_price")))})
    nights = rollover_nights("opened_at", "closed_at", costs)
    extra = F.col("entry_mid") * costs.commission_pct / 100 + nights * F.col("entry_mid") * swap_rate(costs) / 100
    sign, risk = F.when(buy, 1.0).otherwise(-1.0), F.abs(F.col("entry_mid") - F.col("sl_price"))
    gain = lambda fill: sign * (fill - F.col("entry_mid")) - F.col("entry_mid") * costs.spread_pct / 100 - F.col("__extra")
    net = lambda fill: F.when(risk <= 0, F.when(fill.isNotNull(), 0.0)).otherwise(round_to(gain(fill) / risk, 3))
    out = out.withColumn("__extra", F.when(F.col("closed_at").isNotNull(), extra))
    return out.select(
        *[c for c in exits.columns if c != "x"],
        F.when(kind.isNull(), "open").when(kind == "timeout", "expired").otherwise("closed").alias("status"),
        F.when(kind == "sl_partial", "sl_hit").otherwise(kind).alias("exit_reason"),
        round_to("__fill", 4).alias("exit_price"), "closed_at", net(F.col("__fill")).alias("r_multiple"), net(F.col("__fill")).alias("r_pessimistic"),
        F.when(kind == "ambiguous", net(F.col("__best"))).otherwise(net(F.col("__fill"))).alias("r_optimistic"),
        F.coalesce(kind == "ambiguous", F.lit(False)).alias("ambiguous"),
    )


#: Outcomes of a (run, symbol) that are folded in one task, and of a slice beyond that.
FOLD_ROWS, GATE_SLICE = 200_000, 20_000


def position_gate(outcomes: DataFrame, bar_seconds: int, cooldown_bars: int, keys: tuple[str, ...] = ("run_id", "symbol"), fold_rows: int = FOLD_ROWS, slice_rows: int = GATE_SLICE, sized: DataFrame | None = None) -> DataFrame:
    """outcomes with ``admitted``: in as_of order one position at a time; the next is admitted
    from closed_at plus the cooldown on, after an open one none is.

    A (run, symbol) of up to ``fold_rows`` outcomes is folded in one pass over its as_of and
    closed_at; larger ones go in slices (``_sliced_gate``), with the same result.  ``sized`` is a
    cheaper table with a row of these keys for each outcome, such as the trades; without it
    the outcomes are written and counted."""
    if sized is None:
        outcomes = sized = settled(outcomes, "outcomes")
    large = sized.groupBy(*keys).count().where(F.col("count") > fold_rows).select(*[F.col(k).alias(f"__{k}") for k in keys])
    if large.isEmpty():
        return _folded_gate(outcomes, bar_seconds, cooldown_bars, keys)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    outcomes = settled(outcomes, "gated")
    few = outcomes.join(large, same, "left_anti")
    many = outcomes.join(large, same, "left_semi")
    return _folded_gate(few, bar_seconds, cooldown_bars, keys).unionByName(_sliced_gate(many, bar_seconds, cooldown_bars, keys, slice_rows))


def _folded_gate(outcomes: DataFrame, bar_seconds: int, cooldown_bars: int, keys: tuple[str, ...]) -> DataFrame:
    names = outcomes.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("as_of", "ascending"), ("trade_id", "ascending")])
        at = table.column("as_of").cast(pa.int64()).to_pylist()
        end = table.column("closed_at").cast(pa.int64()).to_pylist()
        busy, admitted = None, []
        for a, e in zip(at, end, strict=True):
            free = busy is None or a >= busy
            admitted.append(free)
            if free:
                busy = float("inf") if e is None else e + bar_seconds * cooldown_bars * 1_000_000
        return table.select(names).append_column("admitted", pa.array(admitted, pa.bool_()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outcomes.schema) + ", admitted boolean"
    return outcomes.groupBy(*keys).applyInArrow(run, schema)


def _exits(table: pa.Table) -> pa.Table:
    """Per row of a slice the first row beyond the slice that its chain of next rows comes to."""
    table = table.sort_by("__n")
    n, following = table.column("__n").to_pylist(), table.column("__next").to_pylist()
    place, last = {x: i for i, x in enumerate(n)}, n[-1]
    out: list[int | None] = [None] * len(n)
    for i in range(len(n) - 1, -1, -1):
        to = following[i]
        if to is not None:
            out[i] = to if to > last else out[place[to]]
    return table.set_column(table.column_names.index("__next"), "__next", pa.array(out, pa.int64()))


def _visited(table: pa.Table) -> pa.Table:
    """The rows that are reached from the slice's entry, by following next rows."""
    table = table.sort_by("__n")
    n, following = table.column("__n").to_pylist(), table.column("__next").to_pylist()
    place, at, seen = {x: i for i, x in enumerate(n)}, table.column("__entry")[0].as_py(), []
    while at in place:
        seen.append(place[at])
        at = following[place[at]]
    return table.drop_columns(["__entry"]).take(pa.array(seen, pa.int64()))


def _reached(nodes: DataFrame, keys: list[str], slice_rows: int, fold_rows: int) -> DataFrame:
    """(keys..., __n): rows on the chain that begins at each key's row 1; nodes(keys..., __n,
    __next) with rows in ascending order and __next later or null.

    Within a slice every chain is followed to where it leaves.  Chains that leave for the same row
    are one from there on, so what is left to follow are the rows where chains enter slices; that
    is the same question over fewer rows, until they are few.  Each slice on the way is then
    followed from the one row where the chain enters it."""
    schema = ", ".join(f"{k} {dict(nodes.dtypes)[k]}" for k in keys)
    narrow = f"{schema}, __n long, __next long"
    if nodes.groupBy(*keys).count().where(F.col("count") > fold_rows).isEmpty():
        found = nodes.withColumn("__entry", F.lit(1).cast("long")).groupBy(*keys).applyInArrow(_visited, narrow)
        return found.select(*keys, "__n")
    nodes = settled(nodes.select(*keys, "__n", "__next", F.floor(F.col("__n") / slice_rows).alias("__slice")), "gate")
    exits = settled(nodes.groupBy(*keys, "__slice").applyInArrow(_exits, f"{narrow}, __slice long").select(*keys, "__n", "__next"), "exits")
    entered = exits.select(*keys, F.col("__next").alias("__n")).where("__n is not null").unionByName(exits.select(*keys).distinct().withColumn("__n", F.lit(1).cast("long"))).distinct()
    entries = _reached(entered.join(exits, [*keys, "__n"]), keys, slice_rows * 64, fold_rows)
    entries = entries.select(*keys, F.floor(F.col("__n") / slice_rows).alias("__slice"), F.col("__n").alias("__entry"))
    found = nodes.join(entries, [*keys, "__slice"]).groupBy(*keys, "__slice").applyInArrow(_visited, f"{narrow}, __slice long")
    return found.select(*keys, "__n")


def _sliced_gate(outcomes: DataFrame, bar_seconds: int, cooldown_bars: int, keys: tuple[str, ...], slice_rows: int) -> DataFrame:
    """The gate without a group in one task: each outcome's next admissible one is an as-of step,
    and those on the chain from the first are admitted."""
    name = [f"__key{i}" for i, _ in enumerate(keys)]
    packed = outcomes.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(n) for k, n in zip(keys, name, strict=True)], *[F.col(k).isNull().alias(f"{n}_null") for k, n in zip(keys, name, strict=True)], F.struct(*outcomes.columns).alias("__row"), "as_of", "trade_id", "closed_at")
    by = [*name, *[f"{n}_null" for n in name]]
    rows = settled(running(packed.withColumn("__n", F.lit(1).cast("long")), by, "as_of", ["trade_id"], sums=["__n"]), "numbered")
    busy = F.col("closed_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(bar_seconds * cooldown_bars))
    # rows by as_of and ends by the time from which the next is free, ends first: a running count
    # of rows says how many began before
    asked = rows.where("closed_at is not null").select(*by, busy.alias("__t"), F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__began"), F.col("__n"))
    began = rows.select(*by, F.col("as_of").alias("__t"), F.lit(1).alias("__side"), F.lit(1).cast("long").alias("__began"), F.lit(None).cast("long").alias("__n"))
    free = running(asked.unionByName(began), by, "__t", ["__side"], sums=["__began"]).where("__side = 0")
    total = rows.groupBy(*by).agg(F.max("__n").alias("__all"))
    later = free.select(*by, "__n", F.greatest(F.col("__began") + 1, F.col("__n") + 1).alias("__next")).join(total, by)
    later = later.select(*by, "__n", F.when(F.col("__next") <= F.col("__all"), F.col("__next")).alias("__next"))
    nodes = rows.select(*by, "__n").join(later, [*by, "__n"], "left")
    chain = _reached(nodes, by, slice_rows, slice_rows).withColumn("admitted", F.lit(True))
    return rows.join(chain, [*by, "__n"], "left").select("__row.*", F.coalesce("admitted", F.lit(False)).alias("admitted"))


def missed_open_bars(prev_close: str, close: str, calendar: SessionCalendar, step: int = 15) -> Column:
    """Bars strictly between two closes whose open was in session; 0 without a close before."""
    last = f"({close} - interval {2 * step} minutes + interval 1 microsecond)"  # the last of them opens two steps before
    return F.expr(f"coalesce({calendar.open_slots_sql(prev_close, last, f'({step} * 60000000L)')}, 0L)")


def coverage(trades: DataFrame, bars: DataFrame, now: str, tf: str, calendar: SessionCalendar, slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """(symbol, trade_id, expected, missing, covered): whether every slot in session from the
    one that holds opened_at to ``now`` has a bar."""
    from barcraft.operators.validate import floor_to_grid

    step = minutes(tf)
    until = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {step} minutes")
    keyed = trades.select("symbol", "trade_id", floor_to_grid("opened_at", tf).alias("open_time"))
    # One row per slot and symbol from the earliest entry on, not one per slot and trade:
    # counts running back from ``now`` say what is missing from any slot on.
    first = keyed.groupBy("symbol").agg(F.min("open_time").alias("__first")).where(F.col("__first") <= until)
    slots = first.select("symbol", F.explode(F.sequence("__first", until, F.expr(f"interval {step} minutes"))).alias("open_time"))
    have = bars.select("symbol", "open_time", F.lit(1).alias("__have"))
    flagged = slots.join(have, ["symbol", "open_time"], "left").withColumn("__open", calendar.is_open("open_time"))
    flags = flagged.select("symbol", "open_time", F.col("__open").cast("long").alias("expected"), (F.col("__open") & F.col("__have").isNull()).cast("long").alias("missing"))
    counted = running(flags, ["symbol"], "open_time", [], sums=["expected", "missing"], backward=True, slice_minutes=slice_minutes)
    out = keyed.join(counted, ["symbol", "open_time"], "left").select("symbol", "trade_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "missing")])
    return out.withColumn("covered", F.col("missing") == 0)


def choose_timeframe(fine: DataFrame, coarse: DataFrame, want_tf: str, trigger_tf: str) -> DataFrame:
    """(symbol, trade_id, tf, fell_back, covered) from two coverage frames: the finer bars
    where they cover, else the trigger's."""
    a = fine.select("symbol", "trade_id", F.col("covered").alias("__fine"))
    out = coarse.select("symbol", "trade_id", F.col("covered").alias("__coarse")).join(a, ["symbol", "trade_id"], "left")
    use = F.lit(want_tf != trigger_tf) & F.coalesce("__fine", F.lit(False))
    return out.select("symbol", "trade_id", F.when(use, want_tf).otherwise(trigger_tf).alias("tf"), (~use & F.lit(want_tf != trigger_tf)).alias("fell_back"), (use | F.col("__coarse")).alias("covered"))


def open_action() -> Column:
    """What a reconcile sweep does with an open trade: quarantine on a provider mismatch,
    leave untouched where bars are missing, else reconcile."""
    return F.when(~F.col("provider").eqNullSafe(F.col("bars_provider")), "quarantine").when(~F.coalesce("covered", F.lit(False)), "untouched").otherwise("reconcile")


def mark_to_market(trades: DataFrame, quotes: DataFrame, bar_minutes: int = 15, timeout_bars: int = 96) -> DataFrame:
    """Open trades against the newest quote of each symbol; a quote counts only if its bid is
    positive and its ask not below it."""
    newest = quotes.groupBy("symbol").agg(F.max_by(F.struct("bid", "ask"), "time").alias("q"))
    t = trades.join(newest, "symbol", "left")
    mid = F.when((F.col("q.bid") > 0) & (F.col("q.ask") >= F.col("q.bid")), (F.col("q.bid") + F.col("q.ask")) / 2)
    sign, risk = F.when(F.col("direction") == "BUY", 1.0).otherwise(-1.0), F.abs(F.col("entry_mid") - F.col("sl_price"))
    gain = sign * (F.col("mid") - F.col("entry_mid"))
    return t.withColumn("mid", mid).select(
        *trades.columns, "mid", round_to(gain / F.col("entry_mid") * 100, 4).alias("unrealized_pct"), F.when(risk > 0, round_to(gain / risk, 4)).alias("unrealized_r"),
        round_to(sign * (F.col("mid") - F.col("sl_price")), 4).alias("to_stop"), round_to(sign * (F.col("tp_price") - F.col("mid")), 4).alias("to_target"),
        (F.col("opened_at") + F.expr(f"interval {bar_minutes * timeout_bars} minutes")).alias("times_out_at"),
    )


def r_from_prices() -> Column:
    """Signed move over risk, rounded to 4; null without risk."""
    risk = F.abs(F.col("entry_mid") - F.col("sl_price"))
    sign = F.when(F.col("direction") == "BUY", 1.0).otherwise(-1.0)
    return F.when(risk > 0, round_to(sign * (F.col("exit_price") - F.col("entry_mid")) / risk, 4))


def sweep(trades: DataFrame, positions: DataFrame, now: str, horizon_minutes: int) -> DataFrame:
    """Live trades against broker positions by external_id: held, closed_timeout,
    closed_by_broker, and orphans (positions without a trade)."""
    t = trades.select("external_id", "trade_id", "opened_at", F.lit(True).alias("__trade"))
    p = positions.select("external_id", F.lit(True).alias("__position"))
    both = t.join(p, "external_id", "full")
    late = F.col("opened_at") + F.expr(f"interval {horizon_minutes} minutes") <= F.lit(now).cast("timestamp_ntz")
    action = F.when(F.col("__trade").isNull(), "orphan").when(F.col("__position").isNull(), "closed_by_broker").when(late, "closed_timeout").otherwise("held")
    return both.select("external_id", "trade_id", action.alias("action"))


def cost_manifest(costs: Costs) -> list[Column]:
    """(modeled, not_modeled) of a trade: a component counts if its rate is not zero or the
    terms are sourced."""
    sourced = costs.terms_version != "unset"
    rate = swap_rate(costs)
    parts = [("slippage", F.lit(costs.slippage_pct != 0)), ("commission", F.lit(costs.commission_pct != 0 or sourced)), ("swap", (rate != 0) | F.lit(sourced))]
    fixed = [F.lit(x) for x in ("spread", "gap_through_stop", "latency")]
    yes = F.array_compact(F.array(*fixed, *[F.when(c, F.lit(n)) for n, c in parts]))
    no = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in parts]))
    return [yes.alias("modeled"), no.alias("not_modeled")]


def execution_manifest(costs: Costs, **rules) -> dict:
    """Everything that affects outcomes, for a run to be pinned to: the costs and whatever
    rules (timeout, cooldown, policies' versions, calendar version) the caller names."""
    from dataclasses import asdict

    return {"costs": asdict(costs), **rules}


def execution_text(manifest: dict) -> str:
    """The manifest as sorted compact JSON."""
    import json

    return json.dumps(manifest, sort_keys=True, separators=(",", ":"), default=str)


def execution_hash(manifest: dict) -> str:
    """First sixteen hex digits of the SHA-256 of the manifest's text."""
    import hashlib

    return hashlib.sha256(execution_text(manifest).encode()).hexdigest()[:16]


def with_frozen_costs(trades: DataFrame, stored: dict[str, str], fallback: Costs) -> DataFrame:
    """Adds each rate as stored with the trade (a column or SQL per rate), else the fallback's:
    an open trade keeps the terms it was opened under."""
    return trades.withColumns({name: F.coalesce(F.expr(sql), F.lit(getattr(fallback, name))) for name, sql in stored.items()})


def resume(candidates: DataFrame, prior: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(results that a former run left for these candidates, candidates still to simulate)."""
    done = prior.join(candidates.select(*key), key, "left_semi")
    return done, candidates.join(prior.select(*key), key, "left_anti")


def seeded_maker(sides: DataFrame, seed: int, bar_seconds: int, cooldown_bars: int, keys: tuple[str, ...] = ("run_id", "symbol")) -> DataFrame:
    """A coin per decided bar from one seeded sequence: sides holds both outcomes of each
    candidate (closed_buy, closed_sell).  Bars that the gate holds back draw no coin, so what
    was drawn depends on the positions taken: draw and gate are one fold per group.  Adds
    direction, null where held back."""
    from random import Random

    names = sides.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("as_of", "ascending"), ("trade_id", "ascending")])
        at = table.column("as_of").cast(pa.int64()).to_pylist()
        ends = [table.column(c).cast(pa.int64()).to_pylist() for c in ("closed_buy", "closed_sell")]
        rng, busy, drawn = Random(seed), None, []
        for i, a in enumerate(at):
            if busy is not None and a < busy:
                drawn.append(None)
                continue
            side = 0 if rng.random() < 0.5 else 1
            drawn.append(("BUY", "SELL")[side])
            end = ends[side][i]
            busy = float("inf") if end is None else end + bar_seconds * cooldown_bars * 1_000_000
        return table.select(names).append_column("direction", pa.array(drawn, pa.string()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sides.schema) + ", direction string"
    return sides.groupBy(*keys).applyInArrow(run, schema)
