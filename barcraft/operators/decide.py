"""Eligibility, filtering, decision makers, risk gates and order checks as column rules.

Rules that report every reason build an array in a fixed order; rules where the first
failure decides are ordered CASE chains.  Everything is an expression over one row, so a
pipeline of them is a single projection.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcraft.functions.numeric import round_to
from barcraft.functions.market_calendar import SessionCalendar

BUY, SELL, NO_TRADE = "BUY", "SELL", "NO_TRADE"
#: External name of each direction.
EXTERNAL = {BUY: "Buy", SELL: "Sell", NO_TRADE: "NoTrade"}


def _reasons(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


@dataclass(frozen=True)
class EligibilityPolicy:
    """Limits of trust in a feed; ``recent_bars`` says how many bars of a timeframe must be
    free of unexpected gaps."""

    recent_bars: tuple[tuple[str, int], ...] = (("15min", 8), ("1h", 6), ("4h", 4), ("1day", 3))
    max_feed_lag: int = 1800
    max_quote_lag: int = 120
    max_clock_skew: int = 5

    def version(self) -> str:
        """First ten hex digits of the SHA-1 of the policy as sorted compact JSON."""
        return hashlib.sha1(policy_text(self).encode()).hexdigest()[:10]


def policy_text(policy: EligibilityPolicy) -> str:
    """The policy as sorted compact JSON."""
    return json.dumps(asdict(policy) | {"recent_bars": dict(policy.recent_bars)}, sort_keys=True, separators=(",", ":"))


def eligibility(frame: DataFrame, mode: str, policy: EligibilityPolicy | None = None) -> DataFrame:
    """frame(as_of, feed_close, gap_<tf>..., and online: now, quote_time) with reasons,
    eligible, feed_lag and quote_lag.  A null feed_close means there are no trigger bars."""
    policy = policy or EligibilityPolicy()
    online = mode == "online"
    feed_lag = _seconds(F.col("now") if online else F.col("as_of"), F.col("feed_close"))
    quote_lag = _seconds(F.col("now"), F.col("quote_time")) if online else F.lit(None).cast("double")
    rules = []
    if online:
        whole = lambda c: F.format_string("%d", c.cast("long"))
        rules.append(F.when(feed_lag > policy.max_feed_lag, F.concat(F.lit("stale_feed:"), whole(feed_lag))))
        rules.append(F.when(F.col("quote_time").isNull(), F.lit("missing_quote")).when(quote_lag < -policy.max_clock_skew, F.concat(F.lit("future_quote:"), whole(quote_lag))).when(quote_lag > policy.max_quote_lag, F.concat(F.lit("stale_quote:"), whole(quote_lag))))
    rules += [F.when(F.col(f"gap_{tf}"), F.lit(f"recent_unexpected_gap:{tf}")) for tf, _ in policy.recent_bars if f"gap_{tf}" in frame.columns]
    found = F.when(F.col("feed_close").isNull(), F.array(F.lit("no_trigger_bars"))).otherwise(_reasons(*rules))
    return frame.withColumns({"reasons": found, "feed_lag": round_to(feed_lag, 1), "quote_lag": round_to(quote_lag, 1)}).withColumn("eligible", F.size("reasons") == 0)


def prefilter(max_spread: float = 0.10, blocked: tuple[str, ...] = ("choppy",)) -> Column:
    """Reasons over eligible, reasons, insufficient (array of timeframes), spread_pct, regime
    and event (the blackout's label); a row passes with none."""
    why = F.when(~F.col("eligible"), F.concat(F.lit("ineligible:"), F.when(F.size("reasons") > 0, F.array_join("reasons", ";")).otherwise("unknown")))
    short = F.transform(F.coalesce(F.col("insufficient"), F.array().cast("array<string>")), lambda t: F.concat(F.lit("insufficient_data:"), t))
    rest = [
        F.when(F.col("spread_pct") > max_spread, F.lit("spread_too_wide")),
        F.when(F.col("regime").isin(*blocked), F.concat(F.lit("blocked_regime:"), F.col("regime"))),
        F.when(F.col("event").isNotNull(), F.concat(F.lit("news_blackout:"), F.col("event"))),
    ]
    return F.concat(_reasons(why), short, _reasons(*rest))


# Makers: each gives (direction, confidence) from a packet's columns.


def confluence_maker() -> tuple[Column, Column]:
    direction = F.when(F.col("confluence") == "aligned_bull", BUY).when(F.col("confluence") == "aligned_bear", SELL).otherwise(NO_TRADE)
    return direction, F.when(direction == NO_TRADE, F.lit(0.5)).otherwise(F.lit(0.7))


def flat_maker() -> tuple[Column, Column]:
    return F.lit(NO_TRADE), F.lit(0.5)


def always_buy_maker() -> tuple[Column, Column]:
    return F.lit(BUY), F.lit(0.6)


def hashed_maker(seed: int = 7) -> tuple[Column, Column]:
    """A coin per bar that depends on the bar alone, not on what was decided before."""
    coin = F.pmod(F.crc32(F.concat_ws("|", F.lit(seed), "symbol", F.date_format("as_of", "yyyyMMddHHmm"))), F.lit(2))
    return F.when(coin == 0, BUY).otherwise(SELL), F.lit(0.6)


MAKERS: dict[str, Callable[[], tuple[Column, Column]]] = {"confluence": confluence_maker, "flat": flat_maker, "always_buy": always_buy_maker, "hashed": hashed_maker}


@dataclass(frozen=True)
class RiskPolicy:
    min_confidence: float = 0.55
    atr_multiple: float = 1.5
    reward_risk: float = 2.0
    source: str = "atr"  # or "model"
    max_atr_multiple: float = 2.5
    min_sl: float = 0.05
    max_sl: float = 3.0
    max_spread_share: float = 0.33
    need_session: bool = True


def stops(policy: RiskPolicy) -> tuple[Column, Column, Column]:
    """(sl_pct, tp_pct, source) from atr_pct and, under the model policy, a proposal."""
    sl = round_to(F.col("atr_pct") * policy.atr_multiple, 3)
    tp = round_to(sl * policy.reward_risk, 3)
    if policy.source != "model":
        return sl, tp, F.lit("atr")
    a, b = F.col("proposed_sl"), F.col("proposed_tp")
    source = (
        F.when(a.isNull() | b.isNull(), "atr_fallback:no_proposal").when(b < a * policy.reward_risk, "atr_fallback:rr_too_low").when(a > sl * policy.max_atr_multiple, "atr_fallback:sl_too_wide").otherwise("model")
    )
    own = source == "model"
    return F.when(own, round_to(a, 3)).otherwise(sl), F.when(own, round_to(b, 3)).otherwise(tp), source


def risk(frame: DataFrame, calendar: SessionCalendar, policy: RiskPolicy | None = None) -> DataFrame:
    """frame(direction, confidence, spread_pct, as_of, atr_pct[, proposals]) with the first
    failing gate as verdict (approved if none), sl_pct, tp_pct and their source."""
    policy = policy or RiskPolicy()
    sl, tp, source = stops(policy)
    f = frame.withColumns({"session_open": calendar.is_open("as_of"), "sl_pct": sl, "tp_pct": tp, "sl_source": source})
    verdict = F.when(F.col("direction") == NO_TRADE, "no_trade").when(F.col("confidence") < policy.min_confidence, "low_confidence").when(F.col("spread_pct").isNull(), "missing_spread")
    if policy.need_session:
        verdict = verdict.when(~F.col("session_open"), "market_closed")
    verdict = (
        verdict.when(F.col("atr_pct").isNull() | (F.col("atr_pct") <= 0), "no_atr")
        .when(~F.col("sl_pct").between(policy.min_sl, policy.max_sl), "sl_out_of_bounds")
        .when(F.col("spread_pct") > F.col("sl_pct") * policy.max_spread_share, "spread_vs_sl")
        .otherwise("approved")
    )
    return f.withColumn("verdict", verdict)


def run_decisions(frame: DataFrame, maker: str, calendar: SessionCalendar, policy: RiskPolicy | None = None, blocked: tuple[str, ...] = ("choppy",), max_spread: float = 0.10) -> DataFrame:
    """Prefilter, maker and risk in one projection: stage is prefiltered_out or decided, and
    rows that don't pass the filter have no decision."""
    direction, confidence = MAKERS[maker]()
    f = frame.withColumn("filter_reasons", prefilter(max_spread, blocked))
    passed = F.size("filter_reasons") == 0
    f = f.withColumns({"stage": F.when(passed, "decided").otherwise("prefiltered_out"), "direction": F.when(passed, direction), "confidence": F.when(passed, confidence)})
    f = risk(f, calendar, policy)
    return f.withColumn("verdict", F.when(passed, F.col("verdict")))


def decision_faults() -> Column:
    """Rules of a decision record (direction, confidence, rationale, n_factors, proposed_sl,
    proposed_tp) that a row breaks."""
    return _reasons(
        F.when(~F.col("direction").isin(BUY, SELL, NO_TRADE) | F.col("direction").isNull(), F.lit("direction")),
        F.when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), F.lit("confidence")),
        F.when(F.col("rationale").isNull() | ~F.char_length("rationale").between(1, 4000), F.lit("rationale")),
        F.when(F.col("n_factors") > 12, F.lit("key_factors")),
        F.when((F.col("proposed_sl") <= 0) | (F.col("proposed_sl") > 10), F.lit("proposed_sl")),
        F.when((F.col("proposed_tp") <= 0) | (F.col("proposed_tp") > 20), F.lit("proposed_tp")),
    )


def binding_errors(packets: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Packets without an evaluation of the same mode and instant."""
    return packets.join(evaluations.select("mode", "as_of").distinct(), ["mode", "as_of"], "left_anti")


def live_refusal(max_volume: float = 1.0, cooldown_minutes: int = 30, max_positions: int = 3) -> Column:
    """The first of the ordered refusals of a live order, null if it may go."""
    return (
        F.when(~F.col("enabled"), "disabled").when(~F.col("approved"), "not_approved").when(F.col("sl_pct").isNull() | F.col("tp_pct").isNull(), "missing_sl_tp")
        .when((F.col("volume") <= 0) | (F.col("volume") > max_volume), "volume").when(F.col("minutes_since_last") < cooldown_minutes, "cooldown").when(~F.col("trading_enabled"), "trading_disabled")
        .when(F.col("environment") != "demo", "not_demo").when(F.col("volume") != F.col("broker_volume"), "broker_volume").when(F.col("own_positions") > 0, "position_exists").when(F.col("open_positions") >= max_positions, "max_positions")
    )


def order_fields() -> list[Column]:
    """(probability, stop_loss, take_profit, fault): probability clamped to at least 0.5, the
    take-profit's sign carrying the side."""
    sign = F.when(F.col("direction") == SELL, -1.0).otherwise(1.0)
    fault = F.when(~F.col("direction").isin(BUY, SELL), "not_an_order").when(F.col("sl_pct") <= 0, "stop_loss").when(F.col("tp_pct") <= 0, "take_profit")
    return [F.greatest(F.col("confidence"), F.lit(0.5)).alias("probability"), F.col("sl_pct").alias("stop_loss"), (sign * F.col("tp_pct")).alias("take_profit"), fault.alias("fault")]


def resolve_symbols(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """wanted(query) ⟕ candidates(query, symbol): the one case-insensitive exact match, else
    the sole candidate, else ambiguous (or unknown)."""
    exact = F.lower("symbol") == F.lower("query")
    per = candidates.groupBy("query").agg(F.count("*").alias("n"), F.count_if(exact).alias("n_exact"), F.min(F.when(exact, F.col("symbol"))).alias("hit"), F.min("symbol").alias("sole"))
    out = wanted.join(per, "query", "left")
    found = F.when(F.col("n_exact") == 1, F.col("hit")).when(F.col("n") == 1, F.col("sole"))
    return out.select("query", found.alias("resolved"), F.when(found.isNotNull(), "ok").when(F.coalesce("n", F.lit(0)) == 0, "unknown").otherwise("ambiguous").alias("outcome"))


def spread_pct(bid: str = "bid", ask: str = "ask") -> Column:
    return F.when(F.col(ask) != 0, (F.col(ask) - F.col(bid)) / F.col(ask) * 100).otherwise(F.lit(0.0))


def basis(max_lag: int = 90) -> list[Column]:
    """(mid, spread_pct, lag_seconds, reliable, basis) of a quote against a feed price."""
    mid = (F.col("bid") + F.col("ask")) / 2
    lag = F.abs(_seconds(F.col("quote_time"), F.col("bar_close")))
    good = lag <= max_lag
    return [mid.alias("mid"), spread_pct().alias("spread_pct"), lag.alias("lag_seconds"), good.alias("reliable"), F.when(good, mid - F.col("feed_price")).alias("basis")]


def external_direction() -> Column:
    return F.create_map(*[F.lit(x) for kv in EXTERNAL.items() for x in kv])[F.col("direction")]


def estimate_cost(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """calls(model, tokens_in, tokens_out) with cost: the model's price by exact name, else by
    the first listed prefix, rounded to 6; null without a price."""
    cost = F.lit(None).cast("double")
    for base, (pin, pout) in reversed(list(prices.items())):
        cost = F.when(F.col("model").startswith(base), F.coalesce("tokens_in", F.lit(0)) * pin + F.coalesce("tokens_out", F.lit(0)) * pout).otherwise(cost)
    for name, (pin, pout) in prices.items():
        cost = F.when(F.col("model") == name, F.coalesce("tokens_in", F.lit(0)) * pin + F.coalesce("tokens_out", F.lit(0)) * pout).otherwise(cost)
    return calls.withColumn("cost", round_to(cost, 6))


def attempt_estimate(chars: str, price_in: float, price_out: float, max_tokens: int) -> Column:
    """Reserved cost of an attempt: four characters a token and a fifth more, all output
    tokens, and a quarter of the input again for the cache."""
    tokens = F.floor(F.col(chars) / 4 * 1.2)
    return round_to(tokens * price_in + F.lit(max_tokens * price_out) + tokens * price_in * 0.25, 6)
