"""Joins along time: as-of, interval, horizon and revision views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcraft.operators.segments import SLICE_MINUTES, running


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """Each left row with the latest right row whose time is not after its own (null columns
    if none).  The two sides are stacked and the last right row is carried forward, in slices of
    time, so no key is one task; ties count as known."""
    payload = [c for c in right.columns if c not in by]
    a = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[c for c in left.columns if c not in by]).alias("__left"), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("__right"))
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.struct(*payload).alias("__right"))
    carried = running(a.unionByName(b), by, "__t", ["__side"], last=["__right"], slice_minutes=slice_minutes).where("__side = 1")
    return carried.select(*by, *[F.col(f"__left.{c}").alias(c) for c in left.columns if c not in by], *[F.col(f"__right.{c}").alias(c) for c in payload])


def visible(news: DataFrame, as_of: str) -> DataFrame:
    """Rows both published and seen by ``as_of``."""
    t = F.lit(as_of).cast("timestamp_ntz")
    return news.where((F.col("publication_time") <= t) & (F.col("ingestion_time") <= t))


def latest_revisions(news: DataFrame, as_of: str) -> DataFrame:
    """Of the visible rows of each item the one of the highest revision."""
    w = Window.partitionBy("source", "external_id").orderBy(F.desc("revision"), F.desc("ingestion_time"), F.desc("publication_time"))
    return visible(news, as_of).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _shift(ts: Column, minutes: int) -> Column:
    return ts + F.expr(f"interval {minutes} minutes")


def blackout(instants: DataFrame, events: DataFrame, before: int, after: int, impacts: tuple[str, ...] = ("high",)) -> DataFrame:
    """instants(as_of, ...) with the first event of such an impact whose window
    [at - before, at + after] holds as_of (null if none).

    Events are cut into hour buckets that their windows touch, so the join is an equi-join
    on the bucket: no event table size makes it a nested loop."""
    hour = lambda c: F.date_trunc("hour", c.cast("timestamp")).cast("timestamp_ntz")
    lo, hi = _shift(F.col("scheduled_at"), -before), _shift(F.col("scheduled_at"), after)
    windows = events.where(F.col("impact").isin(*impacts)).select("label", "scheduled_at", lo.alias("__lo"), hi.alias("__hi")).withColumn("__hour", F.explode(F.sequence(hour(F.col("__lo")), hour(F.col("__hi")), F.expr("interval 1 hour"))))
    keyed = instants.withColumns({"__id": F.monotonically_increasing_id(), "__hour": hour(F.col("as_of"))})
    first = Window.partitionBy("__id").orderBy("scheduled_at", "label")
    joined = keyed.join(windows, (keyed["__hour"] == windows["__hour"]) & F.col("as_of").between(F.col("__lo"), F.col("__hi")), "left").drop("__hour")
    return joined.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__id", "__lo", "__hi").withColumnsRenamed({"label": "event", "scheduled_at": "event_at"})


def upcoming(instants: DataFrame, events: DataFrame, horizon: int, most: int = 3) -> DataFrame:
    """(as_of, label, scheduled_at, nth, minutes_until): the next ``most`` events in
    (as_of, as_of + horizon]; halves of a minute go to the even one."""
    day = lambda c: F.date_trunc("day", c.cast("timestamp")).cast("timestamp_ntz")
    reach = instants.select("as_of").distinct().withColumn("__day", F.explode(F.sequence(day(F.col("as_of")), day(_shift(F.col("as_of"), horizon)), F.expr("interval 1 day"))))
    e = events.select("label", "impact", "scheduled_at", day(F.col("scheduled_at")).alias("__day"))
    near = reach.join(e, "__day").where((F.col("scheduled_at") > F.col("as_of")) & (F.col("scheduled_at") <= _shift(F.col("as_of"), horizon)))
    nth = F.row_number().over(Window.partitionBy("as_of").orderBy("scheduled_at", "label"))
    until = F.bround((F.unix_micros(F.col("scheduled_at").cast("timestamp")) - F.unix_micros(F.col("as_of").cast("timestamp"))) / 60_000_000).cast("long")
    return near.withColumn("nth", nth.cast("long")).where(F.col("nth") <= most).select("as_of", "label", "impact", "scheduled_at", "nth", until.alias("minutes_until"))


def event_digest(events: DataFrame) -> DataFrame:
    """``upcoming`` rows as a decision maker sees them: minutes, no absolute times."""
    return events.select("as_of", F.col("label").alias("event"), "impact", F.col("minutes_until").alias("in_minutes"))


def news_digest(news: DataFrame) -> DataFrame:
    """(id, revision, time, headline, impact, sentiment_for_gold) of news items; the time is an
    ISO text in UTC, with microseconds only where there are any."""
    t = F.col("publication_time")
    micros = F.unix_micros(t.cast("timestamp")) % 1_000_000
    iso = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != 0, F.date_format(t, ".SSSSSS")).otherwise(""), F.lit("+00:00"))
    return news.select(F.concat_ws(":", "source", "external_id").alias("id"), "revision", iso.alias("time"), "headline", "impact", "sentiment_for_gold")


def static_news(items: DataFrame, count: int, key: list[str], as_of: str | None = None) -> DataFrame:
    """The last ``count`` items of a held list (0: all).  With ``as_of`` the list is the
    decision view, newest first, so the last ones are the oldest; without it the items stand
    in the order of ``key``.  Ties of publication_time are in the order of ``key`` in the list."""
    if as_of is None:
        return items.orderBy(*[F.desc(k) for k in key]).limit(count) if count else items
    view = latest_revisions(items, as_of)
    return view.orderBy(F.asc("publication_time"), *[F.desc(k) for k in key]).limit(count) if count else view
