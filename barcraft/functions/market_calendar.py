"""Session calendars as column expressions: local rules, daylight saving, dated exceptions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPECTED, UNEXPECTED = "expected_session_gap", "unexpected_missing_bar"


@dataclass(frozen=True)
class SessionCalendar:
    """The week opens on Sunday at ``open_hour`` and closes on Friday at ``close_hour``
    local time, with an hour's break from ``break_hour`` on other days.  ``exceptions`` maps
    local dates to ``"closed"`` or to the hour of an early close.

    ``is_open`` applies the rules in this order: exception, Saturday, Sunday (which has no
    break), Friday close, break."""

    version: str
    open_hour: int
    close_hour: int
    break_hour: int
    tz: str = "America/New_York"
    exceptions: dict[str, str | int] = field(default_factory=dict)

    def _rules(self, day: str, weekday: str, hour: str) -> str:
        """SQL over names of the local date text, the weekday (Monday 0) and the hour."""
        cases = []
        for d, rule in sorted(self.exceptions.items()):
            cases.append(f"WHEN {day} = '{d}'" + ("" if rule == "closed" else f" AND {hour} >= {rule}") + " THEN false")
        cases += [
            f"WHEN {weekday} = 5 THEN false",
            f"WHEN {weekday} = 6 THEN {hour} >= {self.open_hour}",
            f"WHEN {weekday} = 4 AND {hour} >= {self.close_hour} THEN false",
            f"WHEN {hour} = {self.break_hour} THEN false",
        ]
        return f"CASE {' '.join(cases)} ELSE true END"

    def is_open_sql(self, ts: str) -> str:
        """Spark SQL text for a UTC timestamp_ntz expression."""
        local = f"convert_timezone('UTC', '{self.tz}', {ts})"
        return self._rules(f"date_format({local}, 'yyyy-MM-dd')", f"weekday({local})", f"hour({local})")

    def is_open(self, ts: Column | str) -> Column:
        """Whether the market is open at a UTC timestamp_ntz column; null for null."""
        column = F.col(ts) if isinstance(ts, str) else ts
        local = F.convert_timezone(F.lit("UTC"), F.lit(self.tz), column)
        day, weekday, hour = F.date_format(local, "yyyy-MM-dd"), F.weekday(local), F.hour(local)
        out = F.when(column.isNull(), F.lit(None).cast("boolean"))
        for d, rule in sorted(self.exceptions.items()):
            out = out.when((day == d) if rule == "closed" else (day == d) & (hour >= rule), F.lit(False))
        out = out.when(weekday == 5, F.lit(False)).when(weekday == 6, hour >= self.open_hour)
        return out.when((weekday == 4) & (hour >= self.close_hour), F.lit(False)).when(hour == self.break_hour, F.lit(False)).otherwise(F.lit(True))

    def open_slots_sql(self, after: str, before: str, step: str) -> str:
        """Spark SQL text of the number of instants after, after + step, ... before ``before`` (UTC
        timestamp_ntz; step: SQL of microseconds) at which the market is open.

        A local day has at most two open spans, and how many instants fall into a span is a
        difference of two quotients: a gap costs its days, not its slots."""
        cap = "".join(f" WHEN date_format(d, 'yyyy-MM-dd') = '{d}' THEN {0 if rule == 'closed' else rule}" for d, rule in sorted(self.exceptions.items()))
        cap = f"CASE{cap} ELSE 24 END" if cap else "24"
        first = f"CASE weekday(d) WHEN 5 THEN 0 WHEN 6 THEN 24 WHEN 4 THEN {min(self.break_hour, self.close_hour)} ELSE {self.break_hour} END"
        second = f"CASE weekday(d) WHEN 5 THEN 0 WHEN 6 THEN 0 WHEN 4 THEN {self.close_hour} ELSE 24 END"
        us = lambda t: f"unix_micros(cast({t} as timestamp))"
        number = lambda x: f"greatest(0L, cast(ceil(({x} - {us(after)}) / {step}) as bigint))"
        at = lambda hour: number(us(f"convert_timezone('{self.tz}', 'UTC', cast(d as timestamp_ntz) + make_dt_interval(0, {hour}))"))
        until = number(us(before))
        span = lambda lo, hi: f"greatest(0L, least({at(f'least({hi}, {cap})')}, {until}) - {at(lo)})"
        local = lambda t: f"cast(convert_timezone('UTC', '{self.tz}', {t}) as date)"
        opens = f"CASE weekday(d) WHEN 6 THEN {self.open_hour} ELSE 0 END"
        each = f"{span(opens, first)} + {span(str(self.break_hour + 1), second)}"
        days = f"sequence({local(after)}, {local(before)}, interval 1 day)"
        return f"CASE WHEN {after} < {before} THEN aggregate({days}, 0L, (n, d) -> n + {each}) ELSE 0L END"

    def duckdb(self, ts: str) -> str:
        """The same rule for DuckDB."""
        local = f"(({ts}) AT TIME ZONE 'UTC') AT TIME ZONE '{self.tz}'"
        return self._rules(f"strftime({local}, '%Y-%m-%d')", f"(isodow({local}) - 1)", f"hour({local})")


#: Confirmed boundaries of each provider (fixed values).
_GENERAL = SessionCalendar("general-2026.1", 17, 17, 17, exceptions={"2026-07-03": 14})
_BROKER = SessionCalendar("broker-2026.1", 18, 17, 17, exceptions={"2026-07-03": 13})
CALENDARS = {"polygon": _GENERAL, "csv": _GENERAL, "xtb": _BROKER}
#: A calendar for the January 2024 events: as the general one, with a holiday and an early close.
EVENTS_CALENDAR = SessionCalendar("events-2024.1", 17, 17, 17, exceptions={"2024-01-01": "closed", "2024-01-15": 14})


def calendar_for(provider: str) -> SessionCalendar:
    """The provider's calendar; unknown providers raise rather than get another's hours."""
    if provider not in CALENDARS:
        raise ValueError(f"no calendar for provider {provider!r}")
    return CALENDARS[provider]


def any_open(calendar: SessionCalendar, after: str, before: str, step_minutes: int | str) -> Column:
    """Whether a slot that opens in [after, before) is in session; the step is a number of
    minutes or the SQL of one; false for nulls."""
    return F.expr(f"coalesce({calendar.open_slots_sql(after, before, f'(({step_minutes}) * 60000000L)')} > 0, false)")


def with_calendar(df: DataFrame, ts: str, provider: str, name: str = "is_open") -> DataFrame:
    return df.withColumn(name, calendar_for(provider).is_open(ts))
