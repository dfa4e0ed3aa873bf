"""Open slots of gaps by spans of days against looking at every slot."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barcraft.functions.market_calendar import CALENDARS, EVENTS_CALENDAR, SessionCalendar, any_open
from barcraft.operators.simulate import missed_open_bars

ODD = SessionCalendar("odd", 3, 20, 5, tz="Australia/Sydney", exceptions={"2026-04-05": 11, "2026-10-04": "closed", "2026-05-03": 4})


def gaps(seed):
    """Gaps of minutes, of days over changes of the clock and holidays, and of years."""
    rng, out = random.Random(seed), []
    for days in (0.02, 0.3, 2, 9, 40):
        for _ in range(40):
            a = datetime(2023, 12, 28) + timedelta(seconds=rng.randrange(86_400 * 1000))
            out.append((a, a + timedelta(seconds=rng.randrange(int(days * 86_400)) - 60)))
    out += [(datetime(2026, 3, 6), datetime(2026, 3, 11)), (datetime(2026, 7, 1), datetime(2026, 7, 5)), (datetime(2024, 1, 1), datetime(2026, 12, 31)), (None, datetime(2026, 1, 1)), (datetime(2026, 1, 1), None)]
    return out


@pytest.mark.parametrize("calendar", [CALENDARS["polygon"], CALENDARS["xtb"], EVENTS_CALENDAR, ODD])
@pytest.mark.parametrize("step", [15, 60, 240, 1440])
def test_open_slots_of_gaps(spark, calendar, step):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(gaps(step))], "i long, a timestamp_ntz, b timestamp_ntz").repartition(4)
    slots = F.expr(f"CASE WHEN a < b THEN size(filter(sequence(a, b - interval 1 microsecond, interval {step} minutes), t -> {calendar.is_open_sql('t')})) ELSE 0 END")
    inside = f"b >= a + interval {2 * step} minutes"
    between = f"sequence(a + interval {step} minutes, b - interval {step} minutes, interval {step} minutes)"
    missed = F.expr(f"CASE WHEN a IS NULL OR b IS NULL OR NOT ({inside}) THEN 0 ELSE size(filter({between}, t -> {calendar.is_open_sql(f'(t - interval {step} minutes)')})) END")
    counted = F.expr(calendar.open_slots_sql("a", "b", f"({step} * 60000000L)"))
    rows = df.select("i", slots.alias("want"), counted.alias("got"), any_open(calendar, "a", "b", step).alias("any"), missed.alias("want_missed"), missed_open_bars("a", "b", calendar, step).alias("missed")).collect()
    assert len(rows) == 205
    for r in rows:
        assert (r.got or 0, r.any, r.missed) == (r.want or 0, (r.want or 0) > 0, r.want_missed), r
    assert any(r.want == 0 for r in rows) and max(r.got or 0 for r in rows) > (10_000 if step == 15 else 100)
