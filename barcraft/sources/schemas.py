"""Declared schemas: nothing is inferred."""

from __future__ import annotations

BAR = "open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double, volume double"
AGGREGATE_PAGE = "ticker string, status string, next_url string, results array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double>>"
CANDLE = "struct<time: bigint, open: double, high: double, low: double, close: double, volume: double>"
NEWS = "source string, external_id string, revision int, publication_time timestamp_ntz, first_seen_at timestamp_ntz, headline string, impact string"
RELEASES = "release_dates array<struct<release_id: bigint, release_name: string, date: string>>"

#: Timeframes and their length in minutes; the grid is anchored at the epoch.
TIMEFRAMES = {"1min": 1, "15min": 15, "1h": 60, "4h": 240, "1day": 1440}
#: Timeframes whose bars must open on the grid.
GRID_CHECKED = ("1min", "15min", "1h")


def minutes(tf: str) -> int:
    if tf not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {tf!r}")
    return TIMEFRAMES[tf]
