"""Readers and sinks over small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from barcraft.sources import readers, sinks
from tests.test_series import make_bars

HEAD = "open_time,close_time,open,high,low,close,volume\n"
LINES = ["2026-01-01T00:00:00+00:00,2026-01-01T00:15:00+00:00,1,2,0.5,1.5,", "2026-01-01T00:15:00+00:00,2026-01-01T00:30:00+00:00,1.5,2,1,1.8,3"]


def test_csv_fills_volume_and_takes_the_tail(spark, tmp_path):
    path = tmp_path / "X_15min.csv"
    path.write_text(HEAD + "\n".join(LINES) + "\n")
    b = readers.read_bar_csv(spark, str(path), "X", "15min").orderBy("open_time").collect()
    assert [r["volume"] for r in b] == [0.0, 3.0] and b[0]["open_time"].minute == 0
    assert readers.read_bars(spark, "csv", str(path), "X", "15min", 1).first()["close"] == 1.8


def test_unsorted_csv_raises(spark, tmp_path):
    path = tmp_path / "X_15min.csv"
    path.write_text(HEAD + "\n".join(LINES[::-1]) + "\n")
    with pytest.raises(ValueError, match="not sorted"):
        readers.read_bar_csv(spark, str(path), "X", "15min")


def test_missing_archive_is_empty_and_the_last_duplicate_wins(spark, tmp_path):
    assert readers.read_archive(spark, str(tmp_path / "none.csv")).count() == 0
    path = tmp_path / "a.csv"
    path.write_text(HEAD + LINES[0] + "\n" + LINES[0].replace(",1,2,", ",1,9,") + "\n")
    assert [r["high"] for r in readers.read_archive(spark, str(path)).collect()] == [9.0]


def test_archive_round_trip_may_replace_its_source(spark, tmp_path):
    path = str(tmp_path / "archive")
    sinks.write_archive(make_bars(spark, [1.0, 2.0, 3.0]), path)
    old = readers.read_archive(spark, path)
    sinks.write_archive(old.where("close < 3"), path)
    assert readers.read_archive(spark, path).count() == 2


def page(bars, following=None, status="OK"):
    return {"ticker": "X", "status": status, "results": [{"t": t, "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 1.0} for t in bars]} | ({"next_url": following} if following else {})


def test_aggregate_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps(page([1767225600000, 1767226500000], "next")))
    (tmp_path / "2.json").write_text(json.dumps(page([1767227400000])))
    b = readers.read_aggregates(spark, str(tmp_path), "X", "15min").orderBy("open_time").collect()
    assert len(b) == 3 and (b[0]["close_time"] - b[0]["open_time"]).seconds == 900


def test_refused_and_partial_pages_raise(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps(page([1], status="ERROR")))
    with pytest.raises(ValueError, match="refused"):
        readers.read_aggregates(spark, str(tmp_path), "X", "15min")
    (tmp_path / "1.json").write_text(json.dumps(page([1], "next")))
    with pytest.raises(ValueError, match="before the last"):
        readers.read_aggregates(spark, str(tmp_path), "X", "15min")


def test_candles_in_an_envelope_or_bare(spark):
    c = '{"time": 1767225600, "open": 1, "high": 2, "low": 0.5, "close": 1.5}'
    texts = spark.createDataFrame([('{"candles": [' + c + "]}",), ("[" + c + "]",)], "x string")
    assert readers.parse_candles(texts, "x", "X", "15min").count() == 2


def test_news_without_first_seen_raises(spark, tmp_path):
    path = tmp_path / "n.json"
    path.write_text(json.dumps({"source": "s", "external_id": "1", "revision": 0, "publication_time": "2026-01-01 00:00:00"}) + "\n")
    with pytest.raises(ValueError, match="first_seen_at"):
        readers.read_news(spark, str(path))
    assert readers.read_news(spark, str(path), False).count() == 1


def test_releases(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"release_dates": [{"release_id": 1, "release_name": "Gross Domestic Product", "date": "2026-01-29"}]}))
    assert readers.read_releases(spark, str(path)).select(F.year("day")).first()[0] == 2026


def test_a_failing_rename_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3).toDF("x"), path)
    real, calls = sinks._move, []

    def second_fails(store, source, target):
        calls.append(str(target))
        if len(calls) == 2:
            raise OSError("refused")
        real(store, source, target)

    monkeypatch.setattr(sinks, "_move", second_fails)
    with pytest.raises(OSError, match="refused"):
        sinks.replace_table(spark.range(9).toDF("x"), path)
    assert spark.read.parquet(path).count() == 3 and len(calls) == 3
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []

    def first_fails(store, source, target):
        raise OSError("refused")

    monkeypatch.setattr(sinks, "_move", first_fails)
    with pytest.raises(OSError, match="refused"):
        sinks.replace_table(spark.range(9).toDF("x"), path)
    assert spark.read.parquet(path).count() == 3
    monkeypatch.setattr(sinks, "_move", real)
    sinks.replace_table(spark.range(9).toDF("x"), path)
    assert spark.read.parquet(path).count() == 9


def test_a_rename_that_says_no_is_an_error():
    from types import SimpleNamespace

    with pytest.raises(OSError, match="could not rename"):
        sinks._move(SimpleNamespace(rename=lambda a, b: False), "a", "b")


def long_csv(path, n, swap=None):
    lines = [f"2026-01-{1 + i // 1440:02}T{i // 60 % 24:02}:{i % 60:02}:00+00:00,2026-01-{1 + i // 1440:02}T{i // 60 % 24:02}:{i % 60:02}:59+00:00,1,2,0.5,1.5,1" for i in range(n)]
    if swap is not None:
        lines[swap], lines[swap + 1] = lines[swap + 1], lines[swap]
    path.write_text(HEAD + "\n".join(lines) + "\n")


def test_sortedness_is_seen_in_and_between_splits(spark, tmp_path):
    path = tmp_path / "X_1min.csv"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        long_csv(path, 200)
        assert readers.read_bar_csv(spark, str(path), "X", "1min").count() == 200
        for swap in range(0, 199, 9):
            long_csv(path, 200, swap)
            with pytest.raises(ValueError, match="not sorted"):
                readers.read_bar_csv(spark, str(path), "X", "1min")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_candles_static_and_registered_formats(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"candles": [{"time": 1767225600 + 900 * i, "open": 1, "high": 2, "low": 0.5, "close": 1.5 + i} for i in range(3)]}, indent=1))
    assert readers.read_bars(spark, "candles", str(tmp_path / "c.json"), "X", "15min", 1).first()["close"] == 3.5
    held = make_bars(spark, [1.0, 2.0]).unionByName(make_bars(spark, [9.0], symbol="Y"))
    assert readers.read_bars(spark, "static", held, "X", "15min").count() == 2
    readers.register_bar_format("test_only", lambda spark, source, symbol, tf: source)
    try:
        assert readers.read_bars(spark, "test_only", held, "X", "15min").count() == 3
        with pytest.raises(ValueError, match="taken"):
            readers.register_bar_format("test_only", None)
    finally:
        del readers.BAR_FORMATS["test_only"]


def test_unknown_format_raises(spark):
    with pytest.raises(ValueError, match="unknown bar format"):
        readers.read_bars(spark, "tape", "x", "X", "15min")
