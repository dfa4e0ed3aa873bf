"""The paged data source: chains, offsets, filters, streams, and archives of several files."""

from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barcraft.sources import pages, readers
from tests.conftest import rows_of

DAY = 86_400_000


def bar(t, c=1.5):
    return {"t": t, "o": 1, "h": 2, "l": 0.5, "c": c, "v": None}


def put(folder, name, document):
    os.makedirs(f"{folder}/{name}", exist_ok=True)
    with open(f"{folder}/{name}/page.json", "w") as f:
        f.write(document if isinstance(document, str) else json.dumps(document, indent=1))


def chain(folder, symbol="X", days=(1, 2, 3), **changes):
    """A page a day, each naming the next; changes: page number -> fields."""
    for i, d in enumerate(days):
        following = f"https://host/v2/symbol={symbol}/day={days[i + 1]}?cursor=a" if i + 1 < len(days) else None
        page = {"ticker": symbol, "status": "OK", "next_url": following, "results": [bar(d * DAY), bar(d * DAY + 900_000)]}
        put(folder, f"symbol={symbol}/day={d}", page | changes.get(f"p{i}", {}))


def read(spark, folder, **options):
    return pages.read_pages(spark, "aggregate_pages", str(folder), tf="15min", **options)


def test_rows_of_a_chain(spark, tmp_path):
    chain(tmp_path)
    chain(tmp_path, "Y", (2, 5), p1={"status": "DELAYED"})
    (tmp_path / "_SUCCESS").write_text("x")
    got = read(spark, tmp_path, pages_a_task="2")
    assert got.count() == 10 and got.where("symbol = 'Y'").agg(F.max("open_time")).first()[0] == datetime(1970, 1, 6, 0, 15)
    assert {r.volume for r in got.collect()} == {0.0} and got.select(F.spark_partition_id()).distinct().count() == 3


@pytest.mark.parametrize(
    ("changes", "says"),
    [
        ({"p1": {"status": "ERROR"}}, "refused status"), ({"p1": {"status": None}}, "refused status"), ({"p0": {"next_url": None}}, "2 chains"), ({"p2": {"next_url": "symbol=X/day=9"}}, "not there"),
        ({"p2": {"next_url": "symbol=X/day=1"}}, "not later"), ({"p1": {"next_url": "symbol=X/day=2"}}, "not later"), ({"p0": {"next_url": "symbol=X/day=3"}}, "next of 2"), ({"p1": {"results": []}}, "not later"), ({"p2": {"next_url": "symbol=Y/day=8"}}, "another ticker"),
    ],
)
def test_broken_chains_are_refused(spark, tmp_path, changes, says):
    chain(tmp_path, **changes)
    chain(tmp_path, "Y", (8,))
    with pytest.raises(ValueError, match=says):
        read(spark, tmp_path)


def test_unwanted_pages_are_not_opened(spark, tmp_path):
    """Pages of other symbols hold what can't be read; rows are chosen by time at both ends."""
    chain(tmp_path)
    put(tmp_path, "symbol=Z/day=1", "no json at all")
    got = read(spark, tmp_path, symbols=["X"], since="1970-01-02 00:15:00", until="1970-01-04")
    assert [str(r.open_time) for r in got.orderBy("open_time").collect()] == ["1970-01-02 00:15:00", "1970-01-03 00:00:00", "1970-01-03 00:15:00", "1970-01-04 00:00:00"]
    with pytest.raises(Exception, match="not JSON"):
        read(spark, tmp_path, check=False).collect()
    assert read(spark, tmp_path, symbols=["none"]).count() == 0


def test_a_frame_can_be_used_with_several_filters(spark, tmp_path):
    chain(tmp_path)
    chain(tmp_path, "Y", (2, 5))
    got = read(spark, tmp_path)
    assert [got.count(), got.where("symbol = 'Y'").count(), got.where("open_time > timestamp_ntz'1970-01-04'").count(), got.count()] == [10, 4, 3, 10]


def test_no_pages(spark, tmp_path):
    assert read(spark, tmp_path).count() == 0 and read(spark, tmp_path / "none").count() == 0


def test_release_pages_follow_each_other(spark, tmp_path):
    page = lambda i, n, total=5: {"count": total, "offset": i, "limit": n, "release_dates": [{"release_id": 1, "release_name": f"r{i + k}", "date": "2026-03-04"} for k in range(n)]}
    for name, i, n in (("a", 0, 2), ("b", 2, 2), ("c", 4, 1), ("d", 5, 0)):
        put(tmp_path, f"page={name}", page(i, n))
    got = pages.read_pages(spark, "release_pages", str(tmp_path))
    assert sorted(r.release_name for r in got.collect()) == [f"r{i}" for i in range(5)]
    for name, i, n, total, says in (("b", 3, 1, 5, "none ends"), ("b", 2, 1, 5, "none ends"), ("c", 4, 0, 5, "4 rows"), ("e", 0, 2, 5, "7 rows")):
        other = tmp_path / f"{name}{i}{n}"
        for k, j, m in (("a", 0, 2), ("b", 2, 2), ("c", 4, 1)):
            put(other, f"page={k}", page(j, m))
        put(other, f"page={name}", page(i, n, total))
        with pytest.raises(ValueError, match=says):
            pages.read_pages(spark, "release_pages", str(other))
    put(tmp_path, "page=z", {"count": 5})
    with pytest.raises(Exception, match="release_dates"):
        pages.read_pages(spark, "release_pages", str(tmp_path))


def test_new_pages_come_once_each(spark, tmp_path):
    """A stream that is stopped and started again goes on where it was, whatever pages are called."""
    source, seen = tmp_path / "pages", []

    def run():
        stream = pages.stream_pages(spark, "aggregate_pages", str(source), tf="15min")
        q = stream.writeStream.foreachBatch(lambda df, _: seen.append(sorted({r.symbol for r in df.collect()}))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    chain(source, "M", (1, 2))
    run()
    run()
    chain(source, "A", (1,))
    chain(source, "Z", (4,))
    run()
    assert [s for s in seen if s] == [["M"], ["A", "Z"]]


def test_the_last_duplicate_wins_by_file_and_line(spark, tmp_path):
    """Files of an archive count in the order of their names, however large they are."""
    head = "open_time,close_time,open,high,low,close,volume\n"
    line = lambda k, c: f"2026-01-01 00:{k:02d}:00,2026-01-01 00:15:00,1,2,0.5,{c},1\n"
    (tmp_path / "a.csv").write_text(head + "".join(line(k % 60, 1) for k in range(5000)))
    (tmp_path / "b.csv").write_text(head + line(0, 2))
    (tmp_path / "c.csv").write_text(head + line(1, 3) + line(1, 4))
    got = {r.open_time.minute: r.close for r in readers.read_archive(spark, str(tmp_path)).collect()}
    assert got == {k: {0: 2.0, 1: 4.0}.get(k, 1.0) for k in range(60)}


def test_scans_by_symbol_keep_their_rows(spark, tmp_path):
    texts = spark.createDataFrame([("X", '{"candles": [{"time": 0, "open": 1, "high": 2, "low": 0.5, "close": 1.5}]}'), ("Y", '[{"time": 900, "open": 1, "high": 2, "low": 0.5, "close": 1.5, "volume": 3}]')], "symbol string, x string")
    assert [(r[0], r[-1]) for r in readers.parse_candles(texts, "x", F.col("symbol"), "15min").orderBy("symbol").collect()] == [("X", 0.0), ("Y", 3.0)]
    assert rows_of(readers.parse_candles(texts.where("symbol = 'X'"), "x", "Q", "15min"))


def test_counts_come_from_footers(spark, sf_dir, tmp_path):
    """No column is read, the session's settings come back, and tables of many files add up."""
    from barcraft.sources import footers

    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.range(1000).repartition(7).write.parquet(f"{tmp_path}/many")
    spark.range(0).write.parquet(f"{tmp_path}/none")
    got = footers.row_counts(spark, {"events": f"{sf_dir}/events.parquet", "many": f"{tmp_path}/many", "none": f"{tmp_path}/none"})
    assert {r.name: r.n for r in got.collect()} == {"events": spark.read.parquet(f"{sf_dir}/events.parquet").count(), "many": 1000, "none": 0}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    with footers.settings(spark, **footers._FROM_FOOTERS):
        plan = footers.counted(spark, f"{tmp_path}/many")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<count(*):bigint>" in plan
