"""Published versions: no gap for readers, one winner among writers."""

from __future__ import annotations

import threading
import time

import pytest

from barcraft.sources import sinks


def table(spark, k, n=50):
    return spark.range(n).selectExpr("id", f"{k} AS version").repartition(3)


def test_readers_never_find_a_gap(spark, tmp_path):
    """A reader in a loop sees whole versions, none older than one before, while a writer publishes."""
    path, seen, failed, stop = f"file://{tmp_path}/t", [], [], threading.Event()
    sinks.publish(table(spark, 1), path)

    def read():
        while not stop.is_set():
            try:
                rows = sinks.read_published(spark, path).groupBy("version").count().collect()
                seen.append([(r.version, r["count"]) for r in rows])
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(2, 7):
        assert sinks.publish(table(spark, k), path) == k
        time.sleep(0.3)
    stop.set()
    reader.join()
    assert not failed and all(len(s) == 1 and s[0][1] == 50 for s in seen)
    versions = [s[0][0] for s in seen]
    assert versions == sorted(versions) and len(set(versions)) > 2


def test_one_of_two_writers_wins(spark, tmp_path):
    path, results, both = f"file://{tmp_path}/t", [], threading.Barrier(2)
    sinks.publish(table(spark, 0), path)

    def write(k):
        both.wait()
        try:
            results.append(("won", k, sinks.publish(table(spark, k), path)))
        except sinks.WriteConflict:
            results.append(("lost", k, None))

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r[0] for r in results) == ["lost", "won"]
    winner = next(r[1] for r in results if r[0] == "won")
    assert {r.version for r in sinks.read_published(spark, path).collect()} == {winner}
    assert len(list((tmp_path / "t" / "versions").iterdir())) == 2


def test_a_table_may_be_replaced_by_a_part_of_itself(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.publish(table(spark, 1), path)
    old = sinks.read_published(spark, path)
    sinks.publish(old.where("id < 10"), path)
    assert sinks.read_published(spark, path).count() == 10 and old.count() == 50


def test_claims_of_dead_writers_expire(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.publish(table(spark, 1), path)
    sinks._Versions(spark, path).claim(2)
    with pytest.raises(sinks.WriteConflict):
        sinks.publish(table(spark, 2), path)
    assert sinks.publish(table(spark, 2), path, lease_seconds=0) == 3
    assert {r.version for r in sinks.read_published(spark, path).collect()} == {2}


def test_old_versions_go_later(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for k in range(4):
        sinks.publish(table(spark, k), path)
    assert sinks.expire(spark, path, keep=2) == 2 and sinks.expire(spark, path, keep=2) == 0
    assert {r.version for r in sinks.read_published(spark, path).collect()} == {3}
    assert sinks.publish(table(spark, 9), path) == 5
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, f"{path}-none")
