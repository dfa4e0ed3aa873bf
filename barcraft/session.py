"""A SparkSession set up for the engine: UTC, adaptive execution, Arrow transfer."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "barcraft", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started: they get its
    folder in PYTHONPATH.  On a cluster the package is on the workers or goes with --py-files."""
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}" if known else root


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's spark.checkpoint.dir, else the
    context's checkpoint folder, else, on a local master only, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="barcraft-shared-")
        spark.conf.set("spark.checkpoint.dir", _own[app])
    return _own[app]


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of disposable tables, if it can."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; the folder is disposable
        pass


def passing_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one that goes when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove_path, spark, path)
    return path


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for a while; the former ones come back."""
    former = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in former.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
