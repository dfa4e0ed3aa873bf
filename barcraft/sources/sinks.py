"""Sinks that replace whole data sets at once.

``publish`` writes versions and names the current one by a file, so readers never find a gap;
``replace_table`` swaps a plain folder for those who can only read a fixed path.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from barcraft.session import passing_folder


def _move(store, source, target) -> None:
    """A rename that is known to have happened: the file system reports failure by its result."""
    if not store.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Writes beside ``path`` and swaps, so a job that reads ``path`` may write it.

    The old data is moved aside, the new data takes its name, and only then the old is
    deleted.  If the second rename fails, the old data gets its name back and the error is
    raised; if that fails too, the error names the folder that holds it.  Between the two
    renames, an instant, there is no table: directories can't be exchanged in one step."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.staging"
    df.write.format(fmt).options(**options).mode("errorifexists").save(staging)
    make = jvm.org.apache.hadoop.fs.Path
    target, fresh, old = make(path), make(staging), make(f"{staging}.old")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = store.exists(target)
    try:
        if had:
            _move(store, target, old)
        try:
            _move(store, fresh, target)
        except Exception as failed:
            if had:
                try:
                    _move(store, old, target)
                except Exception:
                    raise OSError(f"{path} could not be replaced; its data is in {old}") from failed
            raise
    except Exception:
        store.delete(fresh, True)
        raise
    if had:
        store.delete(old, True)


class WriteConflict(RuntimeError):
    """Another writer published, or is about to, since this one began."""


class _Versions:
    """The files of a published table: ``versions/<name>`` (data), ``claims/<n>`` (who may publish
    number n: created only if absent) and ``current/<n>.<name>`` (published: the number and the
    data's folder are the file's name, so it is there whole or not at all)."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark.sparkContext._jvm
        self.store = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def data(self, name: str) -> str:
        return f"{self.path}/versions/{name}"

    def _listed(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change in milliseconds) of a folder's entries, none if it is not there."""
        target = self._path(folder)
        if not self.store.exists(target):
            return []
        return [(f.getPath().getName(), f.getModificationTime()) for f in self.store.listStatus(target)]

    def published(self) -> list[tuple[int, str]]:
        """(number, version's name), the newest last."""
        return sorted((int(name.split(".", 1)[0]), name.split(".", 1)[1]) for name, _ in self._listed("current"))

    def claimed(self) -> list[tuple[int, int]]:
        return sorted((int(name), at) for name, at in self._listed("claims"))

    def _create(self, name: str) -> bool:
        """Creates an empty file unless there is one; the file system decides between two."""
        target = self._path(name)
        if self.store.getScheme() == "file":  # Hadoop's local file system looks first and then creates
            self.store.mkdirs(target.getParent())
            local = self.jvm.java.io.File(target.toUri().getPath())
            return local.createNewFile()
        try:
            self.store.create(target, False).close()
            return True
        except Exception:
            if self.store.exists(target):
                return False
            raise

    def claim(self, number: int) -> None:
        if not self._create(f"claims/{number:012d}"):
            raise WriteConflict(f"another writer publishes number {number} of {self.path}")

    def name(self, number: int, version: str) -> None:
        self._create(f"current/{number:012d}.{version}")

    def remove(self, name: str) -> None:
        self.store.delete(self._path(name), True)


def publish(df: DataFrame, path: str, fmt: str = "parquet", lease_seconds: float = 600, **options: str) -> int:
    """Writes df as the next version of the table at ``path`` and returns its number.

    Readers see the former version whole until this one is published, and then this one.  The data
    may come from the table itself.  Of two writers that began from the same version one publishes
    and the other raises WriteConflict and leaves nothing; so does one that meets a claim that is not
    yet ``lease_seconds`` old.  An older claim without its version is a writer that died: its number
    is skipped."""
    files = _Versions(df.sparkSession, path)
    began, claims = files.published(), files.claimed()
    last = began[-1][0] if began else 0
    pending = [(n, at) for n, at in claims if n > last]
    if any(time.time() * 1000 - at < lease_seconds * 1000 for _, at in pending):
        raise WriteConflict(f"another writer is about to publish {path}")
    number, version = max([last, *(n for n, _ in pending)]) + 1, uuid.uuid4().hex
    df.write.format(fmt).options(**options).mode("errorifexists").save(files.data(version))
    try:
        now = files.published()
        if (now[-1][0] if now else 0) != last:
            raise WriteConflict(f"{path} was published by another writer")
        files.claim(number)
    except Exception:
        files.remove(f"versions/{version}")
        raise
    files.name(number, version)
    return number


def read_published(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """The current version of a published table; FileNotFoundError where none was published.
    The frame goes on reading that version while others are published."""
    files = _Versions(spark, path)
    found = files.published()
    if not found:
        raise FileNotFoundError(f"{path} has no published version")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(files.data(found[-1][1]))


def expire(spark: SparkSession, path: str, keep: int = 2, lease_seconds: float = 600) -> int:
    """Removes all but the newest ``keep`` versions and what writers that died left ``lease_seconds``
    ago; returns how many versions went.  Readers of older versions must be done."""
    files = _Versions(spark, path)
    found = files.published()
    stay = {version for _, version in found[max(len(found) - max(keep, 1), 0) :]}
    gone = 0
    for name, at in files._listed("versions"):
        done = any(name == version for _, version in found)
        if name not in stay and (done or time.time() * 1000 - at > lease_seconds * 1000):
            files.remove(f"versions/{name}")
            gone += 1
    for number, version in found:
        if version not in stay:
            files.remove(f"current/{number:012d}.{version}")
            files.remove(f"claims/{number:012d}")
    return gone


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder, read back: what several branches of a plan
    use is made once, and a lost executor costs a re-read.  It goes when the program ends."""
    path = passing_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_archive(bars: DataFrame, path: str) -> None:
    """A bar archive as CSV with header, ascending by open_time."""
    replace_table(bars.select("open_time", "close_time", "open", "high", "low", "close", "volume").orderBy("open_time"), path, "csv", header="true")
