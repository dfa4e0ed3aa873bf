"""Tables that cut lineage, in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset on one machine
(tests) a folder of our own is made; on a cluster that is an error, since every executor would
write to its own disk.  A lost executor costs a re-read, not a recomputation, and an aborted
run leaves nothing that a later run would read: every scratch has a fresh name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barcraft.session import passing_folder, remove_path, shared_folder

#: Rows of an Arrow batch where the session names no number: documents may be long, and a
#: batch is held by the JVM and by the worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH_ROWS unless the session has a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def lasting_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for an operator's product beside the scratch tables; nothing here removes it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Written tables of one operator run.  A result may read from them lazily, so what it
    reads stays until the program ends; ``keep_only`` removes the rest at once."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = passing_folder(spark, name)
        small_batches(spark)
        self.names: list[str] = []

    def write(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        """Writes df and returns it as read back: no lineage beyond the files."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_only(self, *names: str) -> None:
        """Removes the tables that nothing will read again."""
        for name in set(self.names) - set(names):
            remove_path(self.spark, f"{self.path}/{name}")
        self.names = [n for n in self.names if n in names]


def open_folder(uri: str):
    """(filesystem, path) for files that Python workers write or read in the shared folder:
    any scheme that Arrow knows; a bare path is local."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), uri


def put_file(uri: str, write) -> None:
    """write(stream) to a name of its own, then moved to ``uri``: a reader never sees a part
    of a file, and a second attempt of the task replaces the first one's whole file."""
    store, path = open_folder(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with store.open_output_stream(own, compression=None) as stream:
        write(stream)
    store.move(own, path)
