"""Paged answers of providers as a Spark data source: a page is a file, a partition some pages.

A page lies in a folder ``key=value/key=value`` under the source's folder; that relative path is
its name, which a ``next_url`` ends with.  ``read_pages`` checks that the pages hang together
before it gives out rows: aggregate pages form one chain a ticker, release pages follow each other
by offset.  As a stream the pages come as they were written: an offset is a page's time and name.

The driver lists names; pages are opened by tasks.  The options ``symbols`` (pages by their folder)
and ``since`` and ``until`` (rows, where they are read) keep from reading what is not wanted.  Filters
of a query are not taken over: in Spark 4.1.2 what one use of a frame pushes into a Python source
stays there for the frame's other uses.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from barcraft.sources.schemas import minutes

BARS = "symbol string, tf string, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double, volume double"
AGGREGATE_HEADERS = "page string, ticker string, status string, next_url string, n_rows long, first_time long, last_time long"
RELEASES = "release_name string, day date"
RELEASE_HEADERS = "page string, n_rows long, at long, total long"
#: Pages of a partition, unless the option ``pages_a_task`` says otherwise.
PAGES = 32

_EPOCH = datetime(1970, 1, 1)


def _open(path: str):
    """(filesystem, path): any scheme that Arrow knows; a bare path is local."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def page_files(path: str) -> list[tuple[int, str]]:
    """(time written in microseconds, relative path) of the pages, ascending; hidden and marker
    files are none."""
    from pyarrow import fs

    store, root = _open(path.rstrip("/"))
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = ((f.mtime_ns // 1000 if f.mtime_ns else 0, f.path[len(root.rstrip("/")) + 1 :]) for f in found if f.is_file and f.size)
    return sorted(f for f in files if not any(part[:1] in "._" for part in f[1].split("/")))


def _load(path: str, name: str) -> Iterator[tuple[str, dict]]:
    """(page's name, its document): one document a line, or one over the whole file."""
    store, root = _open(path.rstrip("/"))
    with store.open_input_stream(f"{root}/{name}") as stream:
        text = stream.read().decode()
    folder = name.rsplit("/", 1)[0] if "/" in name else name
    try:
        documents = [json.loads(text)]
    except ValueError:
        try:
            documents = [json.loads(line) for line in text.splitlines() if line.strip()]
        except ValueError as e:
            raise ValueError(f"page {name} is not JSON") from e
    for document in documents:
        yield folder, document


def _values(name: str) -> dict[str, str]:
    return dict(part.split("=", 1) for part in name.split("/")[:-1] if "=" in part)


@dataclass
class _Pages(InputPartition):
    names: list[str] = field(default_factory=list)

    def __hash__(self) -> int:
        return hash(tuple(self.names))


class _Rows:
    """What reading in a batch and as a stream share."""

    def __init__(self, options: dict[str, str], rows):
        self.path, self.options, self.rows = options["path"], dict(options), rows
        self.symbols = set(json.loads(options["symbols"])) if "symbols" in options else None
        us = lambda name, default: (datetime.fromisoformat(options[name]) - _EPOCH) // timedelta(microseconds=1) if name in options else default
        self.since, self.until = us("since", -(1 << 62)), us("until", 1 << 62)

    def wanted(self, names: list[str]) -> list[str]:
        """Pages whose folder names a symbol that is asked for, or none."""
        return names if self.symbols is None else [n for n in names if _values(n).get("symbol") in self.symbols | {None}]

    def _split(self, names: list[str]) -> list[_Pages]:
        size = int(self.options.get("pages_a_task", PAGES))
        return [_Pages(names[i : i + size]) for i in range(0, len(names), size)] or [_Pages([])]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        for name in partition.names:
            for page, document in _load(self.path, name):
                yield from self.rows(self, page, _values(name), document)


class _BatchReader(_Rows, DataSourceReader):
    """All pages that are there when the query is planned."""

    def partitions(self) -> list[_Pages]:
        return self._split(self.wanted([name for _, name in page_files(self.path)]))


class _StreamReader(_Rows, DataSourceStreamReader):
    """Pages as they are written.  A store whose clock is coarse may show a page after a later one
    of the same time: ``settle_seconds`` leaves pages so young for the next batch."""

    def initialOffset(self) -> dict:
        return {"time": 0, "page": ""}

    def latestOffset(self) -> dict:
        until = (time.time() - float(self.options.get("settle_seconds", 0))) * 1e6
        files = [f for f in page_files(self.path) if f[0] <= until]
        return {"time": files[-1][0], "page": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        begin, until = (start["time"], start["page"]), (end["time"], end["page"])
        return self._split(self.wanted([f[1] for f in page_files(self.path) if begin < f <= until]))


def _aggregate_bars(reader: _Rows, page: str, values: dict[str, str], document: dict) -> Iterator[tuple]:
    tf = reader.options["tf"]
    length = timedelta(minutes=minutes(tf))
    symbol = values.get("symbol") or document.get("ticker")
    if reader.symbols is not None and symbol not in reader.symbols:
        return
    for r in document.get("results") or ():
        us = int(r["t"]) * 1000
        if reader.since <= us <= reader.until:
            at = _EPOCH + timedelta(microseconds=us)
            yield symbol, tf, at, at + length, *(float(r[c]) for c in "ohlc"), float(r.get("v") or 0.0)


def _aggregate_headers(reader: _Rows, page: str, values: dict[str, str], document: dict) -> Iterator[tuple]:
    times = [int(r["t"]) for r in document.get("results") or ()]
    yield page, values.get("symbol") or document.get("ticker"), document.get("status"), document.get("next_url"), len(times), min(times, default=None), max(times, default=None)


def _release_days(reader: _Rows, page: str, values: dict[str, str], document: dict) -> Iterator[tuple]:
    for r in document["release_dates"]:
        yield r["release_name"], datetime.strptime(r["date"], "%Y-%m-%d").date()


def _release_headers(reader: _Rows, page: str, values: dict[str, str], document: dict) -> Iterator[tuple]:
    if "release_dates" not in document:
        raise ValueError(f"page {page} has no release_dates")
    yield page, len(document["release_dates"]), int(document.get("offset", 0)), int(document.get("count", len(document["release_dates"])))


class _PageSource(DataSource):
    """Options: path, tf (of bars), view (``rows`` or ``headers``), symbols (a JSON list), since, until
    (ISO times, both included), pages_a_task, settle_seconds."""

    views: dict = {}

    def schema(self) -> str:
        return self.views[self.options.get("view", "rows")][0]

    def reader(self, schema) -> _BatchReader:
        return _BatchReader(self.options, self.views[self.options.get("view", "rows")][1])

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options, self.views[self.options.get("view", "rows")][1])


class AggregatePages(_PageSource):
    """{"ticker", "status", "next_url", "results": [{"t" (epoch milliseconds), "o", "h", "l", "c", "v"}]}"""

    views = {"rows": (BARS, _aggregate_bars), "headers": (AGGREGATE_HEADERS, _aggregate_headers)}

    @classmethod
    def name(cls) -> str:
        return "aggregate_pages"


class ReleasePages(_PageSource):
    """{"count", "offset", "release_dates": [{"release_name", "date"}]}"""

    views = {"rows": (RELEASES, _release_days), "headers": (RELEASE_HEADERS, _release_headers)}

    @classmethod
    def name(cls) -> str:
        return "release_pages"


def register(spark: SparkSession) -> None:
    """Makes both sources known to the session."""
    for source in (AggregatePages, ReleasePages):
        spark.dataSource.register(source)


def check_chains(headers: DataFrame) -> None:
    """Raises unless the aggregate pages of each ticker form one chain: statuses are OK or
    DELAYED, each next page is there, of the same ticker and later, none is named twice, and only
    the first is not named.  Later pages hold later bars, so there can be no ring."""
    target = F.col("next_url").isNotNull()
    pages = headers.withColumn("next", F.when(target, F.regexp_extract("next_url", r"((?:[^/?#]+=[^/?#]+/?)+|[^/?#]+)/?(?:[?#].*)?$", 1)))
    pages = pages.withColumn("next", F.rtrim("next", F.lit("/")))
    after = pages.select(F.col("page").alias("next"), F.col("ticker").alias("next_ticker"), F.col("first_time").alias("next_time"))
    linked = pages.join(after, "next", "left")
    wrong = F.when(F.col("status").isNull() | ~F.col("status").isin("OK", "DELAYED"), "a refused status").when(target & F.col("next_ticker").isNull(), "a next page that is not there").when(
        target & (F.col("next_ticker") != F.col("ticker")), "a next page of another ticker").when(target & ~F.coalesce(F.col("next_time") > F.col("last_time"), F.lit(False)), "a next page that is not later")
    bad = linked.withColumn("wrong", wrong).where("wrong is not null").select("page", "wrong").first()
    if bad:
        raise ValueError(f"page {bad.page} has {bad.wrong}")
    twice = pages.where(target).groupBy("next").count().where("count > 1").first()
    if twice:
        raise ValueError(f"page {twice.next} is next of {twice['count']} pages")
    split = pages.groupBy("ticker").agg(F.count_if(~target).alias("ends")).where("ends <> 1").first()
    if split:
        raise ValueError(f"the pages of {split.ticker} are {split.ends} chains")


def check_offsets(headers: DataFrame) -> None:
    """Raises unless the release pages follow each other from offset 0 to their count: pages
    begin where others end, and sizes add up."""
    ends = headers.where("n_rows > 0").select((F.col("at") + F.col("n_rows")).alias("at")).unionByName(headers.sparkSession.range(1).select(F.lit(0).cast("long").alias("at")))
    loose = headers.where("n_rows > 0").join(ends, "at", "left_anti").first()
    if loose:
        raise ValueError(f"page {loose.page} begins at {loose['at']}, where none ends")
    sums = headers.agg(F.sum("n_rows").alias("rows"), F.min("total").alias("least"), F.max("total").alias("most"), F.count_distinct(F.when(F.col("n_rows") > 0, F.col("at"))).alias("starts"), F.count_if(F.col("n_rows") > 0).alias("pages")).first()
    if sums.pages and (sums.least != sums.most or sums.rows != sums.most or sums.starts != sums.pages):
        raise ValueError(f"{sums.rows} rows in pages of a list of {sums.most}")


def read_pages(spark: SparkSession, source: str, path: str, check: bool = True, symbols: list[str] | None = None, **options: str) -> DataFrame:
    """The rows of ``aggregate_pages`` (with ``tf``) or ``release_pages``, once the pages are
    known to be whole; of some ``symbols`` only those pages are looked at."""
    register(spark)
    if symbols is not None:
        options["symbols"] = json.dumps(symbols)
    if check:
        headers = spark.read.format(source).options(view="headers", **options).load(path)
        (check_chains if source == "aggregate_pages" else check_offsets)(headers)
    return spark.read.format(source).options(**options).load(path)


def stream_pages(spark: SparkSession, source: str, path: str, **options: str) -> DataFrame:
    """The same rows as a stream: each batch has the pages written since the one before."""
    register(spark)
    return spark.readStream.format(source).options(**options).load(path)


def write_pages(pages: DataFrame, keys: list[str], document: str, path: str) -> str:
    """Writes each row's ``document`` (a JSON text) as the page that its keys name."""
    pages.select(*keys, F.col(document).alias("value")).repartition(*keys).write.partitionBy(*keys).text(path)
    return path
