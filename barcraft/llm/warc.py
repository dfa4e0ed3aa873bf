"""Operator 10: WARC archives with a shared Zstandard dictionary.

Layout of a ``.warc.zst`` file: a leading skippable frame (magic 0x184D2A5D) that holds the
dictionary, then one Zstandard frame per WARC/1.1 record, so any record can be read from its
offset with the dictionary alone.  Of records with equal payloads one is the response and the
others are revisits (identical-payload-digest profile), which store headers only.

The dictionary is trained on whole records as they are written: a bounded sample of about
``sample_records`` records and ``sample_bytes`` bytes by a hash of their ids, of pages up to
``sample_longest`` bytes.  It decides sizes, never contents.  A task that has more than FILE_BYTES
to write goes on in a further file; the number of tasks is that of the join by digest, from the
bytes of the payloads, skewed digests being split by adaptive execution.
"""

from __future__ import annotations

import base64
import hashlib
import io
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcraft.llm.scratch import Scratch, lasting_folder, open_folder, put_file
from barcraft.session import settings

SKIPPABLE = 0x184D2A5D
SAMPLE_RECORDS, SAMPLE_BYTES, SAMPLE_LONGEST, DICTIONARY_BYTES = 1000, 16 << 20, 1 << 20, 65536
FILE_BYTES = 1 << 30
TASK_BYTES, MOST_TASKS = 256 << 20, 100_000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """A response record, or with ``refers_to`` a revisit of that page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, url)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, refers_url)}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_line(refers_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or none (empty) if the samples are too few or too small to train on."""
    if len(samples) < 8 or sum(map(len, samples)) < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def split_file(data: bytes) -> tuple[bytes, int]:
    """(dictionary, offset of the first record's frame)."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    return data[8 : 8 + size], 8 + size


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def read_record(stream) -> tuple[dict[str, str], bytes] | None:
    """The next record's headers and block, None at the end."""
    first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a record: {first[:40]!r}")
    head: dict[str, str] = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(": ")
        head[name] = value
    size = int(head["Content-Length"])
    block = stream.read(size)
    if len(block) != size or stream.read(4) != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return head, block


def describe(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; a
    response's digest is checked against its payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
    number = lambda k: int(head[k]) if k in head else None
    return number("X-Page-ID"), size, digest, head["WARC-Type"], number("X-Refers-To-Page-ID")


_COLUMNS = ["page_id", "url", "html", "refers_to", "refers_url"]


def _serialised(page_id, url, html: bytes | None, refers_to, refers_url) -> bytes:
    payload = html or b""
    return record(page_id, url, payload, payload_digest(payload), refers_to, refers_url)


def _write(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if held:
            held.precompute_compress(level=LEVEL)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=held)
        rows = (row for batch in batches for lo in range(0, batch.num_rows, 256) for row in zip(*(c.cast(pa.binary()).to_pylist() if name == "html" else c.to_pylist() for name, c in zip(_COLUMNS, batch.slice(lo, 256).select(_COLUMNS).columns, strict=True)), strict=True))
        following, k = next(rows, None), 0
        while following is not None:
            name, n = f"{folder}/part-{TaskContext.get().partitionId():05d}-{k:04d}.warc.zst", 0

            def fill(stream) -> None:
                nonlocal following, n
                frame = dictionary_frame(dictionary)
                size = len(frame)
                while following is not None and (size < FILE_BYTES or not n):
                    stream.write(frame)
                    frame = squeeze.compress(_serialised(*following))
                    size += len(frame)
                    n += 1
                    following = next(rows, None)
                stream.write(frame)

            put_file(name, fill)
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n]})
            k += 1

    return run


_FOUND = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)

    for batch in batches:
        for name in batch.column("file").to_pylist():
            store, path = open_folder(name)
            with store.open_input_stream(path, compression=None) as f:
                magic, size = struct.unpack("<II", f.read(8))
                if magic != SKIPPABLE:
                    raise ValueError("no leading dictionary frame")
                unpack = _decompressor(f.read(size))
                stream = io.BufferedReader(unpack.stream_reader(f, read_across_frames=True), 1 << 20)
                rows = []
                while (found := read_record(stream)) is not None:
                    rows.append(describe(*found))
                    if len(rows) == 4096:
                        yield out(rows)
                        rows = []
                yield out(rows)


PARTITIONS = "spark.sql.shuffle.partitions"


def task_number(size: int, least: int) -> int:
    """Tasks of the join by digest, which moves the payloads: about TASK_BYTES each, and no fewer
    than the session asks for.  Adaptive execution splits skewed digests."""
    return max(least, min(MOST_TASKS, -(-size // TASK_BYTES)))


def write_warc(pages: DataFrame, folder: str, scratch: Scratch, min_bytes: int = 0, sample_records: int = SAMPLE_RECORDS, sample_bytes: int = SAMPLE_BYTES, sample_longest: int = SAMPLE_LONGEST) -> DataFrame:
    """Writes the archives and returns their manifest (file, n_records)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= min_bytes)
    winners = large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("w"), F.count("*").alias("n")).where("n > 1 and w.page_id is not null")
    winners = scratch.write("winners", winners.select("digest", F.col("w.page_id").alias("winner"), F.col("w.url").alias("refers_url")))

    def as_written(some: DataFrame) -> DataFrame:
        joined = some.join(winners.hint("merge"), "digest", "left")
        revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")) & (F.octet_length("html") >= min_bytes)
        return joined.select("page_id", "url", "html", F.when(revisit, F.col("winner")).alias("refers_to"), F.when(revisit, F.col("refers_url")).alias("refers_url"))

    short = rows.where(F.octet_length("html") <= sample_longest)
    is_short = F.octet_length("html") <= sample_longest
    size = F.octet_length("html")
    found = rows.agg(F.count_if(is_short).alias("n"), F.sum(F.when(is_short, size)).alias("bytes"), F.sum(size).alias("all")).first()
    share = min(1.0, sample_records / max(1, found["n"]), sample_bytes / max(1, found["bytes"] or 0))
    chosen = short.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_003)) < F.lit(math.ceil(share * 1_000_003)))
    sample = as_written(chosen).collect()  # bounded: sample_records, sample_bytes
    dictionary = train([_serialised(r["page_id"], r["url"], r["html"].encode(), r["refers_to"], r["refers_url"]) for r in sample])
    with settings(scratch.spark, **{PARTITIONS: str(task_number(found["all"] or 0, int(scratch.spark.conf.get(PARTITIONS))))}):
        return scratch.write("manifest", as_written(rows).mapInArrow(_write(folder, dictionary), "file string, n_records long"))


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record."""
    files = manifest.where("n_records > 0").select("file")
    return files.repartition(max(1, files.count())).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, **sample: int) -> DataFrame:
    """Archives pages(page_id, url, html, ...) under ``folder`` (default: a fresh one in the
    shared folder, which stays) and reads them back.

    A null html is an empty payload; of equal payloads of at least ``min_bytes`` bytes the
    one with the largest page_id is the response and the others revisit it.  Rows that share
    that page_id are all responses; a null page_id never is the one referred to (where all
    are null, all are responses).  A payload of any length is one record, held whole while it
    is written.  An empty table gives no rows; other columns, whatever their names, are not
    read.  ``sample``: sample_records, sample_bytes and sample_longest of ``write_warc`` bound what
    the dictionary is trained on.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder or lasting_folder(pages.sparkSession, "archives"), scratch, min_bytes, **sample))
