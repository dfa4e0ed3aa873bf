"""Operator 4: exact substring dedup by super-k-mer partitioning over words.

A window is ``window`` consecutive words.  Its minimiser is the least hash among its
``gram``-word grams; consecutive windows with one minimiser form a super-k-mer, which
travels as one packed string to the bin of its minimiser.  Equal windows have equal
minimisers, so they meet in one bin, where sorting finds each window's first occurrence.

* Pre-aggregation: each chunk of texts first drops the windows that already start earlier
  in the chunk; only first occurrences are packed.
* Transport: a chunk sends one Zstandard block of packed strings per bin, so the shuffle
  moves few rows; bins grow in number with the text, not in size.  Up to MOST_PARTITIONS bins are
  partitions; beyond, neighbours share one and are sorted one after another.
* Skew: minimisers that very many super-k-mers share are found on a sample of the documents
  and rank last, so that the many different windows around a common phrase take rarer grams.
  Equal windows (a passage in a third of all documents) can't be told apart by any gram, so a
  window that has such a minimiser goes in two steps: first salted, so that some FAN chunks
  meet in a bin, where only the first occurrence survives; then the survivors meet without
  salt.  A passage in every document thus costs a bin one occurrence of a window per
  salt.  The sample only routes: equal windows are routed alike whatever it holds.
* Memory: a bin is sorted in PARTS parts; if its strings pass OPEN bytes, only one part's
  are held unpacked at a time.
* Exactness: windows are sorted by a 64-bit hash and repeats are then compared byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcraft.llm.scratch import Scratch
from barcraft.llm.text import Words, mix, rolling, texts_of

WINDOW, GRAM = 20, 4
#: Text bytes that a mapper takes at once, packed bytes that a bin should get, the parts in
#: which a bin is sorted, and the packed bytes that a bin may hold unpacked.
CHUNK, BIN, PARTS, OPEN = 4 << 20, 24 << 20, 8, 64 << 20
#: Partitions of a shuffle to bins: what the driver and the mappers must keep track of.
MOST_PARTITIONS = 4096
#: A minimiser ranks last if the sample (one document in SAMPLE) has it this often.  Where more than
#: MOST_HOT would be, the bound rises until they are not: by arithmetic, no more than
#: (all of them / bound) minimisers can reach it.
SAMPLE, HOT, MOST_HOT = 16, 512, 1_000_000
#: Chunks whose occurrences of one frequent window meet in a bin of the first step.
FAN = 64

_MAX = np.uint64(np.iinfo(np.uint64).max)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _firsts(keys: np.ndarray) -> np.ndarray:
    """For each position the least position with the same key."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    least = np.minimum.reduceat(order, begins)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(least, np.diff(np.concatenate((begins, [len(keys)]))))
    return out


#: The place of a window: document, hash of its text (one id may be used for several texts), word.
Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def _differ(places: Places, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (places[0][a] != places[0][b]) | (places[1][a] != places[1][b]) | (places[2][a] != places[2][b])


def _repeats(words: Words, at: np.ndarray, hashes: np.ndarray, places: Places, window: int) -> np.ndarray:
    """Which windows start earlier too; ``at`` is ascending in places."""
    if not len(at):
        return np.zeros(0, bool)
    first = _firsts(hashes)
    later = np.flatnonzero(first != np.arange(len(at)))
    later = later[_differ(places, later, first[later])]
    out = np.zeros(len(at), bool)
    data, begin, end = words.data, words.start[at], words.end[at + window - 1]
    odd = []
    for i, f, b, e, fb, fe in zip(later.tolist(), first[later].tolist(), begin[later].tolist(), end[later].tolist(), begin[first[later]].tolist(), end[first[later]].tolist(), strict=True):
        if data[b:e] == data[fb:fe]:
            out[i] = True
        else:
            odd.append((i, f))
    if odd:  # two texts with one hash: settle those hashes by the texts
        for h in {int(hashes[i]) for i, _ in odd}:
            seen: dict[bytes, tuple] = {}
            for i in np.flatnonzero(hashes == np.uint64(h)):
                place = tuple(int(p[i]) for p in places)
                out[i] = seen.setdefault(data[begin[i] : end[i]], place) != place
    return out


def _runs(places: Places, marked: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc_id, text_hash, start, number) of the runs of marked windows."""
    at = np.flatnonzero(marked)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    d, t, s = (p[at] for p in places)
    begins = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1))))
    return d[begins], t[begins], s[begins], np.diff(np.concatenate((begins, [len(at)])))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Chunks of (doc_ids, text hashes, texts with single spaces), ascending."""
    rows: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        rows.sort(key=lambda r: r[:2])
        return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]

    for batch in batches:
        ids, hashes = batch.column("doc_id"), batch.column("text_hash")
        for lo, texts in texts_of(batch):
            for i, h, t in zip(ids.slice(lo, len(texts)).to_pylist(), hashes.slice(lo, len(texts)).to_pylist(), texts, strict=True):
                if i is None or not t:
                    continue
                rows.append((i, h, b" ".join(t.split())))
                size += len(t)
                if size >= CHUNK:
                    yield out()
                    rows, size = [], 0
    if rows:
        yield out()


def _minimisers(words: Words, window: int, gram: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window its least gram that is not ``hot`` (its own hash, if all are), and whether
    its least gram of all is."""
    grams = mix(rolling(words.prefix, gram))
    least = _least(grams, window - gram + 1)
    if not len(hot):
        return least, np.zeros(len(least), bool)
    place = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
    grams[hot[place] == grams] = _MAX
    rarer = _least(grams, window - gram + 1)
    return np.where(rarer == _MAX, rolling(words.prefix, window), rarer), rarer != least


def _super_kmers(words: Words, fresh: np.ndarray, least: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser, common) of each super-k-mer of the windows
    ``fresh``; the other two hold a value per window of the chunk."""
    if not len(fresh):
        return fresh, fresh, least[:0], common[:0]
    doc, least, common = words.doc[fresh], least[fresh], common[fresh]
    cut = np.flatnonzero(np.concatenate(([True], (fresh[1:] != fresh[:-1] + 1) | (doc[1:] != doc[:-1]) | (least[1:] != least[:-1]) | (common[1:] != common[:-1]))))
    return fresh[cut], fresh[np.concatenate((cut[1:], [len(fresh)])) - 1], least[cut], common[cut]


def _windows(words: Words, window: int) -> np.ndarray:
    """First words of the windows that lie in one text."""
    n = max(0, len(words.hash) - window + 1)
    return np.flatnonzero(words.doc[:n] == words.doc[len(words.doc) - n :])


def _judged(words: Words, ids: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, Places, np.ndarray]:
    """(windows, their places, which of them start earlier in the chunk)."""
    at = _windows(words, window)
    places = ids[words.doc[at]], hashes[words.doc[at]], at - words.first[words.doc[at]]
    return at, places, _repeats(words, at, rolling(words.prefix, window)[at], places, window)


def _count_minimisers(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, texts in _groups(batches):
            words = Words(texts)
            at, _, repeat = _judged(words, ids, hashes, window)
            if len(at):
                keys, n = np.unique(_super_kmers(words, at[~repeat], *_minimisers(words, window, gram, np.zeros(0, np.uint64)))[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return run


_PIECES = pa.schema([("bin", pa.int64()), ("salted", pa.bool_()), ("block", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_PIECES_SQL = "bin long, salted boolean, block binary, doc_id long, text_hash long, start long, n long"


def _bin(least: np.ndarray, bins: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bin, part) of minimisers; with ``salt`` a bin of the first step."""
    spread = mix(least + np.uint64(99 + 2 * salt))
    return (spread % np.uint64(bins)).astype(np.int64), ((spread >> np.uint64(40)) % np.uint64(PARTS)).astype(np.uint8)


def _packed(words: Words, kmers: tuple, origin: Places, bins: int, salt: int, window: int, squeeze) -> Iterator[pa.RecordBatch]:
    """One block per bin of the strings of super-k-mers; ``origin`` is the place of each one's
    first word.  With ``salt`` they go to bins of the first step."""
    first, last, least, _ = kmers
    if not len(first):
        return
    bin_of, part = _bin(least, bins, salt)
    order = np.lexsort((part, bin_of))
    bin_of, part, first, last = bin_of[order], part[order], first[order], last[order]
    owner, text_hash, at = (p[order] for p in origin)
    begin, end = words.start[first], words.end[last + window - 1]
    cuts = np.flatnonzero(np.concatenate(([True], bin_of[1:] != bin_of[:-1], [True])))
    data, blocks = words.data, []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        strings = [data[b:e] for b, e in zip(begin[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]
        head = np.array([hi - lo], np.int64).tobytes() + owner[lo:hi].tobytes() + text_hash[lo:hi].tobytes() + at[lo:hi].astype(np.int32).tobytes() + np.fromiter(map(len, strings), np.int32, hi - lo).tobytes() + part[lo:hi].tobytes()
        blocks.append(squeeze.compress(head + b"".join(strings)))
    none = pa.nulls(len(blocks), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(bin_of[cuts[:-1]]), pa.array([salt > 0] * len(blocks)), pa.array(blocks, pa.binary()), none, none, none, none], schema=_PIECES)


def _marks(runs: tuple[np.ndarray, ...], bins: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeats as rows; the bin only spreads them."""
    d, t, s, n = runs
    if len(d):
        yield pa.RecordBatch.from_arrays([pa.array((mix(d.view(np.uint64)) % np.uint64(bins)).astype(np.int64)), pa.array([False] * len(d)), pa.nulls(len(d), pa.binary()), pa.array(d), pa.array(t), pa.array(s), pa.array(n)], schema=_PIECES)


def _pack(window: int, gram: int, bins: int, salts: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, hot = zstandard.ZstdCompressor(level=1), shared.value
        for ids, hashes, texts in _groups(batches):
            words = Words(texts)
            at, places, repeat = _judged(words, ids, hashes, window)
            if not len(at):
                continue
            salt = 1 + int(mix((ids[:1] ^ hashes[:1]).view(np.uint64))[0] % np.uint64(salts))
            kmers = _super_kmers(words, at[~repeat], *_minimisers(words, window, gram, hot))
            for common in (False, True):
                some = tuple(x[kmers[3] == common] for x in kmers)
                doc = words.doc[some[0]]
                yield from _packed(words, some, (ids[doc], hashes[doc], some[0] - words.first[doc]), bins, salt * common, window, squeeze)
            yield from _marks(_runs(places, repeat), bins)

    return run


def _unpack(block: bytes):
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    owner = np.frombuffer(raw, np.int64, n, 8)
    text_hash = np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    at = np.frombuffer(raw, np.int32, n, 8 + 16 * n)
    size = np.frombuffer(raw, np.int32, n, 8 + 20 * n)
    part = np.frombuffer(raw, np.uint8, n, 8 + 24 * n)
    ends = 8 + 25 * n + np.cumsum(size.astype(np.int64))
    return raw, owner, text_hash, at, ends - size, ends, part


def _sort_bin(blocks: list[bytes], salted: bool, window: int, gram: int, bins: int, hot: np.ndarray, squeeze) -> Iterator[pa.RecordBatch]:
    """Marks of the windows that start earlier in the bin; of a salted bin also the others,
    packed for the bins that they have without salt."""
    small = sum(map(zstandard.frame_content_size, blocks)) <= OPEN
    opened = [_unpack(b) for b in blocks] if small else None
    for p in range(PARTS):
        packed: list[bytes] = []
        owners, hashes, ats = [], [], []
        for raw, owner, text_hash, at, begin, end, part in opened if opened is not None else map(_unpack, blocks):
            lo, hi = np.searchsorted(part, [p, p + 1])
            packed += [raw[b:e] for b, e in zip(begin[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]
            owners.append(owner[lo:hi])
            hashes.append(text_hash[lo:hi])
            ats.append(at[lo:hi])
        if not packed or len(packed) < 2 and not salted:
            continue
        owner, text_hash, at = np.concatenate(owners), np.concatenate(hashes), np.concatenate(ats).astype(np.int64)
        order = np.lexsort((at, text_hash, owner))
        owner, text_hash, at = owner[order], text_hash[order], at[order]
        words = Words([packed[i] for i in order.tolist()])
        where = _windows(words, window)
        piece = words.doc[where]
        places = owner[piece], text_hash[piece], at[piece] + where - words.first[piece]
        repeat = _repeats(words, where, rolling(words.prefix, window)[where], places, window)
        yield from _marks(_runs(places, repeat), bins)
        if salted:
            kmers = _super_kmers(words, where[~repeat], *_minimisers(words, window, gram, hot))
            piece = words.doc[kmers[0]]
            yield from _packed(words, kmers, (owner[piece], text_hash[piece], at[piece] + kmers[0] - words.first[piece]), bins, 0, window, squeeze)


def _sort(window: int, gram: int, bins: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, hot = zstandard.ZstdCompressor(level=1), shared.value
        current, blocks = None, []
        for batch in batches:
            ready = batch.filter(batch.column("block").is_null())
            if ready.num_rows:
                yield ready
            rest = batch.filter(batch.column("block").is_valid())
            for b, s, block in zip(rest.column("bin").to_pylist(), rest.column("salted").to_pylist(), rest.column("block").to_pylist(), strict=True):
                if (b, s) != current:
                    if blocks:
                        yield from _sort_bin(blocks, current[1], window, gram, bins, hot, squeeze)
                    current, blocks = (b, s), []
                blocks.append(block)
        if blocks:
            yield from _sort_bin(blocks, current[1], window, gram, bins, hot, squeeze)

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            counts, removed, digests, texts = [], [], [], []
            for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = (text or b"").split()
                gone = 0
                if runs:
                    step = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        step[min(r["start"], len(words))] += 1
                        step[min(r["start"] + r["n"] + window - 1, len(words))] -= 1
                    keep = np.cumsum(step[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    counts.append(len(words))
                    words = list(compress(words, keep.tolist()))
                else:
                    counts.append(len(words))
                kept = b" ".join(words)
                removed.append(gone)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if gone or text is None else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _hot_minimisers(texts: DataFrame, window: int, gram: int, scratch: Scratch) -> np.ndarray:
    """Frequent minimisers on the sample, ascending; at most MOST_HOT of them."""
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = scratch.write("frequent", sample.mapInArrow(_count_minimisers(window, gram), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(HOT, -(-total // MOST_HOT))).select("key").toArrow()
    return np.sort(found.column("key").to_numpy().astype(np.int64).view(np.uint64))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most_partitions: int = MOST_PARTITIONS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) per row of docs(doc_id, text, ...).

    Every word under a window that also starts earlier (smaller doc_id, or same document
    and earlier) is removed; kept_sha256 is of the kept words joined by one space and
    kept_text is those words (the text itself where nothing goes).  A null or blank text
    has no words and the digest of the empty string.  Rows with a null doc_id have no place
    in the order: they lose nothing and cost others nothing.  Equal rows count as one document
    at the same places; different texts under one doc_id are documents of their own, ordered
    by a hash of the text.  A text of any length is taken whole, as a chunk of its own if it
    is longer than CHUNK.  An empty table gives no rows; other columns, whatever their names,
    are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins, salts = max(1, -(-3 * size // BIN)), max(1, -(-size // (CHUNK * FAN)))
    hot = spark.sparkContext.broadcast(_hot_minimisers(texts, window, gram, scratch))  # at most MOST_HOT numbers
    packed = texts.mapInArrow(_pack(window, gram, bins, salts, hot), _PIECES_SQL)

    partitions = min(bins, most_partitions)

    def sort(pieces: DataFrame) -> DataFrame:
        # neighbouring bins share a partition where there are more bins than partitions; Spark's
        # external sort brings them to the task one after another, so a task still holds one bin
        place = F.expr(f"cast(bin * {partitions}D / {bins} as int)")
        return pieces.repartitionById(partitions, place).sortWithinPartitions("bin", "salted").mapInArrow(_sort(window, gram, bins, hot), _PIECES_SQL)

    first = scratch.write("first", sort(packed))
    second = sort(first.where("block is not null"))
    runs = first.where("block is null").unionByName(second)
    marks = scratch.write("runs", runs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs")))
    scratch.keep_only("runs")
    joined = texts.join(marks.hint("merge"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
