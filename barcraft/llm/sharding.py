"""Operator 2: shards of bounded size by extendible hashing.

A row's key hash is read bit by bit from the top.  A bucket is a prefix of it; a bucket whose
rows exceed the byte limit is split on one more bit, and only such buckets are, so local
depths differ while every shard fits.  The directory (prefix -> shard) follows from the
leaves: rows look up the prefix of their hash in it.  Byte counts are pre-aggregated into
cells a few bits finer than the average shard; depths are summed from the cells SPAN levels at
a time, inside groups of at most 2 ** (SPAN - 1) cells, whose totals are the next levels' cells.
Only cells that are still too large are split further, in a next round over their rows.

Rows of one key can't be told apart by bits: a bucket of one key that is still too large
becomes a chain of overflow pages, filled in the order of a hash of the text by a running
size in levels (hash ranges, texts, equal rows by the partition that holds them), so a key of
any size is nobody's single task and the pages don't depend on the layout.  Rows above half
the limit have a page each.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcraft.llm.scratch import Scratch

SHARD_BYTES = 1 << 20
BITS = 60
#: Bits by which cells are finer than the average shard, and bits of a further round; levels
#: that are summed at once; hash ranges of a chain's texts.
FINER, SPAN, RANGES = 5, 12, 4096


def key_hash(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


_LEAF = "depth int, prefix long, shard_bytes long, largest long"


def _shallowest(lo: int, hi: int, limit: int):
    """Per cell of ``hi`` bits its shallowest bucket from ``lo`` to ``hi`` bits that fits (null: none)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        cell, size, largest, low, high = (table.column(c).to_numpy() for c in ("cell", "bytes", "largest", "low", "high"))
        depth, prefix, total, most = (np.full(len(cell), -1, np.int64) for _ in range(4))
        for d in range(hi, lo - 1, -1):  # what fits further up replaces what fits below
            name = cell >> (hi - d)
            begins = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            sums = np.add.reduceat(size, begins)
            fits = (sums <= limit) | (np.minimum.reduceat(low, begins) == np.maximum.reduceat(high, begins)) | (d == BITS)
            times = np.diff(np.concatenate((begins, [len(cell)])))
            use = np.repeat(fits, times)
            depth[use], prefix[use] = d, name[use]
            total[use], most[use] = np.repeat(sums, times)[use], np.repeat(np.maximum.reduceat(largest, begins), times)[use]
        none = depth < 0
        out = {"cell": pa.array(cell), "depth": pa.array(depth.astype(np.int32), mask=none)}
        return pa.table(out | {k: pa.array(v, mask=none) for k, v in (("prefix", prefix), ("shard_bytes", total), ("largest", most))})

    return run


def _leaves(cells: DataFrame, lo: int, hi: int, limit: int) -> DataFrame:
    """cells(cell of ``hi`` bits, bytes, largest, low, high) -> (cell, depth, prefix, shard_bytes,
    largest): each cell's leaf from ``lo`` to ``hi`` bits, nulls where none fits."""
    first = max(lo, hi - SPAN + 1)
    found = cells.groupBy(F.shiftright("cell", hi - first)).applyInArrow(_shallowest(first, hi, limit), f"cell long, {_LEAF}")
    if first == lo:
        return found
    up = hi - first + 1
    roots = cells.groupBy(F.shiftright("cell", up).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.max("largest").alias("largest"), F.min("low").alias("low"), F.max("high").alias("high"))
    above = _leaves(roots, lo, first - 1, limit).where("depth is not null").select(F.col("cell").alias("root"), F.struct("depth", "prefix", "shard_bytes", "largest").alias("above"))
    both = found.withColumn("root", F.shiftright("cell", up)).join(above, "root", "left")
    return both.select("cell", *[F.coalesce(F.col("above")[c], F.col(c)).alias(c) for c in ("depth", "prefix", "shard_bytes", "largest")])


def directory(rows: DataFrame, limit: int, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """rows(h, bytes) -> [(bits, (cell, depth, prefix, shard_bytes, largest, chained))]: a
    row belongs to the leaf of its hash's first ``bits`` bits in the one part that has it."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base, top = 0, min(BITS, FINER + max(0, math.ceil(math.log2(max(1, total / limit)))))
    parts, left = [], rows
    while True:
        cells = left.groupBy(F.shiftright("h", BITS - top).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.min("h").alias("low"), F.max("h").alias("high"))
        cells = scratch.write(f"cells{top}", cells)
        leaves = _leaves(cells, base, top, limit).where("depth is not null")
        part = scratch.write(f"directory{top}", leaves.withColumn("chained", F.col("shard_bytes") > limit))
        parts.append((top, part))
        over = cells.join(part, "cell", "left_anti").select("cell")
        if top >= BITS or over.isEmpty():
            return parts
        left = scratch.write(f"left{top}", left.withColumn("cell", F.shiftright("h", BITS - top)).join(over, "cell", "left_semi").drop("cell"))
        base, top = top + 1, min(BITS, top + FINER)


def _name(depth: Column, prefix: Column, page: Column) -> Column:
    bits = F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))
    return F.concat(F.lit("b"), bits, F.when(page > 0, F.concat(F.lit("-"), page.cast("string"))).otherwise(F.lit("")))


def _paged(long: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Rows of chained keys with page and shard_bytes: long(h, bytes, tie, ...), where ``tie`` is a
    hash of the text.  Rows are in the order of tie; equal ones are alike.

    A row above half the limit has a page of its own, after those of the others.  These others are
    laid end to end, and a page takes the rows that begin in its stretch of the limit less their
    largest: it ends at most one row further, and each stretch has a beginning."""
    long = long.withColumns({"__part": F.spark_partition_id(), "__range": F.pmod("tie", F.lit(RANGES)), "__big": 2 * F.col("bytes") > limit})
    long = scratch.write("long", long)
    key, text = ["h", "__big"], ["h", "__big", "__range", "tie", "bytes"]
    texts = scratch.write("texts", long.groupBy(*text, "__part").agg(F.count("*").alias("__n")))

    def running(frame: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
        before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))

    each = F.when(F.col("__big"), F.lit(1)).otherwise(F.col("bytes"))
    ranges = running(texts.groupBy(*key, "__range").agg(F.sum(F.col("__n") * each).alias("b")), key, ["__range"], F.col("b"), "__a").drop("b")
    inside = running(texts.groupBy(*text).agg(F.sum("__n").alias("__n")), [*key, "__range"], ["tie", "bytes"], F.col("__n") * each, "__b").drop("__n")
    parts = running(texts, text, ["__part"], F.col("__n"), "__c").drop("__n")
    steps = texts.groupBy(*key).agg(F.when(F.col("__big"), F.lit(1)).otherwise(F.lit(limit) - F.max("bytes")).alias("__step"))
    # units of the rows before, from the three levels and the place among equal rows of a partition
    place = F.row_number().over(Window.partitionBy(*text, "__part").orderBy("h")) - 1
    starts = reduce(lambda x, y: x.join(*y), [(inside, text), (ranges, [*key, "__range"]), (steps, key)], parts)
    at = F.col("__a") + F.col("__b") + (F.col("__c") + place) * each
    numbered = long.join(starts, [*text, "__part"]).withColumn("page", F.floor(at / F.col("__step")).cast("long"))
    paged = scratch.write("paged", numbered.drop("__part", "__range", "__a", "__b", "__c", "__step"))
    sizes = scratch.write("sizes", paged.groupBy(*key, "page").agg(F.sum("bytes").alias("__bytes")))
    after = sizes.where(~F.col("__big")).groupBy("h").agg((F.max("page") + 1).alias("__after")).withColumn("__big", F.lit(True))
    out = paged.join(sizes, [*key, "page"]).join(after, key, "left")
    return out.withColumns({"shard_bytes": F.col("__bytes"), "page": F.col("page") + F.coalesce("__after", F.lit(0))}).drop("__bytes", "__after", "__big")


def _placed(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """rows(h, bytes, tie, ...) with shard, depth and shard_bytes added."""
    joined, long_ones = None, False
    for bits, part in directory(rows.select("h", "bytes"), limit, scratch):
        found = rows.withColumn("cell", F.shiftright("h", BITS - bits)).join(part.hint("merge"), "cell").drop("cell")
        joined = found if joined is None else joined.unionByName(found)
        long_ones = long_ones or not part.where("chained").isEmpty()
    out = joined.where(~F.col("chained")).withColumn("page", F.lit(0).cast("long"))
    if long_ones:
        out = out.unionByName(_paged(joined.where("chained"), limit, scratch))
    return out.withColumn("shard", _name(F.col("depth"), F.col("prefix"), F.col("page")))


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(*columns, key_hash(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.xxhash64(text).alias("tie"))


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes) per row of docs(doc_id, text, ...).

    n_bytes is the text's UTF-8 size (null: 0); shard is "b" and the bits of its prefix, and
    for overflow pages after the first "-" and the page; depth is the number of bits.  No
    shard exceeds ``limit`` unless one row does alone.  A null doc_id is a key like any
    other.  Repeated rows are rows of one key; in a chain, rows of a key come in the order of a
    hash of their text, so only rows equal in key and text can change places.  A text of any
    length counts whole.  An empty table gives no rows; other columns, whatever their names,
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.write("rows", _keyed(docs, F.col("doc_id")))
    out = _placed(rows, limit, scratch)
    return out.select("doc_id", F.col("bytes").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), F.col("shard_bytes").cast("long").alias("shard_bytes"))


def sharded(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """docs with a shard column added (``shard``, or ``shard_`` where docs has one), every row
    once, as ``shards`` places it."""
    scratch = Scratch(docs.sparkSession, "sharded")
    names = docs.columns
    name = "shard"
    while name in names:
        name += "_"
    packed = _keyed(docs, F.struct(*[docs[f"`{c}`"] for c in names]).alias("__row"))
    return _placed(packed, limit, scratch).select("__row.*", F.col("shard").alias(name))
