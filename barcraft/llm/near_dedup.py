"""Operator 1: near-duplicate grouping by SuperMinHash, banding, verification, union-find.

Two documents are linked when ``100 * |A & B| >= threshold * |A | B|`` for their sets of
distinct word shingles.  The plan:

1. one pass over the texts makes, per document, the set's size, a 128-bit fingerprint of
   the set and the band keys of its SuperMinHash signature;
2. documents with equal sets are one class, a node of its own number (pre-aggregated, so a
   hot group of copies is folded before the shuffle);
3. classes that share a band key are joined to the bucket's least member and the components
   of those candidate links form candidate groups: every pair that shares a bucket lies in
   one group, and no pair is written out.  Only members of groups go on, with their sets as
   hashes, made once;
4. narrow groups (at most ``block`` members of BLOCK_BYTES) are linked in one task each, on
   full sets, skipping pairs that union-find already has together;
5. wide groups first link every member with the hubs of its buckets, some rounds with other
   hubs: a cluster of near copies of any size falls together with work in proportion to
   its members;
6. buckets that still hold several components compare the members outside the bucket's main
   component with all its members, in cells of bounded rows and bytes, so no link is lost.
   A pair is compared only in the first bucket that it shares, so a chain of many buckets
   costs the sum over its buckets, not the square of the group;
7. union-find over the confirmed links gives the components.

Only step 6 can be quadratic, in the members of one bucket that links with no hub hold
together, and its cells are separate tasks.

Joins whose larger side grows with the corpus are sort-merge joins at every size: the plan
that is measured on little data is the one that runs on much, and skewed keys are split.

With b bands of r slots, a pair at the threshold shares no bucket with probability
``(1 - 0.85**r) ** b``: 4.3e-7 for the defaults.  Every pair that shares one is either known
to be connected or compared on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcraft.llm.components import UnionFind, connected_components
from barcraft.llm.scratch import Scratch
from barcraft.llm.superminhash import signatures
from barcraft.llm.text import Words, chunks, mix, prefix_of, rolling

SHINGLE_WORDS, THRESHOLD = 5, 85
BANDS, ROWS = 25, 5
#: Members, and bytes of their sets, that one linking task holds; one set may be larger.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Rounds of hubs in wide groups.
HUB_ROUNDS = 2


def shingle_sets(texts: list[bytes], width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of the distinct shingles of each lower-cased text, ascending by owner
    then hash.  A text with fewer words than ``width`` has its whole sequence as one
    shingle, one without words none."""
    words = Words([t.lower() for t in texts])
    at, hashes = words.grams(width)
    owner = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        extra = [rolling(prefix_of(words.hash[words.first[i] : words.first[i + 1]]), int(words.counts[i]), seed=int(words.counts[i]))[0] for i in short]
        hashes, owner = np.concatenate((hashes, np.array(extra, np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], owner[keep]


def band_keys(slots: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) int64 keys; the band's number is part of its key."""
    grouped = slots[:, : bands * rows].reshape(len(slots), bands, rows)
    odd = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(101, 101 + bands, dtype=np.uint64))
    return mix((grouped * odd).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)


def _describe(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in chunks(batch):
                hashes, owner = shingle_sets(texts, width)
                first = np.searchsorted(owner, np.arange(len(texts) + 1))
                sums = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)), dtype=np.uint64)))
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                n = np.diff(first)
                keys = band_keys(signatures(hashes, owner, len(texts), bands * rows), bands, rows)
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].reshape(-1)))
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("text_hash"), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists],
                    ["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "bands"],
                )

    return run


def _sets(width: int):
    """Texts become their sets' hashes; the other columns go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in chunks(batch):
                hashes, owner = shingle_sets(texts, width)
                first = np.searchsorted(owner, np.arange(len(texts) + 1))
                kept = batch.slice(lo, hi - lo).drop_columns(["text"])
                packed = pa.array([hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*kept.columns, packed], [*kept.schema.names, "set"])

    return run


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _link(threshold: int):
    """Links among rows(node, bands, set).  With a ``probe`` column only pairs of a probe are
    looked at, with ``comp`` not those of one component, and with ``key`` only those whose
    first common band has that key.  A node may stand in a table as a probe and as none."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column_names
        ids = table.column("node").to_pylist()
        keys = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(ids), -1)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        probe = np.array(table.column("probe").to_pylist(), bool) if "probe" in names else np.ones(len(ids), bool)
        key = table.column("key")[0].as_py() if "key" in names and len(ids) else None
        known = UnionFind()
        if "comp" in names:
            for i, c in zip(ids, table.column("comp").to_pylist(), strict=True):
                known.union(i, c)
        found = []
        pairs: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(probe):
            common = keys == keys[i]
            small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
            good = common.any(axis=1) & (100 * small >= threshold * large)
            good[: i + 1] &= ~probe[: i + 1]  # pairs of probes once
            good[i] = False
            at = np.flatnonzero(good)
            if key is not None and len(at):
                at = at[keys[i][common[at].argmax(axis=1)] == key]
            pairs += zip(common[at].sum(axis=1).tolist(), [int(i)] * len(at), at.tolist(), strict=True)
        for _, i, j in sorted(pairs, reverse=True):  # likely links first: more pairs are known then
            if known.find(ids[i]) != known.find(ids[j]) and linked(sets[i], sets[j], threshold):
                known.union(ids[i], ids[j])
                found.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _cells(n: Column, size: Column, block: int) -> Column:
    """Number of cells for so many members of so many bytes."""
    return F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _cell(node: str, seed: int, cells: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(seed)), cells).cast("int")


def _wide_links(sets: DataFrame, threshold: int, block: int, scratch: Scratch) -> DataFrame:
    """Links of the members of wide groups, sets(node, bands, set): hubs, then the rest."""
    link = _link(threshold)
    size = F.octet_length("set")
    bare = scratch.write("wide_keys", sets.select("node", size.alias("size"), F.explode("bands").alias("key")))
    links = None
    where = bare.withColumn("comp", F.col("node"))
    for k in range(HUB_ROUNDS):
        # the hub of a bucket: its member first in a hash order that differs between rounds
        hubs = where.groupBy("key").agg(F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(k))).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        hubs = hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp"))
        # components only grow together, so a bucket of one component is done with: only rows of open buckets go on
        still = scratch.write(f"still{k}", where.join(hubs.hint("merge"), "key").select("key", "node", "size", "hub", (F.col("comp") != F.col("hub_comp")).alias("apart")))
        stars = scratch.write(f"stars{k}", still.where("apart").select("hub", "node", "size").distinct())
        cuts = scratch.write(f"cuts{k}", stars.groupBy("hub").agg(_cells(F.count("*"), F.sum("size"), block).alias("cells")))
        spokes = stars.join(cuts.hint("merge"), "hub").select("hub", "node", _cell("node", k, F.col("cells")).alias("cell"), F.lit(False).alias("probe"))
        centres = cuts.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(True).alias("probe"))
        cast = spokes.unionByName(centres).join(sets.hint("merge"), "node")
        more = cast.groupBy("hub", "cell").applyInArrow(lambda t: link(t.select(["node", "bands", "set", "probe"])), "a long, b long")
        more = scratch.write(f"star_links{k}", more)
        links = more if links is None else links.unionByName(more)
        comps = connected_components(links, scratch, f"round{k}")
        where = scratch.write(f"where{k}", still.select("key", "node", "size").join(comps.withColumnRenamed("label", "comp").hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node")))

    # what is left: in buckets of several components, those outside the main one against all
    held = where.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = held.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("comps")).where("comps > 1")
    open_keys = scratch.write("open_keys", top.select("key", F.col("top.comp").alias("main"), _cells(F.col("n"), F.col("size"), block).alias("blocks"), (F.col("n") - F.col("top.n")).alias("outside")))
    if open_keys.isEmpty():
        return links
    open_keys = open_keys.withColumn("cuts", F.least(F.col("blocks"), F.greatest(F.ceil(F.col("outside") / block).cast("int"), F.lit(1))))
    rows = where.join(open_keys.hint("merge"), "key").select("key", "node", "comp", "main", "blocks", "cuts")
    # one cell: a row is its own probe; several: a probe meets every block, all others every cut
    single = rows.where("blocks = 1").select("key", "node", "comp", F.lit(0).alias("blk"), F.lit(0).alias("cut"), (F.col("comp") != F.col("main")).alias("probe"))
    many = rows.where("blocks > 1")
    probes = many.where("comp <> main").select("key", "node", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), _cell("node", 7, F.col("cuts")).alias("cut"), F.lit(True).alias("probe"))
    others = many.select("key", "node", "comp", _cell("node", 8, F.col("blocks")).alias("blk"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(False).alias("probe"))
    cast = single.unionByName(probes).unionByName(others).join(sets.hint("merge"), "node")
    rest = cast.groupBy("key", "blk", "cut").applyInArrow(lambda t: link(t.select(["node", "bands", "set", "probe", "comp", "key"])), "a long, b long")
    return links.unionByName(scratch.write("rest_links", rest))


def _near(docs: DataFrame, scratch: Scratch, threshold: int, width: int, bands: int, rows: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(described rows, classes with their component's least document).  The second has, per
    class (fp1, fp2, n_shingles), component_id and ``rep``: whether the class holds the
    component's representative."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("text_hash"), text.alias("text"))
    described = scratch.write("described", texts.mapInArrow(_describe(width, bands, rows), "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, bands array<long>"))
    key = ["fp1", "fp2", "n_shingles"]
    least = described.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", "text_hash", "bands")).alias("m"))
    # the numbers are fixed by the written table, whatever is read again later
    classes = scratch.write("classes", least.select(F.monotonically_increasing_id().alias("node"), *key, "m.doc_id", "m.text_hash", "m.bands"))
    keyed = classes.select("node", F.explode("bands").alias("key"))
    hubs = scratch.write("hubs", keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
    stars = keyed.join(hubs.hint("merge"), "key").where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    groups = connected_components(stars, scratch, "groups").withColumnRenamed("label", "grp")
    members = scratch.write("members", groups.join(classes.select("node", "doc_id", "text_hash", "n_shingles", "bands").hint("merge"), "node"))
    sizes = members.groupBy("grp").agg(_cells(F.count("*"), F.sum(8 * F.col("n_shingles")), block).alias("cells"), F.count("*").alias("n"))
    wide = scratch.write("wide", sizes.select("grp", ((F.col("cells") > 1) & (F.col("n") > 2)).alias("wide")))
    placed = members.join(wide.hint("merge"), "grp").select("node", "grp", "wide", "doc_id", "text_hash", "bands")
    fetched = texts.join(placed.hint("merge"), ["doc_id", "text_hash"]).select("node", "grp", "wide", "bands", "text")
    sets = scratch.write("sets", fetched.mapInArrow(_sets(width), "node long, grp long, wide boolean, bands array<long>, set binary"))
    if sets.count() > members.count():  # equal rows of one document: one of them is enough
        sets = scratch.write("sets_once", sets.dropDuplicates(["node"]))
    link = _link(threshold)
    links = scratch.write("links", sets.where("not wide").groupBy("grp").applyInArrow(lambda t: link(t.select(["node", "bands", "set"])), "a long, b long"))
    if not wide.where("wide").isEmpty():
        links = links.unionByName(_wide_links(sets.where("wide").select("node", "bands", "set"), threshold, block, scratch))
    joined = connected_components(links, scratch, "joined").withColumnRenamed("label", "comp")
    comps = scratch.write("comps", classes.select("node", *key, "doc_id").join(joined.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    names = comps.groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("m"))
    named = scratch.write("named", comps.join(names.hint("merge"), "comp").select(*key, F.col("m.doc_id").alias("component_id"), (F.col("node") == F.col("m.node")).alias("rep")))
    scratch.keep_only("described", "named")
    return described, named


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs(doc_id, text, ...)``.

    component_id is the least doc_id reachable over links, itself included; kept marks it.
    A null or wordless text has no shingles and is linked with nothing.  Rows that repeat a
    doc_id are linked by their texts like any others.  A null doc_id is linked with nothing
    and gets a null component and kept = true.  A text of any length is one set, taken
    whole; the set is what one task holds of it.  An empty table gives no rows.  Other
    columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "near")
    described, named = _near(docs, scratch, threshold, width, bands, rows, block)
    key = ["fp1", "fp2", "n_shingles"]
    result = described.select("doc_id", *key).join(named.hint("merge"), key, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row of docs for each component, all columns kept: that of the least doc_id, and of
    rows that share it the one whose text is first by hash.  Rows are judged by their own texts,
    so different texts under one doc_id don't cost each other.  Rows without doc_id and texts
    without words are in no component and stay; an empty table stays empty."""
    scratch = Scratch(docs.sparkSession, "kept")
    described, named = _near(docs, scratch, threshold, width, bands, rows, block)
    key = ["fp1", "fp2", "n_shingles"]
    rep = described.where("n_shingles > 0").select("doc_id", "text_hash", *key).join(named.where("rep").hint("merge"), key).where("doc_id = component_id")
    chosen = scratch.write("chosen", rep.groupBy(*key).agg(F.min("text_hash").alias("__hash"), F.first("doc_id").alias("__kept"), F.count("*").alias("__n")).select("__kept", "__hash", "__n"))
    none = described.where("n_shingles = 0 or doc_id is null").select(F.col("doc_id").alias("__kept"), F.col("text_hash").alias("__hash")).distinct()
    stay = scratch.write("stay", chosen.unionByName(none.withColumn("__n", F.lit(0).cast("long"))))
    scratch.keep_only("stay")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("__of"))
    found = packed.join(stay.hint("merge"), F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__of") == F.col("__hash")))
    out = found.where("__n <= 1").select("__row")
    if not stay.where("__n > 1").isEmpty():
        out = out.unionByName(found.where("__n > 1").dropDuplicates(["__id", "__of"]).select("__row"))
    return out.select("__row.*")
