"""Operator 8: mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to);
a flow network routes each pattern's words to the quotas of its sources, where the e-th pass
over a pattern costs more than the one before (convex), so words are repeated only where a
quota needs it and never more than ``max_passes`` times.  The network has a node per pattern
and per source, never per document.  A pattern's flow is whole passes plus a remainder; the
remainder goes to the documents first in a seeded hash order, found by a histogram of hash
buckets and then inside the one bucket where it ends.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcraft.llm.scratch import Scratch

WEIGHTS = (1, 2, 3)
MAX_PASSES, SEED, BUCKETS = 3, 20240229, 4096
#: Patterns are few (sets of sources); more than this is a wrong membership column.
MAX_PATTERNS = 20_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.size(F.coalesce(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), F.array().cast("array<string>"))).cast("long")


def source_weights(names: list[str | None], weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, int]:
    """Weights given in turn to the sources by code point, null last."""
    ordered = sorted((n for n in names if n is not None)) + [None] * (None in names)
    return {n: weights[i % len(weights)] for i, n in enumerate(ordered)}


def targets(sizes: dict, weights: dict, total: int | Fraction, most: int = MAX_PASSES) -> dict:
    """Exact shares of ``total`` by weight, none above ``most`` times its source's size; what
    is cut off is shared again by weight among the others until none is above."""
    out: dict = {}
    free, left = set(sizes), Fraction(total)
    while free:
        weight = sum(weights[s] for s in free)
        share = {s: left * weights[s] / weight for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def integral(shares: dict) -> dict:
    """Shares rounded to whole words with the same sum (rounded), largest remainders first."""
    out = {s: int(v) for s, v in shares.items()}
    rest = round(sum(shares.values())) - sum(out.values())
    order = sorted(shares, key=lambda s: (out[s] - shares[s], s is None, s or ""))
    for s in order[: max(0, rest)]:
        out[s] += 1
    return out


class _Network:
    """Successive shortest paths with potentials."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def send(self, source: int, sink: int) -> int:
        potential, sent = [0] * len(self.out), 0
        while True:
            far: list[int | None] = [None] * len(self.out)
            via = [-1] * len(self.out)
            far[source], heap = 0, [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    if self.room[e] > 0:
                        y = self.to[e]
                        step = d + self.cost[e] + potential[x] - potential[y]
                        if far[y] is None or step < far[y]:
                            far[y], via[y] = step, e
                            heapq.heappush(heap, (step, y))
            if far[sink] is None:
                return sent
            potential = [p + (f if f is not None else far[sink]) for p, f in zip(potential, far, strict=True)]
            x, amount = sink, None
            while x != source:
                e = via[x]
                amount = self.room[e] if amount is None else min(amount, self.room[e])
                x = self.to[e ^ 1]
            x = sink
            while x != source:
                e = via[x]
                self.room[e] -= amount
                self.room[e ^ 1] += amount
                x = self.to[e ^ 1]
            sent += amount


def route(patterns: dict[tuple, int], quotas: dict, most: int = MAX_PASSES) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources: a min-cost flow in which pass e
    over a pattern's words costs e * e per word.  Quotas that the patterns can't fill get
    what they can.  Of flows of equal cost the same is found for any order of the arguments."""
    # in one order, whatever the arguments': flows of equal cost must not depend on it
    by_name = lambda s: (s is None, s or "")
    names, keys = sorted(quotas, key=by_name), sorted(patterns, key=lambda p: [by_name(s) for s in p])
    place = {s: 1 + i for i, s in enumerate(names)}
    net = _Network(2 + len(names) + len(keys))
    source, sink = 0, 1 + len(names) + len(keys)
    arcs = {}
    for i, p in enumerate(keys):
        node = 1 + len(names) + i
        for e in range(1, most + 1):
            net.arc(source, node, patterns[p], e * e)
        for s in sorted(set(p), key=by_name):
            arcs[p, s] = net.arc(node, place[s], most * patterns[p], 0)
    for s in names:
        net.arc(place[s], sink, quotas[s], 0)
    net.send(source, sink)
    return {p: {s: net.room[arcs[p, s] ^ 1] for s in set(p)} for p in keys}


def _plan(rows: DataFrame, scratch: Scratch, weights, most: int) -> DataFrame:
    """rows(members, size, h, ...) -> one row per pattern: how much of it is taken."""
    spark = rows.sparkSession
    key = F.to_json("members")
    found = rows.where("members is not null").groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["members"]): r["size"] for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in set(p):
            sizes[s] = sizes.get(s, 0) + n
    named = weights(list(sizes)) if callable(weights) else weights
    shares = targets(sizes, named, sum(n for p, n in patterns.items() if p), most)
    flow = route(patterns, integral(shares), most)
    listed = []
    for p, n in patterns.items():
        wanted = sum(flow[p].values())
        passes, rest = divmod(wanted, n) if n else (0, 0)
        listed.append((list(p), passes, rest, sizes[p[0]] if p else None, float(shares[p[0]]) if p else None))
    schema = "members array<string>, passes long, rest long, source_size long, target double"
    plan = spark.createDataFrame(listed, schema).withColumn("key", key).drop("members")

    keyed = rows.select(key.alias("key"), F.pmod("h", F.lit(BUCKETS)).alias("bucket"), "h", "size")
    rests = plan.select("key", "rest")

    def line(frame: DataFrame, order: str) -> DataFrame:
        """Of frame(key, order, size, before) the row in which a pattern's remainder ends."""
        upto = Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = frame.withColumn("upto", F.col("before") + F.sum("size").over(upto)).join(rests, "key")
        return summed.where("upto > rest and upto - size <= rest")

    buckets = keyed.groupBy("key", "bucket").agg(F.sum("size").alias("size")).withColumn("before", F.lit(0).cast("long"))
    cut = scratch.write("cut", line(buckets, "bucket").select("key", F.col("bucket").alias("end_bucket"), (F.col("upto") - F.col("size")).alias("before")))
    inside = keyed.join(cut, (keyed["key"] == cut["key"]) & (keyed["bucket"] == cut["end_bucket"])).groupBy(keyed["key"], "before", "h").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    short = F.col("rest") - F.col("upto") + F.col("size")
    last = line(inside, "h").select("key", F.col("h").alias("end_h"), F.floor(short / F.col("n")).cast("long").alias("part"), (2 * short >= F.col("size")).alias("round_up"))
    return scratch.write("plan", plan.join(cut.drop("before"), "key", "left").join(last, "key", "left").drop("rest"))


def _rows(docs: DataFrame, members: Column | None, seed: int) -> DataFrame:
    text = F.col("text").cast("string")
    member = F.array(F.col("source").cast("string")) if members is None else F.array_sort(F.array_distinct(members))
    return docs.select(F.col("doc_id"), member.alias("members"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("h"))


def _whole() -> Column:
    """Whether a row's document stands before the line where the remainder ends."""
    bucket = F.pmod("h", F.lit(BUCKETS))
    return F.coalesce((bucket < F.col("end_bucket")) | ((bucket == F.col("end_bucket")) & (F.col("h") < F.col("end_h"))), F.lit(False))


def mix(docs: DataFrame, members: Column | None = None, weights=source_weights, most: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of docs(doc_id, text, source, ...).

    ``members`` is an array column of the sources a document belongs to (default: its
    source).  ``weights`` maps the list of sources to weights.  taken counts the words the
    mix takes of the row, repeats included, at most ``most`` times its size; the last
    document that a pattern needs is taken in part, its first words.  source_size and target
    are those of the document's first source.

    A null text has size 0 and is never taken; null is a source of its own; rows without any
    source are not taken (null source_size and target).  Repeated rows are documents of
    their own.  An empty table gives no rows.  The order is a hash of seed, id and text:
    reruns agree, whatever the partitions.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.write("rows", _rows(docs, members, seed))
    plan = _plan(rows, scratch, weights, most)
    scratch.keep_only("rows", "plan")
    joined = rows.withColumn("key", F.to_json("members")).join(plan, "key", "left")
    last = F.when((F.col("h") == F.col("end_h")), F.col("part")).otherwise(F.lit(0))
    extra = F.when(_whole(), F.col("size")).otherwise(F.least(F.coalesce(last, F.lit(0)), F.col("size")))
    taken = F.coalesce(F.col("passes") * F.col("size") + extra, F.lit(0)).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_copies(docs: DataFrame, members: Column | None = None, weights=source_weights, most: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it (whole documents: the last one that a
    pattern needs is in if at least half of it is taken), columns as they are.

    Rows without words go along with each whole pass over their pattern; rows without a
    source go; an empty table stays empty.  Copies of a row are equal rows."""
    scratch = Scratch(docs.sparkSession, "mixed")
    rows = scratch.write("rows", _rows(docs, members, seed))
    plan = _plan(rows, scratch, weights, most)
    scratch.keep_only("plan")
    names = docs.columns
    member = F.array(F.col("source").cast("string")) if members is None else F.array_sort(F.array_distinct(members))
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("__row"), F.to_json(member).alias("key"), F.xxhash64(F.lit(seed), "doc_id", F.col("text").cast("string")).alias("h"))
    joined = packed.join(plan, "key")
    up = _whole() | F.coalesce((F.col("h") == F.col("end_h")) & F.col("round_up"), F.lit(False))
    copies = (F.col("passes") + up.cast("long")).cast("int")
    return joined.select("__row", F.explode(F.array_repeat(F.lit(1), copies)).alias("__copy")).select("__row.*")
