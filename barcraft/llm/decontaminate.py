"""Operator 7: benchmark decontamination on a distributed positional inverted index.

DataFrame operations only.  Over all documents the occurrences of the benchmark's terms are
counted; each benchmark window is anchored at its two rarest positions; the postings
(document, position) of those terms are stored.  Neighbouring windows of an item mostly share
their anchor (the two terms and their distance), so postings are intersected per anchor, not
per window: the second term's list is shifted by the distance, and places at most ``slop``
apart meet in a bucket, where one bit stands for a place.  What the intersection leaves gives
the windows' places, which are confirmed word by word on the document.  Only documents with
candidates are read as words again; of the others the number of words is all that is asked.

Documents are keyed by a hash of id and text, so null and repeated ids are no special case:
a collision could only add a candidate, which the confirmation refuses.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcraft.llm.scratch import Scratch

WINDOW, SLOP = 10, 2
#: Terms that are sent to every task; a larger set is joined by a shuffle of counts, or of
#: the tokens that a run-time filter leaves.
BROADCAST_TERMS = 1_000_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _shared(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased; null: none."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(lowered, _NOT_WORD), ""), F.array().cast("array<string>"))


def word_number(text: Column) -> Column:
    """Number of words; as long as text is not lower-cased, A-Z are word characters too."""
    return F.size(F.coalesce(F.array_remove(F.split(text, _NOT_WORD_ANY_CASE), ""), F.array().cast("array<string>"))).cast("long")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, at, len, words) of every window; an item with fewer words is one window."""
    w = items.select(F.col("item_id"), words_of(F.col("text").cast("string")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))
    return w.select("item_id", "ws", F.explode(starts).alias("at")).select("item_id", "at", F.least(F.size("ws"), F.lit(window)).alias("len"), F.slice("ws", F.col("at") + 1, F.lit(window)).alias("words"))


def _candidates(docs: DataFrame, items: DataFrame, window: int, slop: int, scratch: Scratch) -> DataFrame:
    """(key, hits): per document the windows whose two rarest terms stand in place (within
    ``slop``), as structs (item_id, len, phrase, start, t1, offset, t2, distance).  Documents
    whose keys collide share their hits: ``_exact`` and ``_near`` look at a document's own words."""
    if slop > 15:
        raise ValueError("a slop of 15 words at most")  # a bucket's places are bits of a long
    windows = scratch.write("windows", _windows(items, window).distinct().withColumn("phrase", F.array_join("words", " ")))
    terms = scratch.write("terms", windows.select(F.explode("words").alias("term")).distinct())
    tokens = docs.select("key", "ws")
    every = tokens.select(F.explode("ws").alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        every = every.join(F.broadcast(terms), "term")
    counts = every.groupBy("term").agg(F.count("*").alias("n"))
    counts = scratch.write("counts", terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")))
    # phrases repeat between items: rank the positions of each distinct phrase once
    phrases = windows.select("phrase", "words").distinct()
    placed = phrases.select("phrase", F.posexplode("words").alias("pos", "term")).join(counts, "term")
    ranked = placed.groupBy("phrase").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term", "pos"))), 1, 2).alias("rare"))
    first, second = F.col("rare")[0], F.element_at("rare", -1)
    rare = ranked.where(first["n"] > 0).select("phrase", first["term"].alias("t1"), first["pos"].alias("offset"), second["term"].alias("t2"), (second["pos"] - first["pos"]).alias("distance"))
    rare = scratch.write("rare", rare.withColumn("anchor", F.xxhash64("t1", "t2", "distance")))
    anchors = scratch.write("anchors", rare.select("anchor", "t1", "t2", "distance").distinct())
    wanted = scratch.write("wanted", anchors.select(F.col("t1").alias("term")).union(anchors.select("t2")).distinct())
    postings = scratch.write("postings", tokens.select("key", F.posexplode("ws").alias("pos", "term")).join(_shared(wanted), "term"))
    # a bucket is 2 * slop + 1 places, bit i of ``a`` says that the first term stands at its place i,
    # bit i of ``b`` that the shifted second one stands at place i - slop
    width = 2 * slop + 1
    bit = lambda place: F.expr(f"shiftleft(1L, cast({place} as int))")
    none = F.lit(0).cast("long")
    ones = postings.join(anchors.select("anchor", F.col("t1").alias("term")), "term").withColumn("bucket", F.floor(F.col("pos") / width).cast("int")).select("key", "anchor", "bucket", bit(f"pos - bucket * {width}").alias("a"), none.alias("b"))
    twos = postings.join(anchors.select("anchor", F.col("t2").alias("term"), "distance"), "term").withColumn("at", F.col("pos") - F.col("distance"))
    near = F.array_distinct(F.array(*[F.floor((F.col("at") + d) / width).cast("int") for d in (-slop, slop)]))
    twos = twos.withColumn("bucket", F.explode(near) if slop else F.col("at")).select("key", "anchor", "bucket", none.alias("a"), bit(f"at - bucket * {width} + {slop}").alias("b"))
    met = ones.unionByName(twos).groupBy("key", "anchor", "bucket").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b")).where("a <> 0 and b <> 0")
    met = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).where(f"(shiftright(a, i) & 1) = 1 and (shiftright(b, i) & {(1 << width) - 1}) <> 0")
    named = windows.select("item_id", "len", "phrase").distinct().join(rare.select("phrase", "anchor", "t1", "offset", "t2", "distance"), "phrase")
    hits = met.select("key", "anchor", (F.col("bucket") * width + F.col("i")).alias("place")).join(named, "anchor").withColumn("start", F.col("place") - F.col("offset")).where(F.col("start") >= -slop)
    grouped = hits.groupBy("key").agg(F.collect_set(F.struct("item_id", "len", "phrase", "start", "t1", "offset", "t2", "distance")).alias("hits"))
    return scratch.write("candidates", grouped)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("key"), F.xxhash64(text, "doc_id", F.lit(1)).alias("key2"))


def _covered(hits: Column) -> Column:
    """Positions under the intervals [start, start + len)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, h: Column) -> Column:
        end = F.greatest(acc["end"], h["start"] + h["len"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], h["start"])).alias("n"))

    ordered = F.sort_array(F.array_distinct(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["len"].alias("len")))))
    return F.aggregate(ordered, zero, step, lambda acc: acc["n"].cast("long"))


def _exact(ws: Column, h: Column) -> Column:
    return F.when(h["start"] >= 0, F.array_join(F.slice(ws, F.greatest(h["start"], F.lit(0)) + 1, h["len"]), " ") == h["phrase"]).otherwise(F.lit(False))


def _near(ws: Column, h: Column, slop: int) -> Column:
    """Whether the window's rarest word stands at its place, the second rarest within ``slop`` of
    its own, and all of its words, in any order, within ``slop`` of the window's place."""
    lo = F.greatest(h["start"] - slop, F.lit(0))
    around = F.slice(ws, lo + 1, h["start"] + h["len"] + slop - lo)
    place = h["start"] + h["offset"]
    from_ = F.greatest(place + h["distance"] - slop, F.lit(0))
    second = F.slice(ws, from_ + 1, F.greatest(place + h["distance"] + slop + 1 - from_, F.lit(0)))
    anchored = F.coalesce(F.get(ws, place) == h["t1"], F.lit(False)) & F.array_contains(second, h["t2"])
    return anchored & (F.size(F.array_except(F.split(h["phrase"], " "), around)) == 0)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, matches and near_matches (arrays of item_id, start, len).

    A window is ``window`` consecutive words of an item of items(item_id, text, ...), or a
    shorter item's whole sequence; a document word under any occurrence of a window is hit.
    matches are these occurrences.  near_matches are the places that are none, but where all
    words of a window stand within ``slop`` words in any order: the place is that which the
    window's rarest word gives, and its second rarest lies within ``slop`` of its own place.
    Ties of rarity go to the first word by code point, then to the first position.
    Null or wordless texts have no words and no hits; wordless items have no windows; rows
    that repeat stand each for itself; items that repeat an item_id count once.  A text of
    any length is read whole.  Empty tables give no rows (documents) or no hits (items).
    Other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "contamination")
    keyed = _keyed(docs)
    found = _candidates(keyed.select("key", words_of(F.col("text")).alias("ws")), items, window, slop, scratch)
    scratch.keep_only("candidates")
    # a sort-merge join at every size; on large tables Spark filters the texts by the few keys first
    read = keyed.join(found.hint("merge"), "key").select("key", "key2", words_of(F.col("text")).alias("ws"), "hits")
    bare = lambda hits: F.transform(hits, lambda h: F.struct(h["item_id"].alias("item_id"), h["start"].alias("start"), h["len"].alias("len")))
    ws = F.col("ws")
    judged = read.select("key", "key2", bare(F.filter("hits", lambda h: _exact(ws, h))).alias("matches"), bare(F.filter("hits", lambda h: ~_exact(ws, h) & _near(ws, h, slop))).alias("near_matches"))
    # equal rows have equal hits: one of them is enough
    hits = scratch.write("hits", judged.groupBy("key", "key2").agg(F.first("matches").alias("matches"), F.first("near_matches").alias("near_matches")))
    scratch.keep_only("hits")
    none = F.expr("array()").cast(hits.schema["matches"].dataType)
    rows = keyed.select("doc_id", "key", "key2", word_number(F.col("text")).alias("n_words")).join(hits.hint("merge"), ["key", "key2"], "left").withColumn("matches", F.coalesce("matches", none)).withColumn("near_matches", F.coalesce("near_matches", none))
    names = F.sort_array(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    out = rows.select("doc_id", "n_words", _covered(F.col("matches")).alias("n_hit"), names.alias("names"), "matches", "near_matches")
    return out.select("doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "matches", "near_matches")


def listed(matches: Column) -> Column:
    """Matches as one text: item:start:len, sorted as texts, comma-joined."""
    return F.array_join(F.sort_array(F.transform(matches, lambda m: F.concat_ws(":", F.coalesce(m["item_id"].cast("string"), F.lit("")), m["start"].cast("string"), m["len"].cast("string")))), ",")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit, all columns kept.  Rows without words (null text too)
    stay, repeated rows and null ids stand each for themselves, an empty table stays empty."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", text))
    tokens = keyed.select(F.col("__key").alias("key"), words_of(text).alias("ws"))
    found = _candidates(tokens, items, window, 0, scratch)
    scratch.keep_only("candidates")
    joined = keyed.join(found.select(F.col("key").alias("__key"), F.col("hits").alias("__hits")).hint("merge"), "__key", "left").withColumn("__ws", F.when(F.col("__hits").isNotNull(), words_of(text)))
    hit = F.exists("__hits", lambda h: _exact(F.col("__ws"), h))
    return joined.where(~F.coalesce(hit, F.lit(False))).select(*[docs[f"`{c}`"] for c in docs.columns])
