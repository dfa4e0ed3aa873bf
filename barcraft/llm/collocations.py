"""Operator 11: collocations by suffix arrays of word ids.

A task numbers the words of a shard of documents (some SHARD_WORDS) and sorts the shard's suffixes
by numpy prefix doubling.  Runs of neighbours that share n words (LCP intervals) are the shard's
n-grams, their sizes its counts; counts are added up by phrase over all shards.  Sentinels end
pieces and documents, so no phrase crosses one.

A phrase can only be as frequent as its parts.  So words are counted first, then pairs of frequent
words by a 64-bit hash, then phrases of frequent pairs; what is frequent goes to the tasks as a
bitmap of fixed size.  Hashes and bitmaps only choose what is counted: what they let pass in error
costs rows, never a count.  Counts by phrase are exact for all that reach ``least``, which are all
that can be candidates or their parts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcraft.llm.scratch import Scratch
from barcraft.llm.text import mix, texts_of

#: Words (and sentinels) of a suffix array.
SHARD_WORDS = 1 << 20
#: Bytes of a text that are split into words at once.
SLICE_BYTES = 1 << 20
#: Bits of the maps of frequent words and pairs: 8 MiB each, whatever the corpus.
FILTER_BITS = 26
LONGEST, LEAST, TOP, PERCENT = 5, 100, 2000, 100
_OUT_ROWS = 1 << 16

_ENDS = bytes.maketrans(b".;:!?\n\x0b\x0c\r", b"," * 9)
_SPACE_OR_END = re.compile(rb"[ \t.,;:!?\x0a-\x0d]")
_COUNTS = "lang string, phrase string, c long"


def words_of(data: bytes) -> list[bytes]:
    """The words of a text; a comma, which no word holds, stands for every end of a piece."""
    return data.lower().translate(_ENDS).replace(b",", b" , ").split()


def slices(data: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in slices of about ``size``, never cut inside a word."""
    lo = 0
    while len(data) - lo > size and (found := _SPACE_OR_END.search(data, lo + size)):
        yield data[lo : found.start()]
        lo = found.start()
    yield data[lo:]


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` ids (or more), by prefix doubling."""
    rank, done = ids, 1
    order = np.argsort(rank) if depth == 1 else None
    while done < depth:
        after = np.zeros_like(rank)
        after[:-done] = rank[done:]
        pair = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(pair)
        pair = pair[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.diff(pair, prepend=-1) != 0)  # from 1: 0 stands for what is beyond the end
        done *= 2
    return order


def phrases(ids: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first words' positions, counts) of the distinct n-grams without a 0, by LCP intervals."""
    if not len(ids):
        return
    padded = np.concatenate((ids, np.zeros(longest, ids.dtype)))
    order = suffix_array(ids, longest)
    common, length = np.zeros(len(ids), np.int8), np.zeros(len(ids), np.int8)
    same, alive = np.ones(len(ids), bool), np.ones(len(ids), bool)
    same[0] = False
    for k in range(longest):
        here = padded[order + k]
        alive &= here != 0
        same[1:] &= here[1:] == here[:-1]
        same &= alive
        common += same
        length += alive
    for n in range(shortest, longest + 1):
        at = np.flatnonzero(length >= n)
        begins = np.flatnonzero(common[at] < n)
        if len(begins):
            yield n, order[at[begins]], np.diff(np.append(begins, len(at)))


def linked_runs(ids: np.ndarray, linked: np.ndarray | None, least: int) -> np.ndarray:
    """Runs of at least ``least`` ids without a 0 in which each pair is linked (``linked[i]``: ids
    i and i + 1), a 0 after each run."""
    stop = np.append(ids[1:] == 0, True) if linked is None else np.append(~linked, True)
    word = ids != 0
    ends = np.flatnonzero(word & (stop | np.append(~word[1:], True)))
    begins = np.flatnonzero(word & np.concatenate(([True], ~word[:-1] | stop[:-1])))
    long = ends - begins + 1 >= least
    sizes = (ends - begins + 2)[long]
    out = np.zeros(int(sizes.sum()), ids.dtype)
    offset = np.cumsum(sizes) - sizes
    at = np.arange(len(out)) - np.repeat(offset, sizes)
    inside = at < np.repeat(sizes - 1, sizes)
    out[inside] = ids[(np.repeat(begins[long], sizes) + at)[inside]]
    return out


class Shard:
    """Word ids of some documents; a word of two languages has two ids, 0 is a sentinel."""

    def __init__(self):
        self.ids: dict[str, defaultdict[bytes, int]] = {}
        self.fresh = count(1)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        ids = self.ids.get(lang)
        if ids is None:
            ids = self.ids[lang] = defaultdict(self.fresh.__next__)
            ids[b","] = 0
        self.parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def numbered(self) -> tuple[np.ndarray, list[bytes], np.ndarray, list[str]]:
        """(ids, words by id, each id's language, languages)."""
        langs, words = list(self.ids), [b""] * (1 + sum(len(v) - 1 for v in self.ids.values()))
        lang_of = np.zeros(len(words), np.int32)
        for i, lang in enumerate(langs):
            for word, k in self.ids[lang].items():
                if k:
                    words[k] = word
            lang_of[np.fromiter(self.ids[lang].values(), np.int64)] = i
        return np.concatenate(self.parts), words, lang_of, langs

    def word_counts(self, sign: int) -> Iterator[pa.RecordBatch]:
        """Counts of words, and of all words of a language under no phrase."""
        if self.size:
            ids, words, lang_of, langs = self.numbered()
            totals = np.bincount(lang_of[ids[ids != 0]], minlength=len(langs))
            yield _rows(pa.array(langs), pa.nulls(len(langs), pa.string()), sign * totals)
            yield from self._spelled(ids, words, lang_of, langs, 1, 1, sign)

    def pair_counts(self, sign: int, frequent_words: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of pairs of frequent words by the pairs' hashes."""
        if self.size:
            ids, words, lang_of, langs = self.numbered()
            hashes = word_hashes(words, lang_of, langs)
            known = is_set(frequent_words, hashes)
            known[0] = False
            ids = linked_runs(np.where(known[ids], ids, 0), None, 2)
            for _, start, counts in phrases(ids, 2, 2):
                found = pair_hashes(hashes[ids[start]], hashes[ids[start + 1]]).view(np.int64)
                for lo in range(0, len(start), _OUT_ROWS):
                    yield pa.RecordBatch.from_pydict({"h": found[lo : lo + _OUT_ROWS], "c": (sign * counts[lo : lo + _OUT_ROWS]).astype(np.int64)})

    def phrase_counts(self, sign: int, longest: int, frequent_pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of phrases of 2 to ``longest`` words whose pairs are all frequent."""
        if self.size:
            ids, words, lang_of, langs = self.numbered()
            hashes = word_hashes(words, lang_of, langs)
            ids = linked_runs(ids, is_set(frequent_pairs, pair_hashes(hashes[ids[:-1]], hashes[ids[1:]])), 2)
            yield from self._spelled(ids, words, lang_of, langs, 2, longest, sign)

    def _spelled(self, ids: np.ndarray, words: list[bytes], lang_of: np.ndarray, langs: list[str], shortest: int, longest: int, sign: int) -> Iterator[pa.RecordBatch]:
        names, spelled = pa.array(langs), pa.array(words, pa.binary()).cast(pa.string())
        for n, start, counts in phrases(ids, shortest, longest):
            for lo in range(0, len(start), _OUT_ROWS):
                at = start[lo : lo + _OUT_ROWS]
                parts = [spelled.take(pa.array(ids[at + k])) for k in range(n)]
                phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
                yield _rows(names.take(pa.array(lang_of[ids[at]])), phrase, sign * counts[lo : lo + _OUT_ROWS])


def _rows(lang: pa.Array, phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(counts.astype(np.int64))], names=["lang", "phrase", "c"])


def shards(batches: Iterator[pa.RecordBatch], size: int, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, Shard]]:
    """(1, shard) of all documents.  Where a shard ends inside a text, the next begins with the last
    words of this one, and (-1, those words) takes off what both count."""
    shard = Shard()
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for base, texts in texts_of(batch):
            for i, text in enumerate(texts):
                lang, tail = langs[base + i], []
                for part in slices(text or b"", slice_bytes):
                    if shard.size >= size:
                        yield 1, shard
                        shard = Shard()
                        if tail:
                            shard.add(lang, tail)
                            twice = Shard()
                            twice.add(lang, tail)
                            yield -1, twice
                    words = words_of(part)
                    shard.add(lang, words)
                    tail = (tail + words[1 - LONGEST :])[1 - LONGEST :]
                shard.add(lang, [b","])
    yield 1, shard


def word_hashes(words: list[bytes], lang_of: np.ndarray, langs: list[str]) -> np.ndarray:
    seeds = [xxhash.xxh64_intdigest(x) for x in langs]
    return np.array([xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(words, lang_of.tolist(), strict=True)], np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _word_hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = pc.dictionary_encode(batch.column("lang"))
        hashes = word_hashes(batch.column("phrase").cast(pa.binary()).to_pylist(), langs.indices.to_numpy(), langs.dictionary.to_pylist())
        yield pa.RecordBatch.from_pydict({"h": hashes.view(np.int64)})


def bitmap(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each hash (column h): 2**bits of them, however many rows there are."""
    slot, bit = F.shiftrightunsigned("h", 6).bitwiseAND((1 << (bits - 6)) - 1), F.expr("shiftleft(1L, cast(h & 63 as int))")
    found = hashes.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return out


def _counted(docs: DataFrame, schema: str, count, shard_words: int) -> DataFrame:
    """The sums over all shards of what ``count(sign, shard)`` gives for one."""

    def count_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sign, shard in shards(batches, shard_words):
            yield from count(sign, shard)

    rows = docs.mapInArrow(count_shards, schema)
    return rows.groupBy(*[c for c in rows.columns if c != "c"]).agg(F.sum("c").alias("c"))


def phrase_counts(scratch: Scratch, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``least`` occurrences (lang, phrase, n, a),
    and the words of each language (lang, words)."""
    context = scratch.spark.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    frequent = F.col("c") >= least
    single = scratch.write("words", _counted(texts, _COUNTS, lambda sign, shard: shard.word_counts(sign), shard_words).where(frequent | F.col("phrase").isNull()))
    words, single = single.where("phrase is null").select("lang", F.col("c").alias("words")), single.where("phrase is not null")
    found = single.select("lang", "phrase", F.lit(1).alias("n"), F.col("c").alias("a"))
    if longest > 1:
        known = context.broadcast(bitmap(single.mapInArrow(_word_hash_rows, "h long")))
        pairs = _counted(texts, "h long, c long", lambda sign, shard: shard.pair_counts(sign, known.value), shard_words).where(frequent)
        linked = context.broadcast(bitmap(pairs))
        more = scratch.write("phrases", _counted(texts, _COUNTS, lambda sign, shard: shard.phrase_counts(sign, longest, linked.value), shard_words).where(frequent))
        found = found.unionByName(more.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("n"), F.col("c").alias("a")))
    return found, words


def _joined(words: Column, begin: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """Each phrase of two or more words with its lowest-scoring cut (of equal ones the first).
    Products are decimals of 38 digits: more would be an error, never a wrong digit."""
    w, wide = F.split("phrase", " "), "decimal(38,0)"
    cuts = found.where("n > 1").select("lang", "phrase", "n", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _joined(w, F.lit(1), F.col("k")), "rest": _joined(w, F.col("k") + 1, F.col("n") - F.col("k"))})
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    cuts = cuts.join(words, "lang")
    score = F.expr(f"(cast(1000 as {wide}) * cast(a as decimal(19,0)) * cast(words as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "words", F.col("n").alias("size"))).alias("b"))
    return best.select("lang", "phrase", "b.size", "b.a", "b.l", "b.r", F.col("b.words").alias("n"), "b.score")


def uncontained(candidates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidates that lie in no longer candidate with ``percent`` of their occurrences or more."""
    w, size = F.split("phrase", " "), F.col("size")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
    within = candidates.where("size > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))
    return candidates.join(within, ["lang", "phrase"], "left").where(kept).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r, n, score.

    Null and empty texts have no words; a null lang is ``und``, and so is that value itself.
    Rows are counted each, repeated ones too, whatever their other columns.  Texts of any length are
    counted whole: shards that end inside one overlap by the words that a phrase could cross.
    Equal scores rank by occurrences, then by the phrase's bytes.  A language without candidates
    has no rows, and an empty table none at all.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    found, words = phrase_counts(scratch, docs.select("lang", "text"), least, longest, shard_words)
    candidates = scratch.write("candidates", scored(found, words))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rank = F.row_number()
    first = uncontained(candidates, percent).withColumn("salt", salt).withColumn("rank", rank.over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    first = first.withColumn("rank", rank.over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
