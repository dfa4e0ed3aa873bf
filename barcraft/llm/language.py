"""Operator 5: language identification, word first with backoff.

A word is a letter and the letters and marks that follow it.  A known word scores by its log
frequency in each language.  An unseen word backs off: the longest character n-grams of it
(padded with a boundary sign) of which the model knows any are scored, falling from five
characters to one.  A text's language is the one with the greatest sum over all its words.

The model is fitted on a bounded sample: at most about SAMPLE_DOCS documents of each language,
chosen by a hash of the document's id.  It keeps each language's WORDS most frequent words
that the sample has LEAST times or more and its GRAMS most frequent n-grams of each length; all four are parameters of
``identify``.  Every value of lang is learnt: where the values are so many that the model
could pass MOST_ENTRIES entries, the fit raises and names the bound.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barcraft.llm.scratch import Scratch

SAMPLE_DOCS, WORDS, GRAMS, LEAST, LONGEST = 4000, 40_000, 20_000, 2, 5
#: Entries (name and language) that a model may have, some 100 bytes each in a worker.
MOST_ENTRIES = 16_000_000
UNDETERMINED = "und"
#: Scores (words times languages) that a worker remembers, and words that weigh in the score.
REMEMBERED, EVIDENCE = 1_600_000, 20

_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _members(kinds: str, end: int) -> str:
    """A character class of the code points below ``end`` whose category begins with one of ``kinds``."""
    inside = np.array([unicodedata.category(chr(c))[0] in kinds for c in range(end)])
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


@cache
def _words(end: int) -> re.Pattern:
    return re.compile(f"[{_members('L', end)}][{_members('LM', end)}]*")


def letter_words(text: str) -> list[str]:
    """Letters with the letters and marks that follow, lower-cased: words of scripts that
    write vowels as marks stay whole, and numerals of any kind are no letters."""
    return _words(0x110000 if _BEYOND.search(text) else 0x10000).findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


#: A model's levels: words, then n-grams from the longest to single characters.
LEVELS = (0, *range(LONGEST, 0, -1))


class LanguageModel:
    """Log frequencies by language of words and n-grams, stored sparsely: each name has the
    languages that know it; in the others it scores the level's value for the unknown."""

    def __init__(self, languages: list[str], entries: dict[int, dict[str, dict[str, int]]]):
        """``entries``: size of the n-gram (0: word) -> language -> name -> number."""
        self.languages = sorted(languages)
        k = len(self.languages)
        self.names: list[list[str]] = []
        self.unknown = np.zeros((len(LEVELS), k))
        begin, which, gain = [0], [], []
        for level, size in enumerate(LEVELS):
            table = entries.get(size, {})
            held: dict[str, list[tuple[int, int]]] = {}
            total = np.ones(k)
            for i, lang in enumerate(self.languages):
                for name, n in table.get(lang, {}).items():
                    held.setdefault(name, []).append((i, n))
                    total[i] += n
            self.names.append(list(held))
            self.unknown[level] = np.log(0.5 / (total + 0.5 * max(1, len(held))))
            for found in held.values():
                which += [i for i, _ in found]
                gain += [math.log((0.5 + n) / 0.5) for _, n in found]
                begin.append(len(which))
        self.begin, self.which, self.gain = np.array(begin, np.int64), np.array(which, np.int32), np.array(gain)
        self._places: list[dict[str, int]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": None}

    @property
    def places(self) -> list[dict[str, int]]:
        """Row of each name, by level; made where it is used."""
        if self._places is None:
            offsets = np.cumsum([0, *map(len, self.names)]).tolist()
            self._places = [{name: o + i for i, name in enumerate(names)} for o, names in zip(offsets, self.names, strict=False)]
        return self._places

    def _rows(self, word: str) -> tuple[int, list[int]]:
        """(level, rows known there) of a word; without any, level -1."""
        places = self.places
        if (at := places[0].get(word)) is not None:
            return 0, [at]
        for level in range(1, len(LEVELS)):
            if found := [r for g in grams(word, LEVELS[level]) if (r := places[level].get(g)) is not None]:
                return level, found
        return -1, []

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): the known word's score, or the mean over its known n-grams."""
        found = [self._rows(w) for w in words]
        level = np.array([f[0] for f in found], np.int64)
        out = np.where((level >= 0)[:, None], self.unknown[level], 0.0)
        n = np.array([len(f[1]) for f in found], np.int64)
        rows = np.array([r for f in found for r in f[1]], np.int64)
        owner = np.repeat(np.arange(len(words)), n)
        size = self.begin[rows + 1] - self.begin[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[rows] - (ends - size), size) + np.arange(int(size.sum()))
        np.add.at(out, (np.repeat(owner, size), self.which[at]), self.gain[at] / np.repeat(n[owner], size))
        return out


class Scorer:
    """Scores texts; each distinct word is scored once and remembered."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        outer = self

        class Memory(dict):
            def __missing__(self, word: str) -> int:
                n = self[word] = len(self)
                outer.new.append(word)
                return n

        self.memory, self.new = Memory(), []
        self.table = np.zeros((0, len(self.model.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score from 0 to 1) of each text."""
        k = len(self.model.languages)
        if len(self.memory) * k > REMEMBERED:
            self._reset()
        split = [letter_words(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        if not k or not counts.sum():
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        number = np.fromiter(map(self.memory.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.new:
            self.table = np.concatenate((self.table, self.model.word_scores(self.new)))
            self.new = []
        some = np.flatnonzero(counts)
        begins = (np.cumsum(counts) - counts)[some]
        sums = np.add.reduceat(self.table[number], begins, axis=0)
        best = sums.argmax(axis=1)
        scale = np.minimum(1.0, EVIDENCE / counts[some])[:, None]
        share = 1 / np.exp((sums - sums.max(axis=1, keepdims=True)) * scale).sum(axis=1)
        langs, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for i, b in zip(some.tolist(), best.tolist(), strict=True):
            langs[i] = self.model.languages[b]
        score[some] = share
        return langs, score


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(letter_words(text))
        rows = [(lang, w, n) for lang, counts in found.items() for w, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, word, times in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            for n in range(1, LONGEST + 1):
                for g in grams(word, n):
                    found[lang, n, g] += times
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int32()), pa.array([r[0][2] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["lang", "size", "name", "n"])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, mod ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def sampled(rows: DataFrame, by: str, most: int, values: int) -> DataFrame:
    """About ``most`` rows of each value of ``by`` (all, where there are fewer), chosen by a
    hash of doc_id.  More than ``values`` values raise: none is left out."""
    counts = rows.groupBy(by).agg(F.count("*").alias("__of"))
    found = counts.limit(values + 1).collect()
    if len(found) > values:
        raise ValueError(f"more than {values} values of {by}")
    unit = 1_000_003
    shares = rows.sparkSession.createDataFrame([(r[by], math.ceil(min(1.0, most / r["__of"]) * unit)) for r in found], f"`{by}` {rows.schema[by].dataType.simpleString()}, __share int")
    # bounded by ``values`` rows
    return rows.join(F.broadcast(shares), by).where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(unit)) < F.col("__share")).drop("__share")


def fit(rows: DataFrame, docs_each: int = SAMPLE_DOCS, words: int = WORDS, pieces: int = GRAMS, least: int = LEAST) -> LanguageModel:
    """A model of rows(doc_id, text, lang), none of them null."""
    scratch = Scratch(rows.sparkSession, "language")
    used = sampled(rows, "lang", docs_each, MOST_ENTRIES // (words + LONGEST * pieces)).select("lang", "text")
    counted = scratch.write("words", used.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    parts = counted.mapInArrow(_count_grams, "lang string, size int, name string, n long").groupBy("lang", "size", "name").agg(F.sum("n").alias("n"))
    both = counted.where(F.col("n") >= least).select("lang", F.lit(0).alias("size"), F.col("word").alias("name"), "n").unionByName(parts)
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "name"))
    kept = both.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("size") == 0, words).otherwise(pieces)).select("lang", "size", "name", "n").toArrow()
    scratch.keep_only()
    entries: dict[int, dict[str, dict[str, int]]] = {}
    for lang, size, name, n in zip(*(kept.column(c).to_pylist() for c in ("lang", "size", "name", "n")), strict=True):
        entries.setdefault(size, {}).setdefault(lang, {})[name] = n
    return LanguageModel(sorted({lang for table in entries.values() for lang in table}), entries)


_scorers: dict[str, Scorer] = {}


def scorer_of(name: str, model: LanguageModel) -> Scorer:
    """This worker's scorer of the model: what it remembers outlives a task."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model)
    return _scorers[name]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def identify(docs: DataFrame, folds: int = 4, held: int = 2, docs_each: int = SAMPLE_DOCS, words: int = WORDS, pieces: int = GRAMS, least: int = LEAST) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs(doc_id, text, lang, ...).

    Learns from text and non-null lang of the rows whose crc32(doc_id as text) mod ``folds``
    is not ``held`` (null ids are not learnt from); predicts from the text alone.  A null
    text, or one without a letter (numerals and marks alone are none), is ``und`` with score
    0, as is every text if there is nothing to learn from.  Ties go to the first language by
    code point.  Texts of any length are read whole, 256 at a time.  Repeated rows are
    predicted each; an empty table gives no rows; other columns, whatever their names, are
    not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    part = fold(F.col("doc_id"), folds)
    model = fit(rows.where((part != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()), docs_each, words, pieces, least)
    shared = spark.sparkContext.broadcast(model)  # bounded by MOST_ENTRIES
    name = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(name, shared.value)
        for batch in batches:
            for some in slices(batch):
                langs, score = scorer.predict(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    source = rows.select("doc_id", F.coalesce(part == held, F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
