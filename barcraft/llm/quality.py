"""Operator 3: quality rules by repetition coverage.

Word n-grams of several lengths are hashed by a rolling hash in numpy (prefix sums: the cost
of a length does not depend on it); an n-gram found twice or more in a text covers all its
occurrences, and the characters (code points of words) under that cover are measured per
length.  A duplicated n-gram holds only duplicated shorter ones, so each length looks only
where the shortest found something.  Lines that repeat an earlier line of the text are
measured likewise.

Limits fall with the length, so that every rule can reject what the others let pass: whatever
longer n-grams cover, shorter ones cover too.  The limits are those published for large web
corpora (15 to 10 percent of characters for 5- to 10-grams).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcraft.llm.scratch import small_batches
from barcraft.llm.text import Words, chunks, mix

MIN_WORDS = 20
#: Base rule: percent of words in repeated windows of BASE_WINDOW words.
BASE_WINDOW, BASE_PERCENT = 8, 30
#: Method: greatest percent of word characters under duplicated n-grams, by length.
GRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Method: greatest percent of the word characters on lines that repeat an earlier one.
LINE_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS)] = 1
_LEAD = np.ones(256, np.uint8)  # bytes that begin a code point of a word
_LEAD[0x80:0xC0] = 0
_LEAD[[9, 10, 11, 12, 13, 32]] = 0

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup{n}_chars" for n in GRAM_PERCENT)]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs at least twice."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def measure(texts: list[bytes], lengths: tuple[int, ...] = tuple(GRAM_PERCENT)) -> dict[str, np.ndarray]:
    """The measures of each text, as int64 arrays."""
    words, docs = Words(texts), len(texts)
    raw = np.frombuffer(words.data, np.uint8)
    # sums between the words' beginnings: what stands between words counts nothing
    chars = np.add.reduceat(_LEAD[raw], words.start, dtype=np.int64) if len(words.start) else np.zeros(0, np.int64)

    def per_text(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=docs).astype(np.int64)

    out = {"n_words": words.counts.astype(np.int64), "word_chars": per_text(chars, words.doc)}
    out["n_symbols"] = np.zeros(docs, np.int64)
    some = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if len(some):
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[some]
        # the texts are joined by a space, which is no symbol
        out["n_symbols"][some] = np.add.reduceat(_SYMBOL[raw], begins, dtype=np.int64)

    n_words = len(words.hash)
    shortest = min(*lengths, BASE_WINDOW)
    maybe = None
    for n in sorted({*lengths, BASE_WINDOW}):
        at, hashes = words.grams(n)
        if maybe is not None and len(at):
            some = maybe[at]
            at, hashes = at[some], hashes[some]
        dup = at[_twice(mix(hashes + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))] if len(at) else at
        if n == shortest:
            maybe = np.zeros(n_words, bool)
            maybe[dup] = True
        step = np.zeros(n_words + 1, np.int64)
        np.add.at(step, dup, 1)
        np.add.at(step, dup + n, -1)
        cover = np.cumsum(step[:-1]) > 0
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_text(cover, words.doc)
        if n in lengths:
            out[f"dup{n}_chars"] = per_text(chars * cover, words.doc)

    dup_lines, dup_chars = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for i, text in enumerate(texts):
        if b"\n" not in text:
            continue
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                if in_words := b"".join(line.split()):
                    dup_lines[i] += 1
                    dup_chars[i] += len(in_words.decode("utf-8", "replace"))
            else:
                seen.add(line)
    return out | {"n_dup_lines": dup_lines, "dup_line_chars": dup_chars}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, texts in chunks(batch, "__text"):
            found = measure(texts)
            kept = batch.slice(lo, hi - lo).drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(found[k]) for k in MEASURES)], [*kept.schema.names, *MEASURES])


def verdicts(frame: DataFrame) -> DataFrame:
    """Adds base_failed and kept to a frame with the measures."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))
    bad = 100 * F.col("dup_line_chars") > LINE_PERCENT * F.col("word_chars")
    for n, most in GRAM_PERCENT.items():
        bad = bad | (100 * F.col(f"dup{n}_chars") > most * F.col("word_chars"))
    return frame.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)


def repetition_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, measures..., base_failed, kept) per row of docs(doc_id, text, ...).

    A null, empty or blank text has no words: every measure is 0, base_failed is true and
    kept false.  Repeated rows and null doc_ids are judged each on their own; an empty
    table gives no rows; other columns, whatever their names, are not read.  One pass, no
    shuffle.  A text is measured whole, about half a MB of texts at a time; a longer one takes
    some 20 bytes of memory for each of its own.  A measure that equals its limit passes.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("__text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in MEASURES)
    return verdicts(source.mapInArrow(_measured, schema))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs with a kept verdict, all columns as they are, in one pass.

    Columns of docs may have any names: the measures travel beside a packed copy."""
    small_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), F.col("text").cast("string").alias("__text"))
    schema = f"__row {packed.schema['__row'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in MEASURES)
    return verdicts(packed.mapInArrow(_measured, schema)).where("kept").select("__row.*")
