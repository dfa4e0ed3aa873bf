"""Operator 11 against counting every phrase in Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barcraft.llm import collocations as c
from barcraft.llm.scratch import Scratch
from tests.llm.conftest import AWKWARD, make_docs


def plain_counts(rows, longest=5):
    """({(lang, phrase): f}, {lang: words})"""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    f[lang, " ".join(words[i : i + k])] += 1
    return f, n


def plain(rows, least, top=2000, percent=100, longest=5):
    f, n = plain_counts(rows, longest)
    cands = {k: v for k, v in f.items() if v >= least and " " in k[1]}
    gone = set()
    for (lang, phrase), a in cands.items():
        w = phrase.split(" ")
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                short = lang, " ".join(w[i : i + k])
                if 100 * a >= percent * cands[short]:
                    gone.add(short)
    out = {}
    for (lang, phrase), a in cands.items():
        if (lang, phrase) not in gone:
            w = phrase.split(" ")
            cuts = [(1000 * a * n[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, phrase.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def found(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["of", "the", "New", "york", "city", "hall", "ß", "Éa", "x y", "a\u0085b", "\x00", "漢字", "rare%d"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(60)):
            text += rng.choice(words[:6] + words) .replace("%d", str(rng.randrange(50))) + rng.choice([" "] * 12 + ["\t", "  ", ", ", ".", "\n", "\r", "\x0b", "! "])
            if rng.random() < 0.08:
                text += "in the new York city hall of fame "
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize(("least", "percent", "top", "shard"), [(5, 100, 2000, 1 << 20), (3, 60, 2000, 700), (8, 100, 7, 90), (1, 100, 2000, 300)])
def test_equals_counting(spark, least, percent, top, shard):
    rows = corpus(least)
    assert found(c.collocations(make_docs(spark, rows), least=least, percent=percent, top=top, shard_words=shard)) == plain(rows, least, top, percent)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r[0], r[1], "en") for r in AWKWARD]
    assert found(c.collocations(awkward, least=2)) == plain(rows, 2)
    assert found(c.collocations(nothing)) == []
    assert found(c.collocations(make_docs(spark, [(1, None), (2, "a b"), (3, ", , ,")]), least=2)) == []
    same = [(7, "over and over again " * 40, "en")] * 3
    assert found(c.collocations(make_docs(spark, same), least=50)) == plain(same, 50)


def test_repeated_rows_and_ties(spark):
    rows = [(1, "b a. d c. f e", "en")] * 4 + [(2, "a", None)]
    got = found(c.collocations(make_docs(spark, rows), least=4))
    assert got == plain(rows, 4) and [r[2] for r in got] == ["b a", "d c", "f e"]


def test_long_text_in_slices():
    """Shards and slices that end inside a text lose no phrase and count none twice."""
    rng = random.Random(9)
    text = " ".join(rng.choice(["a", "b", "c", "d,", "e"]) for _ in range(3000))
    f, n = plain_counts([(1, text, "en")])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    for slice_bytes, size in ((7, 40), (1, 1), (100, 64), (64, 5000)):
        total, pairs = Counter(), 0
        whole = np.full(1 << (c.FILTER_BITS - 6), ~np.uint64(0))
        for sign, shard in c.shards(iter([batch]), size, slice_bytes):
            for out in (*shard.word_counts(sign), *shard.phrase_counts(sign, 5, whole)):
                for row in out.to_pylist():
                    total[row["lang"], row["phrase"]] += row["c"]
            pairs += sum(sum(out.column("c").to_pylist()) for out in shard.pair_counts(sign, whole))
        assert pairs == sum(v for (_, p), v in f.items() if p.count(" ") == 1)
        assert total.pop(("en", None)) == n["en"]
        assert {k: v for k, v in total.items() if v} == dict(f)


def test_scores_beyond_64_bits(spark):
    found_ = spark.createDataFrame([("en", "a b", 2, 10**12), ("en", "a", 1, 3 * 10**12 + 1), ("en", "b", 1, 7 * 10**11 + 3)], "lang string, phrase string, n int, a long")
    words = spark.createDataFrame([("en", 9 * 10**13 + 7)], "lang string, words long")
    assert c.scored(found_, words).first()["score"] == 1000 * 10**12 * (9 * 10**13 + 7) // ((3 * 10**12 + 1) * (7 * 10**11 + 3))


def test_frequent_phrases_survive_a_full_bitmap(spark, monkeypatch):
    """Few bits: nearly all are set, counts stay right."""
    monkeypatch.setattr(c, "bitmap", lambda df, bits=8, real=c.bitmap: real(df, 8))
    rows = corpus(11, 60)
    assert found(c.collocations(make_docs(spark, rows), least=4)) == plain(rows, 4)


def test_counts_are_exact(spark):
    rows = corpus(12)
    f, n = plain_counts(rows)
    got, words = c.phrase_counts(Scratch(spark, "t"), make_docs(spark, rows).select("lang", "text"), least=6, shard_words=500)
    assert {(r.lang, r.phrase): r.a for r in got.collect()} == {k: v for k, v in f.items() if v >= 6}
    assert {r.lang: r.words for r in words.collect() if r.words} == dict(+n)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 5))
def test_suffix_array_intervals(ids, longest):
    a = np.array(ids, np.int64)
    got = {}
    for n, at, size in c.phrases(a, 1, longest):
        got |= {tuple(ids[i : i + n]): int(s) for i, s in zip(at.tolist(), size.tolist(), strict=True)}
    want = Counter(tuple(ids[i : i + n]) for n in range(1, longest + 1) for i in range(len(ids) - n + 1))
    assert got == {k: v for k, v in want.items() if 0 not in k}


def test_what_is_beyond_the_end_is_no_word():
    """Without any sentinel the least rank must not be taken for the end of the shard."""
    got = {n: sorted(size.tolist()) for n, _, size in c.phrases(np.array([1, 1, 1, 1], np.int64), 1, 3)}
    assert got == {1: [4], 2: [3], 3: [2]}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(1, 3), st.randoms())
def test_linked_runs(ids, least, rng):
    a = np.array(ids, np.int64)
    linked = np.array([rng.random() < 0.6 for _ in ids[1:]], bool)
    for links in (None, linked):
        runs, run = [], []
        for i, x in enumerate(ids):
            if x and run and links is not None and not links[i - 1]:
                runs.append(run)
                run = []
            if x:
                run.append(x)
            elif run:
                runs.append(run)
                run = []
        runs = [r for r in [*runs, run] if len(r) >= max(least, 1)]
        assert c.linked_runs(a, links, least).tolist() == [y for r in runs for y in [*r, 0]]
