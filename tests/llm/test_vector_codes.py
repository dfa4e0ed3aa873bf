"""Operator 13 against Lloyd's iteration written out in Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barcraft.llm.scratch import Scratch
from barcraft.llm.vector_codes import Part, assign_again, assign_first, fit_and_assign, usable, vector_codes
from tests.llm.conftest import CLASHES

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in [*CLASHES, "v", "code", "upper", "lower", "error", "part_", "s"] if c != "label"})


def plain(rows, entries, parts=4, rounds=4):
    """{position among kept rows: (vec_id, code, error, label_error, digest)} the slow way."""
    kept = [(i, [math.floor(x * 1024) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        codes = [[min(range(len(b)), key=lambda e: (far(cut(v, p), b[e]), e)) for p, b in enumerate(books)] for _, v, _ in kept]
        if r < rounds:
            for p, b in enumerate(books):
                for e in range(len(b)):
                    mine = [cut(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == e]
                    if mine:
                        b[e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes, strict=True)]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{x:02x}" for x in c), e, by_label[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)]
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def cloud(seed, n, width=8, copies=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, width)) * 4) / 16  # a coarse grid: many equal distances
    return [(i, [float(x) for x in v[i // copies]], int(i) % 3 if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "copies"), [(1, 90, 1), (2, 120, 6), (3, 40, 40)])
def test_equals_plain_iteration(spark, seed, n, copies):
    rows = cloud(seed, n, copies=copies)
    assert found(vector_codes(table(spark, rows), entries=16)) == plain(rows, 16)


def test_awkward_rows(spark):
    rows = cloud(4, 30) + [(100, None, 1), (101, [None] + [0.5] * 7, 1), (102, [float("nan")] * 8, 1), (103, [float("-inf")] + [0.0] * 7, 2)]
    rows += [(5, [0.25] * 8, 1), (5, [-0.25] * 8, 1), (None, [0.125] * 8, None), (None, [0.125] * 8, None), (-7, [-0.0001] * 8, 9), (104, [1e-30] * 8, None)]
    assert found(vector_codes(table(spark, rows), entries=16)) == plain(rows, 16)
    few = rows[:3]
    assert found(vector_codes(table(spark, few))) == plain(few, 256)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 2)]):
        df = vector_codes(table(spark, rows))
        assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and df.count() == 0


def test_vectors_without_equal_parts_or_of_another_length_are_left_out(spark):
    rows = cloud(8, 20)
    odd = [(50, [], 1), (51, [0.5] * 7, 1), (52, [0.5] * 12, 1), (-1, [0.5] * 4, 1)]
    assert found(vector_codes(table(spark, rows + odd), entries=8)) == plain(rows, 8)
    assert vector_codes(table(spark, odd[:2])).count() == 0


def test_components_that_could_overflow_are_errors(spark):
    with pytest.raises(Exception, match="would not fit"):
        vector_codes(table(spark, [(1, [16_384.0] * 8, 1)])).collect()


def test_far_components_keep_exact_distances(spark):
    rows = [(i, [(-1.0) ** i * 16_300.5 + i] * 8, 0) for i in range(12)]
    assert found(vector_codes(table(spark, rows), entries=4)) == plain(rows, 4)


def test_bounds_save_most_comparisons(spark):
    """Clustered vectors: after the first assignment few distances are computed."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(32, 8))
    rows = [(i, [float(x) for x in middles[i % 32] + rng.normal(size=8) / 50], 0) for i in range(600)]
    scratch = Scratch(spark, "codes-test")
    state, books = fit_and_assign(scratch, scratch.write("kept", usable(table(spark, rows))), entries=32)
    compared = state.groupBy().sum("compared").first()[0]
    assert compared < 600 * 4 * 32 / 4
    assert len(books) == 4 and all(p.book.shape == (32, 2) for p in books)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 40), st.sampled_from([1, 3, 40]))
def test_bounds_never_change_an_assignment(seed, k, n, spread):
    """Any movement of entries: assignments from shifted bounds are those of all distances."""
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-spread, spread + 1, (n, 2)), rng.integers(-spread, spread + 1, (k, 2))
    part = Part(book.astype(np.int64), np.zeros(k), 1.0)
    part.measure()
    part.step = max(part.half.max() / 4, 0.5)
    entry, upper, lower, _ = assign_first(x, part)
    for _ in range(3):
        new = part.book + rng.integers(-2, 3, part.book.shape)
        part.moved = np.sqrt(((new - part.book) ** 2).sum(axis=1).astype(float)) * (1 + 1e-9)
        part.book = new
        part.measure()
        entry, upper, lower, _ = assign_again(x, part, entry, upper, lower)
        assert entry.tolist() == assign_first(x, part)[0].tolist()
