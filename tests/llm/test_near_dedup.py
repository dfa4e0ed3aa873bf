"""Near duplicates against brute force over full shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from barcraft.llm import components, near_dedup
from barcraft.llm.components import UnionFind, connected_components
from barcraft.llm.near_dedup import keep_one_of_each, near_duplicates, shingle_sets
from barcraft.llm.scratch import Scratch
from barcraft.llm.superminhash import signatures
from barcraft.llm.text import mix
from tests.llm.conftest import AWKWARD, make_docs, text_of, thue_morse


def shingles(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    known = UnionFind()
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                known.union(i, j)
    return {i: (len(x), known.find(i)) for i, x in sets}


def near_copies(n, group, rate, seed=3):
    rng = random.Random(seed)
    base = text_of(99, 200).split()
    rows = []
    for i in range(n):
        words = list(base)
        for k in range(len(words)):
            if rng.random() < rate * rng.random():
                words[k] = f"new{rng.randrange(10**6)}"
        rows.append((1000 * group + i, " ".join(words)))
    return rows


def check(spark, rows, **parameters):
    got = near_duplicates(make_docs(spark, rows), **parameters).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_awkward_rows(spark):
    check(spark, [r for r in AWKWARD if r[1] is None or len(r[1]) < 200_000])


def test_group_of_several_blocks(spark):
    check(spark, near_copies(120, 1, 0.05) + near_copies(40, 2, 0.02, 5) + [(i, text_of(1, 30)) for i in range(30)], block=16)


def test_empty_table(spark, nothing):
    assert near_duplicates(nothing).count() == 0


def test_keeps_one_row_of_each_with_all_columns(spark, awkward):
    kept = keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and 8 not in ids and 6 not in ids and ids.count(None) == 2 and {1, 2, 3} <= set(ids)


def one_by_one(elements, m):
    """SuperMinHash as a loop over elements, without early stopping."""
    out = [None] * m
    for e in elements:
        place = list(range(m))
        for j in range(m):
            draw = int(mix(np.array([(int(e) + (2 * j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            rank = (int(mix(np.array([draw ^ 0xA5A5A5A5A5A5A5A5], np.uint64))[0]) & (2**56 - 1)) | j << 56
            k = j + ((draw >> 32) * (m - j) >> 32)
            place[j], place[k] = place[k], place[j]
            if out[place[j]] is None or rank < out[place[j]]:
                out[place[j]] = rank
    return out


def test_signatures_equal_the_plain_algorithm():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40):
        e = rng.integers(0, 2**63, n).astype(np.uint64)
        assert signatures(e, np.zeros(n, np.int64), 1, 24)[0].tolist() == one_by_one(e, 24)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 600).astype(np.uint64)
    a, b = np.sort(pool[:500]), np.sort(pool[100:])
    s = signatures(np.concatenate((a, b)), np.repeat([0, 1], 500), 2, 250)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.1


@pytest.mark.parametrize("local", [1 << 18, 20, 1])
def test_components_of_chains_stars_and_loops(spark, local, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 300)] + [(500, 500), (7, 7), (None, 3)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    known = UnionFind()
    for a, b in edges:
        if a is not None:
            known.union(a, b) if a != b else known.parent.setdefault(a, a)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["label"] for r in connected_components(df, Scratch(spark, "test")).collect()}
    assert got == {x: known.find(x) for x in known.parent}


def test_shingle_sets_lower_ascii_only():
    h, o = shingle_sets(["A B C D É".encode(), "a b c d É".encode(), "a b c d é".encode()])
    assert len(h) == 3 and h[0] == h[1] != h[2] and o.tolist() == [0, 1, 2]


def table_of(rows, **extra):
    """rows of (node, text) as a table that links are looked for in."""
    h, owner = shingle_sets([t.encode() for _, t in rows])
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    keys = near_dedup.band_keys(signatures(h, owner, len(rows), 125), 25, 5)
    return pa.table({"node": [i for i, _ in rows], "bands": keys.tolist(), "set": [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], **extra})


def pairs_of(table, threshold=85):
    links = near_dedup._link(threshold)(table)
    return {frozenset(x) for x in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True)}


def test_pairs_with_a_common_band_are_compared_on_full_sets():
    base = text_of(1, 200)
    rows = [(1, base), (2, base + " end"), (3, text_of(2, 200)), (4, base[: len(base) // 2])]
    assert pairs_of(table_of(rows)) == {frozenset((1, 2))}
    t = table_of(rows)
    one = [r[:] for r in t["bands"].to_pylist()]
    one[2][7] = one[0][7]  # a common band alone makes no link
    odd = t.set_column(1, "bands", pa.array(one))
    assert pairs_of(odd) == {frozenset((1, 2))}


def test_probes_components_and_first_common_bands():
    base = text_of(1, 300)
    rows = [(i, base + f" end{i}") for i in range(1, 5)]
    assert pairs_of(table_of(rows, probe=[True, False, False, False])) == {frozenset((1, i)) for i in (2, 3, 4)}
    assert pairs_of(table_of(rows, comp=[1, 1, 3, 3])) and not pairs_of(table_of(rows, comp=[1, 1, 1, 1]))
    keys = table_of(rows)["bands"].to_pylist()
    common = [k for k in range(25) if keys[0][k] == keys[1][k]]
    two = rows[:2]
    assert pairs_of(table_of(two, key=[keys[0][common[0]]] * 2)) == {frozenset((1, 2))}
    assert not pairs_of(table_of(two, key=[keys[0][common[1]]] * 2))


def chain(n, words=60, step=6, seed=11):
    """Texts each like the next (about 0.6) and unlike those further on: one candidate group, few links."""
    pool = text_of(seed, words + n * step).split()
    pool = [f"{w}x{i}" for i, w in enumerate(pool)]
    return [(i, " ".join(pool[i * step : i * step + words])) for i in range(n)]


def test_a_chained_candidate_group_of_thousands(spark):
    """Every text is a candidate of its neighbours; some neighbours are near copies."""
    rows = chain(2500)
    rows += [(100_000 + i, t + " tail") for i, t in rows[::50]]
    got = {r["doc_id"]: r for r in near_duplicates(make_docs(spark, rows, extra=False), block=64).collect()}
    sets = {i: shingles(t) for i, t in rows}
    known = UnionFind()
    for i, t in rows:  # neighbours further away share nothing
        for j in (*range(i + 1, i + 12), i + 100_000, *range(100_000 + i, 100_000 + i + 12)):
            if j in sets:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    known.union(i, j)
    assert {i: r["component_id"] for i, r in got.items()} == {i: known.find(i) for i in sets}
    assert len({r["component_id"] for r in got.values()}) == 2500


def test_a_large_cluster_falls_together_by_hubs(spark, monkeypatch):
    """Near copies of one text: hubs alone join all but a few."""
    rows = near_copies(600, 1, 0.04, 8)
    check(spark, rows, block=32)


def test_rows_of_settled_buckets_do_not_go_on(spark, monkeypatch):
    """Only rows of buckets that hold several components meet the components of a round."""
    rows = {}

    def write(self, name, df, real=Scratch.write, **options):
        out = real(self, name, df, **options)
        if name in ("wide_keys", "where0", "where1"):
            rows[name] = [(r["key"], r.asDict().get("comp", r["node"])) for r in out.collect()]
        return out

    monkeypatch.setattr(Scratch, "write", write)
    check(spark, near_copies(120, 1, 0.05) + near_copies(60, 2, 0.0005, 5), block=16)
    for before, after in (("wide_keys", "where0"), ("where0", "where1")):
        comps = {}
        for key, comp in rows[before]:
            comps.setdefault(key, set()).add(comp)
        assert {key for key, _ in rows[after]} == {key for key, c in comps.items() if len(c) > 1}
    assert len(rows["where0"]) < len(rows["wide_keys"])


def test_sets_larger_than_a_cell(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    check(spark, near_copies(40, 1, 0.03, 9) + [(5000, text_of(2, 20_000)), (5001, text_of(2, 20_000) + " end")])


def test_ids_used_for_several_texts_cost_each_other_nothing(spark):
    rows = [(1, text_of(1, 60)), (1, text_of(2, 60)), (1, text_of(2, 60)), (2, text_of(2, 60) + " end"), (3, None), (3, None), (4, "  ")]
    kept = sorted((r["doc_id"], r["text"] or "") for r in keep_one_of_each(make_docs(spark, rows)).collect())
    assert kept == sorted([(1, text_of(1, 60)), (1, text_of(2, 60)), (3, ""), (3, ""), (4, "  ")])


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_that_polynomials_confuse(spark, n):
    """Words that differ everywhere are not linked, alone or among equal words."""
    one, other = thue_morse(n)
    rows = [(1, one), (2, other), (3, f"{one} x"), (4, f"{other} x"), (5, f"a b c d {one} e f"), (6, f"a b c d {other} e f"), (7, one.upper())]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 1}
