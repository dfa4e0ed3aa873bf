"""Quality rules, substring dedup, decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barcraft.llm import decontaminate, quality, substring_dedup
from barcraft.llm.text import Words
from tests.llm.conftest import AWKWARD, CLASHES, WORDS, make_docs, text_of, thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_words_and_hashes_do_not_depend_on_the_neighbours():
    a, b = Words([b"aa bb", b"", b" cc\n"]), Words([b"cc"])
    assert [a.data[s:e] for s, e in zip(a.start, a.end, strict=True)] == [b"aa", b"bb", b"cc"]
    assert a.hash[2] == b.hash[0] and a.counts.tolist() == [2, 0, 1]
    assert Words([b""]).counts.tolist() == [0] and Words([]).hash.size == 0


def brute_quality(text):
    words = WORD.findall(text or "")

    def cover(n):
        seen: dict = {}
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i : i + n]), []).append(i)
        return {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)}

    lines, seen, dup, dup_chars = (text or "").split("\n"), set(), 0, 0
    for line in lines:
        if line in seen and WORD.search(line):
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, WORD.findall(line)))
        seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(cover(8)), "dup_line_chars": dup_chars}
    return out | {f"dup{n}_chars": sum(len(words[i]) for i in cover(n)) for n in quality.GRAM_PERCENT}


REPEATS = [(20, " ".join(["a b c d e f"] * 9)), (21, "\n".join(["one line of five words here"] * 4)), (22, text_of(8, 40) + " " + text_of(8, 40)), (23, "#|<> & $%* x\n#|<> & $%* x\n\n\n"), (24, "\x0b".join(WORDS) + "\r\n" + "\f".join(WORDS))]


def test_quality_measures(spark):
    rows = AWKWARD + REPEATS
    got = quality.repetition_quality(make_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(brute_quality(t))
    for r in got:
        assert {k: r[k] for k in quality.MEASURES} in want[r["doc_id"]]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert {r["doc_id"] for r in got if r["kept"]} >= {7, 8, -3} and not {r["doc_id"] for r in got if r["kept"]} & {20, 21, 22}


def unique(n, seed=0):
    return [f"u{seed}w{i}" for i in range(n)]


def repeated(n, percent, total=400):
    """A text of one-letter-like words of which about ``percent`` percent stand in n-grams that occur twice."""
    gram = [f"r{i:04}x" for i in range(n)]
    times = round(total * percent / 100 / n)
    filler = [f"f{i:04}y" for i in range(total - n * times)]
    step, out = len(filler) // times, []
    for k in range(times):
        out += gram + filler[k * step : (k + 1) * step]
    return " ".join(out + filler[times * step :])


@pytest.mark.parametrize("n", list(quality.GRAM_PERCENT))
def test_each_length_rejects_what_no_other_rule_does(n):
    limit = quality.GRAM_PERCENT[n]
    text = repeated(n, limit + 0.6, 2400).encode()
    m = {k: int(v[0]) for k, v in quality.measure([text]).items()}
    over = [k for k, p in quality.GRAM_PERCENT.items() if 100 * m[f"dup{k}_chars"] > p * m["word_chars"]]
    assert over == [n] and 100 * m["n_repeat_words"] <= 30 * m["n_words"] and not m["dup_line_chars"]
    calm = {k: int(v[0]) for k, v in quality.measure([repeated(n, limit - 1.5, 2400).encode()]).items()}
    assert not [k for k, p in quality.GRAM_PERCENT.items() if 100 * calm[f"dup{k}_chars"] > p * calm["word_chars"]]


def test_lines_reject_what_no_length_does():
    lines = [" ".join(unique(5, i)) + ("\nsame short line" * 2 if i == 3 else "\nsame short line") for i in range(12)]
    text = "\n".join(lines).encode()
    m = {k: int(v[0]) for k, v in quality.measure([text]).items()}
    assert 100 * m["dup_line_chars"] > quality.LINE_PERCENT * m["word_chars"]
    assert not [n for n, p in quality.GRAM_PERCENT.items() if 100 * m[f"dup{n}_chars"] > p * m["word_chars"]]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_windows_that_polynomials_confuse(n):
    one, other = thue_morse(n)
    text = f"{one} b c d e f g h. {other} b c d e f g h."
    assert quality.measure([text.encode()])["n_repeat_words"].tolist() == [0]
    assert quality.measure([f"{text} {one} b c d e f g h.".encode()])["n_repeat_words"].tolist() == [16]
    assert len(set(Words([f"{one} {other}".encode()]).hash.tolist())) == 2


def test_quality_of_nothing_and_kept_rows(spark, awkward, nothing):
    assert quality.repetition_quality(nothing).count() == 0
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and {r["key"] for r in kept.collect()} == {"x0"}


def brute_substrings(rows, window=20):
    docs = sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0])
    first: dict = {}
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, words in split:
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), (i, k))
    out = {}
    for i, words in split:
        gone = {k + d for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] != (i, k) for d in range(window)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


PASSAGES = [(30 + i, text_of(100 + i, 15 + i) + " " + text_of(77, 55) + " " + text_of(200 + i, 30)) for i in range(12)] + [(60, "w " * 90), (61, "w " * 25 + text_of(3, 40)), (62, text_of(9, 19)), (63, text_of(9, 20)), (64, text_of(9, 20))]


@pytest.mark.parametrize("hot", [512, 1])
def test_substrings(spark, hot, monkeypatch):
    """Also with minimisers ranked last that are found in a single sampled window."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    rows = AWKWARD + PASSAGES + [(70, text_of(2, 20_000)), (71, text_of(2, 300))]
    got = substring_dedup.substring_dedup(make_docs(spark, rows)).collect()
    want = brute_substrings(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]


def test_substrings_in_small_chunks_and_bins(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 700)
    monkeypatch.setattr(substring_dedup, "BIN", 900)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(make_docs(spark, PASSAGES)).collect()}
    assert got == {i: v[1] for i, v in brute_substrings(PASSAGES).items()}


@pytest.mark.parametrize("partitions", [1, 3, 5000])
def test_bins_that_share_a_partition(spark, monkeypatch, partitions):
    """Many bins give the same result in any number of partitions, common windows among them."""
    for name, value in {"HOT": 3, "SAMPLE": 1, "CHUNK": 1500, "BIN": 700}.items():
        monkeypatch.setattr(substring_dedup, name, value)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(make_docs(spark, PASSAGES), most_partitions=partitions).collect()}
    assert got == brute_substrings(PASSAGES)


def test_a_passage_in_every_document(spark, monkeypatch):
    """Frequent windows go through both steps, with several salts, and bins are opened part by part."""
    for name, value in {"HOT": 3, "SAMPLE": 1, "CHUNK": 1500, "BIN": 4000, "FAN": 2, "OPEN": 300}.items():
        monkeypatch.setattr(substring_dedup, name, value)
    rows = [(i, text_of(1000 + i, 10 + i % 7) + " " + text_of(77, 55) + " " + text_of(3000 + i, 12)) for i in range(150)]
    salted = []
    real = substring_dedup._sort
    monkeypatch.setattr(substring_dedup, "_sort", lambda *a: salted.append(a) or real(*a))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(make_docs(spark, rows)).collect()}
    assert got == brute_substrings(rows) and len(salted) == 2
    assert sum(v[1] for v in got.values()) >= 149 * 55
    hot = salted[0][3].value
    assert len(hot) and substring_dedup._minimisers(Words([text_of(77, 55).encode()]), 20, 4, hot)[1].all()


def test_frequent_minimisers_stay_within_their_bound(spark, monkeypatch):
    for name, value in {"HOT": 2, "SAMPLE": 1, "MOST_HOT": 5, "CHUNK": 2000}.items():
        monkeypatch.setattr(substring_dedup, name, value)
    from barcraft.llm.scratch import Scratch

    rows = make_docs(spark, [(i, text_of(77, 55 + i)) for i in range(60)] + [(100 + i, text_of(i % 5, 40)) for i in range(60)], extra=False)
    found = substring_dedup._hot_minimisers(rows.withColumn("text_hash", F.xxhash64("text")), 20, 4, Scratch(spark, "test"))
    assert len(found) <= 5


def test_ids_used_for_several_texts_lose_only_their_own_words(spark):
    same = text_of(5, 50)
    rows = [(1, same), (2, "lead " + same), (2, text_of(6, 40)), (2, text_of(6, 40)), (3, text_of(6, 40))]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(make_docs(spark, rows)).collect())
    assert got == [(1, 50, 0), (2, 40, 0), (2, 40, 0), (2, 51, 50), (3, 40, 40)]


def test_equal_hashes_are_settled_by_the_texts(monkeypatch):
    import numpy as np

    words = Words([text_of(1, 30).encode(), text_of(2, 30).encode(), text_of(1, 30).encode()])
    at = np.concatenate([np.arange(11) + 30 * i for i in range(3)])
    got = substring_dedup._repeats(words, at, np.zeros(33, np.uint64), (np.repeat([1, 2, 3], 11), np.zeros(33, np.int64), np.tile(np.arange(11), 3)), 20)
    assert got.tolist() == [False] * 22 + [True] * 11


def test_substrings_of_nothing(nothing):
    assert substring_dedup.substring_dedup(nothing).count() == 0


ITEMS = [(1, text_of(77, 40)), (2, "Short ITEM here"), (3, None), (4, "..."), (5, text_of(77, 40)), (6, text_of(500, 30)), (7, "Éa,ß! 漢字"), (10, text_of(77, 12)), (8, "dup dup dup dup dup dup dup dup dup dup dup dup")]
TAINTED = [(40, "before short. item: HERE, after"), (41, text_of(77, 55)), (42, text_of(77, 9)), (43, text_of(500, 30).upper()), (44, "x éa ß 漢字 y Éa-ß-漢字"), (45, "dup " * 30), (46, "short item short item here here"), (None, text_of(77, 55)), (41, "clean text of the same id")]


def brute_hits(text, items, window=10):
    words = TOKEN.findall(lower(text))
    hit, names = set(), set()
    for item, t in items:
        w = TOKEN.findall(lower(t))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            g = w[k : k + window]
            for p in range(len(words) - len(g) + 1):
                if words[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def items_table(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("y") for c in CLASHES})


def test_contamination(spark):
    rows = AWKWARD + TAINTED
    got = decontaminate.contamination(make_docs(spark, rows), items_table(spark)).collect()
    want = sorted((str(i), *brute_hits(t, ITEMS)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert sum(r["contaminated"] for r in got) == 8


def test_contamination_of_and_by_nothing(spark, awkward, nothing):
    none = items_table(spark).where("item_id < 0")
    assert decontaminate.contamination(nothing, items_table(spark)).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(awkward, none).collect())


def test_contaminated_rows_go(spark):
    docs = make_docs(spark, TAINTED)
    kept = decontaminate.drop_contaminated(docs, items_table(spark))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"][:5]) for r in kept.collect()) == [(41, "clean"), (42, text_of(77, 9)[:5])]


def brute_matches(rows, items, window=10, slop=2):
    """(document row, item, start, len) of the exact and of the near matches."""
    split = [TOKEN.findall(lower(t)) for _, t in rows]
    counts = Counter(w for words in split for w in words)
    exact, near = set(), set()
    for item, t in items:
        w = TOKEN.findall(lower(t))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            g = w[k : k + window]
            order = sorted(range(len(g)), key=lambda i: (counts[g[i]], g[i], i))
            a, b = order[0], order[min(1, len(order) - 1)]
            for n, words in enumerate(split):
                places = [p - b for p, x in enumerate(words) if x == g[b]] if g[a] in words else []
                for start in {p - a for p, x in enumerate(words) if x == g[a]}:
                    if start < -slop or not any(abs(start - p) <= slop for p in places):
                        continue
                    if start >= 0 and words[start : start + len(g)] == g:
                        exact.add((n, item, start, len(g)))
                    elif set(g) <= set(words[max(0, start - slop) : start + len(g) + slop]):
                        near.add((n, item, start, len(g)))
    return exact, near


def shuffled(seed, words):
    import random

    rng, out = random.Random(seed), list(words)
    for _ in range(2):
        k = rng.randrange(len(out) - 1)
        out[k], out[k + 1] = out[k + 1], out[k]
    return out


def test_phrase_and_proximity_matches(spark):
    base = text_of(500, 30).split()
    rows = [(i, t) for i, (_, t) in enumerate(AWKWARD + TAINTED)]
    rows += [(100 + i, " ".join([*base[3:6], *shuffled(i, base[: 12 + i % 9]), "tail"])) for i in range(12)] + [(200, " ".join(base[1:25])), (201, "item short here"), (202, "here far from short and item")] + [(300 + k, " ".join(base[k + 2 : k + 10] + base[k : k + 2])) for k in range(8)]
    got = {r["doc_id"]: r for r in decontaminate.contamination(make_docs(spark, rows), items_table(spark)).collect()}
    exact, near = brute_matches(rows, ITEMS)
    at = {i: n for n, (i, _) in enumerate(rows)}
    assert {(at[i], m["item_id"], m["start"], m["len"]) for i, r in got.items() for m in r["matches"]} == exact
    assert {(at[i], m["item_id"], m["start"], m["len"]) for i, r in got.items() for m in r["near_matches"]} == near
    assert len(exact) > 50 and len(near) > 20 and any(s < 0 for _, _, s, _ in near)


def test_keys_that_collide_share_no_matches(spark, monkeypatch):
    """Documents of one key keep their own matches: rows are grouped by a second hash, too."""
    base = text_of(500, 30).split()
    docs = make_docs(spark, TAINTED + [(100 + i, " ".join([*base[3:6], *shuffled(i, base[: 12 + i % 9]), "tail"])) for i in range(12)])
    columns = ["doc_id", "n_hit", "items_sha256", *(decontaminate.listed(F.col(c)).alias(c) for c in ("matches", "near_matches"))]
    found = lambda: sorted(map(str, decontaminate.contamination(docs, items_table(spark)).select(*columns).collect()))
    want = found()
    monkeypatch.setattr(decontaminate, "_keyed", lambda d, real=decontaminate._keyed: real(d).withColumn("key", F.lit(7).cast("long")))
    assert found() == want and any("6:" in x for x in want)


def test_a_vocabulary_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 3)
    rows = TAINTED + [(50, text_of(9, 40))]
    got = decontaminate.contamination(make_docs(spark, rows), items_table(spark)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == sorted((str(i), *brute_hits(t, ITEMS)) for i, t in rows)


def test_proximity_finds_shuffled_words(spark):
    w = text_of(500, 30).split()[:10]
    moved = [w[1], w[0], *w[2:8], w[9], w[8]]
    docs = make_docs(spark, [(1, "lead in " + " ".join(moved) + " tail"), (2, " ".join(w)), (3, " ".join(w[:5]) + " far " * 9 + " ".join(w[5:]))])
    one = spark.createDataFrame([(6, " ".join(w))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, one).collect()}
    assert len(got[1]["near_matches"]) == 1 and not got[1]["contaminated"] and not got[2]["near_matches"] and got[2]["contaminated"] and not got[3]["near_matches"]
