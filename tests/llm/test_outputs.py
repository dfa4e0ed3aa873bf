"""Sharding, token files, mixing, WARC and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from barcraft.llm import mixing, sharding, token_output, warc
from barcraft.llm.scratch import Scratch
from tests.llm.conftest import AWKWARD, make_docs, text_of


def brute_shards(rows, limit):
    keyed = [(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), len((t or "").encode())) for i, t in rows]
    out = []
    for h, _ in keyed:
        for depth in range(61):
            same = [(g, b) for g, b in keyed if g >> (60 - depth) == h >> (60 - depth)]
            if sum(b for _, b in same) <= limit or len({g for g, _ in same}) == 1:
                out.append((format(h >> (60 - depth), f"0{depth}b") if depth else "", sum(b for _, b in same)))
                break
    return out


def test_shards(spark):
    rows = [(i, text_of(i, 5 + i % 30)) for i in range(300)] + [(1000, None), (1001, "")]
    got = sharding.shards(make_docs(spark, rows), 2000).collect()
    want = {r[0]: w for r, w in zip(rows, brute_shards(rows, 2000), strict=True)}
    assert {r["doc_id"]: (r["shard"].removeprefix("b"), r["shard_bytes"]) for r in got} == want
    assert len({r["depth"] for r in got}) > 1 and max(r["shard_bytes"] for r in got) <= 2000


def test_one_key_larger_than_a_shard_becomes_pages(spark):
    rows = [(5, "x" * (40 + i % 7)) for i in range(200)] + [(6, "y" * 5000), (7, "z")]
    got = sharding.shards(make_docs(spark, rows), 500).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["n_bytes"]
    assert len(got) == 202 and all(v <= 500 or k == next(r["shard"] for r in got if r["doc_id"] == 6) for k, v in sizes.items())
    assert {r["shard"]: r["shard_bytes"] for r in got} == dict(sizes)


@pytest.mark.parametrize("large", [[], [4950], [10_000], [2600, 4950, 5000, 5001, 30_000, 2500, 0]])
def test_pages_stay_full_beside_large_rows(spark, large):
    """Rows of mixed sizes under one key: pages are numbered without gaps, none exceeds the limit
    but a row that does alone, and there are no more than their bytes need."""
    rows = [(5, "x" * (90 + i % 25) + str(i)) for i in range(300)] + [(5, "y" * n) for n in large] + [(None, "")] * 3 + [(None, "z" * 800)] * 40
    got = sharding.shards(make_docs(spark, rows), 5000).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    for key in (5, None):
        sizes, names = Counter(), Counter()
        for r in got:
            if r["doc_id"] == key:
                sizes[r["shard"]] += r["n_bytes"]
                names[r["shard"]] += 1
        assert all(v <= 5000 or names[k] == 1 for k, v in sizes.items())
        assert {r["shard"]: r["shard_bytes"] for r in got if r["doc_id"] == key} == dict(sizes)
        own = [len(t) for i, t in rows if i == key]
        assert len(sizes) <= 2 * sum(n for n in own if n <= 2500) / 5000 + 1 + sum(n > 2500 for n in own)
        pages = sorted(int(k.split("-")[1]) if "-" in k else 0 for k in sizes)
        assert pages == list(range(len(sizes)))


def test_many_levels_are_summed_in_spans(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPAN", 3)
    rows = [(i, text_of(i, 3 + i % 20)) for i in range(400)]
    got = sharding.shards(make_docs(spark, rows), 300).collect()
    want = {r[0]: w for r, w in zip(rows, brute_shards(rows, 300), strict=True)}
    assert {r["doc_id"]: (r["shard"].removeprefix("b"), r["shard_bytes"]) for r in got} == want


def test_pages_do_not_depend_on_the_layout(spark):
    rows = [(5, "x" * (10 + i % 9) + str(i % 40)) for i in range(400)] + [(6, "same text") for _ in range(200)] + [(7, None)] * 3
    docs = make_docs(spark, rows)
    found = [Counter((r["doc_id"], r["n_bytes"], r["shard"], r["shard_bytes"]) for r in sharding.shards(docs.repartition(n), 400).collect()) for n in (1, 4, 11)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
    texts = [Counter((r["text"], r["shard_"]) for r in sharding.sharded(docs.repartition(n), 400).collect()) for n in (2, 7)]
    assert texts[0] == texts[1]


def test_awkward_shards(spark, awkward, nothing):
    assert sharding.shards(awkward).count() == len(AWKWARD) and sharding.shards(nothing).count() == 0
    out = sharding.sharded(awkward, 1000)
    assert out.columns == [*awkward.columns, "shard_"] and out.count() == len(AWKWARD)


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_word_encoder_equals_the_tokenizer(tokenizer):
    plain = token_output.load_tokenizer(tokenizer)
    texts = [t or "" for _, t in AWKWARD] + ["<|endoftext|> It's<|startoftext|>a b é ́x DON'T", "H̱ello J̌ K. 'S. end!! a,b c., d.¦ ¦ x¦y 12. a1. <|ENDOFTEXT|>", "don't. we're! A. B, É."]
    ids, n = token_output.WordEncoder(plain).encode([t.encode() for t in texts])
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_token_files_round_trip(spark, tokenizer):
    plain = token_output.load_tokenizer(tokenizer)
    rows = AWKWARD
    got = token_output.token_files(make_docs(spark, rows), tokenizer, sequence=64).collect()
    want, at = Counter(), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = {}
    for i, t in ordered:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        start.setdefault(i, at)
        at += len(ids)
        want[i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    first = {}
    for r in got:
        first[r["doc_id"]] = min(first.get(r["doc_id"], r["start"]), r["start"])
    assert first == start


def test_other_tokenizers_encode_whole_texts(spark, tokenizer, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    assert token_output.word_wise(token_output.load_tokenizer(tokenizer))
    words = ["One", "two", "three,", "Two", "[UNK]"]
    cased = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    cased.save(str(tmp_path / "cased.json"))
    texts = ["One two three, Two", "  leading  blanks\n\nand Case", "don't STOP", "漢字 🙂", "", "x" * 3000]
    for path in (str(tmp_path / "cased.json"), public_tokenizers.path("byte_bpe_50k.json")):
        plain = token_output.load_tokenizer(path)
        assert not token_output.word_wise(plain)
        got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_output.token_files(make_docs(spark, list(enumerate(texts))), path, sequence=16, end_id=0).collect()}
        for i, t in enumerate(texts):
            ids = plain.encode(t, add_special_tokens=False).ids + [0]
            assert got[i] == (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))


def test_files_follow_the_bytes_and_stay(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_BYTES", 3000)
    rows = [(i, text_of(i, 40)) for i in range(100)]
    folder = str(tmp_path / "tokens")
    assert token_output.token_files(make_docs(spark, rows), tokenizer, folder=folder).count() == 100
    files = sorted(p.name for p in (tmp_path / "tokens").glob("*.index.arrow"))
    assert len(files) == -(-sum(len(t) for _, t in rows) // 3000)
    sizes = [token_output.open_sequences(f"{folder}/{f.removesuffix('.index.arrow')}")[1].num_rows for f in files]
    assert sum(sizes) == 100 and max(sizes) < 30


def test_sequences_have_one_length_and_masks_hide_padding(spark, tokenizer):
    scratch = Scratch(spark, "test")
    m = token_output.write_tokens(make_docs(spark, [(1, text_of(1, 50)), (2, text_of(2, 80))]), tokenizer, f"{scratch.path}/files", scratch, sequence=32)
    total = 0
    for r in m.collect():
        sequences, index = token_output.open_sequences(r["file"])
        kind = sequences.schema.field("input_ids").type
        assert kind.list_size == 32 and kind.value_type == pa.uint16()
        masks = sequences.column("mask").to_pylist()
        assert sum(map(sum, masks)) == r["n_tokens"] and all(m == sorted(m, reverse=True) for m in masks)
        total += index.num_rows
    assert total == 2


def test_empty_token_files(nothing, tokenizer):
    assert token_output.token_files(nothing, tokenizer).count() == 0


def brute_targets(sizes, weights, most=3):
    out, total = {}, Fraction(sum(sizes.values()))
    while True:
        free = {s for s in sizes if s not in out}
        left = total - sum(out.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        out |= {s: Fraction(most * sizes[s]) for s in over}


MIXED = [(i, text_of(i, 5 + i % 40), "en", ["b", "a", None, "c"][i % 4] if i % 10 else "tiny") for i in range(400)] + [(900, None, "en", "a"), (901, "", "en", "b")]


def test_mix_meets_its_targets(spark):
    got = mixing.mix(make_docs(spark, MIXED)).collect()
    source = {r[0]: r[3] for r in MIXED}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    weights = {"a": 1, "b": 2, "c": 3, "tiny": 1, None: 2}
    want = brute_targets(sizes, weights)
    for s in sizes:
        assert target[s] == pytest.approx(float(want[s])) and abs(taken[s] - target[s]) <= 1
    assert {source[r["doc_id"]]: r["source_size"] for r in got} == dict(sizes)


def test_mix_repeats_itself_whatever_the_partitions(spark):
    a, b = (sorted(tuple(r) for r in mixing.mix(make_docs(spark, MIXED).repartition(n)).collect()) for n in (2, 9))
    assert a == b


def test_copies_follow_the_mix(spark):
    docs = make_docs(spark, MIXED)
    taken = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    out = mixing.mixed_copies(docs)
    copies = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == docs.columns
    for i, r in taken.items():
        assert abs(copies[i] * r["size"] - r["taken"]) <= max(r["size"] / 2, 0) + 1


def test_overlapping_sources_share_by_flow(spark):
    rows = [(i, " ".join(["w"] * 10)) for i in range(90)]
    docs = make_docs(spark, rows).withColumn("tags", F.when(F.col("doc_id") < 30, F.array(F.lit("a"))).when(F.col("doc_id") < 60, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))))
    out = mixing.mix(docs, F.col("tags"), {"a": 1, "b": 1}).collect()
    assert sum(r["taken"] for r in out) == 900 and all(r["taken"] == 10 for r in out)


def test_flow_prefers_first_passes():
    flow = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 100}, {"a": 150, "b": 150})
    assert {p: sum(f.values()) for p, f in flow.items()} == {("a",): 100, ("a", "b"): 100, ("b",): 100}
    short = mixing.route({("a",): 10}, {"a": 100})
    assert short == {("a",): {"a": 30}}


def best_flow(patterns, quotas, most):
    """(greatest flow, least cost of it) by trying every allotment."""
    choices = []
    for p, n in patterns.items():
        split = [()]
        for _ in p:
            split = [(*x, k) for x in split for k in range(most * n - sum(x) + 1)]
        choices.append([(dict(zip(p, x, strict=True)), sum(x), n) for x in split])
    best = (-1, 0)
    for pick in itertools.product(*choices):
        got = Counter()
        for given, _, _ in pick:
            got.update(given)
        if all(got[s] <= quotas.get(s, 0) for s in got):
            # words w of a pattern of n: pass e costs e * e a word
            cost = sum(sum((k // n + 1) ** 2 for k in range(w)) for _, w, n in pick)
            total = sum(w for _, w, _ in pick)
            if total > best[0] or total == best[0] and cost < best[1]:
                best = (total, cost)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_equals_exhaustive_search(seed):
    import random

    rng = random.Random(seed)
    kinds = [("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "c"), ("c",)]
    patterns = {p: rng.randrange(1, 4 if len(p) == 1 else 3) for p in rng.sample(kinds, 3)}
    quotas = {s: rng.randrange(0, 7) for s in "abc"}
    flow = mixing.route(patterns, quotas, 2)
    for p, given in flow.items():
        assert set(given) == set(p) and all(v >= 0 for v in given.values()) and sum(given.values()) <= 2 * patterns[p]
    taken = Counter()
    for given in flow.values():
        taken.update(given)
    assert all(taken[s] <= quotas[s] for s in quotas)
    cost = sum((k // patterns[p] + 1) ** 2 for p, given in flow.items() for k in range(sum(given.values())))
    assert (sum(taken.values()), cost) == best_flow(patterns, quotas, 2)


def test_flows_of_equal_cost_do_not_depend_on_the_order():
    patterns, quotas = {("a",): 300, ("a", "b"): 200, ("b",): 100, (None, "b"): 40}, {"a": 10, "b": 590, None: 5}
    want = mixing.route(patterns, quotas)
    for order in itertools.permutations(patterns):
        turned = mixing.route({p: patterns[p] for p in order}, dict(reversed(quotas.items())))
        assert turned == want


def test_overlap_lets_a_small_source_be_filled_without_repeats(spark):
    """Source b alone has few words; documents of both sources go to b, so nothing repeats."""
    rows = [(i, " ".join(["w"] * 10)) for i in range(60)]
    tags = F.when(F.col("doc_id") < 30, F.array(F.lit("a"))).when(F.col("doc_id") < 50, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    out = {r["doc_id"]: r["taken"] for r in mixing.mix(make_docs(spark, rows).withColumn("tags", tags), F.col("tags"), {"a": 1, "b": 1}).collect()}
    assert sum(out.values()) == 600 and set(out.values()) == {10}
    # a weighs nothing beside b: b takes all it has, thrice where the target asks for it
    heavy = {r["doc_id"]: r["taken"] for r in mixing.mix(make_docs(spark, rows).withColumn("tags", tags), F.col("tags"), {"a": 1, "b": 59}).collect()}
    b = sum(v for i, v in heavy.items() if i >= 30)
    assert sum(heavy.values()) == 600 and b >= 590 and max(heavy.values()) <= 30
    patterns = {("a",): 300, ("a", "b"): 200, ("b",): 100}
    flow = mixing.route(patterns, {"a": 10, "b": 590})
    assert sum(heavy[i] for i in range(30, 50)) == sum(flow["a", "b"].values()) and sum(heavy[i] for i in range(30)) == sum(flow["a",].values())


def brute_mix(rows, order, most=3):
    """{row: (taken, copies)} of rows(source, size) by exact shares, ``order`` the places of
    each source's rows; equal places are equal rows."""
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    named = mixing.source_weights(list(sizes))
    quota = mixing.integral(brute_targets(dict(sizes), named, most))
    out = {}
    for s in sizes:
        own = sorted((i for i, r in enumerate(rows) if r[0] == s), key=lambda i: order[i])
        passes, rest = divmod(quota[s], sizes[s]) if sizes[s] else (0, 0)
        upto, ended = 0, False
        for _, same in itertools.groupby(own, key=lambda i: order[i]):
            same = list(same)
            n = sum(rows[i][1] for i in same)
            whole = not ended and upto + n <= rest and sizes[s] > 0
            short = 0 if ended or whole else rest - upto
            for i in same:
                part = rows[i][1] if whole else min(rows[i][1], short // len(same))
                out[i] = (passes * rows[i][1] + part, passes + (whole or (not ended and n > 0 and 2 * short >= n)))
            upto += n
            ended = ended or not whole
    return out


def places(docs):
    """Rows of a table with the place that their hash gives them."""
    h = F.xxhash64(F.lit(mixing.SEED), "doc_id", F.col("text").cast("string"))
    return [(r["doc_id"], r["text"], r["source"], (r["b"], r["h"])) for r in docs.select("doc_id", "text", "source", F.pmod(h, F.lit(mixing.BUCKETS)).alias("b"), h.alias("h")).collect()]


def test_mix_equals_brute_force(spark):
    docs = make_docs(spark, [*MIXED, (7, MIXED[7][1], "en", MIXED[7][3])])
    rows = places(docs)
    want = brute_mix([(s, len((t or "").encode().split())) for _, t, s, _ in rows], [p for *_, p in rows])
    got = Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect())
    assert got == Counter((rows[i][0], v[0]) for i, v in want.items())
    copies = Counter(r["doc_id"] for r in mixing.mixed_copies(docs).collect())
    expected = Counter()
    for i, v in want.items():
        expected[rows[i][0]] += v[1]
    assert copies == +expected


def test_awkward_mix(awkward, nothing):
    assert mixing.mix(awkward).count() == len(AWKWARD) and mixing.mix(nothing).count() == 0
    assert mixing.mixed_copies(nothing).count() == 0


PAGES = [(1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "http://b\r\nx: y", None), (4, "http://b/4", ""), (6, "http://c", "é" * 5000), (7, "http://d", "<html>" + "x" * 100_000), (None, "http://e", "<p>same</p>"), (8, "http://f", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]


def pages_table(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "winner", "n", "refers_to", "file")}).repartition(3)


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages_table(spark)).collect()}
    top = {}
    for i, _, t in PAGES:
        if i is not None:
            top[t or ""] = max(top.get(t or "", i), i)
    for i, _, t in PAGES:
        best = top[t or ""]
        assert got[i] == (len((t or "").encode()), sha(t), "response" if i == best else "revisit", None if i == best else best)


def test_small_payloads_are_not_revisits(spark):
    got = warc.warc_round_trip(pages_table(spark), min_bytes=1000).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_records_are_single_frames_after_the_dictionary(spark):
    scratch = Scratch(spark, "test")
    rows = [(i, f"http://h/{i}", f"<html><body>page {i} {text_of(i, 60)}</body></html>") for i in range(60)]
    m = warc.write_warc(pages_table(spark, rows), f"{scratch.path}/files", scratch)
    store, path = warc.open_folder(m.first()["file"])
    data = store.open_input_stream(path, compression=None).read()
    dictionary, at = warc.split_file(data)
    assert dictionary and data[:4] == b"\x5d\x2a\x4d\x18"
    unpack, n = warc._decompressor(dictionary), 0
    while at < len(data):
        one = unpack.decompressobj()
        record = one.decompress(data[at:])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        at, n = len(data) - len(one.unused_data), n + 1
    assert n == m.first()["n_records"]
    assert sum(len(x[2]) for x in rows) / 60 * n > len(data) - len(dictionary)


def test_archives_roll_over_and_their_dictionary_knows_the_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1500)
    rows = [(i, f"http://h/{i}", f"<html>{text_of(i, 60)}</html>") for i in range(40)] + [(100, "http://long", "<html>" + text_of(7, 300_000) + "</html>")]
    seen = []
    monkeypatch.setattr(warc, "train", lambda samples, size=0: seen.extend(samples) or b"")
    folder = str(tmp_path / "archives")
    got = warc.warc_round_trip(pages_table(spark, rows), folder=folder).collect()
    assert sorted(r["page_id"] for r in got) == sorted(i for i, _, _ in rows)
    assert len(list((tmp_path / "archives").glob("*.warc.zst"))) > 10
    assert sorted(seen) == sorted(warc.record(i, u, t.encode(), sha(t)) for i, u, t in rows if len(t) <= warc.SAMPLE_LONGEST)
    assert len(seen) == 40


def test_damage_is_noticed():
    record = warc.record(1, "http://a", b"payload", warc.payload_digest(b"other"))
    import io

    head, block = warc.read_record(io.BytesIO(record))
    with pytest.raises(ValueError, match="damaged"):
        warc.describe(head, block)
    with pytest.raises(ValueError, match="cut short"):
        warc.read_record(io.BytesIO(record[:-10]))


def test_empty_pages(spark):
    assert warc.warc_round_trip(pages_table(spark).where("page_id < 0")).count() == 0
    assert isinstance(zstandard.__version__, str)


def test_tasks_grow_with_the_bytes():
    """Files and tasks by bytes; small inputs use the cores, and no number passes its bound."""
    from barcraft.llm import token_output as t

    assert [t.file_number(n, 8) for n in (0, 1, t.LEAST_BYTES * 3, 25 << 20, t.FILE_BYTES * 40, 10**18)] == [1, 1, 3, 8, 40, t.MOST_FILES]
    assert [warc.task_number(n, 200) for n in (0, warc.TASK_BYTES * 100, warc.TASK_BYTES * 1000, 10**18)] == [200, 200, 1000, warc.MOST_TASKS]


def test_files_do_not_change_what_is_read(spark, tokenizer, monkeypatch):
    from barcraft.llm import token_output as t

    docs = make_docs(spark, AWKWARD + [(100 + i, text_of(i, 40)) for i in range(60)])
    found = []
    for least in (1 << 30, 1 << 10):
        monkeypatch.setattr(t, "LEAST_BYTES", least)
        found.append(sorted(map(str, t.token_files(docs, tokenizer).collect())))
    assert found[0] == found[1]


def test_bounds_of_the_dictionary_sample(spark):
    """What the dictionary is trained on changes sizes, never records."""
    scratch = Scratch(spark, "t")
    rows = [(i, f"http://h/{i}", f"<html><body>page {i} {text_of(i, 60)}</body></html>") for i in range(60)]
    want = sorted(map(str, warc.warc_round_trip(pages_table(spark, rows)).collect()))
    for bounds in ({"sample_records": 0}, {"sample_bytes": 1}, {"sample_longest": 3}, {"sample_records": 20}):
        assert sorted(map(str, warc.warc_round_trip(pages_table(spark, rows), **bounds).collect())) == want
    sizes = []
    for longest in (3, 1 << 20):
        m = warc.write_warc(pages_table(spark, rows), f"{scratch.path}/longest{longest}", scratch, sample_longest=longest)
        data = [open(r["file"].removeprefix("file://"), "rb").read() for r in m.where("n_records > 0").collect()]
        sizes.append(sum(len(warc.split_file(d)[0]) for d in data))
    assert sizes[0] == 0 < sizes[1]
