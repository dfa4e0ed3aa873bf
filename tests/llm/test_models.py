"""Language identification and toxicity: accuracy on held-out rows and awkward input."""

from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barcraft.llm import language, toxicity
from tests.llm.conftest import AWKWARD, make_docs, text_of

VOCAB = {"aa": ["molo", "bani", "keto", "luma", "sani"], "bb": ["strig", "wolth", "brenk", "schrop", "klump"], "cc": ["eixa", "quioa", "ueil", "aioun", "oiseau"]}


def corpus(n=240, seed=5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = sorted(VOCAB)[i % 3]
        rows.append((i, " ".join(rng.choice(VOCAB[lang]) + rng.choice(VOCAB[lang]) for _ in range(12)) + ".", lang))
    return rows


def test_held_out_languages_are_found(spark):
    got = language.identify(make_docs(spark, corpus())).collect()
    truth = {r[0]: r[2] for r in corpus()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == 240 and {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_does_not_look_at_lang_source_or_id(spark):
    rows = corpus()
    base = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(make_docs(spark, rows)).collect()}
    held = {i for i in base if zlib.crc32(str(i).encode()) % 4 == 2}
    lied = [(i, t, "zz" if i in held else lang, "other") for i, t, lang in rows]
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(make_docs(spark, lied)).collect()}
    assert again == base


def test_unseen_words_back_off():
    entries = {0: {"aa": {"banana": 5}, "bb": {"strong": 5}}} | {n: {"aa": {g: 5 for g in language.grams("banana", n)}, "bb": {g: 5 for g in language.grams("strong", n)}} for n in range(1, 6)}
    scorer = language.Scorer(language.LanguageModel(["bb", "aa"], entries))
    langs, score = scorer.predict(["anana nan", "stron gnort", "", None, "123 !?", "BANANA"])
    assert langs == ["aa", "bb", "und", "und", "und", "aa"] and score[2] == 0


def test_words_are_letters_and_marks():
    assert language.letter_words("हिन्दी 12²½Ⅷ① cafe\u0301 \u0301x ไทยนี้ a_b 𐐀𐐨") == ["हिन्दी", "cafe\u0301", "x", "ไทยนี้", "a", "b", "𐐨𐐨"]


def plain_language(model, text):
    """(language, sums) by loops over names, without arrays."""
    sums = [0.0] * len(model.languages)
    tables = []
    at = 0
    for names in model.names:
        tables.append({name: dict(zip(model.which[model.begin[at + i] : model.begin[at + i + 1]].tolist(), model.gain[model.begin[at + i] : model.begin[at + i + 1]].tolist(), strict=True)) for i, name in enumerate(names)})
        at += len(names)
    words = [w for w in re.split(r"[^\w\u0300-\u036f]|[\d_]", (text or "").lower()) if w]
    for word in words:
        pieces = [(0, [word])]
        for level, n in enumerate((5, 4, 3, 2, 1), 1):
            padded = "\x02" + word + "\x03" if n > 1 else word
            pieces.append((level, [padded[i : i + n] for i in range(len(padded) - n + 1)]))
        for level, found in pieces:
            known = [p for p in found if p in tables[level]]
            if known:
                for lang in range(len(sums)):
                    sums[lang] += sum(model.unknown[level][lang] + tables[level][p].get(lang, 0.0) for p in known) / len(known)
                break
    return (model.languages[sums.index(max(sums))], sums) if words else ("und", sums)


def test_every_document_as_by_plain_loops(spark, documents):
    part = language.fold(F.col("doc_id"), 4)
    rows = documents.select("doc_id", "text", "lang")
    model = language.fit(rows.where((part != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    tables = plain_language(model, "")  # warms nothing; the check below is per text
    assert tables[0] == "und"
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = {r["doc_id"]: r for r in language.identify(documents).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        want, sums = plain_language(model, text)
        best = sorted(sums)[-2:]
        if want == "und" or best[1] - best[0] > 1e-9:
            assert got[i]["lang_pred"] == want
        if want != "und":
            n = len(language.letter_words(text))
            share = 1 / sum(math.exp((s - best[1]) * min(1.0, language.EVIDENCE / n)) for s in sums)
            assert got[i]["score"] == pytest.approx(share, abs=1e-9)


def test_fitted_numbers_as_by_counting(spark):
    rows = corpus(60)
    model = language.fit(make_docs(spark, rows).select("doc_id", "text", "lang"), least=1)
    counts = {lang: Counter(w for _, t, x in rows if x == lang for w in re.findall(r"[a-z]+", t.lower())) for lang in VOCAB}
    for name, at in zip(model.names[0], range(len(model.names[0])), strict=True):
        for j in range(model.begin[at], model.begin[at + 1]):
            assert model.gain[j] == pytest.approx(math.log((0.5 + counts[model.languages[model.which[j]]][name]) / 0.5))
    assert len(model.names[0]) == len(set().union(*counts.values()))


def test_no_language_is_dropped(spark, monkeypatch):
    rows = [(100 * k + i, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 2} " * 8, f"l{k:03}") for k in range(60) for i in range(4)]
    got = language.identify(make_docs(spark, rows)).collect()
    assert {r["lang_pred"] for r in got} == {f"l{k:03}" for k in range(60)}
    monkeypatch.setattr(language, "MOST_ENTRIES", 59 * 140_000)
    with pytest.raises(ValueError, match="more than 59 values of lang"):
        language.identify(make_docs(spark, rows))


def test_awkward_languages(spark, awkward, nothing):
    got = language.identify(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, None} or {1, 2, 3} <= {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert language.identify(nothing).count() == 0
    odd = make_docs(spark, [*corpus(30), (1000, "² ½ ①", None), (1001, "\u0301 ١٢", None), (1002, "bani " * 30_000, None)])
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd).collect()}
    assert found[1000] == found[1001] == ("und", 0.0) and found[1002][0] == "aa"
    unlabelled = make_docs(spark, [(1, "some text", None)])
    assert language.identify(unlabelled).first()["lang_pred"] == "und"


def toxic_corpus(n=600, seed=9):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = text_of(1000 + i, 40).split()
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["vilefoo", "vilebar", "grotty", "VileBaz!"])
        rows.append((i, " ".join(words), "en" if i % 2 else "de"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, marks = toxic_corpus()
    labels = spark.createDataFrame([*marks, (5, 0, None), (99_999, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(make_docs(spark, rows), labels).collect()}
    held = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert np.mean([got[i]["predicted"] == marks[i][2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_toxicity_shares_beginnings_of_words():
    rows, marks = toxic_corpus()
    net = toxicity.train([t.encode() for _, t, _ in rows], np.array([m[2] for m in marks]))
    new, clean = net.logits([(text_of(5, 30) + " vilequx").encode(), text_of(5, 30).encode()])
    assert new > clean + 1


def plain_logit(net, text):
    """The forward pass as loops over words, widths and filters."""
    ids, _ = toxicity.word_ids([text])
    vectors = [[float(v) for i, t in enumerate(net.tables) for v in t[row[i]]] for row in ids]
    total = net.offset
    for j, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(vectors)):
                value = float(net.bias[w][f])
                for k in range(w):
                    if at + k < len(vectors):
                        value += sum(a * float(b) for a, b in zip(vectors[at + k], net.filters[w][k][:, f], strict=True))
                best = max(best, value)
            total += best * float(net.weight[j * toxicity.FILTERS + f])
    return total


def filled(seed=3):
    net, rng = toxicity.TextCnn(seed), np.random.default_rng(seed)
    for t in net.tables:
        t[1:] = rng.standard_normal(t[1:].shape).astype(np.float32)
    return net


def test_logits_equal_plain_loops():
    net = filled()
    texts = [b"", b"one", text_of(3, 25).encode(), "naïve 漢字 Word, word".encode(), b"a b c d e f"]
    assert np.allclose(net.logits(texts), [plain_logit(net, t) for t in texts], atol=1e-4)
    alone = [float(net.logits([t])[0]) for t in texts]
    assert np.allclose(net.logits(texts[::-1])[::-1], alone, atol=1e-5)  # neighbours don't matter


def test_gradients_equal_differences():
    net = filled()
    net.weight *= 0.2
    texts = [text_of(i, 6).encode() for i in range(4)]
    ids, first = toxicity.word_ids(texts)
    labels, weigh = np.array([1, 0, 0, 1]), np.array([1.0, 0.5, 2.0, 1.0])
    keep = np.ones((4, toxicity.FILTERS * len(toxicity.WIDTHS)), np.float32)

    def loss():
        z = net.logits(texts)
        return float((weigh * (np.log1p(np.exp(z)) - labels * z)).mean())

    weight, offset, filters, bias, rows, row_grads = toxicity.gradients(net, ids, first, labels, weigh, keep)

    def slope(array, at, step=1e-3):
        old = array[at]
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        return (up - down) / (2 * step)

    assert weight[3] == pytest.approx(slope(net.weight, 3), abs=2e-3)
    for w in toxicity.WIDTHS:
        assert bias[w][2] == pytest.approx(slope(net.bias[w], 2), abs=2e-3)
        assert filters[w][w - 1][5, 1] == pytest.approx(slope(net.filters[w], (w - 1, 5, 1)), abs=5e-3)
    row = int(ids[2, 0])
    found = row_grads[rows[:, 0] == row][:, : toxicity.DIM].sum(axis=0)
    for d in range(toxicity.DIM):
        assert found[d] == pytest.approx(slope(net.tables[0], (row, d)), abs=5e-3)
    old, net.offset = net.offset, net.offset + 1e-4
    up = loss()
    net.offset = old
    assert offset == pytest.approx((up - loss()) / 1e-4, abs=2e-3)


def test_thresholds_of_their_own_are_told():
    net = filled()
    texts = [text_of(i, 8).encode() for i in range(200)]
    labels = (net.logits(texts) > np.median(net.logits(texts))).astype(np.int64)
    toxicity.calibrate(net, texts, labels, ["en"] * 190 + ["de"] * 10)
    assert set(net.threshold) == {None, "en"}


def test_toxicity_of_held_out_documents(spark):
    """The larger test tables have positives enough to grade by."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no larger tables")
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), marks).where("held_out").join(marks, "doc_id").select("score", "predicted", "toxic").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert len(bad) >= 30
    ranks = got.score.rank()
    auc = (ranks[bad.index].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good))
    assert auc > 0.95 and bad.predicted.mean() > 0.8 and good.predicted.mean() < 0.03


def test_clashing_columns_of_labels(spark):
    rows, marks = toxic_corpus(200)
    plain = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    odd = plain.withColumns({c: F.lit("z") for c in ("text", "lang", "order", "apart", "part", "__id", "__share", "score")})
    docs = make_docs(spark, [*rows, (10_000, "word " * 40_000, "en")])
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, x).collect()) for x in (plain, odd))
    assert a == b and len(a) == 201


def test_awkward_toxicity(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(awkward, none).collect()
    assert len(got) == len(AWKWARD) and all(r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(nothing, none).count() == 0
    one = spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(awkward, one).collect())


def test_the_toxicity_sample_stops_at_its_bytes(spark):
    """Rows teach in the order of a hash of their ids, 256 at a time, until the bytes are had."""
    from pyspark.sql import functions as F

    rows = [(i, ("you awful vile " if i % 3 == 0 else "a calm kind ") + text_of(i, 12), "en") for i in range(700)]
    docs, labels = make_docs(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(700)], "doc_id long, toxic int")
    learns = docs.where((F.crc32(F.col("doc_id").cast("string")) % 5) != 0)
    first = {r.doc_id for r in learns.orderBy(F.xxhash64("doc_id"), "text").limit(256).collect()}
    found = lambda marks, **bounds: {r.doc_id: r.score for r in toxicity.toxicity(docs, marks, **bounds).collect()}
    stopped = found(labels, sample_bytes=1)
    assert stopped == found(labels.where(F.col("doc_id").isin(*first)))
    assert stopped != found(labels) and found(labels, sample_docs=40) != stopped
    assert all(not r.own_threshold for r in toxicity.toxicity(docs, labels, own_from=10**6).collect())
