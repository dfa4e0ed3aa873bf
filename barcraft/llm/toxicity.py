"""Operator 9: toxicity by a convolutional text classifier trained in numpy.

Words (letters and digits, A-Z lower-cased) are embedded by hashing: the word, and its first
and last few bytes, which inflected forms share, each look up a table.  Filters of several widths slide over the text, each keeps its maximum, and a logistic layer
weighs them.  Only the place of a filter's maximum gets gradient, so training is cheap.
Unseen words have zero embeddings.  Thresholds are calibrated per language on rows that
training did not see, the language being predicted from the text; the score is shifted so
that the threshold lies at 0.5.

Training uses a bounded sample: at most about ``sample_docs`` rows of each label, chosen by a hash
of the id and read in its order until ``sample_bytes`` of text are had.  One task trains on it, so
the driver holds the model but no text.
"""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcraft.llm.language import Scorer, fit, fold, sampled, scorer_of
from barcraft.llm.text import Words, chunks

SAMPLE_DOCS, SAMPLE_BYTES = 3000, 64 << 20
TABLE_BITS, DIM, WIDTHS, FILTERS = 16, 4, (1, 2, 3), 8
#: Bytes at a word's beginning (positive) and end (negative) that have a table beside the word's.
AFFIXES = (4, 5, 6, -4, -5)
TABLES = 1 + len(AFFIXES)
EPOCHS, RATE, BATCH_DOCS, SEED, DECAY = 10, 0.1, 32, 7, 1e-4
#: A table row learns only if so many training texts have it: what one text alone has would
#: be learnt by heart.  Small samples get more epochs, up to MOST_EPOCHS.
MIN_TEXTS, MOST_EPOCHS = 3, 60
#: Share of pooled features left out of each training step.
DROP = 0.3
#: A language gets a threshold of its own from so many calibration rows of either label.
CALIBRATE = 20

_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if chr(c) in string.ascii_uppercase else 32 for c in range(256))


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """((words, TABLES) table rows, first row of each text); every text ends in max(WIDTHS) zero
    rows (row 0), so that each of its words begins a window of its own rows."""
    words = Words([t.translate(_PLAIN) for t in texts], AFFIXES)
    pad = max(WIDTHS)
    size = words.counts + pad
    first = np.cumsum(size) - size
    ids = np.zeros((int(size.sum()), TABLES), np.int64)
    at = first[words.doc] + np.arange(len(words.hash)) - words.first[words.doc]
    top = np.uint64((1 << TABLE_BITS) - 1)
    for i, h in enumerate((words.hash, *words.affix)):
        ids[at, i] = 1 + (h % top).astype(np.int64)
    return ids, first


def _own_maximum(values: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Maximum over the windows that end inside their text."""
    last = np.concatenate((first[1:], [len(values)])) - (width - 1)
    cuts = np.stack((first, last), axis=1).reshape(-1)
    return np.maximum.reduceat(values, cuts[:-1] if last[-1] == len(values) else cuts, axis=0)[::2]


class TextCnn:
    """Parameters and the forward pass."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dim = TABLES * DIM
        self.tables = [np.zeros((1 << TABLE_BITS, DIM), np.float32) for _ in range(TABLES)]
        self.filters = {w: (rng.standard_normal((w, dim, FILTERS)) / np.sqrt(dim * w)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.full(FILTERS, 0.01, np.float32) for w in WIDTHS}
        self.weight = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.offset = 0.0
        self.threshold: dict[str | None, float] = {None: 0.0}

    def maps(self, ids: np.ndarray) -> list[np.ndarray]:
        """Each width's filter values at every place (the last places see zeros)."""
        x = np.concatenate([t[ids[:, i]] for i, t in enumerate(self.tables)], axis=1)
        out = []
        for w in WIDTHS:
            y = np.repeat(self.bias[w][None], len(x), axis=0)
            for k in range(w):
                y[: len(x) - k] += x[k:] @ self.filters[w][k]
            out.append(np.maximum(y, 0))
        return out

    def logits(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        ids, first = word_ids(texts)
        pooled = np.concatenate([_own_maximum(y, first, w) for y, w in zip(self.maps(ids), WIDTHS, strict=True)], axis=1)
        return pooled.astype(np.float64) @ self.weight + self.offset

    def scores(self, texts: list[bytes], languages: list[str]) -> np.ndarray:
        shift = np.array([self.threshold.get(lang, self.threshold[None]) for lang in languages])
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - shift, -30, 30)))


def places_of(maps: list[np.ndarray], first: np.ndarray, n: int) -> list[np.ndarray]:
    """Per width the place (docs, filters) of each filter's maximum among its text's windows."""
    ends = np.concatenate((first[1:], [n]))
    return [np.stack([y[a : b - w + 1].argmax(axis=0) + a for a, b in zip(first, ends, strict=True)]) for y, w in zip(maps, WIDTHS, strict=True)]


def gradients(net: TextCnn, ids: np.ndarray, first: np.ndarray, labels: np.ndarray, weigh: np.ndarray, keep: np.ndarray):
    """Gradients of the weighted mean log loss of some texts; ``keep`` (docs, features) scales
    the pooled features.  Returns those of the weight, the offset, each width's filters and
    bias, and of the tables as (rows, gradients per row)."""
    maps = net.maps(ids)
    places = places_of(maps, first, len(ids))
    pooled = np.concatenate([np.take_along_axis(y, p, axis=0) for y, p in zip(maps, places, strict=True)], axis=1) * keep
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.weight + net.offset, -30, 30)))
    delta = ((p - labels) * weigh / len(first)).astype(np.float32)
    back = delta[:, None] * net.weight[None] * keep * (pooled > 0)
    gathered = np.concatenate((ids, np.zeros((max(WIDTHS), TABLES), np.int64)))
    rows, row_grads, filters, bias = [], [], {}, {}
    for j, w in enumerate(WIDTHS):
        g = back[:, j * FILTERS : (j + 1) * FILTERS]
        filters[w], bias[w] = np.empty_like(net.filters[w]), g.sum(axis=0)
        for k in range(w):
            at = gathered[places[j] + k]  # (docs, filters, tables)
            x = np.concatenate([t[at[..., i]] for i, t in enumerate(net.tables)], axis=2)
            filters[w][k] = np.einsum("df,dfe->ef", g, x)
            rows.append(at.reshape(-1, TABLES))
            row_grads.append((g[:, :, None] * net.filters[w][k].T[None]).reshape(-1, TABLES * DIM))
    return pooled.T @ delta, float(delta.sum()), filters, bias, np.concatenate(rows), np.concatenate(row_grads)


class _Adagrad:
    """Sums of squared gradients and the steps they allow."""

    def __init__(self, net: TextCnn):
        self.net = net
        self.tables = [np.full(t.shape, 1e-6, np.float32) for t in net.tables]
        self.rest: dict = {}

    def _move(self, key, value: np.ndarray, grad: np.ndarray) -> None:
        held = self.rest.setdefault(key, np.full_like(value, 1e-6))
        held += grad * grad
        value -= RATE * grad / np.sqrt(held)

    def step(self, weight, offset, filters, bias, rows, row_grads) -> None:
        net = self.net
        for w in WIDTHS:
            self._move(("filters", w), net.filters[w], filters[w] + DECAY * net.filters[w])
            self._move(("bias", w), net.bias[w], bias[w])
        for i, t in enumerate(net.tables):
            use, inverse = np.unique(rows[:, i], return_inverse=True)
            total = np.zeros((len(use), DIM), np.float32)
            np.add.at(total, inverse, row_grads[:, i * DIM : (i + 1) * DIM])
            total += DECAY * t[use]
            total[use == 0] = 0  # row 0 is padding
            self.tables[i][use] += total * total
            t[use] -= RATE * total / np.sqrt(self.tables[i][use])
        self._move("weight", net.weight, weight + DECAY * net.weight)
        self.rest["offset"] = self.rest.get("offset", 1e-6) + offset**2
        net.offset -= RATE * offset / np.sqrt(self.rest["offset"])


def _learnable(texts: list[bytes], min_texts: int = MIN_TEXTS) -> list[np.ndarray]:
    """Per table the rows that ``min_texts`` texts or more have."""
    common = [np.zeros(1 << TABLE_BITS, np.int32) for _ in range(TABLES)]
    for lo in range(0, len(texts), BATCH_DOCS):
        ids, first = word_ids(texts[lo : lo + BATCH_DOCS])
        owner = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(ids)]))))
        for i in range(TABLES):
            pairs = np.unique(owner << TABLE_BITS | ids[:, i])
            common[i] += np.bincount(pairs & (1 << TABLE_BITS) - 1, minlength=1 << TABLE_BITS).astype(np.int32)
    return [c >= min_texts for c in common]


def train(texts: list[bytes], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS, min_texts: int = MIN_TEXTS) -> TextCnn:
    """A classifier by Adagrad; both labels weigh the same in all."""
    net, rng = TextCnn(seed), np.random.default_rng(seed)
    n = len(texts)
    if not n or labels.min() == labels.max():
        net.weight[:] = 0
        net.offset = -4.0 if not n or not labels.max() else 4.0
        return net
    share = labels.mean()
    weigh = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    learns, walk = _learnable(texts, min_texts), _Adagrad(net)
    batches = -(-n // BATCH_DOCS)
    for _ in range(min(MOST_EPOCHS, max(epochs, -(-600 // batches)))):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH_DOCS):
            some = order[lo : lo + BATCH_DOCS]
            ids, first = word_ids([texts[i] for i in some])
            for i in range(TABLES):
                ids[:, i] *= learns[i][ids[:, i]]
            keep = (rng.random((len(some), FILTERS * len(WIDTHS))) >= DROP).astype(np.float32) / np.float32(1 - DROP)
            walk.step(*gradients(net, ids, first, labels[some], weigh[some], keep))
    return net


def _best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle one of the cuts whose F1 is within half a hundredth of the best; a cut lies
    in the middle between two scores."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    last = np.concatenate((logits[order][1:] != logits[order][:-1], [True]))
    f1 = np.where(last, f1, -1)
    good = np.flatnonzero(f1 >= f1.max() - 0.005)
    ranked = logits[order]
    below = np.concatenate((ranked[1:], [ranked[-1] - 1]))
    return float(np.median((ranked[good] + below[good]) / 2))


def calibrate(net: TextCnn, texts: list[bytes], labels: np.ndarray, languages: list[str], least: int = CALIBRATE) -> None:
    """Sets a threshold for all and one for each language with rows enough."""
    if not len(texts) or labels.min() == labels.max():
        return
    logits = net.logits(texts)
    net.threshold = {None: _best_threshold(logits, labels)}
    langs = np.array(languages)
    for lang in set(languages):
        own = langs == lang
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= least:
            net.threshold[lang] = _best_threshold(logits[own], labels[own])


def learn(texts: list[bytes], labels: np.ndarray, apart: np.ndarray, scorer: Scorer, min_texts: int = MIN_TEXTS, least: int = CALIBRATE) -> TextCnn:
    """A classifier trained on the texts that are not ``apart`` and calibrated on those that are."""
    net = train([t for t, a in zip(texts, apart, strict=True) if not a], labels[~apart], min_texts=min_texts)
    seen = [t for t, a in zip(texts, apart, strict=True) if a]
    calibrate(net, seen, labels[apart], scorer.predict([t.decode("utf-8", "replace") for t in seen])[0], least)
    return net


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, min_texts: int = MIN_TEXTS, own_from: int = CALIBRATE) -> DataFrame:
    """(doc_id, held_out, score, predicted, own_threshold) per row of docs(doc_id, text, lang, ...).

    Learns from labels(doc_id, toxic, ...) of the documents whose crc32(doc_id as text) mod
    ``folds`` is not ``held``; rows of one more residue, (held + 1) mod ``folds``, calibrate
    and don't train.  Scores are from the text alone.  A null or empty text is scored as a
    text without words.  Labels that are null, repeat or have no document teach nothing more
    or nothing; without both labels every score is near the one label's side (near 0 with
    no labels at all).  A document with several labels counts as toxic if one says so.  Texts
    of any length are scored whole, about half a MB at a time.  Repeated rows are scored each; an
    empty table gives no rows; other columns of both tables, whatever their names, are not
    read.  A language has a threshold of its own if ``own_from`` rows of either label calibrate
    it; the others share one, and ``own_threshold`` says which a row's score is shifted by.  A score
    of exactly 0.5 is predicted 1.  About ``sample_docs`` rows of each label teach, in the order of a
    hash of their ids, until ``sample_bytes`` of text are had (256 rows at a time).
    """
    spark = docs.sparkSession
    part = fold(F.col("doc_id"), folds)
    learns = F.coalesce(part != held, F.lit(False)) & F.col("text").isNotNull()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    marks = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    # choose by id first, so that only the sample's texts move
    chosen = sampled(marks.where(part != held), "toxic", sample_docs, 2)
    model = fit(rows.where(learns & F.col("lang").isNotNull()))
    known = spark.sparkContext.broadcast(model)  # bounded by the fit's MOST_ENTRIES
    # the sample has about 2 * sample_docs ids at most, so their texts are found by broadcast
    learnt = rows.where(learns).join(F.broadcast(chosen), "doc_id").select("text", "toxic", (part == (held + 1) % folds).alias("apart"), F.xxhash64("doc_id").alias("order"))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marked, apart = [], [], []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                if size < sample_bytes:
                    some = batch.slice(lo, 256)
                    texts += some.column("text").cast(pa.binary()).to_pylist()
                    marked += some.column("toxic").to_pylist()
                    apart += some.column("apart").to_pylist()
                    size = sum(map(len, texts))
        net = learn(texts, np.array(marked, np.int64), np.array(apart, bool), Scorer(known.value), min_texts, own_from)
        yield pa.RecordBatch.from_pydict({"net": [pickle.dumps(net)]})

    taught = learnt.repartition(1).sortWithinPartitions("order", "text").mapInArrow(teach, "net binary").collect()
    net = pickle.loads(taught[0]["net"]) if taught else train([], np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast((net, model))  # bounded by the tables' sizes and the fit
    name = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, model = shared.value
        scorer = scorer_of(name, model)
        for batch in batches:
            for lo, hi, raw in chunks(batch):
                # a language only matters where one has a threshold of its own
                langs = scorer.predict([t.decode("utf-8", "replace") for t in raw])[0] if len(net.threshold) > 1 else [""] * len(raw)
                score = net.scores(raw, langs)
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([x in net.threshold for x in langs])], ["doc_id", "held_out", "score", "predicted", "own_threshold"])

    source = rows.select("doc_id", F.coalesce(part == held, F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, own_threshold boolean")
