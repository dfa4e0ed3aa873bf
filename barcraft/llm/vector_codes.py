"""Operator 13: product codes of vectors by Elkan's Lloyd iteration, in integers.

A component x becomes floor(1024 * x), a vector is cut into equal consecutive parts, and each
part position has a codebook of its own.  The state is a table: per vector and part the entry it
belongs to, an upper bound of the distance to that entry, and one lower bound per entry.  A round
shifts the bounds by how far the entries moved and computes a distance only where neither
``upper < lower`` nor ``upper < half the distance between the entries`` excludes it.  Both
comparisons are strict and bounds are rounded outwards, so an entry at an equal distance is always
compared in integers and the lower index wins.

Lower bounds are kept in steps of a part's codebook diameter / STEPS, one byte each, rounded down:
a coarser step costs comparisons, never a result.  Codebooks (parts x entries x components) are
all that the driver and the broadcasts hold; sums are added up per task, then by entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcraft.llm.scratch import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Steps of lower bounds to a codebook's diameter; 255 steps is the most that is stored.
STEPS = 32
#: Components from here on (16,384 before scaling) could overflow the 64-bit distances of vectors
#: of some thousand components.
MOST = 1 << 24
#: How far float bounds are moved outwards; their own error is some 1e-15.
_OUT = 1e-9
_STATE = "vec_id {id}, label {label}, v array<int>, code binary, upper array<double>, lower binary, compared long"


@dataclass
class Part:
    """One part position: its entries, how far each moved, and what bounds need of them."""

    book: np.ndarray
    moved: np.ndarray
    step: float
    half: np.ndarray | None = None
    near: np.ndarray | None = None

    def measure(self) -> None:
        """Half the distances between entries, rounded down; ``near``: to the nearest other."""
        apart = np.sqrt(_squares(self.book, self.book).astype(float)) * (1 - _OUT) / 2
        self.half = apart
        others = apart + np.diag(np.full(len(apart), np.inf))
        self.near = others.min(axis=1)


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every entry, exact."""
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(book.shape[1]):
        gap = x[:, j, None] - book[None, :, j]
        out += gap * gap
    return out


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


def assign_first(x: np.ndarray, part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entries, upper bounds, lower bounds, distances computed) without earlier bounds."""
    squares = _squares(x, part.book)
    entry = squares.argmin(axis=1)
    upper = _roots(squares[np.arange(len(x)), entry]) * (1 + _OUT)
    lower = np.minimum(_roots(squares) * (1 - _OUT) / part.step, 255).astype(np.uint8)
    return entry, upper, lower, squares.size


def assign_again(x: np.ndarray, part: Part, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after entries moved: bounds are shifted, and only what they leave is computed."""
    entry = entry.astype(np.int64)
    upper = (upper + part.moved[entry]) * (1 + _OUT)
    down = np.minimum(np.ceil(part.moved * (1 + _OUT) / part.step), 255).astype(np.int16)
    lower = np.maximum(lower.astype(np.int16) - down, 0).astype(np.uint8)
    computed = 0
    at = np.flatnonzero(upper >= part.near[entry])

    def open_pairs(at: np.ndarray) -> np.ndarray:
        most = upper[at, None]
        left = (lower[at] * part.step <= most) & (part.half[entry[at]] <= most)
        left[np.arange(len(at)), entry[at]] = False
        return left

    if len(at):
        at = at[open_pairs(at).any(axis=1)]
        gap = x[at] - part.book[entry[at]]
        own = (gap * gap).sum(axis=1)
        upper[at] = _roots(own) * (1 + _OUT)
        computed += len(at)
        left = open_pairs(at)
        row, other = np.nonzero(left)
        gap = x[at[row]] - part.book[other]
        squares = (gap * gap).sum(axis=1)
        computed += len(row)
        lower[at[row], other] = np.minimum(_roots(squares) * (1 - _OUT) / part.step, 255).astype(np.uint8)
        if len(row):
            begins = np.flatnonzero(np.diff(row, prepend=-1))
            which, best = row[begins], np.minimum.reduceat(squares, begins)
            ties = np.flatnonzero(squares == np.repeat(best, np.diff(np.append(begins, len(row)))))
            first = ties[np.searchsorted(ties, begins)]  # the least entry of those at the least distance
            better = (best < own[which]) | ((best == own[which]) & (other[first] < entry[at[which]]))
            rows, old = at[which[better]], entry[at[which[better]]]
            lower[rows, old] = np.minimum(_roots(own[which[better]]) * (1 - _OUT) / part.step, 255).astype(np.uint8)
            entry[rows] = other[first[better]]
            upper[rows] = _roots(best[better]) * (1 + _OUT)
    return entry, upper, lower, computed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _split(parts: list[Part]) -> list[slice]:
    width = parts[0].book.shape[1]
    return [slice(p * width, (p + 1) * width) for p in range(len(parts))]


def _assigned(batch: pa.RecordBatch, parts: list[Part], first: bool) -> pa.RecordBatch:
    n, k, spans = batch.num_rows, len(parts[0].book), _split(parts)
    v = _matrix(batch.column("v"), spans[-1].stop)
    codes, uppers, lowers = np.empty((n, len(parts)), np.uint8), np.empty((n, len(parts))), np.empty((n, len(parts), k), np.uint8)
    if not first:
        old, was = _bytes(batch.column("code"), len(parts)), batch.column("upper").flatten().to_numpy().reshape(n, -1)
        low = _bytes(batch.column("lower"), len(parts) * k).reshape(n, len(parts), k)
    compared = 0
    for p, (part, span) in enumerate(zip(parts, spans, strict=True)):
        found = assign_first(v[:, span], part) if first else assign_again(v[:, span], part, old[:, p], was[:, p], low[:, p])
        codes[:, p], uppers[:, p], lowers[:, p], some = found
        compared += some
    ends = np.arange(0, n * len(parts) + 1, len(parts))
    columns = [
        batch.column("vec_id"), batch.column("label"), batch.column("v"),
        pa.array([c.tobytes() for c in codes], pa.binary()),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(uppers.ravel())),
        pa.array([x.tobytes() for x in lowers], pa.binary()),
        pa.array([compared] + [0] * (n - 1), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "code", "upper", "lower", "compared"])


def _sums(batches: Iterator[pa.RecordBatch], parts: int, entries: int, width: int) -> Iterator[pa.RecordBatch]:
    """A task's count and componentwise sums per part and entry."""
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for batch in batches:
        if batch.num_rows:
            v, code = _matrix(batch.column("v"), parts * width), _bytes(batch.column("code"), parts)
            for p in range(parts):
                np.add.at(counts[p], code[:, p], 1)
                np.add.at(sums[p], code[:, p], v[:, p * width : (p + 1) * width])
    p, e = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": counts[p, e], "s": pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))})


def _errors(batch: pa.RecordBatch, parts: list[Part]) -> pa.RecordBatch:
    code, spans = _bytes(batch.column("code"), len(parts)), _split(parts)
    v = _matrix(batch.column("v"), spans[-1].stop)
    total = np.zeros(batch.num_rows, np.int64)
    for p, span in enumerate(spans):
        gap = v[:, span] - parts[p].book[code[:, p]]
        total += (gap * gap).sum(axis=1)
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("code"), pa.array(total)], names=["vec_id", "label", "code", "error"])


def of_one_length(kept: DataFrame) -> DataFrame:
    """The vectors of the most common length (of equally common ones the larger)."""
    lengths = kept.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(2).collect()
    return kept.where(F.size("v") == lengths[0].length) if len(lengths) > 1 else kept


def usable(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v): integer components of the vectors that can be coded."""
    x = F.col("embedding")
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.when(F.exists(x, lambda c: F.abs(c) >= MOST / SCALE), F.raise_error(F.lit(f"a component is {MOST // SCALE} or more: its distances would not fit 64 bits")).cast("array<int>"))
    fine = fine & (F.size(x) > 0) & (F.size(x) % parts == 0)
    v = F.coalesce(whole, F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int")))
    return vectors.where(fine).select("vec_id", "label", v.alias("v"))


def fit_and_assign(scratch: Scratch, kept: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, list[Part]]:
    """The state table after the last assignment and the final codebooks.  ``kept`` is a written
    table of (vec_id, label, v)."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is one byte: 1 to 256 entries")
    spark = scratch.spark
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not start:
        return kept, []
    vectors = np.array([r.v for r in start], np.int64)
    width = vectors.shape[1] // parts
    books = [Part(vectors[:, p * width : (p + 1) * width].copy(), np.zeros(len(vectors)), 1.0) for p in range(parts)]
    for part in books:
        part.measure()
        part.step = max(2 * part.half.max() / STEPS, 1.0)
    types = dict(kept.dtypes)
    schema, state = _STATE.format(id=types["vec_id"], label=types["label"]), kept
    for r in range(rounds + 1):
        shared = spark.sparkContext.broadcast(books)

        def assign(batches: Iterator[pa.RecordBatch], shared=shared, first=r == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield _assigned(batch, shared.value, first)

        state = scratch.write(f"round{r}", state.mapInArrow(assign, schema), compression="zstd")
        scratch.keep_only(f"round{r}")
        if r == rounds:
            break
        k = len(vectors)
        per_task = state.select("v", "code").mapInArrow(lambda batches, k=k: _sums(batches, parts, k, width), "part int, entry int, n long, s array<long>")
        total = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)])
        for part in books:
            part.moved[:] = 0
        for row in total.collect():  # parts x entries rows at most; entries without a row stay
            part = books[row.part]
            new = np.array([int(row[f"s{j}"]) // int(row.n) for j in range(width)], np.int64)
            gap = new - part.book[row.entry]
            part.moved[row.entry] = np.sqrt(float((gap * gap).sum())) * (1 + _OUT)
            part.book[row.entry] = new
        for part in books:
            part.measure()
    return state, books


def codebooks_text(books: list[Part]) -> str:
    return ",".join(str(x) for part in books for x in part.book.ravel().tolist())


def vector_codes(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept.

    Vectors that are null or hold nulls, NaN or infinities are left out.  Rows are vectors of their
    own whatever their vec_id: repeated ids and vectors share a code; null ids come last among the
    smallest, equal ids in the order of their components.  With fewer vectors than entries the
    codebook has as many as there are; without any the result is empty.  Null labels are one label.
    Vectors that have no equal parts (empty, or of a length that is no multiple of ``parts``) and those
    of another length than most can't share a codebook and are left out like null ones.  A component
    of 16,384 or more is an error, never a wrong distance.  Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    kept = scratch.write("kept", usable(vectors.select("vec_id", "embedding", "label"), parts), compression="zstd")
    state, books = fit_and_assign(scratch, of_one_length(kept), entries, parts, rounds)
    if not books:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _errors(batch, shared.value)

    types = dict(kept.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code binary, error long"
    coded = scratch.write("codes", state.select("vec_id", "label", "v", "code").mapInArrow(errors, schema))
    scratch.keep_only("codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
