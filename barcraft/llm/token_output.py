"""Operator 6: token ids as Arrow files of equal-length sequences and masks.

Documents in ascending doc_id order are encoded, an end id closes each, and the stream of
ids is cut into sequences of one length.  Each partition writes

* ``part-NNNNN.arrow``: an Arrow IPC file whose batches hold ``input_ids`` (fixed-size list
  of the narrowest unsigned type that the vocabulary needs) and ``mask`` (fixed-size list of
  booleans, false on the padding of the file's last sequence); memory-mapped, sequence i is
  read at a known place without copying or decoding;
* ``part-NNNNN.index.arrow``: doc_id, start (within the file) and n_tokens per document;

and one manifest row, from which a file's place in the whole stream follows.  Partitions are
ranges of doc_id, as many as FILE_BYTES of text each make necessary, so files have about one
size whatever the table's; beyond MOST_FILES they grow, and a small table has smaller ones, a
file for each core.

Words are encoded once and remembered where that gives the ids of the whole text: under a
normalizer that lower-cases and a pre-tokenizer of WORD_PATTERN, which no blank belongs to.
Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barcraft.llm.scratch import Scratch, lasting_folder, open_folder, put_file
from barcraft.llm.text import chunks

SEQUENCE, BATCH = 1024, 256
#: Text bytes of a file, the least where cores would be idle, and the number of files from which on
#: they hold more.
FILE_BYTES, LEAST_BYTES, MOST_FILES = 32 << 20, 1 << 20, 100_000
END_ID, PAD_ID = 1, 0
#: Distinct words whose ids a worker remembers before it starts anew.
REMEMBERED = 600_000

#: Pre-tokens of the tokenizers whose words can be encoded one by one (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Stands between words that are encoded in one call; words that hold it are not.
_BETWEEN = "\u00a6"
_TAIL = re.compile(rb"(?<=[a-z])[.,;:!?](?=\s|\Z)")


class _Memory(dict):
    """Number of each word; ``new`` has those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def _loosened(text: bytes) -> bytes:
    """The text with A-Z lowered and a lone mark after a letter set apart: fewer distinct
    words, same ids under a lower-casing tokenizer.  Texts with what may be a special token
    or a combining mark stay as they are."""
    if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
        return text
    return _TAIL.sub(rb" \g<0>", text.lower())


class WordEncoder:
    """Encodes texts with a lower-casing tokenizer whose pre-tokens never cross white space
    and keep letters from other signs.  Each distinct word is encoded once and remembered;
    the ids are those that encoding the whole text gives."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.mark = self._ids([_BETWEEN])[0]
        self._reset()

    def _reset(self) -> None:
        self.memory = _Memory()
        self.flat, self.offset = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        words = [w.decode("utf-8", "replace") for w in self.memory.new]
        found: list[list[int]] = [[]] * len(words)
        plain = [i for i, w in enumerate(words) if _BETWEEN not in w]
        n = len(self.mark)
        for lo in range(0, len(plain), 500):
            some = plain[lo : lo + 500]
            ids = np.array(self._ids([f" {_BETWEEN} ".join(words[i] for i in some)])[0], np.int64)
            # the mark's ids end a word of their own, so they mark nothing else
            at = np.flatnonzero(ids[n - 1 :] == self.mark[-1])
            at = at[np.all([ids[at + k] == self.mark[k] for k in range(n)], axis=0)] if len(at) else at
            begins, ends = np.concatenate(([0], at + n)), np.concatenate((at, [len(ids)]))
            for i, b, e in zip(some, begins.tolist(), ends.tolist(), strict=True):
                found[i] = ids[b:e]
        for i in set(range(len(words))) - set(plain):
            found[i] = self._ids([words[i]])[0]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.flat = np.concatenate((self.flat, *(np.asarray(x, np.uint32) for x in found)))
        self.offset = np.concatenate((self.offset, self.offset[-1] + np.cumsum(sizes)))
        self.memory.new = []

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if len(self.memory) > REMEMBERED:
            self._reset()
        split = [_loosened(t).split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        number = np.fromiter(map(self.memory.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.memory.new:
            self._learn()
        size = self.offset[number + 1] - self.offset[number]
        ends = np.cumsum(size)
        where = np.repeat(self.offset[number] - (ends - size), size) + np.arange(int(size.sum()))
        word_ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return self.flat[where], np.diff(word_ends)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class TextEncoder:
    """Encodes whole texts: right with any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(x, np.uint32) for x in found)]), sizes


def word_wise(tokenizer) -> bool:
    """Whether encoding word by word gives the ids of the whole text."""
    made = json.loads(tokenizer.to_str())
    steps = lambda x, inner: [] if not x else x.get(inner, [x])
    normal = [n["type"] for n in steps(made["normalizer"], "normalizers")]
    cuts = steps(made["pre_tokenizer"], "pretokenizers")
    first = cuts[0] if cuts else {}
    splits = first.get("type") == "Split" and first["pattern"] == {"Regex": WORD_PATTERN} and first["behavior"] == "Removed" and first["invert"]
    return bool(splits) and normal == ["NFC", "Replace", "Lowercase"] and all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"] for c in cuts[1:])


_encoders: dict[str, WordEncoder | TextEncoder] = {}


def encoder_of(path: str) -> WordEncoder | TextEncoder:
    """This worker's encoder: what it remembers outlives a task."""
    if path not in _encoders:
        tokenizer = load_tokenizer(path)
        _encoders[path] = WordEncoder(tokenizer) if word_wise(tokenizer) else TextEncoder(tokenizer)
    return _encoders[path]


def narrowest(n_ids: int) -> np.dtype:
    return np.dtype(np.uint16 if n_ids <= 1 << 16 else np.uint32)


def _write(folder: str, tokenizer: str, sequence: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer)
        kind = narrowest(max(encoder.tokenizer.get_vocab_size(), end_id + 1))
        item = pa.from_numpy_dtype(kind)
        schema = pa.schema([("input_ids", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        doc_ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def fill(stream) -> None:
            rest, step = np.zeros(0, kind), sequence * BATCH
            with pa.ipc.new_file(stream, schema) as out:

                def put(ids: np.ndarray, real: int) -> None:
                    mask = np.arange(len(ids)) < real
                    out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence)], schema=schema))

                for batch in batches:
                    for lo, hi, texts in chunks(batch):
                        ids, n = encoder.encode(texts)
                        closed = np.insert(ids.astype(kind), np.cumsum(n), end_id)
                        doc_ids.append(batch.column("doc_id").slice(lo, hi - lo))
                        sizes.append(n + 1)
                        rest = np.concatenate((rest, closed))
                        whole = len(rest) // step * step
                        for at in range(0, whole, step):
                            put(rest[at : at + step], step)
                        rest = rest[whole:].copy()
                if len(rest):
                    padded = np.full(-(-len(rest) // sequence) * sequence, PAD_ID, kind)
                    padded[: len(rest)] = rest
                    put(padded, len(rest))

        name = f"{folder}/part-{part:05d}"
        put_file(f"{name}.arrow", fill)
        n = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        start = np.cumsum(n) - n
        ids = pa.chunked_array(doc_ids, pa.int64()).combine_chunks() if doc_ids else pa.array([], pa.int64())
        index = pa.table({"doc_id": ids, "start": pa.array(start), "n_tokens": pa.array(n)})

        def fill_index(stream) -> None:
            with pa.ipc.new_file(stream, index.schema) as out:
                out.write_table(index)

        put_file(f"{name}.index.arrow", fill_index)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(n)], "n_tokens": [int(n.sum())]})

    return run


def file_number(size: int, cores: int) -> int:
    """Files for texts of ``size`` bytes: of about FILE_BYTES, or smaller ones, down to LEAST_BYTES,
    while there are cores without one; what is read back is the same."""
    return max(1, min(MOST_FILES, max(-(-size // FILE_BYTES), min(cores, -(-size // LEAST_BYTES)))))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, scratch: Scratch, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Writes the files under ``folder`` and returns the manifest (part, file, n_docs,
    n_tokens, base): base is the number of ids in the files before."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = texts.repartitionByRange(file_number(size, docs.sparkSession.sparkContext.defaultParallelism), "doc_id").sortWithinPartitions("doc_id", F.crc32("text"))
    written = scratch.write("manifest", ordered.mapInArrow(_write(folder, tokenizer, sequence, end_id), "part long, file string, n_docs long, n_tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_sequences(name: str) -> tuple[pa.Table, pa.Table]:
    """(sequences, index) of one file, memory-mapped where the store is local."""
    from pyarrow import fs

    out = []
    for suffix in (".arrow", ".index.arrow"):
        store, path = open_folder(name + suffix)
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        out.append(pa.ipc.open_file(source).read_all())
    return out[0], out[1]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            store, path = open_folder(name + ".arrow")
            index_store, index_path = open_folder(name + ".index.arrow")
            with index_store.open_input_file(index_path) as f:
                index = pa.ipc.open_file(f).read_all()
            start, n = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
            sums = np.zeros(len(n), np.int64)
            with store.open_input_file(path) as f:
                reader = pa.ipc.open_file(f)
                held, at, have, turn = np.zeros(0, np.uint32), 0, 0, 0  # ids at..have are held
                for i in range(len(n)):
                    while have < start[i] + n[i]:
                        block = reader.get_batch(turn)
                        ids = block.column(0).flatten().to_numpy(zero_copy_only=False)
                        mask = block.column(1).flatten().to_numpy(zero_copy_only=False)
                        fresh = ids[mask].astype(np.uint32)
                        held, at = np.concatenate((held[start[i] - at :], fresh)), int(start[i])
                        have, turn = have + len(fresh), turn + 1
                    sums[i] = zlib.crc32(held[start[i] - at : start[i] - at + n[i]].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks(), pa.array(start + base), pa.array(n), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    rows = manifest.select("file", "base")
    return rows.repartition(max(1, rows.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Writes docs(doc_id, text, ...) as token files under ``folder`` (default: a fresh one in
    the shared folder, which stays) and reads them back; ``tokenizer`` is the path of a
    tokenizers file that every worker has.

    A null or blank text has the end id alone.  Null doc_ids come first; rows that repeat a
    doc_id are neighbours in the order of a checksum of their texts, each with its own place.
    An empty table gives no rows; other columns, whatever their names, are not read.  A
    document longer than a sequence runs over several; a very long one is encoded whole, by
    itself.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, folder or lasting_folder(docs.sparkSession, "token-files"), scratch, sequence, end_id))
