"""Texts as blocks of numbered words, and exchanges of keys between blocks and ranges.

A block is a run of documents of one task with a bounded number of words: the distinct
words once, and the words of the documents as their numbers. What a block asks about the
corpus goes out as one packed row for each range of keys and comes back as one packed row
of answers in the order of the keys, so that a shuffle carries a few bytes a distinct key
of a block and no group grows with a frequent word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from .common import give_back, written

#: Words of a block, about (one document may have more); keys of a range, about.
BLOCK_WORDS, RANGE_KEYS = 1_500_000, 1_500_000
#: Bytes of text that are split into words at a time.
SPLIT_BYTES = 8 << 20

_UPPER = dict(zip(range(65, 91), range(97, 123)))


def byte_map(changed: dict[int, int]) -> bytes:
    """For `tokens`: each ASCII byte's replacement; A-Z in lower case."""
    return bytes((_UPPER | changed).get(i, i) for i in range(256))


# ---------------------------------------------------------------- packing


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers by planes of bytes."""
    x = np.ascontiguousarray(x, "<u8")
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view("u1").reshape(-1, 8)[:, :wide].T)
    return bytes([wide]) + zstandard.compress(planes.tobytes(), 1)


def unpacked(body: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(body[1:]), "u1").reshape(body[0], -1)
    out = np.zeros((flat.shape[1], 8), "u1")
    out[:, : body[0]] = flat.T
    return out.view("<u8").ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    """Ascending integers, as differences."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_sorted(body: bytes) -> np.ndarray:
    return np.cumsum(unpacked(body), dtype="u8")


def packed_words(words: pa.Array) -> bytes:
    """Strings without line feeds."""
    return zstandard.compress(b"\n".join(words.cast(pa.binary()).to_pylist()) if len(words) else b"", 3)


def unpacked_words(body: bytes, n: int) -> list[bytes]:
    return zstandard.decompress(body).split(b"\n") if n else []


def packed_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked_table(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- words


def tokens(texts: pa.Array, chars: bytes, breaks: str | None = None) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and the number of each text's words. Bytes
    are replaced by `chars` first; then words stand between ASCII white space. A line feed is
    a word of its own, `breaks`, if that is given. Nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    if data is not None:
        texts = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(data.to_pybytes().translate(chars))], offset=texts.offset)
    words, counts = [pa.array([], texts.type)], [np.zeros(0, "i8")]
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPLIT_BYTES, "right")))
        part = texts.slice(at, to - at)
        lists = pc.ascii_split_whitespace(pc.replace_substring(part, "\n", f" {breaks} ") if breaks else part)
        flat, lens = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("i8")
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not full.all():
            lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[full], minlength=len(lens))
            flat = flat.filter(pa.array(full))
        words.append(flat)
        counts.append(lens)
        at = to
    return pa.concat_arrays(words), np.concatenate(counts)


def runs(batches: Iterator[pa.RecordBatch], chars: bytes, breaks: str | None = None, size: int = BLOCK_WORDS) -> Iterator[tuple[pa.Table, np.ndarray, list[bytes], np.ndarray]]:
    """Runs of documents of about `size` words: their other columns, numbers of words, the
    distinct words, and all words as numbers of these. The text is the last column."""
    rows, lens, words, held = [], [], [], 0

    def run() -> tuple[pa.Table, np.ndarray, list[bytes], np.ndarray]:
        coded = pa.chunked_array(words).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        return pa.Table.from_batches(rows), np.concatenate(lens), coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()

    for batch in batches:
        flat, n = tokens(batch.column(batch.num_columns - 1), chars, breaks)
        other = batch.select(range(batch.num_columns - 1))
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size - held, "right")))
            rows.append(other.slice(at, to - at))
            lens.append(n[at:to])
            words.append(flat.slice(before, int(ends[to - 1]) - before))
            held += len(words[-1])
            at = to
            if held >= size or at < len(n):
                yield run()
                rows, lens, words, held = [], [], [], 0
    if rows:
        yield run()


BLOCK = "block long, n_words long, docs binary, lens binary, words binary, n_distinct int, ids binary"


def token_blocks(docs: DataFrame, kept: list[Column], text: Column, chars: bytes, breaks: str | None = None, size: int = BLOCK_WORDS) -> DataFrame:
    """The blocks of all documents, written: columns `kept` in `docs`, numbers of words in
    `lens`, distinct words in `words`, and the documents' words in `ids`."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, (rows, lens, words, ids) in enumerate(runs(batches, chars, breaks, size)):
            values = [first + k, len(ids), packed_table(rows), packed(lens), zstandard.compress(b"\n".join(words), 3), len(words), packed(ids)]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in BLOCK.split(", ")])
        give_back()

    return written(docs.select(*kept, text).mapInArrow(built, BLOCK), "token-blocks")


def ranges_for(n_keys: int) -> int:
    """Number of ranges for about so many keys: a power of two, so that it is some top bits."""
    return 1 << max(0, (n_keys // RANGE_KEYS).bit_length())
