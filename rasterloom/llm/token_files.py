"""Token files: ids coded with a static range asymmetric numeral system (rANS).

`write_tokens` lays out ids in ascending document order. The corpus is cut into ranges
of ids; a task encodes texts, the ids travel once to their range, and each range is one
part of the output. Counts of all ids give one frequency table, shared by all blocks. A
block holds whole documents and is coded with many interleaved lanes (numpy works on
all lanes at once), 64-bit states and 32-bit words; it carries the states and stream
position at checkpoints, so that a reader can start inside it, and CRC-32 checksums of its
head and of the ids from each checkpoint to the next. Blocks are rows of a Parquet table, written by Spark's committer: a lost
executor's attempt leaves nothing behind. `read_tokens` decodes blocks in parallel.

Layout of a block (little-endian): magic ``RNS1``; u32 lanes, documents, checkpoints,
words; u64 tokens; u32 CRC-32 of the rest of the head; i64 ids and u32 lengths of documents;
per checkpoint (the first is the start) u32 step, u32 word position, u32 CRC-32 of its ids
and u64 states; u32 words.

Defined results: null text is an empty document, which holds only the end id; rows with
a null id take no part; repeated ids follow one another; an empty table gives an empty
dataset; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

#: The frequency table's sum is 2**SCALE_BITS; states stay in [2**31, 2**63).
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
MAGIC = b"RNS1"
BLOCK_TOKENS = 1 << 20
MAX_LANES = 4096
CHECKPOINT_STEPS = 128
#: Texts that are encoded at a time, and bytes of them, about.
TEXTS, TEXT_BYTES = 2048, 8 << 20


# ---------------------------------------------------------------- frequency table


def quantised(counts: np.ndarray) -> np.ndarray:
    """Integer frequencies with sum 2**SCALE_BITS; at least 1 for each id that occurs."""
    total, goal = int(counts.sum()), 1 << SCALE_BITS
    out = np.zeros(len(counts), "i8")
    if not total:
        return out
    used = counts > 0
    exact = counts * ((goal - used.sum()) / total)
    out[used] = np.floor(exact[used]).astype("i8") + 1
    short = goal - int(out.sum())
    order = np.argsort(-(exact - np.floor(exact)) * used, kind="stable")[:short]
    out[order] += 1
    return out


class Table:
    """Lookup arrays of a frequency table."""

    def __init__(self, freqs: np.ndarray) -> None:
        self.freq = freqs.astype("u8")
        self.start = np.r_[0, np.cumsum(freqs)[:-1]].astype("u8")
        self.symbol = np.repeat(np.arange(len(freqs)), freqs).astype("u4")


# ---------------------------------------------------------------- coder


def encode_block(doc_ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, table: Table) -> bytes:
    n = len(tokens)
    lanes = int(min(MAX_LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    bits, half = np.uint64(SCALE_BITS), np.uint64(32)
    state = np.full(lanes, LOW, "u8")
    chunks: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []  # step, words from the end, states
    written_words = 0
    freq, start = table.freq[tokens], table.start[tokens]
    room = np.uint64(63 - SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        at = step * lanes
        m = min(lanes, n - at)
        x, f = state[:m], freq[at : at + m]
        over = x >= (f << room)
        if over.any():
            chunks.append(x[over].astype("u4"))
            written_words += len(chunks[-1])
            x = np.where(over, x >> half, x)
        q = x // f
        state[:m] = (q << bits) + (x - q * f) + start[at : at + m]
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((step, written_words, state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "u4")
    marks.append((0, len(words), state))
    marks = marks[::-1]
    places = [m[0] * lanes for m in marks] + [n]
    raw = memoryview(tokens.astype("<u4").tobytes())
    head = [doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes()]
    for (step, from_end, states), a, b in zip(marks, places, places[1:]):
        head += [np.array([step, len(words) - from_end, zlib.crc32(raw[4 * a : 4 * b])], "<u4").tobytes(), states.astype("<u8").tobytes()]
    head = b"".join(head)
    sizes = np.array([lanes, len(doc_ids), len(marks), len(words)], "<u4").tobytes() + np.array([n], "<u8").tobytes()
    check = np.array([zlib.crc32(head, zlib.crc32(sizes))], "<u4").tobytes()
    return b"".join([MAGIC, sizes, check, head, words.astype("<u4").tobytes()])


class Block:
    """A block that was read; `segment(i)` decodes its ids from a checkpoint to the next,
    `tokens()` all of them. Either checks what it has decoded."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.lanes, docs, marks, words = (int(x) for x in np.frombuffer(data, "<u4", 4, 4))
        self.n = int(np.frombuffer(data, "<u8", 1, 20)[0])
        at, end = 32, 32 + 12 * docs + marks * (12 + 8 * self.lanes)
        if zlib.crc32(data[32:end], zlib.crc32(data[4:28])) != int(np.frombuffer(data, "<u4", 1, 28)[0]):
            raise ValueError("a block's checksum does not match its head")
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.lengths = np.frombuffer(data, "<u4", docs, at)
        at += 4 * docs
        self.marks = []
        for _ in range(marks):
            step, position, crc = (int(x) for x in np.frombuffer(data, "<u4", 3, at))
            self.marks.append((step, position, crc, np.frombuffer(data, "<u8", self.lanes, at + 12)))
            at += 12 + 8 * self.lanes
        self.words = np.frombuffer(data, "<u4", words, at)

    def segment(self, mark: int, table: Table) -> np.ndarray:
        step, position, crc, state = self.marks[mark]
        steps = self.marks[mark + 1][0] if mark + 1 < len(self.marks) else -(-self.n // self.lanes)
        state = state.copy()
        mask, bits, half = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
        out, done = np.empty(max(0, min(self.n, steps * self.lanes) - step * self.lanes), "<u4"), 0
        for s in range(step, steps):
            m = min(self.lanes, self.n - s * self.lanes)
            x = state[:m]
            slot = x & mask
            symbol = table.symbol[slot]
            x = table.freq[symbol] * (x >> bits) + slot - table.start[symbol]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << half) | self.words[position : position + len(low)]
                position += len(low)
            state[:m] = x
            out[done : done + m] = symbol
            done += m
        if zlib.crc32(out.tobytes()) != crc:
            raise ValueError("a segment's checksum does not match its ids")
        return out

    def tokens(self, table: Table) -> np.ndarray:
        return np.concatenate([self.segment(i, table) for i in range(len(self.marks))])


# ---------------------------------------------------------------- tokenizer

#: Makes, in a task, the function from texts (no nulls) to all their ids and their lengths.
Encoder = Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]]


# What a byte of a text is. OTHER: part of a character that is no white space, but may be a
# letter, digit or mark. UNSURE: control characters, white space beyond ASCII, and what may be such.
UNSURE, LETTER, DIGIT, MARK, QUOTE, OTHER, SPACE, FEED = range(8)
SOLID = (LETTER, DIGIT, MARK, QUOTE, OTHER)


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, "u1")
    for i in range(128):
        c = chr(i)
        kinds[i] = LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else MARK if "!" <= c <= "~" else UNSURE
    kinds[0x20], kinds[[0x09, 0x0A, 0x0D]] = SPACE, FEED
    kinds[0xC3:0xCA] = LETTER  # U+00C0 to U+024F are letters but for two signs
    return kinds


def _pairs() -> np.ndarray:
    """By kinds of two neighbours (8 * left + right): bit 1, no pre-token holds both; bit 2,
    the same if the left one is the only white space there."""
    found = np.zeros((8, 8), "u1")
    for left in SOLID:
        found[left, [SPACE, FEED]] = 1
        found[FEED, left] = 2
    for left in (LETTER, DIGIT, MARK, QUOTE):
        for right in (LETTER, DIGIT, MARK, QUOTE):
            found[left, right] = left != right and {left, right} != {MARK, QUOTE} and (left, right) != (QUOTE, LETTER)
    return found.ravel()


KINDS, PAIRS = _kinds(), _pairs()
#: A piece without white space or controls, but for a space in front.
SOLID_PIECE = re.compile(rb" ?[^\x00-\x20\x7f]+").fullmatch


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 text."""
    kinds = KINDS[data]
    if not len(data) or int(data.max()) < 0x80:
        return kinds
    latin = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    kinds[latin + 1] = LETTER
    signs = latin[(data[latin] == 0xC3) & ((data[latin + 1] == 0x97) | (data[latin + 1] == 0xB7))]
    kinds[signs] = kinds[signs + 1] = OTHER
    short = np.flatnonzero(data == 0xC2)
    short = short[data[short + 1] <= 0xA0]
    kinds[short] = kinds[short + 1] = UNSURE
    for lead, seconds in ((0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)), (0xEF, (0xBB,))):
        at = np.flatnonzero(data == lead)
        at = at[np.isin(data[at + 1], np.array(seconds, "u1"))]
        if lead == 0xE2:  # dashes, quotation marks and dots are none
            at = at[~((data[at + 1] == 0x80) & (data[at + 2] >= 0x90) & (data[at + 2] < 0xA8))]
        kinds[at] = kinds[at + 1] = kinds[at + 2] = UNSURE
    return kinds


class PieceEncoder:
    """Ids of whole texts from a byte-level BPE of the tokenizers library.

    Its pre-tokenizer looks ahead only, so a text can be cut wherever no pre-token reaches
    over: in front of white space, behind a single line feed, and between letters, digits and
    marks of which both sides are known. Where it is not certain that a cut is right there
    is none. Each distinct piece is encoded once and kept in a bounded memo, which forgets
    those that did not come again; pieces of more than `LONG` bytes are encoded whenever they
    come. Texts that hold an added token are one piece, unless `added` is off and these are
    ordinary text; so are all texts if the file's pre-tokenizer is another one. Pieces are
    cut and numbered for many texts at once; Python sees each distinct piece of a batch once.
    """

    LIMIT = 700_000  # of about 200 bytes each
    LONG = 64

    def __init__(self, path: str, added: bool = False) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = not added
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()] if added else []
        settings = json.loads(self.tok.to_str())
        before = settings["pre_tokenizer"] or {}
        self.cuts = not settings["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        #: For ids: starts with a space, is a line feed.
        self.spaced, self.feeds = (np.zeros(max(vocab.values()) + 1, bool) for _ in range(2))
        self.spaced[[i for s, i in vocab.items() if s.startswith("Ġ")]] = True
        self.feeds[[i for s, i in vocab.items() if s == "Ċ"]] = True
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}  # piece -> its place in the store
        self.flat, self.used = np.zeros(1 << 16, "u4"), 0
        self.begin, self.size, self.stored = np.zeros(1 << 14, "i8"), np.zeros(1 << 14, "i4"), 0
        self.uses = np.zeros(1 << 14, "i4")  # batches that held the piece

    def _forget(self) -> None:
        """Keeps the pieces that came again, half of the limit at most."""
        need = 2
        while np.count_nonzero(self.uses[: self.stored] >= need) > self.LIMIT // 2:
            need *= 2
        kept = self.uses[: self.stored] >= need
        pieces = list(compress(self.memo, kept.tolist()))  # in the order of their places
        ids, sizes = self._gathered(np.flatnonzero(kept))
        self.clear()
        self._store(ids, sizes)
        self.memo.update(zip(pieces, range(len(pieces))))
        self.uses[: self.stored] = 1

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        at, to, end = self.stored, self.stored + len(sizes), self.used + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while to > len(self.begin):
            self.begin, self.size, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size, self.uses))
        self.flat[self.used : end] = ids
        self.size[at:to] = sizes
        self.begin[at:to] = self.used + np.cumsum(sizes) - sizes
        self.stored, self.used = to, end

    def _store_each(self, pieces: list[bytes]) -> None:
        if pieces:
            ids = self._ids([p.decode() for p in pieces])
            self._store(np.concatenate(ids), np.array([len(x) for x in ids]))

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes new pieces: those without white space inside many at a time, one after the
        other if spaces start them and as lines if not."""
        solid = list(map(bool, map(SOLID_PIECE, pieces))) if self.cuts else [False] * len(pieces)
        words = [p for p, ok in zip(pieces, solid) if ok and p[0] == 32]
        lines = [p for p, ok in zip(pieces, solid) if ok and p[0] != 32]
        rest = [p for p, ok in zip(pieces, solid) if not ok]
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            ids = self._ids([b"".join(part).decode()])[0]
            begin = np.flatnonzero(self.spaced[ids])
            if len(begin) == len(part):
                self._store(ids, np.diff(begin, append=len(ids)))
            else:
                self._store_each(part)
        for at in range(0, len(lines), 256):
            part = lines[at : at + 256]
            ids = self._ids([b"\n".join(part).decode()])[0]
            feeds = self.feeds[ids]
            ends = np.flatnonzero(feeds)
            if len(ends) == len(part) - 1:
                self._store(ids[~feeds], np.diff(ends, prepend=-1, append=len(ids)) - 1)
            else:
                self._store_each(part)
        self._store_each(rest)
        self.memo.update(zip(chain(words, lines, rest), range(self.stored - len(pieces), self.stored)))

    def _gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids at these places of the store, one after the other, and their numbers."""
        size = self.size[places]
        upto = np.cumsum(size, dtype="i8") - size
        at = np.repeat(self.begin[places] - upto, size)
        at += np.arange(len(at))
        return self.flat[at], size

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts one after the other, and each text's first piece (and the end)."""
        large = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, "i8" if large else "i4")[texts.offset : texts.offset + len(texts) + 1]
        low, ends = int(ends[0]), ends - ends[0]
        data = data.slice(low, int(ends[-1])) if data is not None else pa.py_buffer(b"")
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = True
        if self.cuts and len(data):
            kinds = kinds_of(np.frombuffer(data, "u1"))
            pairs = PAIRS[kinds[:-1] << 3 | kinds[1:]]
            inner = cut[1:-1]
            inner |= (pairs & 1).view(bool)
            inner[1:] |= (pairs[1:] >> 1 & pairs[:-1]).view(bool)
            for token in self.added:
                for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist():
                    cut[ends[i] + 1 : ends[i + 1]] = False
        at = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.large_binary() if large else pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(ends.dtype)), data])
        return pieces, np.searchsorted(at, ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        if not len(texts):
            return np.zeros(0, "u4"), np.zeros(0, "i8")
        if len(self.memo) > self.LIMIT:
            self._forget()
        cut, first = self._cut(texts)
        coded = cut.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.memo.get, pieces.tolist(), repeat(-1)), "i8", len(pieces))
        new = np.flatnonzero(places < 0)
        long = np.array(list(map(len, pieces[new].tolist())), "i8") > self.LONG
        if not long.all():
            found = pieces[new[~long]].tolist()
            self._learn(found)
            places[new[~long]] = list(map(self.memo.get, found))
        self.uses[places[places >= 0]] += 1
        kept = self.flat, self.used, self.begin, self.size, self.stored, self.uses
        self._store_each(pieces[new[long]].tolist())  # for this batch alone
        places[new[long]] = np.arange(kept[4], self.stored)
        ids, size = self._gathered(places[coded.indices.to_numpy()])
        self.flat, self.used, self.begin, self.size, self.stored, self.uses = kept
        upto = np.concatenate((np.zeros(1, "i8"), np.cumsum(size, dtype="i8")))
        return ids, np.diff(upto[first])


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder_of(path: str, added: bool = False) -> PieceEncoder:
    """The worker process's encoder: its memo serves all tasks that run there."""
    if (path, added) not in _encoders:
        _encoders[path, added] = PieceEncoder(path, added)
    return _encoders[path, added]


def tokenizer_encoder(path: str, added: bool = False) -> Encoder:
    """`added`: the file's added tokens become their ids, as the library does by default."""
    return lambda: encoder_of(path, added).encode


# ---------------------------------------------------------------- jobs


def _range_ends(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """Ids that cut the documents into ranges of about equal size."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if parts < 2:
        return []
    found = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return sorted(set(found or []))


def write_tokens(
    docs: DataFrame,
    make_encoder: Encoder,
    path: str,
    vocab_size: int,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes ``path/blocks`` (part, block, n_tokens, payload) and ``path/table``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = _range_ends(docs, id_col, parts)
    width = "<u2" if vocab_size <= 1 << 16 else "<u4"

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed ids of documents, and one last row (n = -1) with the task's counts."""
        encode, pack = make_encoder(), zstandard.ZstdCompressor(level=1)
        total = np.zeros(vocab_size, "i8")
        for batch in batches:
            ends_at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype="i8")
            at = to = 0
            while (at := to) < batch.num_rows:
                to = int(np.searchsorted(ends_at, (ends_at[at - 1] if at else 0) + TEXT_BYTES, "right"))
                to = min(max(at + 1, to), at + TEXTS, batch.num_rows)
                one = batch.slice(at, to - at)
                found, n = encode(one.column(1).fill_null(""))
                found, n = np.insert(found, np.cumsum(n), end_id).astype(width), n + 1
                total += np.bincount(found, minlength=vocab_size)
                planes = [pack.compress(x.tobytes()) for x in np.split(found, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), pa.array(np.searchsorted(ends, one.column(0).to_numpy()).astype("i4")), pa.array(n), pa.array(planes, pa.binary())], ["id", "part", "n", "ids"]
                )
        last = [pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([-1], pa.int64()), pa.array([pack.compress(total.tobytes())], pa.binary())]
        yield pa.RecordBatch.from_arrays(last, ["id", "part", "n", "ids"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stored = written(rows.mapInArrow(ids, "id long, part int, n long, ids binary"), "token-ids")

    def unpacked(pack: zstandard.ZstdDecompressor, n: int, data: bytes) -> np.ndarray:
        return np.frombuffer(pack.decompress(data, max_output_size=4 * n), width).astype("u4")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdDecompressor()
        for batch in batches:
            for data in batch.column(0):
                total = np.frombuffer(pack.decompress(data.as_py(), max_output_size=8 * vocab_size), "i8")
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype("i4")), pa.array(total[found])], ["symbol", "n"])

    sums = stored.where("n < 0").select("ids").mapInArrow(counted, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocab_size, "i8")
    for row in sums.collect():  # at most one row for each id of the vocabulary
        counts[row.symbol] = row.n
    freqs = quantised(counts)
    used = [(int(i), int(freqs[i])) for i in np.flatnonzero(freqs)]
    spark.createDataFrame(used, "symbol int, freq int").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freqs.astype("u4"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # workers are reused: texts are encoded by now
        pack, table = zstandard.ZstdDecompressor(), Table(shared.value)
        held: list[tuple[int, np.ndarray]] = []
        size, now, number = 0, None, 0

        def out() -> pa.RecordBatch:
            payload = encode_block(np.array([d for d, _ in held]), np.array([len(t) for _, t in held]), np.concatenate([t for _, t in held]), table)
            first, last = held[0][0], held[-1][0]
            columns = [[now], [number], [size], [first], [last]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))] + [pa.array([payload], pa.binary())], ["part", "block", "n_tokens", "first_id", "last_id", "payload"])

        for batch in batches:
            for doc_id, n, data, p in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (size >= BLOCK_TOKENS or p != now):
                    yield out()
                    held, size, number = [], 0, number + 1 if p == now else 0
                now = p
                held.append((doc_id, unpacked(pack, n, data)))
                size += n
        if held:
            yield out()

    dealt = stored.where("n > 0").select("id", "n", "ids", "part").repartition(max(1, len(ends) + 1), "part").sortWithinPartitions("part", "id", "ids")
    dealt.mapInArrow(blocks, "part int, block long, n_tokens long, first_id long, last_id long, payload binary").write.parquet(f"{path}/blocks")


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    table = spark.read.parquet(f"{path}/table").collect()  # one row for each used id
    freqs = np.zeros(max((r.symbol for r in table), default=0) + 1, "i8")
    for r in table:
        freqs[r.symbol] = r.freq
    shared = spark.sparkContext.broadcast(freqs)
    blocks = spark.read.parquet(f"{path}/blocks")

    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = parts.select("part", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "block", (F.col("part_start") + F.col("before")).alias("start"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Table(shared.value)
        for batch in batches:
            for part, number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block = Block(payload.as_py())
                raw = block.tokens(lookup).astype("<u4").tobytes()
                ends = np.cumsum(block.lengths.astype("i8"))
                begin = ends - block.lengths
                view = memoryview(raw)
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(block.doc_ids), pa.array(begin), pa.array(block.lengths.astype("i8")), pa.array(crcs, pa.int64())],
                    ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    docs = blocks.select("part", "block", "payload").mapInArrow(decoded, "part int, block long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "block"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark, name: str = "tokens") -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
