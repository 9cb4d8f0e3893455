"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols are the leaves of a segment tree; a leaf's key is the merge rank
of the pair that starts there, joined with its position, so the root yields the leftmost
lowest-rank merge. A merge rewrites three leaves (the pair, the pair before it, the
symbol that went) and repairs their paths: logarithmic work for each merge, until the
root holds no mergeable pair. Trees of pre-tokens of similar length are worked on side
by side: each tree level is one array over all of them. A pre-token of `LONG_RUN` bytes or more has
a tree of its own: all leaves with the root's rank are found by one descent and merged from
left to right at once. That gives the same ids where each merge comes after those that make its
parts, as then a merge makes no pair of its own rank or below; files of other order are merged
one pair at a time.

The vocabulary file (JSON of the tokenizers library) is a parameter and is only read.
Supported is its kind of word BPE: NFC, lower case, white space dropped, byte symbols
and a suffix that ends a word; a file with other settings raises ValueError.

Defined results: null text counts as empty; empty and blank texts give no ids; strings of
added tokens in a text become their ids with `added`, as the library does by default, and
are ordinary text without; very long texts are encoded whole; repeated rows are encoded each, and
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

_NONE = np.int64(1 << 62)

# The settings of a vocabulary file that this coder follows.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
UNSET = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")


def check_settings(file: dict) -> None:
    """Raises ValueError where a vocabulary file asks for what this coder does not do."""
    model, before, cut = file["model"], file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, good in (
            ("model", model.get("type") == "BPE" and not any(model.get(k) for k in UNSET)),
            ("normalizer", before.get("normalizers") == NORMALIZERS),
            ("pre_tokenizer", cut.get("pretokenizers") == [SPLIT, BYTES]),
            ("decoder", file.get("decoder") is None),
            ("post_processor", file.get("post_processor") is None),
        )
        if not good
    ]
    if wrong:
        raise ValueError(f"unsupported settings of the vocabulary file: {', '.join(wrong)}")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the
    others, in order, for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairRanks:
    """Open-addressing table from a pair of ids to (rank, merged id), for arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray) -> None:
        size = 1 << (4 * len(pairs) + 1).bit_length()
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, "i8")
        self.rank = np.full(size, -1, "i8")
        self.merged = np.zeros(size, "i8")
        todo = np.arange(len(pairs))
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        slot = self._hash(keys)
        while len(todo):
            free = self.keys[slot] < 0
            take, first = np.unique(slot[free], return_index=True)
            rows = todo[free][first]
            self.keys[take], self.rank[take], self.merged[take] = keys[rows], rows, merged[rows]
            rest = np.ones(len(todo), bool)
            rest[np.flatnonzero(free)[first]] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(40)).astype("i8") & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (or -1) and merged ids."""
        keys = left << 32 | right
        slot = self._hash(keys)
        seen = self.keys[slot]
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            seen = self.keys[slot[todo]]
            todo = todo[(seen != keys[todo]) & (seen >= 0)]
        return np.where(self.keys[slot] == keys, self.rank[slot], -1), self.merged[slot]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    LIMIT = 150_000  # of about 350 bytes each
    LONG_RUN = 1 << 12

    def __init__(self, path: str, added: bool = False) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        check_settings(file)
        model = file["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        tokens = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names = [""] * (max([*vocab.values(), *tokens.values()]) + 1)
        for name, i in [*vocab.items(), *tokens.items()]:
            self.names[i] = name
        self.added = tokens if added else {}
        if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must stand for their exact content")
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(tokens, key=len, reverse=True))) if self.added else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], "i8")
        self.table = PairRanks(ids[:, :2], ids[:, 2])
        latest = np.full(len(self.names), -1, "i8")  # rank of the last merge that makes a symbol
        latest[ids[:, 2]] = np.arange(len(ids))
        self.in_order = bool((latest[ids[:, :2]] < np.arange(len(ids))[:, None]).all())
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], "i8")
        self.final = np.array([vocab[s + self.suffix] for s in symbols], "i8")
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.memo: dict[str, tuple[str, str]] = {}

    # -- segment trees

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaf keys of pairs; `right` is -1 where there is no right neighbour."""
        rank, _ = self.table.find(left, np.maximum(right, 0))
        return np.where((right >= 0) & (rank >= 0), rank * width + at, _NONE)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank, _ = self.table.find(left, right)
        return np.where(rank >= 0, rank, _NONE)

    def _trees(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Merged ids of words of at most `width` bytes; width is a power of two."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), "u1")
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sym = np.full((width + 1, n), -1, "i8")
        sym[col, row] = self.inner[flat]
        last = flat[np.cumsum(lengths) - 1]
        sym[lengths - 1, np.arange(n)] = self.final[last]
        after = np.tile(np.arange(1, width + 2)[:, None], (1, n))
        before = np.tile(np.arange(-1, width)[:, None], (1, n))
        tree = np.full((2 * width, n), _NONE, "i8")
        live = sym[:width] >= 0
        c, r = np.nonzero(live)
        tree[width + c, r] = self._keys(sym[c, r], sym[c + 1, r], c, width)
        level = width
        while level > 1:
            half = level // 2
            tree[half:level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level = half
        active = np.flatnonzero(tree[1] < _NONE)
        while len(active):
            at = tree[1, active] % width
            right = after[at, active]
            _, merged = self.table.find(sym[at, active], sym[right, active])
            sym[at, active] = merged
            sym[right, active] = -1
            following = after[right, active]
            after[at, active] = following
            inside = following < width
            before[following[inside], active[inside]] = at[inside]
            # the pair that now starts here, the removed symbol, the pair before
            nxt = np.where(following < width, sym[np.minimum(following, width), active], -1)
            self._put(tree, width, at, active, self._keys(merged, nxt, at, width))
            self._put(tree, width, right, active, np.full(len(active), _NONE))
            left = before[at, active]
            has = left >= 0
            if has.any():
                lft, act = left[has], active[has]
                self._put(tree, width, lft, act, self._keys(sym[lft, act], merged[has], lft, width))
            active = active[tree[1, active] < _NONE]
        out = sym[:width].T
        keep = out >= 0
        return np.split(out[keep], np.cumsum(keep.sum(axis=1))[:-1])

    @staticmethod
    def _put(tree: np.ndarray, width: int, at: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> None:
        node = at + width
        tree[node, rows] = keys
        node = node >> 1
        while len(node) and node[0] >= 1:
            tree[node, rows] = np.minimum(tree[2 * node, rows], tree[2 * node + 1, rows])
            node = node >> 1

    def _long_tree(self, word: bytes) -> np.ndarray:
        """Merged ids of one long word: in each round all pairs of the root's rank."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        sym = self.inner[np.frombuffer(word, "u1")]
        sym[-1] = self.final[word[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        tree = np.full(2 * width, _NONE, "i8")  # ranks alone: places come from the descent
        tree[width : width + n - 1] = self._ranks(sym[:-1], sym[1:])
        level = width
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        while tree[1] < _NONE:
            rank, nodes = tree[1], np.array([1])
            while nodes[0] < width:
                nodes = np.repeat(2 * nodes, 2)
                nodes[1::2] += 1
                nodes = nodes[tree[nodes] == rank]
            at = nodes - width
            # of pairs that share a symbol, the first, third, ... are merged
            chained = np.r_[False, after[at[:-1]] == at[1:]]
            first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            right = after[at]
            following = after[right]
            sym[at] = self.table.find(sym[at[:1]], sym[right[:1]])[1]
            sym[right] = -1
            after[at] = following
            inside = following < n
            before[following[inside]] = at[inside]
            left = before[at]
            touched = np.unique(np.r_[left[left >= 0], at])
            nxt = after[touched]
            has = nxt < n
            ranks = np.full(len(touched), _NONE)
            ranks[has] = self._ranks(sym[touched[has]], sym[nxt[has]])
            tree[width + touched], tree[width + right] = ranks, _NONE
            nodes = np.sort(np.r_[touched, right]) + width >> 1
            while nodes[0] >= 1:
                nodes = nodes[np.r_[True, nodes[1:] != nodes[:-1]]]
                tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
                nodes = nodes >> 1
        return sym[sym >= 0]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of pre-tokens, given as bytes (none empty)."""
        out: list[np.ndarray | None] = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if self.in_order and len(w) >= self.LONG_RUN:
                out[i] = self._long_tree(w)
                continue
            classes.setdefault(1 << max(1, (len(w) - 1).bit_length()), []).append(i)
        for width, members in classes.items():
            step = max(1, (1 << 19) // width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for i, ids in zip(part, self._trees([words[i] for i in part], width)):
                    out[i] = ids
        return out

    # -- texts

    def _chunk_words(self, chunk: str) -> list[str]:
        """Pre-tokens of a text without spaces and line feeds."""
        chunk = unicodedata.normalize("NFC", chunk)
        chunk = chunk.replace("Σ", "σ").lower()  # character by character: no final sigma
        return self.word.findall(chunk)

    def _learn(self, chunks: list[str]) -> None:
        words = [self._chunk_words(c) for c in chunks]
        distinct = sorted({w for ws in words for w in ws})
        ids = dict(zip(distinct, (x.tolist() for x in self.merge([w.encode() for w in distinct]))))
        names = self.names
        for chunk, ws in zip(chunks, words):
            flat = [i for w in ws for i in ids[w]]
            self.memo[chunk] = (" ".join(map(str, flat)), " ".join([names[i] for i in flat]))

    def _chunks(self, text: str) -> list[str]:
        """Pieces between spaces and line feeds; added tokens are pieces of their own."""
        if self.added and any(t in text for t in self.added):
            text = self.cut.sub(lambda m: f" {m[0]} ", text)
        return text.replace("\n", " ").split(" ")

    def strings(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text: decimal ids joined by spaces, and the decoded text (tokens
        joined by spaces, as a decoder-less vocabulary decodes)."""
        chunks = [self._chunks(t) for t in texts]
        if len(self.memo) > self.LIMIT:
            self.memo.clear()
        for token, i in self.added.items():
            self.memo[token] = (str(i), self.names[i])
        missing = {c for cs in chunks for c in cs} - self.memo.keys()
        if missing:
            self._learn(list(missing))
        get = self.memo.__getitem__
        for cs in chunks:
            found = [x for x in map(get, cs) if x[0]]
            yield " ".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def encode(self, text: str) -> list[int]:
        ids, _ = next(self.strings([text]))
        return [int(x) for x in ids.split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


_coders: dict[tuple[str, bool], WordBpe] = {}


def coder_of(path: str, added: bool = False) -> WordBpe:
    """The worker process's coder, with its tables; a task empties its memo at the end."""
    if (path, added) not in _coders:
        _coders[path, added] = WordBpe(path, added)
    return _coders[path, added]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder_of(path, added)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                n, ids, decoded = [], [], []
                for coded, plain in bpe.strings(texts):
                    n.append(coded.count(" ") + 1 if coded else 0)
                    ids.append(hashlib.sha256(coded.encode()).hexdigest())
                    decoded.append(hashlib.sha256(plain.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.memo.clear()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(job, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """doc_id and ids array<int> of every whole text."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder_of(path, added)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [[int(x) for x in coded.split()] for coded, _ in bpe.strings(["" if t is None else t for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.memo.clear()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(job, "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded` (or replaces it): tokens joined by spaces; null ids decode to an
    empty text."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder_of(path)
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(ids_col) if at is None else at
            decoded = pa.array([bpe.decode(x or []) for x in batch.column(at).to_pylist()], pa.string())
            yield batch.append_column("decoded", decoded)

    coded = coded.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(job, f"{fields}, decoded string")
