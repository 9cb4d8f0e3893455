"""Exact deduplication with Patricia-trie owners.

Texts are equal when they are identical after every run of white space became one
space. Each task inserts its normalised texts, as full UTF-8 byte strings, into a
compressed radix trie whose terminal nodes hold the smallest identifier and a count.
A trie over its memory budget spills by subtree: the heaviest subtree leaves as
rows. What the tasks found then meets partitioned by length and content hash, where one
owner trie for each partition merges it and spills in the same way; what it yields, an
owner and a count, meets once more by hash. So a text travels at most once for each task
(and spill) that met it, however many copies it has, and no task gathers a group.

Defined results: null text counts as empty; the owner of a group is its smallest
non-null id; rows with a null id belong to the group but own it only if all ids are
null; repeated rows with the owner's id are all marked kept, and an id that stands on
several texts is judged text by text. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, give_back, mark, without_rows, written

#: Bytes of text that a task's trie holds before it spills its heaviest subtree.
TRIE_BYTES = 16 << 20

#: Bytes of a node and its places in dictionaries, about.
NODE_BYTES = 400

_NO_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class Node:
    """A node of the trie; `edges` has (label, child) by the label's first byte."""

    __slots__ = ("count", "edges", "owner")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.owner = _NO_ID
        self.count = 0


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of `a` and ``b[start:]``."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[start + low : start + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie from byte strings to (smallest id, count)."""

    def __init__(self) -> None:
        self.root = Node()
        self.bytes = 0

    def add(self, key: bytes, owner: int, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            step = node.edges.get(key[at])
            if step is None:
                leaf = Node()
                node.edges[key[at]] = (key[at:], leaf)
                self.bytes += len(key) - at + NODE_BYTES
                node, at = leaf, len(key)
                break
            label, child = step
            if not key.startswith(label, at):
                n = _common(label, key, at)
                middle = Node()
                middle.edges[label[n]] = (label[n:], child)
                node.edges[key[at]] = (label[:n], middle)
                self.bytes += NODE_BYTES
                node, at = middle, at + n
            else:
                node, at = child, at + len(label)
        node.owner = min(node.owner, owner)
        node.count += count

    def pop(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        """(text, owner, count) of all terminals at and below `node`."""
        todo = [(prefix, node or self.root)]
        while todo:
            prefix, node = todo.pop()
            if node.count:
                yield prefix, node.owner, node.count
            todo += [(prefix + label, child) for label, child in node.edges.values()]

    def spill(self) -> Iterator[tuple[bytes, int, int]]:
        """Takes the heaviest subtree out and yields its terminals."""
        node, prefix = self.root, b""
        while len(node.edges) == 1 and not node.count:
            (label, child), = node.edges.values()
            if not child.edges:
                break
            node, prefix = child, prefix + label
        if not node.edges:
            return
        weigh = {first: sum(len(label) + NODE_BYTES for label, _ in self._edges(step)) for first, step in node.edges.items()}
        first = max(weigh, key=weigh.get)
        label, child = node.edges.pop(first)
        self.bytes -= weigh[first]
        yield from self.pop(child, prefix + label)

    @staticmethod
    def _edges(step: tuple[bytes, Node]) -> Iterator[tuple[bytes, Node]]:
        todo = [step]
        while todo:
            step = todo.pop()
            yield step
            todo += step[1].edges.values()


_PARTIAL = pa.schema([("sha", pa.string()), ("body", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
_OWNERS = pa.schema([("sha", pa.string()), ("owner", pa.int64()), ("n", pa.int64())])


def _rows(found: Iterator[tuple[bytes, int, int]], bodies: bool) -> Iterator[pa.RecordBatch]:
    """Terminals as rows, with their texts or without."""
    import hashlib

    out, size, schema = [], 0, _PARTIAL if bodies else _OWNERS

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for body, owner, n in found:
        sha = hashlib.sha256(body).hexdigest()
        out.append((sha, body, owner, n) if bodies else (sha, owner, n))
        size += len(body) if bodies else 0
        if size > 4 << 20 or len(out) >= 4096:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _inserted(bodies: bool, budget: int):
    """Job that inserts rows (id, body, n) into one trie and yields its terminals."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            ids, counts = batch.column(0).fill_null(_NO_ID).to_pylist(), batch.column(2).to_pylist()
            for owner, body, n in zip(ids, batch.column(1).cast(pa.binary()), counts):
                trie.add(body.as_py(), owner, n)
                while trie.bytes > budget:
                    yield from _rows(trie.spill(), bodies)
        yield from _rows(trie.pop(), bodies)
        del trie
        give_back()

    return job


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct normalised text: sha, owner (smallest id), n (rows)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("body"), F.lit(1).cast("long").alias("n"))
    partial = rows.mapInArrow(_inserted(True, budget), "sha string, body binary, owner long, n long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partial.repartition(parts, F.length("body"), "sha").select("owner", "body", "n")
    found = dealt.mapInArrow(_inserted(False, budget), "sha string, owner long, n long").groupBy("sha").agg(F.min("owner").alias("owner"), F.sum("n").alias("n"))
    return found.withColumn("owner", F.when(F.col("owner") != _NO_ID, F.col("owner")))


def _owned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, its text's mark and hash, owner and size of its group."""
    every = docs.select(
        F.col(id_col).alias("doc_id"), mark(F.col(text_col)).alias("mark"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256")
    )
    groups = owners(docs, id_col, text_col).where("n > 1")
    alone = F.col("n").isNull()
    return every.join(groups, every.text_sha256 == groups.sha, "left").select(
        "doc_id", "mark", "text_sha256",
        F.when(alone, F.col("doc_id")).otherwise(F.col("owner")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("owner"))).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _owned(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text has no copy with a smaller id."""
    gone = _owned(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").cast("long").alias("id"), "mark").distinct()
    return without_rows(docs, written(gone, "exact-dropped"), id_col, text_col)


ORACLE = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
