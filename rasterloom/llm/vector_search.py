"""Exact top-k search by inner product.

Vectors are packed into tiles: `TILE` query rows or item rows as one matrix. Every query
tile meets every item tile; a matrix product gives a tile's scores and a partial
selection keeps k of each query. Item tiles stay where their group is and the query
tiles, which are the smaller side, are sent to each group, by a shuffle. There are at most
half as many groups as item tiles, and groups of `HELD_TILES` tiles, about, at most. A task
merges the lists of the tiles it meets, then lists are merged along a tree of `FAN_IN` groups a level, so
that no task ever holds more than a query tile's lists from `FAN_IN` groups.

Scores are exact integers: components are whole numbers, products of doubles are used
while every partial sum stays under 2**53 and Python integers beyond that.

Defined results: rows with a null id or vector, or a null or non-finite component, take
no part; only vectors of equal length are compared; ties go to the smaller id; a query id
that stands on several vectors is answered for the smallest of them, repeated items count
as rows of their own; products past 64 bits are held at the bounds of a long, and tie
there; an empty side gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 2048
QUERY_TILE = 512
FAN_IN = 8
#: Item tiles of a group, about, at most.
HELD_TILES = 16
#: Query tiles whose running lists a task holds before it passes them on.
HELD = 256


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vec.isNotNull() & finite


def floor_scaled(vec: Column, scale: int = 256) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("double"))


_TILES = "tile long, dim int, ids binary, body binary"


def _packer(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 32

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            rows = sorted(held.pop(dim), key=lambda r: r[0])
            ids = np.array([r[0] for r in rows], "<i8").tobytes()
            body = np.array([r[1] for r in rows], "<f8").reshape(len(rows), dim).tobytes()
            number += 1
            return pa.RecordBatch.from_pydict(
                {"tile": pa.array([number - 1], pa.int64()), "dim": pa.array([dim], pa.int32()), "ids": [ids], "body": [body]}
            )

        for batch in batches:
            vecs = batch.column(1)
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(vecs.value_lengths().to_numpy(zero_copy_only=False))
            for vec_id, end, start in zip(batch.column(0).to_pylist(), ends, np.r_[0, ends[:-1]]):
                dim = int(end - start)
                held.setdefault(dim, []).append((vec_id, flat[start:end]))
                if len(held[dim]) >= size:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return pack


def tiles(rows: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    kept = rows.where(F.col(id_col).isNotNull() & usable(vec)).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    return kept.mapInArrow(_packer(size), _TILES)


#: Inner products past 64 bits are held at these bounds.
_BOUND = 2**63 - 1


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    top = lambda a: float(np.abs(a).max(initial=0.0))
    if top(q) * top(x) * max(1, q.shape[1]) < 2**53:
        return (q @ x.T).astype("i8")
    exact = lambda a: np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)
    return np.clip(exact(q) @ exact(x).T, -_BOUND, _BOUND).astype("i8")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, score and id of each row's k best; `ids` ascending for ties."""
    n = len(ids)
    if np.abs(scores).max(initial=0) >= 2**62 // max(n, 1):
        cols = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    else:
        key = scores * n + (n - 1 - np.arange(n))
        cols = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(scores), 1))
    rows = np.repeat(np.arange(len(scores)), cols.shape[1])
    cols = cols.ravel().astype("i8")
    return rows, scores[rows, cols], ids[cols]


def _merge(query: np.ndarray, score: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((item, -score, query))
    query, score, item = query[order], score[order], item[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) if len(query) else np.zeros(0, int)
    keep = np.arange(len(query)) - start < k
    return query[keep], score[keep], item[keep]


_LISTS = "query_tile long, node int, query binary, score binary, item binary"


def _matcher(k: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            lists = [np.concatenate(c) for c in zip(*held.pop(key))]
            columns = [np.ascontiguousarray(c, "<i8").tobytes() for c in _merge(*lists, k)]
            return pa.RecordBatch.from_pydict(
                {"query_tile": pa.array([key[0]], pa.int64()), "node": pa.array([key[1]], pa.int32())} | dict(zip(("query", "score", "item"), ([c] for c in columns)))
            )

        for batch in batches:
            for qt, g, dim, qids, qbody, ids, body in zip(*(c.to_pylist() for c in batch.columns)):
                qids, ids = np.frombuffer(qids, "<i8"), np.frombuffer(ids, "<i8")
                q = np.frombuffer(qbody, "<f8").reshape(len(qids), dim)
                x = np.frombuffer(body, "<f8").reshape(len(ids), dim)
                scores = _products(q, x)
                rows, score, item = _best(scores, ids, k + 1 + _repeats(qids, ids))
                own = qids[rows] == item
                one = _merge(qids[rows][~own], score[~own].astype("i8"), item[~own], k)
                mine = held.setdefault((qt, g), [])
                mine.append(one)
                if len(mine) >= 16:
                    held[(qt, g)] = [_merge(*(np.concatenate(c) for c in zip(*mine)), k)]
                if len(held) > HELD:
                    yield out(next(iter(held)))
        for key in list(held):
            yield out(key)

    return match


def _repeats(qids: np.ndarray, ids: np.ndarray) -> int:
    """How often a query's own id repeats among the items, less one."""
    found = ids[np.isin(ids, qids)]
    return int(np.unique(found, return_counts=True)[1].max(initial=1)) - 1


def top_k(queries: DataFrame, items: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """query_id, rank (from 1), item_id, score: each query's k best items but itself."""
    spark = items.sparkSession
    partitions, n_tiles = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-items.count() // TILE)
    groups = max(1, n_tiles // HELD_TILES, min(partitions, n_tiles // 2))
    asked = queries.groupBy(id_col).agg(F.min(F.col(vec_col).cast("array<double>")).alias(vec_col))
    q = tiles(asked.coalesce(max(1, partitions // 4)), id_col, vec_col, QUERY_TILE)
    q = q.select(F.col("tile").alias("query_tile"), "dim", F.col("ids").alias("qids"), F.col("body").alias("qbody"))
    q = q.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    x = tiles(items, id_col, vec_col, TILE).withColumn("node", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
    # Spark knows no size of tiles: without the hint it may send all of them through the driver
    pairs = q.hint("merge").join(x.hint("merge"), ["node", "dim"]).select("query_tile", "node", "dim", "qids", "qbody", "ids", "body")
    lists = pairs.mapInArrow(_matcher(k), _LISTS)

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [np.concatenate([np.frombuffer(b, "<i8") for b in pdf[c]]) for c in ("query", "score", "item")]
        return pd.DataFrame([[int(key[0]), int(key[1]), *(np.ascontiguousarray(c, "<i8").tobytes() for c in _merge(*columns, k))]], columns=["query_tile", "node", "query", "score", "item"])

    nodes = groups
    while nodes > 1:
        lists = lists.withColumn("node", F.expr(f"node div {FAN_IN}").cast("int")).groupBy("query_tile", "node").applyInPandas(merged, _LISTS)
        nodes = -(-nodes // FAN_IN)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for query, score, item in zip(pdf["query"], pdf["score"], pdf["item"]):
                query = np.frombuffer(query, "<i8")
                start = np.maximum.accumulate(np.where(np.r_[True, query[1:] != query[:-1]], np.arange(len(query)), 0)) if len(query) else query
                yield pd.DataFrame({"query_id": query, "rank": (np.arange(len(query)) - start + 1).astype("i4"), "item_id": np.frombuffer(item, "<i8"), "score": np.frombuffer(score, "<i8")})

    return lists.mapInPandas(rows, "query_id long, rank int, item_id long, score long")


ORACLE = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
