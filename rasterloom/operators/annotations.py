"""Annotation records: defaults, migration between schemas, revision logs, JSON search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def empty_annotation(lines: Sequence[str]) -> Column:
    line = F.struct(F.lit("unreviewed").alias("status"), F.array().cast("array<struct<x:double,y:double>>").alias("points"))
    return F.struct(
        F.lit(2).alias("schema"), F.lit(0).alias("revision"), F.lit("pending").alias("status"), F.lit("unknown").alias("handedness"), F.lit("unknown").alias("mirrored"), F.lit("").alias("notes"),
        F.create_map(*[x for name in lines for x in (F.lit(name), line)]).alias("lines"),
    )


def migrate(rows: DataFrame, lines: Sequence[str]) -> DataFrame:
    """Schema 1 to 2: other lines move to `legacy_lines`, defaults are filled, revision + 1."""
    old = F.col("schema") < 2
    known = F.array(*[F.lit(x) for x in lines])
    return rows.select(
        *[c for c in rows.columns if c not in ("schema", "revision", "lines", "handedness", "mirrored")],
        F.col("revision").alias("old_revision"),
        (F.col("revision") + F.when(old, 1).otherwise(0)).alias("revision"),
        F.lit(2).alias("schema"),
        F.map_filter("lines", lambda k, _: F.array_contains(known, k)).alias("lines"),
        F.map_filter("lines", lambda k, _: ~F.array_contains(known, k)).alias("legacy_lines"),
        F.coalesce("handedness", F.lit("unknown")).alias("handedness"),
        F.coalesce("mirrored", F.lit("unknown")).alias("mirrored"),
    )


def first_text_under(json: Column, keys: Sequence[str]) -> Column:
    """The first non-empty text under any of `keys`, at any depth, in document order."""
    names = "|".join(keys)
    found = F.regexp_extract(json, rf'"(?:{names})"\s*:\s*"((?:[^"\\]|\\.)+)"', 1)
    return F.nullif(found, F.lit(""))


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The newest row of each key, by partial aggregation and not by a sort."""
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_top"))
    return top.select(*keys, "_top.*")


#: Edits of one key that one task folds at a time.
EDITS = 10_000


def _ordered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal keys in sorted batches; one key may have several runs."""
    for batch in batches:
        columns = list(zip(*(batch.column(c).to_pylist() for c in keys)))
        at = 0
        for i in range(1, len(columns) + 1):
            if i == len(columns) or columns[i] != columns[at]:
                yield columns[at], batch.slice(at, i - at)
                at = i


def _maps(key: str, base: str):
    """A block of edits as a map from the revision before it to the one after: only starts
    that one of its edits asks for can move, all others stay. Starts that have come to the
    same revision move on together."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, left = None, {}, set()  # starts by revision, where not each by itself; revisions that were left

        def out() -> pa.RecordBatch:
            pairs = [(start, now) for now, starts in at.items() for start in starts if start != now]
            n = len(pairs)
            columns = [pa.array([held[0]] * n, key_type), pa.array([held[1]] * n, pa.int64()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["key", "block", "start", "stop"])

        key_type = None
        for which, run in _ordered(batches, [key, "_block"]):
            key_type = run.schema.field(key).type
            if held != which:
                if held is not None:
                    yield out()
                held, at, left = which, {}, set()
            for wanted in run.column(base).to_pylist():
                if wanted is None:
                    continue
                moved, there = (at.pop(r, [] if r in left else [r]) for r in (wanted, wanted + 1))
                left.add(wanted)
                if len(there) < len(moved):
                    moved, there = there, moved
                there.extend(moved)
                at[wanted + 1] = there
        if held is not None:
            yield out()

    return of


def _starts(rows: DataFrame, key: str, seq: str, base: str, blocks: int) -> DataFrame:
    """(key, block, start): the revision before each block. Maps of neighbouring blocks are
    composed pair by pair up a tree, and the starts come down it; each level is a join."""
    kind = rows.schema[key].dataType.simpleString()
    sorted_rows = rows.select(key, "_block", seq, base).repartition(key, "_block").sortWithinPartitions(key, "_block", seq)
    level = written(sorted_rows.mapInArrow(_maps(key, base), f"key {kind}, block long, start long, stop long"), "edit-maps")
    levels, n = [level], blocks
    while n > 1:
        left = level.where("block % 2 = 0").select("key", F.expr("block div 2").alias("block"), "start", "stop")
        right = level.where("block % 2 = 1").select("key", F.expr("block div 2").alias("block"), F.col("start").alias("mid"), F.col("stop").alias("end"))
        on = left["key"].eqNullSafe(right["key"]) & (left["block"] == right["block"]) & (left["stop"] == right["mid"])
        through = left.join(right, on, "left").select(left["key"], left["block"], "start", F.coalesce("end", "stop").alias("stop"))
        same = right["key"].eqNullSafe(left["key"]) & (right["block"] == left["block"]) & (right["mid"] == left["start"])
        alone = right.join(left, same, "left_anti").select("key", "block", F.col("mid").alias("start"), F.col("end").alias("stop"))
        level = written(through.unionByName(alone).where("start <> stop"), "edit-maps")
        levels.append(level)
        n = -(-n // 2)
    starts = rows.select(F.col(key).alias("key")).distinct().select("key", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("start"))
    for below in reversed(levels[:-1]):
        own = below.where("block % 2 = 0").select(F.col("key").alias("_key"), F.expr("block div 2").alias("_block"), F.col("start").alias("_from"), "stop")
        on = starts["key"].eqNullSafe(own["_key"]) & (starts["block"] == own["_block"]) & (starts["start"] == own["_from"])
        right = starts.join(own, on, "left").select("key", (2 * F.col("block") + 1).alias("block"), F.coalesce("stop", "start").alias("start"))
        starts = written(starts.select("key", (2 * F.col("block")).alias("block"), "start").unionByName(right), "edit-starts")
    return starts


def accepted_edits(log: DataFrame, key: str, seq: str, base: str, block: int = EDITS) -> DataFrame:
    """Optimistic revisions: in the order of `seq`, a whole number of its own for each edit
    of a key, an edit is accepted iff its base revision is the current one, which it raises
    by 1. Adds `accepted` and `current`. A key's log is cut into blocks of `block` numbers;
    where a key has more than one, an associative scan over the blocks' maps of revisions
    gives the revision that each begins with, and all blocks are then folded side by side."""
    rows = log.withColumn("_block", F.expr(f"`{seq}` div {block}").cast("long"))
    blocks = (rows.agg(F.max("_block")).first()[0] or 0) + 1
    if blocks > 1:
        starts = _starts(rows, key, seq, base, blocks)
        starts = starts.select(F.col("key").alias("_key"), F.col("block").alias("_of"), F.col("start").alias("_start"))
        rows = rows.join(starts, rows[key].eqNullSafe(starts["_key"]) & (rows["_block"] == starts["_of"])).drop("_key", "_of")
    else:
        rows = rows.withColumn("_start", F.lit(0).cast("long"))
    names = log.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, 0
        for batch in batches:
            accepted, current = [], []
            for *which, start, wanted in zip(*(batch.column(c).to_pylist() for c in (key, "_block", "_start", base))):
                if which != held:
                    held, now = which, start
                accepted.append(wanted == now)
                now += accepted[-1]
                current.append(now)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(accepted, pa.bool_()), pa.array(current, pa.int64())], [*names, "accepted", "current"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    return rows.repartition(key, "_block").sortWithinPartitions(key, "_block", seq).mapInArrow(fold, f"{fields}, accepted boolean, current long")


def undo_history(log: DataFrame, key: str, seq: str, state: str, depth: int = 30) -> DataFrame:
    """Adds `previous` (the state before each save) and `undo_depth`."""
    order = Window.partitionBy(key).orderBy(seq)
    return log.withColumn("previous", F.lag(state).over(order)).withColumn("undo_depth", F.count(F.lit(1)).over(order.rowsBetween(-depth, -1)))


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of `base` with the values of `changes` where they have one."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(new, base[key] == new["_key"], "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else base[c] for c in base.columns])
