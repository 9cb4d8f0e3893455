"""Manifest operators: duplicates, gates, queues, integrity and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def mark_duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds `original`, the first row's `order` value, to all later rows of a key.

    First rows come from a partial aggregation, so a key of any size passes through no
    single task on its way there; the join back is one that Spark can split.
    """
    firsts = rows.groupBy(key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key"), "_first")
    joined = rows.join(firsts, rows[key] == firsts["_key"], "left")
    return joined.select(*rows.columns, F.when(F.col("_first") != F.col(order), F.col("_first")).alias("original"))


def ingest_gate(duplicate: Column, unreadable: Column, small: Column, blurry: Column, poor: Column, reason: Column, mask: Column) -> Column:
    """The first check that a row fails, or an empty text."""
    return (
        F.when(duplicate, "exact_duplicate").when(unreadable, "bad_read").when(small, "too_small").when(blurry, "too_blurry")
        .when(poor, F.lower(reason)).when(mask, "mask_quality").otherwise("")
    )


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflicting_keys(rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Keys that carry more than one combination of values."""
    return rows.groupBy(key).agg(F.countDistinct(F.struct(*values)).alias("n")).where("n > 1")


def first_match(rows: DataFrame, candidates: Column, known: DataFrame, known_col: str) -> DataFrame:
    """Adds `matched`: the first of an array of candidate keys that exists in `known`."""
    keyed = rows.select("*", F.posexplode_outer(candidates).alias("_rank", "_candidate"))
    found = keyed.join(known.select(F.col(known_col).alias("_known")).distinct(), F.col("_candidate") == F.col("_known"), "left")
    best = F.min_by("_known", F.when(F.col("_known").isNotNull(), F.col("_rank")))
    return found.groupBy(*rows.columns).agg(best.alias("matched"))


def hold_out_reason(rows: DataFrame, held: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds `reason`: the first key (column, reason) that a row shares with `held`."""
    reason = F.lit(None).cast("string")
    for i, (column, name) in reversed(list(enumerate(keys))):
        seen = held.where(F.col(column).isNotNull()).select(F.col(column).alias(f"_held{i}")).distinct()
        rows = rows.join(seen, rows[column] == seen[f"_held{i}"], "left")
        reason = F.when(F.col(f"_held{i}").isNotNull(), F.lit(name)).otherwise(reason)
    return rows.withColumn("reason", reason).drop(*[f"_held{i}" for i in range(len(keys))])


def quota_queue(rows: DataFrame, status: str, position: str, quota: int) -> DataFrame:
    """Adds `queued`: reviewed rows first, then pending ones by position, up to a quota,
    which is a reviewer's day and not a share of the rows: its last row is found by top-k."""
    pending = (F.col(status) == "pending").cast("int")
    order = F.struct(pending.alias("p"), F.col(position).alias("pos"))
    top = rows.select(order.alias("o")).orderBy("o").limit(quota).agg(F.max("o").alias("_last"))
    return rows.join(F.broadcast(top)).withColumn("queued", order <= F.col("_last")).drop("_last")


def seeded_order(seed: str, *keys: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]), 256)


def first_valid(rows: DataFrame, seed: str, key: str, valid: Column, wanted: int) -> DataFrame:
    """In seeded order, rows up to the one that makes `wanted` valid rows; adds `valid`."""
    marked = rows.withColumn("_order", seeded_order(seed, F.col(key))).withColumn("valid", valid)
    last = marked.where("valid").select("_order").orderBy("_order").limit(wanted).agg(F.max("_order").alias("_last"), F.count(F.lit(1)).alias("_n"))
    joined = marked.join(F.broadcast(last))
    return joined.where((F.col("_n") < wanted) | (F.col("_order") <= F.col("_last"))).drop("_order", "_last", "_n")


def union_keep_first(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the first occurrence of each key: `first` comes before `second`."""
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in (key, "_part")]
    top = both.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("_part", order)).alias("_row"))
    return top.select(key, "_row.*")


def numbered(rows: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Adds consecutive numbers from 1 in a total order without one global window: rows
    are range-partitioned, each partition numbers its own, and partition sizes shift them.
    The numbered ranges are written once, as another evaluation could cut them elsewhere."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    local = written(ranged.withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)), "numbered")
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_shift"))
    return local.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_shift") + F.col("_local") + 1).drop("_part", "_local", "_shift")
