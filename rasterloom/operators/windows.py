"""Window operators: queues, stability of metrics and exclusive assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def ranged(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` in ranges of (group, order), written once so that a range keeps its rows, with
    `_part`, the range's number. A large group stands in many ranges."""
    return written(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def _with_parts(rows: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """`rows` with the columns of `parts`, which has a row for each group and range."""
    parts = parts.withColumnsRenamed({group: "_g", "_part": "_p"})
    return rows.join(parts, rows[group].eqNullSafe(parts["_g"]) & (rows["_part"] == parts["_p"])).drop("_g", "_p")


def next_pending(rows: DataFrame, group: str, order: str, pending: Column) -> DataFrame:
    """Adds `next_pending`: the next pending row after this one, else the first one before
    it, within the group; -1 if there is none. A segmented scan: windows run over ranges of
    a group, and the first pending rows of the ranges after and before come from a table
    with one row for each group and range."""
    cut = ranged(rows.withColumn("_place", F.when(pending, F.col(order))), group, order)
    parts = cut.groupBy(group, "_part").agg(F.min("_place").alias("_first"))
    of_group = Window.partitionBy(group).orderBy("_part")
    later, earlier = of_group.rowsBetween(1, Window.unboundedFollowing), of_group.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", F.min("_first").over(later).alias("_later"), F.min("_first").over(earlier).alias("_earlier"))
    own = Window.partitionBy(group, "_part").orderBy(order)
    after, before = F.min("_place").over(own.rowsBetween(1, Window.unboundedFollowing)), F.min("_place").over(own.rowsBetween(Window.unboundedPreceding, -1))
    cut = _with_parts(cut.withColumn("_after", after).withColumn("_before", before), parts, group)
    return cut.withColumn("next_pending", F.coalesce("_after", "_later", "_earlier", "_before", F.lit(-1))).drop("_place", "_part", "_after", "_before", "_later", "_earlier")


def positions(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds `_n`, each row's place in its group from 0, without a window over a whole group."""
    cut = ranged(rows, group, *order)
    sizes = cut.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    shift = F.coalesce(F.sum("_size").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    cut = _with_parts(cut.withColumn("_local", local), sizes.select(group, "_part", shift.alias("_shift")), group)
    return cut.withColumn("_n", F.col("_shift") + F.col("_local")).drop("_part", "_local", "_shift")


def quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of an array without nulls."""
    ordered = F.array_sort(values)
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
    return a + (b - a) * (at - low)


#: Rows of a camera that one window holds, besides the rows before them that it looks back on.
STRETCH = 100_000


def stability(frames: DataFrame, metrics: Sequence[str], rows: int = 12, least: int = 3, floor: float = 0.03, limit: float = 0.10, stretch: int = STRETCH) -> DataFrame:
    """Adds `stable`: over the camera's last frames, the 80th percentile of the relative
    deviation of the metrics that matter stays under `limit`. A camera's history is cut into
    stretches by row number; the last rows of one also stand before the next."""
    timed = positions(frames, "camera", "ts", "frame_id").withColumn("_stretch", F.expr(f"_n div {stretch}"))
    # rows that stretches after this one look back on; more than one if these are short
    reach = F.expr(f"(_n + {rows - 1}) div {stretch}")
    halo = timed.where(reach > F.col("_stretch")).withColumn("_stretch", F.explode(F.sequence(F.col("_stretch") + 1, reach)))
    both = timed.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)))
    w = Window.partitionBy("camera", "_stretch").orderBy("_n").rowsBetween(1 - rows, 0)
    ratios = F.array_compact(F.array(*[F.when(F.avg(m).over(w) > floor, F.stddev_pop(m).over(w) / F.avg(m).over(w)) for m in metrics]))
    out = both.withColumn("_r", ratios).withColumn("_c", F.count(F.lit(1)).over(w)).where("_own")
    stable = (F.col("_c") >= least) & (F.size("_r") > 0) & (F.round(quantile(F.col("_r"), 0.8), 9) < limit)
    return out.withColumn("stable", F.coalesce(stable, F.lit(False))).drop("_r", "_c", "_n", "_stretch", "_own")


def trailing_count(rows: DataFrame, key: str, micros: Column, reach: int, slot: int = 3_600_000_000) -> DataFrame:
    """Adds `in_window`: rows of the key in the last `reach` microseconds, this one included.
    A key's history is cut into time slots that tasks share; rows near a slot's end also
    stand in the next one, where they are only counted."""
    timed = rows.withColumn("_t", micros).withColumn("_slot", F.floor(F.col("_t") / slot))
    late = timed.where(F.col("_t") + reach >= (F.col("_slot") + 1) * slot).withColumn("_slot", F.explode(F.sequence(F.col("_slot") + 1, F.floor((F.col("_t") + reach) / slot))))
    both = timed.withColumn("_own", F.lit(True)).unionByName(late.withColumn("_own", F.lit(False)))
    w = Window.partitionBy(key, "_slot").orderBy("_t").rangeBetween(-reach, 0)
    return both.withColumn("in_window", F.count(F.lit(1)).over(w)).where("_own").drop("_t", "_slot", "_own")


def assign_exclusively(rows: DataFrame, key: str, component: str, lines: Sequence[str], least: float) -> DataFrame:
    """(key, line, component): lines in order each take the best component that no line
    before took, from a least score on; ties go to the smaller component."""
    left, out = rows, None
    for line in lines:
        best = left.where(F.col(line) >= least).groupBy(key).agg(F.max_by(component, F.struct(line, -F.col(component))).alias(component))
        one = best.select(key, F.lit(line).alias("line"), component)
        out = one if out is None else out.unionByName(one)
        left = left.join(best, [key, component], "left_anti")
    return out
