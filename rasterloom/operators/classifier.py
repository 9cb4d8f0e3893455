"""Per-pixel Gaussian classifier: fit, scoring and mask confidence, as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

MIN_STD = 0.025


def capped(pixels: DataFrame, cap: int, seed: str) -> DataFrame:
    """At most `cap` pixels of each image and class, by a seeded hash."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), "image_id", "y", "x"), 256)
    rank = F.row_number().over(Window.partitionBy("image_id", "class_id").orderBy(order))
    return pixels.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def fit(pixels: DataFrame, features: Sequence[str], classes: int) -> DataFrame:
    """One row for each class and feature: mean, std, prior, n. A class without pixels
    has the mean and std of all of them; priors follow the root of the counts."""
    spark = pixels.sparkSession
    long = pixels.select("class_id", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("f")).select("class_id", "f.*")
    sets = long.groupingSets([["class_id", "feature"], ["feature"]], "class_id", "feature")  # one pass for classes and all
    sets = written(sets.agg(F.grouping("class_id").alias("_all"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count(F.lit(1)).alias("c")), "moments")
    one, every = sets.where("_all = 0").drop("_all"), sets.where("_all = 1").select("feature", F.col("m").alias("gm"), F.col("s").alias("gs"))
    ids = spark.range(classes).select(F.col("id").cast("int").alias("class_id"))
    grid = ids.join(F.broadcast(every))  # classes x features rows
    table = grid.join(F.broadcast(one), ["class_id", "feature"], "left").select(
        "class_id", "feature", F.coalesce("m", "gm").alias("mean"), F.greatest(F.coalesce("s", "gs"), F.lit(MIN_STD)).alias("std"), F.coalesce("c", F.lit(0)).alias("n")
    )
    root = F.sqrt(F.col("n") + 1)
    return table.withColumn("prior", root / F.sum(root).over(Window.partitionBy("feature")))


def score(pixels: DataFrame, model: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds `pred` and `prob` (softmax of Gaussian log-likelihoods) to each pixel; classes
    without pixels in training are impossible. The model is classes x features rows and
    travels as one broadcast row of arrays, so pixels are neither shuffled nor exploded."""
    mean, std = lambda c: c["mean"], lambda c: c["std"]
    packed = model.where("n > 0").groupBy("class_id", "prior").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("p"))
    packed = packed.agg(F.collect_list(F.struct("class_id", "prior", "p")).alias("_model"))

    def logit(c):
        total = F.ln(c["prior"])
        for f in features:
            p = c["p"][f]
            z = (F.col(f) - mean(p)) / std(p)
            total = total - 0.5 * z * z - F.ln(std(p))
        return F.struct(total.alias("l"), (-c["class_id"]).alias("i"))

    logits = F.transform("_model", logit)
    out = pixels.join(F.broadcast(packed)).withColumn("_l", logits).withColumn("_top", F.array_max("_l"))
    share = F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.exp(x["l"] - F.col("_top.l")))
    return out.withColumn("pred", (-F.col("_top.i")).cast("int")).withColumn("prob", 1 / share).drop("_model", "_l", "_top")


def mask_confidence(scored: DataFrame, lines: Sequence[int]) -> DataFrame:
    """Per image: mean probability overall and over line pixels, their minimum, and the
    share of line pixels; confidence is 0 without one."""
    line = F.col("pred").isin(*lines)
    out = scored.groupBy("image_id").agg(F.avg("prob").alias("overall"), F.coalesce(F.avg(F.when(line, F.col("prob"))), F.lit(0.0)).alias("on_lines"), F.avg(line.cast("double")).alias("line_ratio"))
    return out.withColumn("confidence", F.least("overall", "on_lines"))


def early_stopping(history: DataFrame, patience: int, least_gain: float = 1e-6) -> DataFrame:
    """Best epoch, best loss and the epoch at which training stops. The history is folded
    in order: one short row an epoch."""
    logs = history.agg(F.array_sort(F.collect_list(F.struct("epoch", "val_loss"))).alias("h"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).alias("best_epoch"), F.lit(0).alias("stale"), F.lit(-1).alias("stopped"))

    def step(a, e):
        over = a["stopped"] >= 0
        better = ~over & (e["val_loss"] < a["best"] - least_gain)
        stale = F.when(better, 0).otherwise(a["stale"] + 1)
        return F.struct(
            F.when(better, e["val_loss"]).otherwise(a["best"]).alias("best"), F.when(better, e["epoch"]).otherwise(a["best_epoch"]).alias("best_epoch"),
            F.when(over, a["stale"]).otherwise(stale).alias("stale"), F.when(over, a["stopped"]).when(stale >= patience, e["epoch"]).otherwise(F.lit(-1)).alias("stopped"),
        )

    return logs.select(F.aggregate("h", start, step).alias("r")).select("r.best", "r.best_epoch", "r.stopped")
