"""Keypoint operators over a long table (image_id, line, k, x, y, px, py, status, presence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def targets(points: DataFrame) -> DataFrame:
    """Per image: flat coordinates, their 0/1 mask, presence and the mask of known lines."""
    line = points.groupBy("image_id", "line").agg(F.first("status").alias("status"), F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("ps"))
    shown = F.col("status") == "present"
    coords = F.flatten(F.transform("ps", lambda p: F.when(shown, F.array(p["x"], p["y"])).otherwise(F.array(F.lit(0.0), F.lit(0.0)))))
    row = F.struct("line", coords.alias("coords"), F.transform(coords, lambda _: shown.cast("int")).alias("mask"), shown.cast("int").alias("present"), (F.col("status") != "unreviewed").cast("int").alias("known"))
    image = line.groupBy("image_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return image.select(
        "image_id", F.flatten("rows.coords").alias("coords"), F.flatten("rows.mask").alias("mask"), F.col("rows.present").alias("present"), F.col("rows.known").alias("known")
    )


def exclude_together(rows: DataFrame, one: Column, others: Column, reason: str) -> DataFrame:
    """If line `one` and any of `others` are found in an image, none of them counts."""
    image = Window.partitionBy("image_id")
    clash = F.max(F.col("found") & one).over(image) & F.max(F.col("found") & others).over(image)
    marked = rows.withColumn("_clash", clash & F.col("found"))
    return marked.select("image_id", "line", (F.col("found") & ~F.col("_clash")).alias("found"), F.when(F.col("_clash"), reason).otherwise("").alias("reason"))


def handedness(left: Column, right: Column, mirrored: Column) -> tuple[Column, Column]:
    """Thumb side and hand from the extents (in palm radii) to either side of the palm
    centre; unknown if the extents are short or alike, or mirroring is not known."""
    clear = (F.greatest(left, right) >= 1.35) & (F.abs(left - right) >= 0.30)
    thumb = F.when(clear & (left > right), "left").when(clear, "right").otherwise("unknown")
    side = F.when((thumb == "unknown") | mirrored.isNull(), "unknown").when((thumb == "left") == mirrored, "left").otherwise("right")
    return thumb, side


def route_lines(rows: DataFrame, absent_at: float = 0.05, confident_at: float = 0.90) -> DataFrame:
    """Adds `reasons`, `state` (absent, present, review) and the image's `needs_review`."""
    absent = (F.col("presence") <= absent_at) & F.col("supported")
    low = F.col("confidence") * F.col("presence") < confident_at
    reasons = F.array_compact(F.array(F.when(low, "low_confidence"), F.when(~F.col("supported"), "no_support")))
    out = rows.withColumn("reasons", F.when(absent, F.array().cast("array<string>")).otherwise(reasons))
    out = out.withColumn("state", F.when(absent, "absent").when(F.size("reasons") == 0, "present").otherwise("review"))
    return out.withColumn("needs_review", F.max(F.col("state") == "review").over(Window.partitionBy("image_id")))


def evaluate(points: DataFrame, width: Column, at: float = 0.5, pck_at: float = 0.05) -> DataFrame:
    """Per line: counts of states, tp, fp, fn of presence, mean error in reference widths,
    PCK, precision and recall; measures without samples are null."""
    error = F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)) / width
    shown, gone = F.col("status") == "present", F.col("status") == "absent"
    first, said = F.col("k") == 0, F.col("presence") >= at
    count = lambda c: F.sum(F.when(c & first, 1).otherwise(0))
    out = points.groupBy("line").agg(
        count(shown).alias("present"), count(gone).alias("absent"), count(~shown & ~gone).alias("unlabelled"), count(shown & said).alias("tp"), count(gone & said).alias("fp"), count(shown & ~said).alias("fn"),
        F.avg(F.when(shown, error)).alias("mean_error"), F.avg(F.when(shown, (error <= pck_at).cast("double"))).alias("pck"),
    )
    return out.withColumn("precision", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")))


def auto_label_supported() -> Column:
    """Enough samples of both states, and measures that allow labels without review."""
    c = F.col
    return (c("present") >= 3) & (c("absent") >= 3) & (c("precision") >= 0.95) & (c("recall") >= 0.90) & F.coalesce(c("pck") >= 0.90, F.lit(False))


def masked_loss(points: DataFrame, delta: float = 0.05, bce_weight: float = 0.15) -> DataFrame:
    """Huber loss over visible coordinates plus weighted cross-entropy over known lines."""
    def huber(e: Column) -> Column:
        a = F.abs(e)
        return F.when(a <= delta, 0.5 * a * a / delta).otherwise(a - 0.5 * delta)

    shown, known, first = F.col("status") == "present", F.col("status") != "unreviewed", F.col("k") == 0
    logit = F.ln(F.col("presence") / (1 - F.col("presence")))
    bce = F.greatest(logit, F.lit(0.0)) - logit * shown.cast("double") + F.log1p(F.exp(-F.abs(logit)))
    sums = points.agg(
        F.sum(F.when(shown, huber(F.col("px") - F.col("x")) + huber(F.col("py") - F.col("y"))).otherwise(0.0)).alias("h"), F.sum(F.when(shown, 2).otherwise(0)).alias("nh"),
        F.sum(F.when(known & first, bce).otherwise(0.0)).alias("b"), F.sum(F.when(known & first, 1).otherwise(0)).alias("nb"),
    )
    return sums.select((F.col("h") / F.greatest(F.lit(1), F.col("nh")) + bce_weight * F.col("b") / F.greatest(F.lit(1), F.col("nb"))).alias("loss"))


def segments(points: DataFrame, width: float, height: float) -> DataFrame:
    """Adds segment length to the previous point and the running length, in pixels."""
    line = Window.partitionBy("image_id", "line").orderBy("k")
    px, py = F.col("x") * (width - 1), F.col("y") * (height - 1)
    dx, dy = px - F.lag(px).over(line), py - F.lag(py).over(line)
    step = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return points.withColumn("sx", px).withColumn("sy", py).withColumn("step", step).withColumn("along", F.sum("step").over(line))


def turns(points: DataFrame, width: float, height: float) -> DataFrame:
    """Turn angle (degrees) at each inner point of a line."""
    line = Window.partitionBy("image_id", "line").orderBy("k")
    px, py = F.col("x") * (width - 1), F.col("y") * (height - 1)
    ax, ay, bx, by = px - F.lag(px).over(line), py - F.lag(py).over(line), F.lead(px).over(line) - px, F.lead(py).over(line) - py
    cosine = (ax * bx + ay * by) / F.nullif(F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by), F.lit(0.0))
    angle = F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    return points.withColumn("turn", F.when(cosine.isNotNull(), angle))


def crossings(points: DataFrame, width: float, height: float, eps: float = 1e-10) -> DataFrame:
    """(image_id, line) of lines with two segments, not adjacent, that cross."""
    line = Window.partitionBy("image_id", "line").orderBy("k")
    px, py = F.col("x") * (width - 1), F.col("y") * (height - 1)
    seg = points.select("image_id", "line", "k", px.alias("ax"), py.alias("ay"), F.lead(px).over(line).alias("bx"), F.lead(py).over(line).alias("by")).where("bx IS NOT NULL")
    other = seg.select("image_id", "line", F.col("k").alias("k2"), *[F.col(c).alias(d) for c, d in zip(("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy"))])
    cross = lambda ox, oy, px, py, qx, qy: (px - ox) * (qy - oy) - (py - oy) * (qx - ox)
    c = F.col
    v1, v2 = cross(c("ax"), c("ay"), c("bx"), c("by"), c("cx"), c("cy")), cross(c("ax"), c("ay"), c("bx"), c("by"), c("dx"), c("dy"))
    v3, v4 = cross(c("cx"), c("cy"), c("dx"), c("dy"), c("ax"), c("ay")), cross(c("cx"), c("cy"), c("dx"), c("dy"), c("bx"), c("by"))
    pairs = seg.join(other, ["image_id", "line"]).where(c("k2") >= c("k") + 2)
    return pairs.where((v1 * v2 < -eps) & (v3 * v4 < -eps)).select("image_id", "line").distinct()


def resample(points: DataFrame, width: float, height: float, n: int = 6, least: float = 8.0) -> DataFrame:
    """`n` points at equal distances along each line; lines under `least` pixels go."""
    seg = segments(points, width, height)
    line = Window.partitionBy("image_id", "line").orderBy("k")
    spans = seg.select("image_id", "line", "k", F.lag("sx").over(line).alias("ax"), F.lag("sy").over(line).alias("ay"), "sx", "sy", F.lag("along").over(line).alias("start"), F.col("along").alias("stop")).where("start IS NOT NULL")
    total = seg.groupBy("image_id", "line").agg(F.max("along").alias("total")).where(F.col("total") >= least)
    goal = total.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("goal", F.col("total") * F.col("i") / (n - 1))
    hit = goal.join(spans, ["image_id", "line"]).where((F.col("goal") <= F.col("stop") + 1e-9) & (F.col("goal") >= F.col("start") - 1e-9))
    part = F.coalesce(F.least(F.greatest((F.col("goal") - F.col("start")) / F.nullif(F.col("stop") - F.col("start"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    at = F.struct("k", (F.col("ax") + part * (F.col("sx") - F.col("ax"))).alias("x"), (F.col("ay") + part * (F.col("sy") - F.col("ay"))).alias("y"))
    return hit.groupBy("image_id", "line", "i").agg(F.min(at).alias("p")).select("image_id", "line", "i", "p.x", "p.y")


# Fixed values of the validity rules: points of a line, least palm width in pixels, least
# confidence, least step (pixels, and part of the palm width), sharpest turn in degrees,
# and the product below which two segments cross.
N_POINTS, LEAST_PALM, LEAST_CONFIDENCE, LEAST_STEP, STEP_PART, SHARPEST, CROSSED = 6, 4.0, 0.90, 0.25, 0.002, 135.0, -1e-10


def validity(points: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, line, reasons): why a line's points (k, x, y, confidence; its palm_width)
    can't be measured, in the order of the rules. The first five rules end the search; a low
    confidence is noted; a collapsed step ends it; turns and crossings are noted. One shuffle
    by line; the rules are expressions over its ordered points."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x, y, confidence = (F.col(c).cast("double") for c in ("x", "y", "confidence"))
    lines = points.groupBy("image_id", "line").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(finite(x) & finite(y)).alias("numbers"), F.bool_and((x >= 0) & (x <= 1) & (y >= 0) & (y <= 1)).alias("inside"),
        F.max(F.col("palm_width").cast("double")).alias("palm"), F.bool_and(finite(confidence) & (confidence >= 0) & (confidence <= 1)).alias("rated"), F.min(confidence).alias("least"),
        F.array_sort(F.collect_list(F.struct("k", (x * (width - 1)).alias("x"), (y * (height - 1)).alias("y")))).alias("p"),
    )
    at = lambda i: F.element_at("p", i)
    whole = F.coalesce(F.col("numbers"), F.lit(False)) & (F.col("n") == N_POINTS)  # the expressions below need all points
    between = lambda i: F.struct((at(i + 1)["x"] - at(i)["x"]).alias("x"), (at(i + 1)["y"] - at(i)["y"]).alias("y"))
    lines = lines.withColumn("d", F.when(whole, F.array(*[between(i) for i in range(1, N_POINTS)])))
    steps = F.transform("d", lambda d: F.sqrt(d["x"] * d["x"] + d["y"] * d["y"]))
    lines = lines.withColumn("s", steps)

    def bend(i: int) -> Column:
        a, b = F.element_at("d", i), F.element_at("d", i + 1)
        cosine = (a["x"] * b["x"] + a["y"] * b["y"]) / F.nullif(F.element_at("s", i) * F.element_at("s", i + 1), F.lit(0.0))
        return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))

    def side(o: Column, a: Column, b: Column) -> Column:
        return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])

    def cross(i: int, j: int) -> Column:
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        return (side(a, b, c) * side(a, b, d) < CROSSED) & (side(c, d, a) * side(c, d, b) < CROSSED)

    crossed = F.array_contains(F.array(*[cross(i, j) for i in range(1, N_POINTS - 1) for j in range(i + 2, N_POINTS)]), True)
    palm = F.col("palm")
    first = (
        F.when(~F.coalesce(F.col("numbers"), F.lit(False)) | F.lit(width < 2 or height < 2), "invalid_keypoints").when(F.col("n") != N_POINTS, "missing_keypoints").when(~F.col("inside"), "out_of_bounds")
        .when(~finite(palm) | (palm < LEAST_PALM), "invalid_palm_reference").when(~F.coalesce(F.col("rated"), F.lit(False)), "invalid_confidence")
    )
    low = F.when(F.col("least") < LEAST_CONFIDENCE, "low_keypoint_confidence")
    collapsed = F.array_min("s") < F.greatest(F.lit(LEAST_STEP), palm * STEP_PART)
    shape = [F.when(F.array_max(F.array(*[bend(i) for i in range(1, N_POINTS - 1)])) > SHARPEST, "keypoint_order_or_sharp_turn"), F.when(crossed, "keypoint_self_intersection")]
    found = F.when(first.isNotNull(), F.array(first)).when(collapsed, F.array(low, F.lit("duplicate_or_collapsed_keypoints"))).otherwise(F.array(low, *shape))
    return lines.select("image_id", "line", F.array_compact(found).alias("reasons"))
