"""Composed loops: review queue, pseudo-labels, label conversion, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import classifier as L
from ..operators import graph as G
from ..operators import manifests as M
from ..operators import pixels as X
from ..operators import windows as W


def review_queue(manifest: DataFrame, seed: str, wanted: int) -> DataFrame:
    """Review rows: the first valid images in seeded order, numbered in manifest order,
    with their review status."""
    chosen = M.first_valid(manifest, seed, "image_path", F.col("score") > 0.45, wanted).where("valid").drop("valid")
    return M.numbered(chosen, ["image_path"], "n").withColumn("review_id", F.format_string("review_%04d", "n")).drop("n")


def pseudo_labels(manifest: DataFrame, pixels: DataFrame, features: Sequence[str], confidence: float = 0.90, line_ratio: float = 0.005, classes: int = 7) -> DataFrame:
    """One round: fit on approved training rows, score the candidates that share nothing
    with held-out rows, and keep the confident ones, for training only. Returns one row an
    image: image_id, route, confidence, line_ratio. Fewer than 3 approved rows are an error."""
    approved = manifest.where("review_status = 'approved'")
    if approved.limit(3).count() < 3:
        raise ValueError("at least 3 approved rows are needed")
    held = manifest.where("split <> 'train'")
    of_images = lambda ids: X.features(pixels.join(ids, "image_id", "left_semi"))
    pending = manifest.where("review_status = 'pending' AND split = 'train'")
    free = M.hold_out_reason(pending, held, [("subject_id", "held_out_subject"), ("sha256", "held_out_content")])
    close = G.near_any(free, held)
    free = free.join(close, free["phash"] == close["h"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("h").isNotNull(), "held_out_hash"))).drop("h")
    seed = of_images(approved.where("split = 'train'").select(F.col("doc_id").alias("image_id")))
    model = L.fit(seed, features, classes)
    scored = L.score(of_images(free.where("reason IS NULL").select(F.col("doc_id").alias("image_id"))), model, features)
    found = L.mask_confidence(scored, (2, 3, 4, 5))
    route = F.when((F.col("confidence") >= confidence) & (F.col("line_ratio") >= line_ratio), "pseudo_label").otherwise("manual_review")
    kept = found.select("image_id", route.alias("route"), "confidence", "line_ratio")
    skipped = free.where("reason IS NOT NULL").select(F.col("doc_id").alias("image_id"), F.col("reason").alias("route"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("line_ratio"))
    return kept.unionByName(skipped)


def converted_labels(labels: DataFrame, width: int, height: int, least_points: int = 2) -> DataFrame:
    """Label rows (image_id, path, class_name, numbers) as drawable segments: class by
    alias, points from keypoints or else the box's centre line, and the path's split."""
    v = F.col("numbers")
    w, h = F.lit(width), F.lit(height)
    tail = F.slice(v, F.lit(6), F.greatest(F.size(v) - 5, F.lit(0)))
    points = C.keypoints(tail, w, h)
    line = C.box_line(v[1], v[2], v[3], v[4], w, h)
    rows = labels.select("image_id", C.split_of_path(F.col("path")).alias("split"), C.class_of(F.col("class_name")).alias("class_id"), F.when(F.size(points) >= least_points, points).otherwise(line).alias("ps"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ps") - 1), lambda i: F.struct(F.col("ps")[i - 1].alias("a"), F.col("ps")[i].alias("b")))
    seg = rows.where("class_id > 0 AND size(ps) > 1").select("image_id", "split", "class_id", F.explode(pairs).alias("s"))
    return seg.select("image_id", "split", "class_id", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def evaluation(pixels: DataFrame, tags: dict[str, Column], classes: int = 7) -> DataFrame:
    """Per-class metrics of aligned masks, with tags that say where they come from."""
    out = X.class_metrics(X.confusion(pixels, classes))
    return out.select(*[c.alias(k) for k, c in tags.items()], "*")


LINE_CLASSES = {"life": 2, "head": 3, "heart": 4}


def pseudo_masks(pixels: DataFrame, width: int, height: int, thumb: Column, quantile: float = 0.88, least_area: int = 3, least_score: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """Pseudo-masks from dark thin structures: (pixels with `mask`, a report an image).

    The response is thresholded at an image's quantile; components that are large enough
    are scored as each line; lines take their best component in turn, plausible rest is
    minor; line pixels are then dilated by one pixel, higher classes last.
    """
    response = X.features(pixels)
    cut = response.groupBy("image_id").agg(F.percentile("blackhat", F.lit(quantile)).alias("cut"))
    dark = response.join(cut, "image_id").where("blackhat > cut AND blackhat > 0").select("image_id", "y", "x")
    parts = G.written(X.components(dark, F.lit(True)), "components")
    feats = X.component_features(parts, width, height).where(F.col("length_px") >= least_area)
    scores = C.line_scores(thumb)
    scored = G.written(feats.select("image_id", "label", *[s.alias(k) for k, s in scores.items()]), "component-scores")
    taken = W.assign_exclusively(scored, "image_id", "label", list(LINE_CLASSES), least_score)
    ids = F.create_map(*[F.lit(x) for pair in LINE_CLASSES.items() for x in pair])
    taken = G.written(taken.join(scored.unpivot(["image_id", "label"], list(LINE_CLASSES), "line", "score"), ["image_id", "label", "line"]).withColumn("mask", ids[F.col("line")]), "lines")
    rest = scored.join(taken, ["image_id", "label"], "left_anti").where("minor >= 0.25").select("image_id", "label", F.lit(5).alias("mask"))
    drawn = parts.join(taken.select("image_id", "label", "mask").unionByName(rest), ["image_id", "label"])
    near = F.sequence(F.lit(-1), F.lit(1))
    wide = drawn.select("image_id", "y", "x", "mask", F.explode(near).alias("dy")).withColumn("dx", F.explode(near)).where("abs(dy) + abs(dx) < 2")
    wide = wide.groupBy("image_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).agg(F.max("mask").alias("mask"))
    masks = pixels.select("image_id", "y", "x").join(wide, ["image_id", "y", "x"], "left").withColumn("mask", F.coalesce("mask", F.lit(1)))
    main = taken.groupBy("image_id").agg(F.count(F.lit(1)).alias("main_lines"), (F.sum("score") / len(LINE_CLASSES)).alias("mean_score"))
    ratio = masks.groupBy("image_id").agg(F.avg(F.col("mask").between(2, 5).cast("double")).alias("line_ratio"), F.sum((F.col("mask") == 5).cast("long")).alias("minor_pixels"))
    report = ratio.join(main, "image_id", "left").na.fill({"main_lines": 0, "mean_score": 0.0})
    return masks, report.withColumn("mask_quality", C.mask_quality(F.col("line_ratio"), F.col("main_lines"), F.col("mean_score"), F.lit(0.35)))
