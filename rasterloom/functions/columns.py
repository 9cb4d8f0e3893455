"""Column functions of the manifest, quality and annotation rules; no UDFs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- names and paths


def safe_member_path(name: Column) -> Column:
    """A relative path with forward slashes, or null if it is empty, absolute, has a
    drive letter or climbs up; empty and ``.`` parts go."""
    flat = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.split(flat, "/")
    bad = flat.startswith("/") | flat.rlike("^[A-Za-z]:") | F.exists(parts, lambda p: p == "..")
    kept = F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")
    return F.when(~bad & (kept != ""), kept)


def safe_token(text: Column, length: int, fallback: str) -> Column:
    """Letters, digits, dots, dashes and underscores; the rest becomes one underscore."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(F.substring(flat, 1, length), F.lit("")), F.lit(fallback))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def output_name(path: Column, index: Column) -> Column:
    """``parents__stem_000042.ext`` with safe parts."""
    parents = F.array_join(F.transform(F.split(parent(path), "/"), lambda p: safe_token(p, 60, "dir")), "__")
    return F.concat(parents, F.lit("__"), safe_token(stem(path), 80, "image"), F.lit("_"), F.lpad(index.cast("string"), 6, "0"), suffix(path))


def normalised_path(path: Column) -> Column:
    """Forward slashes, no ``.`` parts, ``..`` folded; null if it leaves its root."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        up, n = p == "..", F.size(acc["kept"])
        kept = F.when(up, F.slice(acc["kept"], F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(F.concat(acc["kept"], F.array(p)))
        return F.struct(kept.alias("kept"), (acc["out"] | (up & (n == 0))).alias("out"))

    return F.aggregate(parts, start, step, lambda a: F.when(~a["out"], F.array_join(a["kept"], "/")))


def human_bytes(n: Column) -> Column:
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n / F.lit(1024.0**power), 1))
    out = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024 ** (power + 1), shown(power, unit)).otherwise(out)
    return out


def split_of_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.when(F.array_contains(parts, "valid") | F.array_contains(parts, "val"), "val").when(F.array_contains(parts, "test"), "test").otherwise("train")


def source_group(group: Column, subject: Column, path: Column) -> Column:
    """The annotation's group, else the subject, else the folder."""
    return F.coalesce(F.nullif(group, F.lit("")), F.concat(F.lit("subject:"), F.nullif(subject, F.lit(""))), parent(path))


# ---------------------------------------------------------------- scores


def normal(x: Column, low: float, high: float) -> Column:
    """(x - low) / (high - low) within 0 and 1; 0 if the range is empty."""
    if high <= low:
        return F.lit(0.0)
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def weighted(terms: Sequence[tuple[float, Column]]) -> Column:
    total = F.lit(0.0)
    for w, x in terms:
        total = total + w * x
    return total


# Centre and reach of brightness, and (low, high) of each measure.
BRIGHTNESS = (135.0, 110.0)
RANGES = {"blur": (45.0, 260.0), "contrast": (20.0, 65.0), "glare": (0.03, 0.25), "edge": (0.015, 0.12)}
# Weights of the two summary scores.
IMAGE_WEIGHTS = {"brightness": 0.20, "blur": 0.25, "contrast": 0.20, "resolution": 0.15, "glare": 0.10, "detection": 0.10}
LINE_WEIGHTS = {"contrast": 0.45, "edge": 0.35, "blur": 0.20}


def quality_scores(min_side: float) -> dict[str, Column]:
    """Sub-scores and summaries from mean, contrast, laplacian, short_side, hi_ratio,
    edge_density and detection."""
    s = {
        "brightness": 1 - F.least(F.abs(F.col("mean") - BRIGHTNESS[0]) / BRIGHTNESS[1], F.lit(1.0)),
        "blur": normal(F.col("laplacian"), *RANGES["blur"]),
        "contrast": normal(F.col("contrast"), *RANGES["contrast"]),
        "resolution": normal(F.col("short_side"), 0.65 * min_side, min_side),
        "glare": 1 - normal(F.col("hi_ratio"), *RANGES["glare"]),
        "edge": normal(F.col("edge_density"), *RANGES["edge"]),
        "detection": F.col("detection"),
    }
    s["image_quality"] = unit(weighted([(w, s[k]) for k, w in IMAGE_WEIGHTS.items()]))
    s["line_visibility"] = unit(weighted([(w, s[k]) for k, w in LINE_WEIGHTS.items()]))
    return s


# Order in which equal scores are blamed, and the reason of each.
BLAME = (
    ("image_quality", "LOW_LINE_CONTRAST"), ("brightness", None), ("blur", "BLURRY_IMAGE"), ("contrast", "LOW_LINE_CONTRAST"), ("resolution", "LOW_RESOLUTION"),
    ("glare", "GLARE_REFLECTION"), ("detection", "NO_HAND_FOUND"), ("line_visibility", "LOW_LINE_CONTRAST"),
)


def quality_reason(min_side: float) -> Column:
    """The main reason, from columns named as in `quality_scores` and the measures."""
    c = F.col
    weakest = F.array_min(F.array(*[F.struct(c(name).alias("s"), F.lit(i).alias("i")) for i, (name, _) in enumerate(BLAME)]))["i"]
    blamed = F.lit("LOW_LINE_CONTRAST")
    for i, (_, reason) in enumerate(BLAME):
        dark = F.when(c("mean") < BRIGHTNESS[0], "TOO_DARK").otherwise("TOO_BRIGHT")
        blamed = F.when(weakest == i, F.lit(reason) if reason else dark).otherwise(blamed)
    return (
        F.when(c("detection") < 0.25, "NO_HAND_FOUND").when(c("short_side") < 0.65 * min_side, "LOW_RESOLUTION").when(c("blur") < 0.35, "BLURRY_IMAGE")
        .when(c("mean") < 65, "TOO_DARK").when((c("mean") > 215) | (c("hi_ratio") > 0.22), "TOO_BRIGHT")
        .when((c("contrast_score") < 0.35) | (c("line_visibility") < 0.35), "LOW_LINE_CONTRAST").when(c("image_quality") < 0.55, blamed).otherwise("OK")
    )


# The weights and ranges in this function.
def skin_box_score(area: Column, box: Column, aspect: Column, inside: Column) -> Column:
    return unit(
        0.45 * normal(area, 0.05, 0.45) + 0.25 * normal(box, 0.12, 0.75) + 0.15 * (1 - F.least(F.abs(aspect - 0.75), F.lit(0.75)) / 0.75)
        + 0.15 * F.when(inside, 1.0).otherwise(0.5)
    )


# The weights and ranges in this function.
def line_scores(thumb: Column) -> dict[str, Column]:
    """Scores of a component as each line, from cx, cy, bw, y0, y1, length_px and the
    three directions; `thumb` is left, right or unknown."""
    c = F.col
    zone = lambda x, at, reach: 1 - F.least(F.abs(x - at) / reach, F.lit(1.0))
    length = normal(c("length_px"), 30, 600)
    side = F.when(thumb == "left", zone(c("cx"), 0.28, 0.32)).when(thumb == "right", zone(c("cx"), 0.72, 0.32)).otherwise(0.0)
    return {
        "heart": unit(weighted([(0.36, zone(c("cy"), 0.30, 0.22)), (0.24, c("horizontal")), (0.16, normal(c("bw"), 0.16, 0.55)), (0.24, length)])),
        "head": unit(weighted([(0.34, zone(c("cy"), 0.50, 0.24)), (0.18, c("horizontal")), (0.16, c("diagonal")), (0.14, normal(c("bw"), 0.14, 0.60)), (0.18, length)])),
        "life": unit(weighted([(0.30, side), (0.22, normal(c("y1") - c("y0"), 0.12, 0.50)), (0.14, c("diagonal")), (0.10, c("vertical")), (0.24, length)])),
        "minor": unit(weighted([(0.45, length), (0.20, F.greatest("horizontal", "diagonal", "vertical"))])),
    }


# The weights and ranges in this function.
def mask_quality(line_ratio: Column, main_lines: Column, mean_score: Column, hand: Column) -> Column:
    return unit(0.25 * normal(line_ratio, 0.002, 0.035) + 0.25 * (main_lines / 3.0) + 0.25 * mean_score + 0.25 * hand)


def final_line_score(quality: Column, visibility: Column, model: Column, template: Column, length: Column, validation: Column) -> Column:
    return F.least(quality, visibility, model, template, F.greatest(length, F.lit(0.35)), validation)


def length_bucket(x: Column) -> Column:
    return F.when(x >= 0.55, "long").when(x >= 0.30, "medium").otherwise("short")


def side_of_drag(x: Column) -> Column:
    return F.when(x <= -96, "left").when(x >= 96, "right")


# ---------------------------------------------------------------- labels and boxes


# Names of classes in label files.
CLASS_ALIASES: Mapping[str, int] = {
    "minor": 5, "minor_or_unknown_line": 5, "unknown_line": 5, "life": 2, "life_line": 2, "life line": 2, "lifeline": 2, "head": 3, "head_line": 3,
    "head line": 3, "headline": 3, "heart": 4, "heart_line": 4, "heart line": 4, "heartline": 4, "fate": 5, "fate_line": 5, "fate line": 5, "fateline": 5,
    "simian": 6, "simian_line": 6, "simian line": 6, "single transverse palmar crease": 6,
}


def class_key(name: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_")), r"\s+", " ")


def class_of(name: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in CLASS_ALIASES.items() for x in pair])
    key = class_key(name)
    return F.coalesce(aliases[key], aliases[F.replace(key, F.lit("_"), F.lit(" "))], F.lit(0))


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def keypoints(tail: Column, width: Column, height: Column) -> Column:
    """Pixel points from the numbers after a label line's first five: triples (x, y, v)
    if their count divides by 3, else pairs; null if neither or under four numbers."""
    n = F.size(tail)

    def read(step: int) -> Column:
        at = F.sequence(F.lit(0), F.floor(n / step).cast("int") - 1)
        found = F.transform(at, lambda i: F.struct(tail[i * step].alias("x"), tail[i * step + 1].alias("y"), (tail[i * step + 2] if step == 3 else F.lit(1.0)).alias("v")))
        return F.filter(found, lambda p: (p["v"] > 0) & p["x"].between(0, 1) & p["y"].between(0, 1))

    picked = F.when(n < 4, F.lit(None)).when(n % 3 == 0, read(3)).when(n % 2 == 0, read(2))
    return F.transform(picked, lambda p: F.struct(half_even(p["x"] * width).alias("x"), half_even(p["y"] * height).alias("y")))


def box_line(xc: Column, yc: Column, bw: Column, bh: Column, width: Column, height: Column) -> Column:
    """The centre line along a box's longer side, within the image."""
    cx, cy = half_even(xc * width), half_even(yc * height)
    w, h = F.greatest(half_even(bw * width), F.lit(2)), F.greatest(half_even(bh * height), F.lit(2))
    half_w, half_h = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    across = F.array(point(F.greatest(cx - half_w, F.lit(0)), cy), point(F.least(cx + half_w, width - 1), cy))
    down = F.array(point(cx, F.greatest(cy - half_h, F.lit(0))), point(cx, F.least(cy + half_h, height - 1)))
    return F.when(w >= h, across).otherwise(down)


def rescale(p: Column, from_size: Column, to_size: int) -> Column:
    return F.least(F.greatest(half_even(p * to_size / from_size), F.lit(0)), F.lit(to_size - 1))


def letterbox(width: Column, height: Column, size: int) -> Column:
    """scale and offsets that fit an image into a square."""
    scale = F.least(size / width, size / height)
    return F.struct(scale.alias("scale"), ((size - width * scale) / 2).alias("dx"), ((size - height * scale) / 2).alias("dy"))


def finite(text: Column) -> Column:
    """A number, or null where the text is none or is not finite."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


# The weights and ranges in this function.
def is_skin(r: Column, g: Column, b: Column) -> Column:
    """Broad skin range in YCrCb, or in HSV (hue in half degrees)."""
    y = luma(r, g, b)
    cr, cb = (r - y) * 0.713 + 128, (b - y) * 0.564 + 128
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    hue = F.when(d == 0, 0.0).when(v == r, F.pmod(60.0 * (g - b) / d, F.lit(360.0))).when(v == g, 60.0 * (b - r) / d + 120).otherwise(60.0 * (r - g) / d + 240) / 2
    sat = F.when(v == 0, 0.0).otherwise(255.0 * d / v)
    return (cr.between(133, 180) & cb.between(77, 135)) | (hue.between(0, 35) & (sat >= 15) & (v >= 40))


def annotation_violations(status: Column, points: Column, review: Column, handed: Column, mirrored: Column, width_points: Column, most: int = 6) -> Column:
    """Names of the rules that an annotation breaks."""
    outside = lambda ps: F.exists(ps, lambda p: F.isnan(p["x"]) | F.isnan(p["y"]) | ~p["x"].between(0, 1) | ~p["y"].between(0, 1))
    rules = [
        (~review.isin("pending", "approved", "rejected"), "review_status"), (~status.isin("present", "absent", "unreviewed"), "line_status"), (F.size(points) > most, "too_many_points"),
        (outside(points), "point_outside"), ((status == "absent") & (F.size(points) > 0), "absent_with_points"), (~handed.isin("unknown", "left", "right"), "handedness"),
        (~mirrored.isin("unknown", "yes", "no"), "mirrored"), ((F.size(width_points) > 2) | outside(width_points), "width_points"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def reference_width(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    """Pixels between the two width points; null under 4 or outside the image."""
    d = F.sqrt(F.pow((x2 - x1) * (width - 1), 2) + F.pow((y2 - y1) * (height - 1), 2))
    inside = x1.between(0, 1) & y1.between(0, 1) & x2.between(0, 1) & y2.between(0, 1)
    return F.when(inside & (d >= 4), d)


def checked(value: Column, rule: Column, message: str) -> Column:
    """`value`, with a failure of the job where `rule` does not hold."""
    return F.when(F.assert_true(F.coalesce(rule, F.lit(False)), F.lit(message)).isNull(), value)
