"""Raster operators over pixel tables (image_id, y, x, v, ...). An image is the parallel
unit: windows and groups are keyed by image and hold one image's pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blend(pixels: DataFrame, palette: DataFrame, alpha: float) -> DataFrame:
    """Mixes a class's colour into its pixels; classes without a colour stay."""
    joined = pixels.join(F.broadcast(palette), "class_id", "left")  # one row a class
    mixed = F.floor(F.col("v") * (1 - alpha) + F.col("colour") * alpha).cast("int")
    return joined.withColumn("v", F.coalesce(mixed, F.col("v")))


def crop_to(pixels: DataFrame, chosen: Column, width: int, height: int, pad: float) -> DataFrame:
    """Crops to the chosen pixels' box, padded and clamped, with new coordinates; an
    image without one keeps its centred square."""
    box = pixels.groupBy("image_id").agg(*[f(F.when(chosen, F.col(c))).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"))])
    px, py = F.floor(pad * (F.col("x1") - F.col("x0") + 1)).cast("int"), F.floor(pad * (F.col("y1") - F.col("y0") + 1)).cast("int")
    side = min(width, height)
    none = F.col("x0").isNull()
    box = box.select(
        "image_id", F.when(none, "center").otherwise("box").alias("method"),
        F.when(none, (width - side) // 2).otherwise(F.greatest(F.lit(0), F.col("x0") - px)).alias("bx0"), F.when(none, (width + side) // 2).otherwise(F.least(F.lit(width), F.col("x1") + 1 + px)).alias("bx1"),
        F.when(none, (height - side) // 2).otherwise(F.greatest(F.lit(0), F.col("y0") - py)).alias("by0"), F.when(none, (height + side) // 2).otherwise(F.least(F.lit(height), F.col("y1") + 1 + py)).alias("by1"),
    )
    inside = (F.col("x") >= F.col("bx0")) & (F.col("x") < F.col("bx1")) & (F.col("y") >= F.col("by0")) & (F.col("y") < F.col("by1"))
    out = pixels.join(box, "image_id").where(inside)
    return out.withColumn("x", F.col("x") - F.col("bx0")).withColumn("y", F.col("y") - F.col("by0")).drop("bx0", "bx1", "by0", "by1")


def stretch(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Percentile stretch to 0..255, cut off and truncated; flat images become 0."""
    bounds = pixels.groupBy("image_id").agg(F.percentile("v", F.lit(low)).alias("lo"), F.percentile("v", F.lit(high)).alias("hi"))
    scaled = F.round((F.col("v") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")), 6)  # percentiles carry rounding noise
    value = F.when(F.col("hi") <= F.col("lo"), 0).otherwise(F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0))))
    return pixels.join(bounds, "image_id").withColumn("stretched", value.cast("int")).drop("lo", "hi")


def neighbours(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Adds left, right, up, down (the pixel itself at the border)."""
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    v = F.col(value)
    out = pixels.withColumn("left", F.coalesce(F.lag(v).over(row), v)).withColumn("right", F.coalesce(F.lead(v).over(row), v))
    return out.withColumn("up", F.coalesce(F.lag(v).over(col), v)).withColumn("down", F.coalesce(F.lead(v).over(col), v))


def image_metrics(pixels: DataFrame) -> DataFrame:
    """Size, mean, population deviation, Laplacian variance, bright and dark shares."""
    lap = F.col("left") + F.col("right") + F.col("up") + F.col("down") - 4 * F.col("v")
    edge = F.abs(F.col("right") - F.col("left")) + F.abs(F.col("down") - F.col("up")) > 60
    return neighbours(pixels).groupBy("image_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("contrast"), F.var_pop(lap).alias("laplacian"),
        F.avg((F.col("v") > 245).cast("double")).alias("hi_ratio"), F.avg((F.col("v") < 10).cast("double")).alias("lo_ratio"), F.avg(edge.cast("double")).alias("edge_density"),
    )


def confusion(pairs: DataFrame, classes: int, target: str = "class_id", pred: str = "pred_id") -> DataFrame:
    """Dense classes x classes counts, zero cells included."""
    counts = pairs.groupBy(F.col(target).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    ids = F.sequence(F.lit(0), F.lit(classes - 1))
    grid = pairs.sparkSession.range(1).select(F.explode(ids).alias("target")).select("target", F.explode(ids).alias("pred"))
    return grid.join(F.broadcast(counts), (F.col("t") == F.col("target")) & (F.col("p") == F.col("pred")), "left").select("target", "pred", F.coalesce("c", F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """IoU, Dice, precision, recall, F1 and support of each class; null without samples."""
    diag = F.sum(F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(F.col("target").alias("class_id")).agg(F.sum("n").alias("support"), diag.alias("tp"))
    cols = matrix.groupBy(F.col("pred").alias("p")).agg(F.sum("n").alias("predicted"))
    both = rows.join(cols, F.col("class_id") == F.col("p"))
    part = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    out = both.select("class_id", "support", part(tp, support + predicted - tp).alias("iou"), part(2 * tp, support + predicted).alias("dice"), part(tp, predicted).alias("precision"), part(tp, support).alias("recall"))
    return out.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def components(pixels: DataFrame, chosen: Column) -> DataFrame:
    """8-connected components of the chosen pixels: adds `label`, the component's smallest
    ``y * 65536 + x``. An image is labelled by one task, with arrays in numpy: rasters
    are bounded by the reader's pixel limit, and images are the parallel unit."""
    import numpy as np
    import pandas as pd

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        y0, x0 = y.min(), x.min()
        wide = int(x.max() - x0) + 3
        own = (y - y0 + 1).astype("i8") * wide + (x - x0 + 1)  # places, with an empty border
        size = (int(y.max() - y0) + 3) * wide
        root = np.full(size, size, "i8")  # the border and pixels not chosen: beyond all places
        root[own] = own
        steps = [dy * wide + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        while True:
            # the smallest root around a pixel becomes its root's root; then all roots jump
            least = np.minimum.reduce([root[own + s] for s in steps])
            now = root.copy()
            np.minimum.at(now, root[own], least)
            now[own] = np.minimum(now[own], least)
            while True:
                further = now[now[own]]
                if (further == now[own]).all():
                    break
                now[own] = further
            if (now == root).all():
                return pdf.assign(label=(root[own] // wide + y0 - 1) * 65536 + root[own] % wide + x0 - 1)
            root = now

    kept = pixels.where(chosen)
    return kept.groupBy("image_id").applyInPandas(label, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kept.schema.fields)}, label long")


def component_features(labelled: DataFrame, width: int, height: int) -> DataFrame:
    """Box, size, centre, principal angle and its three directions of each component."""
    rows = labelled.groupBy("image_id", "label").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("size"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.covar_samp(F.col("x").cast("double"), F.col("y").cast("double")).alias("cxy"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"),
    )
    half = F.lit(3.141592653589793 / 2)
    # rounded: a symmetric component has no direction, whatever the noise of its moments
    angle = F.abs(0.5 * F.atan2(2 * F.round("cxy", 9) + 0.0, F.round(F.col("vx") - F.col("vy"), 9) + 0.0))
    rows = rows.withColumn("angle", F.when(F.col("size") > 2, F.coalesce(angle, F.lit(0.0))).otherwise(0.0))
    toward = lambda at, reach: 1 - F.least(F.abs(F.col("angle") - at) / reach, F.lit(1.0))
    return rows.select(
        "image_id", "label", (F.col("x0") / width).alias("x0"), (F.col("x1") / width).alias("x1"), (F.col("y0") / height).alias("y0"), (F.col("y1") / height).alias("y1"),
        ((F.col("x1") - F.col("x0") + 1) / width).alias("bw"), ((F.col("y1") - F.col("y0") + 1) / height).alias("bh"), F.col("size").cast("double").alias("length_px"),
        (F.col("mx") / width).alias("cx"), (F.col("my") / height).alias("cy"), "angle",
        toward(F.lit(0.0), half).alias("horizontal"), toward(half, half).alias("vertical"), toward(half / 2, half / 2).alias("diagonal"),
    )


def largest_region(labelled: DataFrame, total_pixels: int, least: int = 64, most_share: float = 0.95, second_share: float = 0.25) -> DataFrame:
    """Per image: the largest region's label and area, and why it is no palm."""
    sizes = labelled.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"))
    image = Window.partitionBy("image_id").orderBy(F.desc("area"), "label")
    ranked = sizes.withColumn("rank", F.row_number().over(image)).withColumn("second", F.coalesce(F.lead("area").over(image), F.lit(0)))
    reason = F.when((F.col("area") < least) | (F.col("area") > total_pixels * most_share), "invalid_region").when(F.col("second") > F.col("area") * second_share, "multiple_regions").otherwise("")
    return ranked.where("rank = 1").select("image_id", "label", "area", reason.alias("reason"))


def edges8(pixels: DataFrame, chosen: Column) -> DataFrame:
    """Skeleton graph: edges between 8-neighbours (each once), weight 1 or sqrt 2; a
    diagonal goes if either pixel that both touch is chosen too."""
    on = pixels.where(chosen).select("image_id", "y", "x")
    offsets = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))])).alias("o")
    ask = on.select("*", offsets).select("image_id", "y", "x", (F.col("y") + F.col("o.dy")).alias("y2"), (F.col("x") + F.col("o.dx")).alias("x2"))
    to = on.select("image_id", F.col("y").alias("y2"), F.col("x").alias("x2"))
    found = ask.join(to, ["image_id", "y2", "x2"])
    corner = lambda y, x: on.select("image_id", F.col("y").alias(y), F.col("x").alias(x))
    straight = found.where((F.col("y") == F.col("y2")) | (F.col("x") == F.col("x2"))).withColumn("weight", F.lit(1.0))
    diagonal = found.where((F.col("y") != F.col("y2")) & (F.col("x") != F.col("x2"))).withColumn("weight", F.sqrt(F.lit(2.0)))
    diagonal = diagonal.join(corner("y", "x2"), ["image_id", "y", "x2"], "left_anti").join(corner("y2", "x"), ["image_id", "y2", "x"], "left_anti")
    return straight.unionByName(diagonal)


def runs(pixels: DataFrame, chosen: Column) -> DataFrame:
    """Runs of chosen pixels along each row: image_id, y, start, length (gaps and islands)."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    on = pixels.where(chosen).withColumn("_island", F.col("x") - F.row_number().over(row))
    return on.groupBy("image_id", "y", "_island").agg(F.min("x").alias("start"), F.count(F.lit(1)).alias("length")).drop("_island")


def block_mean(pixels: DataFrame, factor: int) -> DataFrame:
    """Area resize by a whole factor."""
    return pixels.groupBy("image_id", F.expr(f"y div {factor}").cast("int").alias("y"), F.expr(f"x div {factor}").cast("int").alias("x")).agg(F.avg("v").alias("v"))


def keep_aspect(pixels: DataFrame, size: int) -> DataFrame:
    """(image_id, w, h, nw, nh, x0, y0): each image's sides, its sides when the longer one
    becomes `size` (halves to even), and its place in the middle of a square."""
    sides = pixels.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))
    scaled = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * F.lit(float(size)) / F.greatest("w", "h"), 0).cast("int"))
    sides = sides.withColumn("nw", scaled("w")).withColumn("nh", scaled("h"))
    return sides.withColumn("x0", F.expr(f"({size} - nw) div 2").cast("int")).withColumn("y0", F.expr(f"({size} - nh) div 2").cast("int"))


def letterbox_nearest(pixels: DataFrame, size: int, pad: int = 0) -> DataFrame:
    """Each image in a `size` x `size` square: output pixel x takes source pixel
    x * w div nw, and what lies outside is `pad`. The inverse of that rule gives each source
    pixel its run of output pixels, so that no grid is joined; the margins are made from
    one row an image."""
    sides = keep_aspect(pixels, size)
    # outputs x with x * w div nw = s run from ceil(s * nw / w) to ceil((s + 1) * nw / w) - 1
    run = lambda s, n, side: F.expr(f"CASE WHEN ({s} * {n} + {side} - 1) div {side} < (({s} + 1) * {n} + {side} - 1) div {side} THEN sequence(({s} * {n} + {side} - 1) div {side}, (({s} + 1) * {n} + {side} - 1) div {side} - 1) ELSE array() END")
    placed = pixels.select("image_id", "y", "x", "v").join(sides, "image_id").withColumn("oy", F.explode(run("y", "nh", "h"))).withColumn("ox", F.explode(run("x", "nw", "w")))
    inner = placed.select("image_id", (F.col("oy") + F.col("y0")).cast("int").alias("y"), (F.col("ox") + F.col("x0")).cast("int").alias("x"), F.col("v").cast("int").alias("v"))
    all_of = F.sequence(F.lit(0), F.lit(size - 1))
    margin = sides.withColumn("y", F.explode(all_of)).withColumn("x", F.explode(all_of)).where("y < y0 OR y >= y0 + nh OR x < x0 OR x >= x0 + nw")
    return inner.unionByName(margin.select("image_id", "y", "x", F.lit(pad).alias("v")))


def resize_area(pixels: DataFrame, size: int) -> DataFrame:
    """Area resize with kept aspect to any smaller size: an output pixel is the mean of the
    source area that it covers, with parts of pixels by their share. Each source pixel adds
    to the one or two output pixels that it overlaps on each axis; one shuffle by output pixel."""
    sides = keep_aspect(pixels, size)

    def overlaps(s: str, n: str, side: str) -> Column:
        # output o covers [o * side, (o + 1) * side), source s covers [s * n, (s + 1) * n), in parts of a pixel
        at = F.expr(f"sequence({s} * {n} div {side}, (({s} + 1) * {n} - 1) div {side})")
        return F.transform(at, lambda o: F.struct(o.cast("int").alias("o"), (F.least((o + 1) * F.col(side), (F.col(s) + 1) * F.col(n)) - F.greatest(o * F.col(side), F.col(s) * F.col(n))).cast("long").alias("part")))

    rows = pixels.select("image_id", "y", "x", "v").join(sides, "image_id").withColumn("_y", F.explode(overlaps("y", "nh", "h"))).withColumn("_x", F.explode(overlaps("x", "nw", "w")))
    weight = F.col("_y.part") * F.col("_x.part")
    return rows.groupBy("image_id", F.col("_y.o").alias("y"), F.col("_x.o").alias("x")).agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("v"))


def features(pixels: DataFrame, reach: int = 4) -> DataFrame:
    """Per pixel: gray, black-hat (separable closing minus gray), gradient and place."""
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    near_row, near_col = row.rowsBetween(-reach, reach), col.rowsBetween(-reach, reach)
    whole = pixels.repartition("image_id")  # the one shuffle: an image's rows and columns meet
    out = whole.withColumn("_m", F.max("v").over(near_row)).withColumn("_m", F.max("_m").over(near_col))
    out = out.withColumn("_m", F.min("_m").over(near_row)).withColumn("_m", F.min("_m").over(near_col))
    out = neighbours(out)
    smooth_x = lambda c: F.coalesce(F.lag(c).over(col), F.col(c)) + 2 * F.col(c) + F.coalesce(F.lead(c).over(col), F.col(c))
    smooth_y = lambda c: F.coalesce(F.lag(c).over(row), F.col(c)) + 2 * F.col(c) + F.coalesce(F.lead(c).over(row), F.col(c))
    out = out.withColumn("_gx", smooth_x("right") - smooth_x("left")).withColumn("_gy", smooth_y("down") - smooth_y("up"))
    gx, gy = F.col("_gx") / 255.0, F.col("_gy") / 255.0
    size = Window.partitionBy("image_id")
    return out.select(
        "image_id", "y", "x", "class_id", (F.col("v") / 255.0).alias("gray"), ((F.col("_m") - F.col("v")) / 255.0).alias("blackhat"), F.least(F.sqrt(gx * gx + gy * gy), F.lit(1.0)).alias("gradient"),
        (F.col("x") / F.greatest(F.max("x").over(size), F.lit(1))).alias("fx"), (F.col("y") / F.greatest(F.max("y").over(size), F.lit(1))).alias("fy"),
    )


def inscribed(pixels: DataFrame, chosen: Column) -> DataFrame:
    """Radius and centre of the largest circle inside the chosen pixels: the largest
    distance to a pixel that is not chosen, or to the frame around the image."""
    import numpy as np
    import pandas as pd

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((pdf["y"].max() + 3, pdf["x"].max() + 3), bool)
        grid[pdf["y"] + 1, pdf["x"] + 1] = pdf["_on"]
        far = float(sum(grid.shape)) ** 2
        # exact Euclidean distances, one axis after the other
        up = np.where(grid, np.inf, 0.0)
        for axis_pass in (range(1, len(up)), range(len(up) - 2, -1, -1)):
            for i in axis_pass:
                j = i - 1 if axis_pass.step > 0 else i + 1
                up[i] = np.minimum(up[i], up[j] + 1)
        square, cols = np.minimum(up * up, far), np.arange(grid.shape[1])
        best = np.full(grid.shape, far)
        for c in cols:
            best = np.minimum(best, square[:, c : c + 1] + (cols - c) ** 2)
        best = np.where(grid, best, 0.0)
        at = int(best.argmax())
        y, x = divmod(at, grid.shape[1])
        return pd.DataFrame([[key[0], float(np.sqrt(best.flat[at])), y - 1, x - 1]], columns=["image_id", "radius", "cy", "cx"])

    return pixels.select("image_id", "y", "x", chosen.alias("_on")).groupBy("image_id").applyInPandas(find, "image_id long, radius double, cy int, cx int")
