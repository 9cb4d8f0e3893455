"""Queries of raster operators (A6 to A12, A17 to A25, J13 to J16, W6, W10, K*, P8, G5, G6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import classifier as L
from ..operators import graph as G
from ..operators import pixels as X
from ..operators import polylines as R
from ..operators.graph import written
from . import views
from .registry import query


@query("pixels", sql="""WITH b AS (SELECT image_id, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM pixels GROUP BY image_id)
SELECT image_id, pos, CASE WHEN hi <= lo THEN 0 ELSE floor(least(greatest(round((v - lo) * 255 / (hi - lo), 6), 0), 255)) END::INT AS stretched FROM pixels JOIN b USING (image_id)""")
def p8_percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.stretch(views.pixels(spark, sf_dir), 0.1, 0.9).select("image_id", "pos", "stretched")


_GRID = "g AS (SELECT t.t::INT AS target, p.p::INT AS pred FROM (SELECT unnest(range(7)) AS t) t, (SELECT unnest(range(7)) AS p) p)"
_MATRIX = f"c AS (SELECT class_id, pred_id, count(*) AS n FROM pixels GROUP BY ALL), {_GRID}, m AS (SELECT target, pred, coalesce(n, 0) AS n FROM g LEFT JOIN c ON class_id = target AND pred_id = pred)"


@query("pixels", sql=f"WITH {_MATRIX} SELECT * FROM m")
def a6_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.confusion(views.pixels(spark, sf_dir), 7)


_METRICS = f"""{_MATRIX}, k AS (SELECT i.i::INT AS class_id, (SELECT sum(n) FROM m WHERE target = i) AS support, (SELECT sum(n) FROM m WHERE pred = i) AS predicted, (SELECT sum(n) FROM m WHERE pred = i AND target = i) AS tp FROM (SELECT unnest(range(7)) AS i) i),
s AS (SELECT class_id, support::BIGINT AS support, tp / nullif(support + predicted - tp, 0) AS iou, 2 * tp / nullif(support + predicted, 0) AS dice, tp / nullif(predicted, 0) AS precision, tp / nullif(support, 0) AS recall FROM k)"""


@query("pixels", sql=f"WITH {_METRICS} SELECT class_id, support, round(iou, 6) AS iou, round(dice, 6) AS dice, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM s")
def a7_segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.class_metrics(X.confusion(views.pixels(spark, sf_dir), 7))
    return out.select("class_id", "support", *[F.round(c, 6).alias(c) for c in ("iou", "dice", "precision", "recall", "f1")])


@query("pixels", sql=f"WITH {_METRICS} SELECT round(avg(coalesce(dice, 0)) FILTER (class_id BETWEEN 2 AND 4), 6) AS mean_dice, round(avg(iou), 6) AS macro_iou FROM s")
def a8_line_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.class_metrics(X.confusion(views.pixels(spark, sf_dir), 7))
    lines = F.when(F.col("class_id").between(2, 4), F.coalesce("dice", F.lit(0.0)))
    return out.agg(F.round(F.avg(lines), 6).alias("mean_dice"), F.round(F.avg("iou"), 6).alias("macro_iou"))


_NEAR = """n AS (SELECT *, coalesce(lag(v) OVER r, v) AS l, coalesce(lead(v) OVER r, v) AS r, coalesce(lag(v) OVER c, v) AS u, coalesce(lead(v) OVER c, v) AS d FROM pixels
  WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))"""


@query("pixels", sql=f"""WITH {_NEAR} SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS contrast, round(var_pop(l + r + u + d - 4 * v) + 1e-7, 4) AS laplacian,
  round(avg((v > 245)::INT), 6) AS hi_ratio, round(avg((v < 10)::INT), 6) AS lo_ratio, round(avg((abs(r - l) + abs(d - u) > 60)::INT), 6) AS edge_density FROM n GROUP BY image_id""")
def a9_image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.image_metrics(views.pixels(spark, sf_dir))
    return out.select("image_id", "width", "height", *[F.round(c, 6).alias(c) for c in ("mean", "contrast", "hi_ratio", "lo_ratio", "edge_density")], F.round(F.col("laplacian") + 1e-7, 4).alias("laplacian"))


FEATURES = ("gray", "gradient", "fx", "fy")
_FEATURES = f"""{_NEAR}, s0 AS (SELECT *, coalesce(lag(r) OVER c, r) + 2 * r + coalesce(lead(r) OVER c, r) - coalesce(lag(l) OVER c, l) - 2 * l - coalesce(lead(l) OVER c, l) AS gx,
  coalesce(lag(d) OVER w, d) + 2 * d + coalesce(lead(d) OVER w, d) - coalesce(lag(u) OVER w, u) - 2 * u - coalesce(lead(u) OVER w, u) AS gy FROM n
  WINDOW w AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)),
f AS (SELECT image_id, y, x, class_id, v / 255.0::DOUBLE AS gray, least(sqrt((gx / 255.0::DOUBLE) ** 2 + (gy / 255.0::DOUBLE) ** 2), 1) AS gradient, x / 7.0::DOUBLE AS fx, y / 7.0::DOUBLE AS fy FROM s0)"""


@query("pixels", sql=f"""WITH {_FEATURES}, m1 AS (SELECT image_id, y, x, max(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM pixels),
m2 AS (SELECT image_id, y, x, max(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM m1),
m3 AS (SELECT image_id, y, x, min(m) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM m2),
m4 AS (SELECT image_id, y, x, min(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM m3)
SELECT image_id, y, x, round(gray, 6) AS gray, round(m / 255.0::DOUBLE - gray, 6) AS blackhat, round(gradient, 6) AS gradient, round(fx, 6) AS fx, round(fy, 6) AS fy FROM f JOIN m4 USING (image_id, y, x)""")
def k3_pixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.features(views.pixels(spark, sf_dir))
    return out.select("image_id", "y", "x", *[F.round(c, 6).alias(c) for c in ("gray", "blackhat", "gradient", "fx", "fy")])


_CAP = f"{_FEATURES}, t AS (SELECT * FROM f WHERE image_id % 10 > 1 AND class_id <> 6 QUALIFY row_number() OVER (PARTITION BY image_id, class_id ORDER BY sha256('s|' || image_id || '|' || y || '|' || x)) <= 20)"


@query("pixels", sql=f"WITH {_CAP} SELECT image_id, class_id, count(*) AS n FROM t GROUP BY ALL")
def w10_sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training(spark, sf_dir).groupBy("image_id", "class_id").agg(F.count(F.lit(1)).alias("n"))


def sampled(pixels: DataFrame) -> DataFrame:
    return L.capped(pixels.where("image_id % 10 > 1 AND class_id <> 6"), 20, "s")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(X.features(views.pixels(spark, sf_dir)))


_LONG = " UNION ALL ".join(f"SELECT class_id, '{f}' AS feature, {f} AS value FROM t" for f in FEATURES)
_MODEL = f"""{_CAP}, v AS ({_LONG}), a AS (SELECT feature, avg(value) AS gm, stddev_pop(value) AS gs FROM v GROUP BY feature), o AS (SELECT class_id, feature, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM v GROUP BY ALL),
model AS (SELECT i.i::INT AS class_id, a.feature, coalesce(m, gm) AS mean, greatest(coalesce(s, gs), 0.025) AS std, coalesce(n, 0) AS n, sqrt(coalesce(n, 0) + 1) / sum(sqrt(coalesce(n, 0) + 1)) OVER (PARTITION BY a.feature) AS prior
  FROM (SELECT unnest(range(7)) AS i) i CROSS JOIN a LEFT JOIN o ON o.class_id = i.i AND o.feature = a.feature)"""


@query("pixels", sql=f"WITH {_MODEL} SELECT class_id, feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(prior, 6) AS prior FROM model")
def a10_gaussian_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fit(training(spark, sf_dir), FEATURES, 7).select("class_id", "feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "prior")])


_SCORED = f"""{_MODEL}, l AS (SELECT f.image_id, f.y, f.x, model.class_id, ln(any_value(prior)) + sum(-0.5 * ((CASE feature {' '.join(f"WHEN '{f}' THEN f.{f}" for f in FEATURES)} END - mean) / std) ** 2 - ln(std)) AS l
  FROM f CROSS JOIN model WHERE n > 0 GROUP BY ALL),
p AS (SELECT image_id, y, x, arg_max(class_id, (round(l, 9), -class_id)) AS pred, 1 / sum(exp(l - top)) AS prob FROM (SELECT *, max(l) OVER (PARTITION BY image_id, y, x) AS top FROM l) GROUP BY ALL)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel's class. Features are made once, for the fit and the scoring."""
    pixels = written(X.features(views.pixels(spark, sf_dir)), "features")
    return L.score(pixels, L.fit(sampled(pixels), FEATURES, 7), FEATURES)


@query("pixels", sql=f"WITH {_SCORED} SELECT image_id, y, x, pred, round(prob, 5) AS prob FROM p")
def k6_pixel_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 and T6 too: every learned class is scored for each pixel, the best one wins."""
    return predicted(spark, sf_dir).select("image_id", "y", "x", "pred", F.round("prob", 5).alias("prob"))


@query("pixels", sql=f"""WITH {_SCORED}, q AS (SELECT image_id, avg(prob) AS overall, coalesce(avg(prob) FILTER (pred IN (2, 3, 4, 5)), 0) AS on_lines, avg((pred IN (2, 3, 4, 5))::INT) AS line_ratio FROM p GROUP BY image_id)
SELECT image_id, round(least(overall, on_lines), 5) AS confidence, round(line_ratio, 6) AS line_ratio FROM q""")
def a17_mask_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.mask_confidence(predicted(spark, sf_dir), (2, 3, 4, 5)).select("image_id", F.round("confidence", 5).alias("confidence"), F.round("line_ratio", 6).alias("line_ratio"))


@query("pixels", sql=f"WITH {_SCORED}, i AS (SELECT DISTINCT image_id FROM p) SELECT image_id, k.k::INT AS class_id, round(coalesce(avg(prob), 0), 5) AS mean_prob FROM i CROSS JOIN (SELECT unnest([2, 3, 4]) AS k) k LEFT JOIN p USING (image_id) WHERE TRUE GROUP BY image_id, k.k HAVING TRUE".replace("LEFT JOIN p USING (image_id) WHERE TRUE", "LEFT JOIN p ON p.image_id = i.image_id AND p.pred = k.k").replace("SELECT image_id, k.k", "SELECT i.image_id, k.k").replace("GROUP BY image_id, k.k HAVING TRUE", "GROUP BY i.image_id, k.k"))
def a24_mean_class_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir).groupBy("image_id").agg(*[F.round(F.coalesce(F.avg(F.when(F.col("pred") == k, F.col("prob"))), F.lit(0.0)), 5).alias(str(k)) for k in (2, 3, 4)])
    return rows.unpivot("image_id", ["2", "3", "4"], "class_id", "mean_prob").select("image_id", F.col("class_id").cast("int").alias("class_id"), "mean_prob")


@query("pixels", sql="SELECT CASE WHEN class_id <= 4 THEN class_id ELSE 0 END AS class_id, count(*) AS n FROM pixels WHERE image_id IN (SELECT DISTINCT image_id FROM pixels ORDER BY image_id LIMIT 300) GROUP BY 1")
def a11_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = views.pixels(spark, sf_dir)
    shown = pixels.select("image_id").distinct().orderBy("image_id").limit(300)  # a report of 300 masks
    known = F.when(F.col("class_id") <= 4, F.col("class_id")).otherwise(0)
    return pixels.join(shown, "image_id", "left_semi").groupBy(known.alias("class_id")).agg(F.count(F.lit(1)).alias("n"))


@query("pixels", sql="SELECT class_id, y, x, round(n / max(n) OVER (PARTITION BY class_id), 6) AS heat FROM (SELECT class_id, y, x, count(*) AS n FROM pixels GROUP BY ALL)")
def a12_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = views.pixels(spark, sf_dir).groupBy("class_id", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("class_id", "y", "x", F.round(F.col("n") / F.max("n").over(Window.partitionBy("class_id")), 6).alias("heat"))


BRIGHT = 150
_ON = f"on_ AS (SELECT image_id, y, x, y * 65536 + x AS id FROM pixels WHERE v > {BRIGHT})"
_COMPONENTS = f"""{_ON}, r AS (SELECT image_id, id, id AS root FROM on_ UNION SELECT b.image_id, b.id, r.root FROM r JOIN on_ a ON a.image_id = r.image_id AND a.id = r.id JOIN on_ b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
lab AS (SELECT image_id, id, min(root) AS label FROM r GROUP BY image_id, id), lp AS (SELECT lab.image_id, label::BIGINT AS label, id // 65536 AS y, id % 65536 AS x FROM lab)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.components(views.pixels(spark, sf_dir), F.col("v") > BRIGHT)


@query("pixels", sql=f"WITH RECURSIVE {_COMPONENTS} SELECT image_id, label, y::INT AS y, x::INT AS x FROM lp")
def g5_pixel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("image_id", "label", "y", "x")


_BOXES = f"""{_COMPONENTS}, cf AS (SELECT image_id, label, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS mx, avg(y) AS my, CASE WHEN count(*) > 2 THEN coalesce(abs(0.5 * atan2(2 * round(covar_samp(x, y), 9) + 0.0, round(var_samp(x) - var_samp(y), 9) + 0.0)), 0) ELSE 0 END AS angle FROM lp GROUP BY image_id, label)"""


@query("pixels", sql=f"""WITH RECURSIVE {_BOXES} SELECT image_id, label, n::DOUBLE AS length_px, x0 / 8 AS x0, (y1 - y0 + 1) / 8 AS bh, round(mx / 8, 6) AS cx, round(angle, 5) AS angle, round(1 - least(angle / (pi() / 2), 1), 5) AS horizontal, round(1 - least(abs(angle - pi() / 4) / (pi() / 4), 1), 5) AS diagonal FROM cf""")
def a18_component_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.component_features(labelled(spark, sf_dir), 8, 8)
    return out.select("image_id", "label", "length_px", "x0", "bh", F.round("cx", 6).alias("cx"), *[F.round(c, 5).alias(c) for c in ("angle", "horizontal", "diagonal")])


@query("pixels", sql=f"""WITH RECURSIVE {_BOXES}, fz AS (SELECT image_id, label, mx / 8 AS cx, my / 8 AS cy, (x1 - x0 + 1) / 8 AS bw, y0 / 8 AS y0, y1 / 8 AS y1, least(greatest((n - 30) / 570, 0), 1) AS len, 1 - least(angle / (pi() / 2), 1) AS h, 1 - least(abs(angle - pi() / 2) / (pi() / 2), 1) AS ve, 1 - least(abs(angle - pi() / 4) / (pi() / 4), 1) AS d FROM cf)
SELECT image_id, label, round(0.36 * (1 - least(abs(cy - 0.30) / 0.22, 1)) + 0.24 * h + 0.16 * least(greatest((bw - 0.16) / 0.39, 0), 1) + 0.24 * len + 1e-9, 5) AS heart,
  round(0.34 * (1 - least(abs(cy - 0.50) / 0.24, 1)) + 0.18 * h + 0.16 * d + 0.14 * least(greatest((bw - 0.14) / 0.46, 0), 1) + 0.18 * len + 1e-9, 5) AS head,
  round(0.30 * (1 - least(abs(cx - 0.28) / 0.32, 1)) + 0.22 * least(greatest((y1 - y0 - 0.12) / 0.38, 0), 1) + 0.14 * d + 0.10 * ve + 0.24 * len + 1e-9, 5) AS life, round(0.45 * len + 0.20 * greatest(h, d, ve) + 1e-9, 5) AS minor FROM fz""")
def p13_line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.component_features(labelled(spark, sf_dir), 8, 8)
    scores = C.line_scores(F.lit("left"))
    return out.select("image_id", "label", *[F.round(scores[k] + 1e-9, 5).alias(k) for k in ("heart", "head", "life", "minor")])


@query("pixels", sql=f"""WITH RECURSIVE {_COMPONENTS}, sz AS (SELECT image_id, label, count(*) AS area FROM lp GROUP BY ALL), rk AS (SELECT *, row_number() OVER w AS rk, coalesce(lead(area) OVER w, 0) AS second FROM sz WINDOW w AS (PARTITION BY image_id ORDER BY area DESC, label))
SELECT image_id, label, area, CASE WHEN area < 4 OR area > 60.8 THEN 'invalid_region' WHEN second > area * 0.25 THEN 'multiple_regions' ELSE '' END AS reason FROM rk WHERE rk = 1""")
def a19_largest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.largest_region(labelled(spark, sf_dir), 64, least=4)


@query("pixels", sql=f"WITH RECURSIVE {_COMPONENTS} SELECT image_id, label, count(*) AS area FROM lp GROUP BY ALL HAVING count(*) >= 3")
def a20_small_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area")).where("area >= 3")


@query("pixels", sql="""WITH a AS (SELECT image_id, avg((class_id BETWEEN 2 AND 5)::INT) AS ratio, count(*) FILTER (class_id = 5) AS minor, count(DISTINCT class_id) FILTER (class_id BETWEEN 2 AND 4) AS main FROM pixels GROUP BY image_id)
SELECT image_id, round(ratio, 6) AS line_ratio, minor, main, round(least(greatest(0.25 * least(greatest((ratio - 0.002) / 0.033, 0), 1) + 0.25 * (main / 3) + 0.25 * 0.5 + 0.25 * 0.8, 0), 1), 6) AS mask_quality FROM a""")
def a21_line_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 on top: the mask's quality from its counts."""
    line = F.col("class_id").between(2, 5)
    out = views.pixels(spark, sf_dir).groupBy("image_id").agg(F.avg(line.cast("double")).alias("ratio"), F.sum((F.col("class_id") == 5).cast("long")).alias("minor"), F.countDistinct(F.when(F.col("class_id").between(2, 4), F.col("class_id"))).alias("main"))
    return out.select("image_id", F.round("ratio", 6).alias("line_ratio"), "minor", "main", F.round(C.mask_quality(F.col("ratio"), F.col("main"), F.lit(0.5), F.lit(0.8)), 6).alias("mask_quality"))


@query("pixels", sql="SELECT image_id, " + ", ".join(f"(count(*) FILTER (class_id = {k}) > 0)::INT AS has_{k}" for k in (2, 3, 4, 5)) + ", round(avg((class_id BETWEEN 2 AND 5)::INT), 6) AS density FROM pixels GROUP BY image_id HAVING count(DISTINCT class_id) FILTER (class_id BETWEEN 2 AND 5) >= 1")
def a25_label_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.max((F.col("class_id") == k).cast("int")).alias(f"has_{k}") for k in (2, 3, 4, 5)]
    out = views.pixels(spark, sf_dir).groupBy("image_id").agg(*flags, F.round(F.avg(F.col("class_id").between(2, 5).cast("double")), 6).alias("density"))
    return out.where("has_2 + has_3 + has_4 + has_5 >= 1")


_EDGES = f"""{_ON}, ed AS (SELECT a.image_id, a.y, a.x, b.y AS y2, b.x AS x2 FROM on_ a JOIN on_ b ON a.image_id = b.image_id AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND abs(b.x - a.x) <= 1))
  WHERE b.y = a.y OR b.x = a.x OR NOT EXISTS (SELECT 1 FROM on_ c WHERE c.image_id = a.image_id AND ((c.y = a.y AND c.x = b.x) OR (c.y = b.y AND c.x = a.x))))"""


@query("pixels", sql=f"WITH {_EDGES} SELECT image_id, y, x, y2, x2, CASE WHEN y <> y2 AND x <> x2 THEN sqrt(2) ELSE 1 END::DOUBLE AS weight FROM ed")
def j14_neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.edges8(views.pixels(spark, sf_dir), F.col("v") > BRIGHT).select("image_id", "y", "x", "y2", "x2", "weight")


@query("pixels", sql=f"WITH {_EDGES}, dg AS (SELECT image_id, y, x, count(*) AS degree FROM (SELECT image_id, y, x FROM ed UNION ALL SELECT image_id, y2, x2 FROM ed) GROUP BY ALL) SELECT image_id, count(*) FILTER (degree = 1) AS endpoints, max(degree) AS most FROM dg GROUP BY image_id")
def g6_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = G.degrees(X.edges8(views.pixels(spark, sf_dir), F.col("v") > BRIGHT), ("y", "y2"), ("x", "x2"))
    return deg.groupBy("image_id").agg(F.sum((F.col("degree") == 1).cast("long")).alias("endpoints"), F.max("degree").alias("most"))


@query()
def g7_line_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6 and J16 joined: lengths of principal paths in palm widths."""
    pixels = views.pixels(spark, sf_dir)
    paths = R.principal_paths(X.edges8(pixels, F.col("v") > BRIGHT))
    return R.line_measures(paths, X.inscribed(pixels, F.col("v") > 90))


@query("pixels", sql="""WITH f AS (SELECT image_id, y, x, v > 110 AS on_ FROM pixels), b AS (SELECT image_id, y, x FROM f WHERE NOT on_ UNION SELECT DISTINCT image_id, yy::INT, xx::INT FROM f, (SELECT unnest(range(-1, 9)) AS yy), (SELECT unnest(range(-1, 9)) AS xx) WHERE yy IN (-1, 8) OR xx IN (-1, 8)),
d AS (SELECT f.image_id, f.y, f.x, CASE WHEN on_ THEN min(sqrt((f.y - b.y) ** 2 + (f.x - b.x) ** 2)) ELSE 0 END AS d FROM f JOIN b USING (image_id) GROUP BY f.image_id, f.y, f.x, on_)
SELECT image_id, round(max(d), 6) AS radius FROM d GROUP BY image_id""")
def j16_inscribed_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.inscribed(views.pixels(spark, sf_dir), F.col("v") > 110).select("image_id", F.round("radius", 6).alias("radius"))


@query("pixels", sql="""WITH i AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM pixels WHERE v > 110)
SELECT image_id, max(n) AS longest, count(*) AS runs FROM (SELECT image_id, y, island, count(*) AS n FROM i GROUP BY ALL) WHERE n >= 2 GROUP BY image_id""")
def w6_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = X.runs(views.pixels(spark, sf_dir), F.col("v") > 110).where("length >= 2")
    return runs.groupBy("image_id").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("runs"))


@query("pixels", sql="SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, avg(v) AS v FROM pixels GROUP BY image_id, y // 2, x // 2")
def k2_block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.block_mean(views.pixels(spark, sf_dir), 2)


#: Images cut to 8, 7 or 5 rows, and their sides in a square of 13 and of 5 pixels.
_OBLONG = "o AS (SELECT image_id, y, x, v FROM pixels WHERE y < [8, 7, 5][image_id % 3 + 1])"
_SIDES = """d AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM o GROUP BY image_id),
s AS (SELECT *, greatest(1, round_even(w * {0}.0::DOUBLE / greatest(w, h), 0)::INT) AS nw, greatest(1, round_even(h * {0}.0::DOUBLE / greatest(w, h), 0)::INT) AS nh FROM d)"""


def _oblong(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.element_at(F.array(F.lit(8), F.lit(7), F.lit(5)), (F.col("image_id") % 3 + 1).cast("int"))
    return views.pixels(spark, sf_dir).where(F.col("y") < rows)


@query("pixels", sql=f"""WITH {_OBLONG}, {_SIDES.format(13)}, g AS (SELECT s.*, gy.y AS gy, gx.x AS gx, gy.y - (13 - nh) // 2 AS oy, gx.x - (13 - nw) // 2 AS ox FROM s, (SELECT unnest(range(13)) AS y) gy, (SELECT unnest(range(13)) AS x) gx)
SELECT g.image_id, gy::INT AS y, gx::INT AS x, coalesce(o.v, 114)::INT AS v FROM g LEFT JOIN o ON o.image_id = g.image_id AND oy BETWEEN 0 AND nh - 1 AND ox BETWEEN 0 AND nw - 1 AND o.y = oy * h // nh AND o.x = ox * w // nw""")
def k2_letterbox_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.letterbox_nearest(_oblong(spark, sf_dir), 13, 114)


@query("pixels", sql=f"""WITH {_OBLONG}, {_SIDES.format(5)},
t AS (SELECT s.*, gy.y AS oy, gx.x AS ox FROM s, (SELECT unnest(range(5)) AS y) gy, (SELECT unnest(range(5)) AS x) gx WHERE gy.y < nh AND gx.x < nw),
p AS (SELECT t.image_id, oy, ox, v, (least((oy + 1) * h, (y + 1) * nh) - greatest(oy * h, y * nh)) * (least((ox + 1) * w, (x + 1) * nw) - greatest(ox * w, x * nw)) AS part
  FROM t JOIN o ON o.image_id = t.image_id AND y * nh < (oy + 1) * h AND (y + 1) * nh > oy * h AND x * nw < (ox + 1) * w AND (x + 1) * nw > ox * w)
SELECT image_id, oy::INT AS y, ox::INT AS x, round(sum(v * part) / sum(part), 9) AS v FROM p GROUP BY ALL""")
def k2_area_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.resize_area(_oblong(spark, sf_dir), 5).select("image_id", "y", "x", F.round("v", 9).alias("v"))


_DCT = "CASE WHEN {k} = 0 THEN sqrt(1.0 / 8) ELSE sqrt(2.0 / 8) END * cos(pi() * (2 * {i} + 1) * {k} / 16)"


@query("pixels", sql=f"""WITH c AS (SELECT image_id, ky.k AS ky, kx.k AS kx, sum(v * {_DCT.format(k='ky.k', i='y')} * {_DCT.format(k='kx.k', i='x')}) AS c FROM pixels, (SELECT unnest(range(8)) AS k) ky, (SELECT unnest(range(8)) AS k) kx GROUP BY image_id, ky.k, kx.k),
m AS (SELECT image_id, median(c) AS m FROM c WHERE ky + kx > 0 GROUP BY image_id)
SELECT image_id, lpad(lower(to_hex(sum(CASE WHEN c > m THEN (1::UBIGINT << (8 * ky + kx - 1)::UBIGINT) ELSE 0 END)::UBIGINT)), 16, '0') AS phash FROM c JOIN m USING (image_id) WHERE ky + kx > 0 GROUP BY image_id""")
def k1_perceptual_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rasters = views.pixels(spark, sf_dir).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("values"))
    return rasters.select("image_id", R.perceptual_hash(F.col("values")).alias("phash"))


@query()
def g8_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.thin_masks(views.pixels(spark, sf_dir).where("v > 110"))


@query()
def k4_line_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rasters = views.pixels(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("ps"))
    data = F.unhex(F.array_join(F.transform("ps", lambda p: F.lpad(F.hex(F.least(p["v"], F.lit(255)).cast("long")), 2, "0")), ""))
    out = R.line_response(rasters.select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), data.alias("data")), lengths=(3, 5))
    return out.select("image_id", F.md5("response").alias("response_md5"), F.length("response").alias("n"))
