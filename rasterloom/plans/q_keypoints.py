"""Queries of keypoints and polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import keypoints as K
from ..operators import polylines as R
from . import views
from .registry import query

WIDTH = 0.5

_EVAL = """e AS (SELECT *, sqrt((px - x) ** 2 + (py - y) ** 2) / 0.5 AS err FROM points),
v AS (SELECT line, count(*) FILTER (k = 0 AND status = 'present') AS present, count(*) FILTER (k = 0 AND status = 'absent') AS absent, count(*) FILTER (k = 0 AND status = 'unreviewed') AS unlabelled,
  count(*) FILTER (k = 0 AND status = 'present' AND presence >= 0.5) AS tp, count(*) FILTER (k = 0 AND status = 'absent' AND presence >= 0.5) AS fp, count(*) FILTER (k = 0 AND status = 'present' AND presence < 0.5) AS fn,
  avg(err) FILTER (status = 'present') AS mean_error, avg((err <= 0.05)::INT) FILTER (status = 'present') AS pck FROM e GROUP BY line)"""


@query("points", sql=f"WITH {_EVAL} SELECT line, present, absent, unlabelled, tp, fp, fn, round(mean_error, 6) AS mean_error, round(pck, 6) AS pck, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall FROM v")
def a13_keypoint_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.evaluate(views.points(spark, sf_dir), F.lit(WIDTH))
    return out.select("line", "present", "absent", "unlabelled", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("mean_error", "pck", "precision", "recall")])


@query("points", sql=f"WITH {_EVAL} SELECT line, present >= 3 AND absent >= 3 AND tp / greatest(1, tp + fp) >= 0.95 AND tp / greatest(1, tp + fn) >= 0.90 AND coalesce(pck >= 0.90, FALSE) AS supported FROM v")
def a14_auto_label_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.evaluate(views.points(spark, sf_dir), F.lit(WIDTH)).select("line", K.auto_label_supported().alias("supported"))


@query("points", sql="SELECT line, k, round(avg(px), 6) AS mean_x, round(stddev_pop(px), 6) AS std_x, round(avg(py), 6) AS mean_y, round(stddev_pop(py), 6) AS std_y FROM points GROUP BY line, k")
def a15_draw_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = [F.round(f(c), 6).alias(f"{n}_{c[1]}") for c in ("px", "py") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return views.points(spark, sf_dir).groupBy("line", "k").agg(*stats)


@query("points", sql="""WITH h AS (SELECT *, abs(px - x) AS ax, abs(py - y) AS ay, ln(presence / (1 - presence)) AS z FROM points),
s AS (SELECT sum(CASE WHEN status = 'present' THEN CASE WHEN ax <= 0.05 THEN 0.5 * ax * ax / 0.05 ELSE ax - 0.025 END + CASE WHEN ay <= 0.05 THEN 0.5 * ay * ay / 0.05 ELSE ay - 0.025 END ELSE 0 END) AS h, sum(CASE WHEN status = 'present' THEN 2 ELSE 0 END) AS nh,
  sum(CASE WHEN status <> 'unreviewed' AND k = 0 THEN greatest(z, 0) - CASE WHEN status = 'present' THEN z ELSE 0 END + ln(1 + exp(-abs(z))) ELSE 0 END) AS b, sum(CASE WHEN status <> 'unreviewed' AND k = 0 THEN 1 ELSE 0 END) AS nb FROM h)
SELECT round(h / greatest(1, nh) + 0.15 * b / greatest(1, nb), 6) AS loss FROM s""")
def a16_masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.masked_loss(views.points(spark, sf_dir)).select(F.round("loss", 6).alias("loss"))


_SEG = """s0 AS (SELECT image_id, line, k, x * 639 AS sx, y * 479 AS sy FROM points), s1 AS (SELECT *, coalesce(sqrt((sx - lag(sx) OVER w) ** 2 + (sy - lag(sy) OVER w) ** 2), 0) AS step FROM s0 WINDOW w AS (PARTITION BY image_id, line ORDER BY k)),
seg AS (SELECT *, sum(step) OVER (PARTITION BY image_id, line ORDER BY k) AS along FROM s1)"""


@query("points", sql=f"WITH {_SEG} SELECT image_id, line, k, round(step, 6) AS step, round(along, 6) AS along FROM seg")
def w7_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.segments(views.points(spark, sf_dir), 640, 480).select("image_id", "line", "k", F.round("step", 6).alias("step"), F.round("along", 6).alias("along"))


_TURN = f"""{_SEG}, t0 AS (SELECT image_id, line, k, sx - lag(sx) OVER w AS ax, sy - lag(sy) OVER w AS ay, lead(sx) OVER w - sx AS bx, lead(sy) OVER w - sy AS by_ FROM seg WINDOW w AS (PARTITION BY image_id, line ORDER BY k)),
trn AS (SELECT image_id, line, k, degrees(acos(least(greatest((ax * bx + ay * by_) / nullif(sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_), 0), -1), 1))) AS turn FROM t0 WHERE ax IS NOT NULL AND bx IS NOT NULL)"""


@query("points", sql=f"WITH {_TURN} SELECT image_id, line, k, round(turn, 4) AS turn, turn > 135 AS sharp FROM trn")
def w8_turn_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.turns(views.points(spark, sf_dir), 640, 480).where("turn IS NOT NULL")
    return out.select("image_id", "line", "k", F.round("turn", 4).alias("turn"), (F.col("turn") > 135).alias("sharp"))


_CROSS = """g0 AS (SELECT image_id, line, k, x * 639 AS ax, y * 479 AS ay, lead(x * 639) OVER w AS bx, lead(y * 479) OVER w AS b2 FROM points WINDOW w AS (PARTITION BY image_id, line ORDER BY k)), g AS (SELECT * FROM g0 WHERE bx IS NOT NULL),
crs AS (SELECT DISTINCT p.image_id, p.line FROM g p JOIN g q ON p.image_id = q.image_id AND p.line = q.line AND q.k >= p.k + 2
  WHERE ((p.bx - p.ax) * (q.ay - p.ay) - (p.b2 - p.ay) * (q.ax - p.ax)) * ((p.bx - p.ax) * (q.b2 - p.ay) - (p.b2 - p.ay) * (q.bx - p.ax)) < -1e-10
    AND ((q.bx - q.ax) * (p.ay - q.ay) - (q.b2 - q.ay) * (p.ax - q.ax)) * ((q.bx - q.ax) * (p.b2 - q.ay) - (q.b2 - q.ay) * (p.bx - q.ax)) < -1e-10)"""


@query("points", sql=f"WITH {_CROSS} SELECT * FROM crs")
def r2_self_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.crossings(views.points(spark, sf_dir), 640, 480)


@query("points", sql=f"""WITH {_TURN}, {_CROSS}, l AS (SELECT image_id, line, count(*) AS n, min(least(x, y)) AS lo, max(greatest(x, y)) AS hi FROM points GROUP BY ALL),
m AS (SELECT image_id, line, min(step) FILTER (k > 0) AS least_step FROM seg GROUP BY ALL), a AS (SELECT image_id, line, max(turn) AS most_turn FROM trn GROUP BY ALL)
SELECT image_id, line, concat_ws(',', CASE WHEN lo < 0 OR hi > 1 THEN 'out_of_bounds' END, CASE WHEN least_step < 10 THEN 'collapsed' END, CASE WHEN most_turn > 135 THEN 'sharp_turn' END,
  CASE WHEN (image_id, line) IN (SELECT (image_id, line) FROM crs) THEN 'self_intersection' END) AS reasons FROM l JOIN m USING (image_id, line) JOIN a USING (image_id, line)""")
def r1_polyline_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.points(spark, sf_dir)
    steps = K.segments(points, 640, 480).groupBy("image_id", "line").agg(F.min(F.when(F.col("k") > 0, F.col("step"))).alias("step"), F.min(F.least("x", "y")).alias("lo"), F.max(F.greatest("x", "y")).alias("hi"))
    turn = K.turns(points, 640, 480).groupBy("image_id", "line").agg(F.max("turn").alias("turn"))
    cross = K.crossings(points, 640, 480).withColumn("crossed", F.lit(True))
    rows = steps.join(turn, ["image_id", "line"]).join(cross, ["image_id", "line"], "left")
    reasons = F.array_compact(F.array(
        F.when((F.col("lo") < 0) | (F.col("hi") > 1), "out_of_bounds"), F.when(F.col("step") < 10, "collapsed"), F.when(F.col("turn") > 135, "sharp_turn"), F.when(F.col("crossed"), "self_intersection"),
    ))
    return rows.select("image_id", "line", F.array_join(reasons, ",").alias("reasons"))


@query("points", sql=f"""WITH {_SEG}, sp AS (SELECT image_id, line, k, lag(sx) OVER w AS ax, lag(sy) OVER w AS ay, sx, sy, lag(along) OVER w AS st, along AS en FROM seg WINDOW w AS (PARTITION BY image_id, line ORDER BY k)),
tt AS (SELECT image_id, line, max(along) AS total FROM seg GROUP BY ALL HAVING max(along) >= 8), gl AS (SELECT image_id, line, i, total * i / 5 AS goal FROM tt, (SELECT unnest(range(6)) AS i)),
ht AS (SELECT gl.*, sp.k, ax + least(greatest((goal - st) / nullif(en - st, 0), 0), 1) * (sx - ax) AS hx, ay + least(greatest((goal - st) / nullif(en - st, 0), 0), 1) * (sy - ay) AS hy FROM gl JOIN sp ON gl.image_id = sp.image_id AND gl.line = sp.line AND st IS NOT NULL AND goal <= en + 1e-9 AND goal >= st - 1e-9)
SELECT image_id, line, i::INT AS i, round(arg_min(hx, k), 5) AS x, round(arg_min(hy, k), 5) AS y FROM ht GROUP BY image_id, line, i""")
def r6_equal_arc_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 too: each goal finds its segment by a range join on the running length."""
    return K.resample(views.points(spark, sf_dir), 640, 480).select("image_id", "line", "i", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query()
def r3_curve_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("k", "x", "y")))
    lines = views.points(spark, sf_dir).groupBy("image_id", "line").agg(ordered.alias("ps"))
    lines = lines.select("image_id", "line", F.col("ps.x").alias("xs"), F.col("ps.y").alias("ys"), F.lit(120.0).alias("palm_width"))
    return R.curves(lines, 640, 480).select("image_id", "line", F.round("length", 4).alias("length"), F.round("curvature", 4).alias("curvature"), F.array_join("reasons", ",").alias("reasons"))


@query("points", sql="""WITH s AS (SELECT image_id, line + 2 AS class_id, k, round_even(x * 31, 0)::INT AS x2, round_even(y * 31, 0)::INT AS y2, lag(round_even(x * 31, 0)::INT) OVER w AS x1, lag(round_even(y * 31, 0)::INT) OVER w AS y1 FROM points WINDOW w AS (PARTITION BY image_id, line ORDER BY k)),
n AS (SELECT *, greatest(abs(x2 - x1), abs(y2 - y1), 1) AS n FROM s WHERE x1 IS NOT NULL), p AS (SELECT *, unnest(range(n + 1)) AS i FROM n)
SELECT image_id, round_even(y1 + (i::DOUBLE / n) * (y2 - y1), 0)::INT AS y, round_even(x1 + (i::DOUBLE / n) * (x2 - x1), 0)::INT AS x, max(class_id)::INT AS class_id FROM p GROUP BY 1, 2, 3""")
def r4_rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("image_id", "line").orderBy("k")
    x, y = F.bround(F.col("x") * 31).cast("int"), F.bround(F.col("y") * 31).cast("int")
    seg = views.points(spark, sf_dir).select("image_id", (F.col("line") + 2).alias("class_id"), F.lag(x).over(w).alias("x1"), F.lag(y).over(w).alias("y1"), x.alias("x2"), y.alias("y2")).where("x1 IS NOT NULL")
    return R.rasterised(seg).select("image_id", "y", "x", "class_id")


@query("points", "pixels", sql="""WITH c AS (SELECT DISTINCT image_id, x * 7 AS x, y * 7 AS y FROM points),
e AS (SELECT a.image_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON a.image_id = b.image_id AND (a.x <> b.x OR a.y <> b.y) JOIN c p ON a.image_id = p.image_id
  GROUP BY ALL HAVING min((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) >= 0 AND max((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) > 0),
i AS (SELECT image_id, y, x FROM pixels JOIN e USING (image_id) GROUP BY ALL HAVING bool_and((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0))
SELECT image_id, count(*) AS filled FROM i GROUP BY image_id""")
def r5_hull_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = views.points(spark, sf_dir).select("image_id", (F.col("x") * 7).alias("x"), (F.col("y") * 7).alias("y"))
    filled = R.inside_hull(views.pixels(spark, sf_dir).select("image_id", "y", "x"), R.hulls(corners))
    return filled.groupBy("image_id").agg(F.count(F.lit(1)).alias("filled"))


_FLAWED = """fl AS (SELECT image_id, line, k, CASE WHEN image_id % 17 = 2 AND k = 3 THEN NULL WHEN image_id % 17 = 4 AND k = 2 THEN x + 2 WHEN image_id % 17 = 9 AND k = 3 THEN first_value(x) OVER w ELSE x END AS x,
  CASE WHEN image_id % 17 = 9 AND k = 3 THEN first_value(y) OVER w ELSE y END AS y, CASE WHEN image_id % 17 = 7 AND k = 1 THEN 1.5 WHEN image_id % 17 IN (8, 9) AND k = 1 THEN 0.5 ELSE 0.95 END AS confidence,
  CASE image_id % 17 WHEN 5 THEN NULL WHEN 6 THEN 3.9 ELSE 120 END AS palm_width FROM points WHERE NOT (image_id % 17 = 3 AND k = 5)
  WINDOW w AS (PARTITION BY image_id, line ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))"""


@query("points", sql=f"""WITH {_FLAWED},
ln AS (SELECT image_id, line, count(*) AS n, bool_and(x IS NOT NULL AND y IS NOT NULL) AS numbers, bool_and(x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) AS inside, max(palm_width) AS palm, bool_and(confidence BETWEEN 0 AND 1) AS rated,
  min(confidence) AS least, list(x * 639 ORDER BY k) AS px, list(y * 479 ORDER BY k) AS py FROM fl GROUP BY ALL),
dd AS (SELECT *, [px[i + 1] - px[i] FOR i IN range(1, 6)] AS dx, [py[i + 1] - py[i] FOR i IN range(1, 6)] AS dy FROM ln),
ss AS (SELECT *, [sqrt(dx[i] ** 2 + dy[i] ** 2) FOR i IN range(1, 6)] AS s FROM dd),
tt AS (SELECT *, list_max([degrees(acos(least(greatest((dx[i] * dx[i + 1] + dy[i] * dy[i + 1]) / nullif(s[i] * s[i + 1], 0), -1), 1))) FOR i IN range(1, 5)]) AS turn FROM ss),
ij AS (SELECT * FROM (VALUES (1, 3), (1, 4), (1, 5), (2, 4), (2, 5), (3, 5)) v(i, j)),
cc AS (SELECT DISTINCT image_id, line, TRUE AS crossed FROM tt, ij WHERE n = 6 AND numbers
  AND (dx[i] * (py[j] - py[i]) - dy[i] * (px[j] - px[i])) * (dx[i] * (py[j + 1] - py[i]) - dy[i] * (px[j + 1] - px[i])) < -1e-10
  AND (dx[j] * (py[i] - py[j]) - dy[j] * (px[i] - px[j])) * (dx[j] * (py[i + 1] - py[j]) - dy[j] * (px[i + 1] - px[j])) < -1e-10)
SELECT image_id, line, CASE WHEN NOT numbers THEN 'invalid_keypoints' WHEN n <> 6 THEN 'missing_keypoints' WHEN NOT inside THEN 'out_of_bounds' WHEN palm IS NULL OR palm < 4 THEN 'invalid_palm_reference' WHEN NOT rated THEN 'invalid_confidence'
  WHEN list_min(s) < greatest(0.25, palm * 0.002) THEN concat_ws(',', CASE WHEN least < 0.9 THEN 'low_keypoint_confidence' END, 'duplicate_or_collapsed_keypoints')
  ELSE concat_ws(',', CASE WHEN least < 0.9 THEN 'low_keypoint_confidence' END, CASE WHEN turn > 135 THEN 'keypoint_order_or_sharp_turn' END, CASE WHEN crossed THEN 'keypoint_self_intersection' END) END AS reasons
FROM tt LEFT JOIN cc USING (image_id, line)""")
def r1_validity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, over points a third of which are made to break one or two."""
    flaw, k = F.col("image_id") % 17, F.col("k")
    before = Window.partitionBy("image_id", "line").orderBy("k")
    own = lambda c: F.when((flaw == 9) & (k == 3), F.lag(c).over(before)).otherwise(F.col(c))
    points = views.points(spark, sf_dir).select(
        "image_id", "line", "k", F.when((flaw == 2) & (k == 3), None).when((flaw == 4) & (k == 2), F.col("x") + 2).otherwise(own("x")).alias("x"), own("y").alias("y"),
        F.when((flaw == 7) & (k == 1), 1.5).when(flaw.isin(8, 9) & (k == 1), 0.5).otherwise(0.95).alias("confidence"), F.when(flaw == 5, None).when(flaw == 6, 3.9).otherwise(120.0).alias("palm_width"),
    )
    found = K.validity(points.where(~((flaw == 3) & (k == 5))), 640, 480)
    return found.select("image_id", "line", F.array_join("reasons", ",").alias("reasons"))
