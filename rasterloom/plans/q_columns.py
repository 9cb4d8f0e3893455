"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from . import views
from .registry import query

SAFE = r"""CASE WHEN NOT (replace(name, '\', '/') LIKE '/%' OR regexp_matches(replace(name, '\', '/'), '^[A-Za-z]:') OR list_contains(string_split(replace(name, '\', '/'), '/'), '..'))
  THEN nullif(array_to_string([p FOR p IN string_split(replace(name, '\', '/'), '/') IF p NOT IN ('', '.')], '/'), '') END"""


@query("members", sql=f"SELECT ordinal, {SAFE} AS safe_path FROM members")
def p1_safe_member_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.members(spark, sf_dir).select("ordinal", C.safe_member_path(F.col("name")).alias("safe_path"))


@query("members", sql=r"""SELECT ordinal, coalesce(nullif(left(regexp_replace(regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 24), ''), 'item') AS token FROM members""")
def p2_safe_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.members(spark, sf_dir).select("ordinal", C.safe_token(F.col("name"), 24, "item").alias("token"))


@query("files", sql=r"""SELECT doc_id, source_group || '__' || doc_id || '_' || lpad(doc_id::VARCHAR, 6, '0') || '.png' AS name, doc_id || '_' || left(md5(path), 8) AS md5_name, doc_id || '_' || left(sha256(path), 16) AS sha_name FROM files""")
def p3_output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, stem = F.col("path"), C.stem(F.col("path"))
    return views.files(spark, sf_dir).select(
        "doc_id", C.output_name(path, F.col("doc_id")).alias("name"),
        F.concat(stem, F.lit("_"), F.substring(F.md5(path), 1, 8)).alias("md5_name"), F.concat(stem, F.lit("_"), F.substring(F.sha2(path, 256), 1, 16)).alias("sha_name"),
    )


@query("files", sql="""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source_group || '/x.png' WHEN 1 THEN NULL WHEN 2 THEN 'x.png' ELSE source_group || '/y/x.png' END AS path FROM files""")
def p4_normalised_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    group, kind = F.col("source_group"), F.col("doc_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("./"), group, F.lit("\\.\\x.png"))).when(kind == 1, F.concat(group, F.lit("/../../x.png")))
        .when(kind == 2, F.concat(group, F.lit("/../x.png"))).otherwise(F.concat(group, F.lit("//y/z/../x.png")))
    )
    return views.files(spark, sf_dir).select("doc_id", C.normalised_path(raw).alias("path"))


@query("files", sql="SELECT doc_id, '.png' AS suffix, doc_id::VARCHAR AS stem, source_group AS parent FROM files")
def p5_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.regexp_replace("path", "png$", ""), F.lit("PNG"))
    return views.files(spark, sf_dir).select("doc_id", C.suffix(path).alias("suffix"), C.stem(path).alias("stem"), C.parent(path).alias("parent"))


@query("files", sql="""SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1024 ** 2 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1024 ** 3 THEN printf('%.1f MB', n / 1024.0 ** 2)
  WHEN n < 1024 ** 4 THEN printf('%.1f GB', n / 1024.0 ** 3) ELSE printf('%.1f TB', n / 1024.0 ** 4) END AS size FROM (SELECT doc_id, length * (1::BIGINT << (10 * (doc_id % 4))::INT) AS n FROM files)""")
def p6_human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr("length * shiftleft(1L, cast(10 * (doc_id % 4) AS int))")
    return views.files(spark, sf_dir).select("doc_id", C.human_bytes(n).alias("size"))


@query("files", sql="SELECT doc_id, round(least(greatest((length - 100) / 4900.0, 0), 1), 6)::DOUBLE AS score, 0::DOUBLE AS empty FROM files")
def p7_clamp_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("length")
    return views.files(spark, sf_dir).select("doc_id", F.round(C.normal(n, 100, 5000), 6).alias("score"), C.normal(n, 5, 5).alias("empty"))


#: Measures of an image, made up from a file's length and digest, in both languages.
MEASURES_SQL = """m AS (SELECT doc_id, (length * 7 % 2560) / 10.0::DOUBLE AS mean, (length * 11 % 800) / 10.0::DOUBLE AS contrast, (length * 13 % 4000) / 10.0::DOUBLE AS laplacian,
  (length * 17 % 2048)::DOUBLE AS short_side, (length * 19 % 300) / 1000.0::DOUBLE AS hi_ratio, (length * 23 % 150) / 1000.0::DOUBLE AS edge_density, (length * 29 % 1000) / 1000.0::DOUBLE AS detection FROM files)"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("length")
    part = lambda k, m, d: ((n * k % m) / float(d)).cast("double")
    return views.files(spark, sf_dir).select(
        "doc_id", part(7, 2560, 10).alias("mean"), part(11, 800, 10).alias("contrast"), part(13, 4000, 10).alias("laplacian"), part(17, 2048, 1).alias("short_side"),
        part(19, 300, 1000).alias("hi_ratio"), part(23, 150, 1000).alias("edge_density"), part(29, 1000, 1000).alias("detection"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = C.quality_scores(1024)
    rows = measures(spark, sf_dir).select("doc_id", "mean", "short_side", "hi_ratio", *[s.alias("contrast_score" if k == "contrast" else k) for k, s in scores.items()])
    return rows.withColumn("contrast", F.col("contrast_score"))


_N = lambda x, lo, hi: f"least(greatest(({x} - {lo}) / ({hi} - {lo}), 0), 1)"
SCORED_SQL = f"""{MEASURES_SQL}, q0 AS (SELECT doc_id, mean, short_side, hi_ratio, detection, 1 - least(abs(mean - 135) / 110, 1) AS brightness, {_N('laplacian', '45::DOUBLE', '260')} AS blur,
  {_N('contrast', '20::DOUBLE', '65')} AS contrast_score, {_N('short_side', '665.6::DOUBLE', '1024')} AS resolution, 1 - {_N('hi_ratio', '0.03::DOUBLE', '0.25::DOUBLE')} AS glare, {_N('edge_density', '0.015::DOUBLE', '0.12::DOUBLE')} AS edge FROM m),
q AS (SELECT *, least(greatest(0.0::DOUBLE + 0.2::DOUBLE * brightness + 0.25::DOUBLE * blur + 0.2::DOUBLE * contrast_score + 0.15::DOUBLE * resolution + 0.1::DOUBLE * glare + 0.1::DOUBLE * detection, 0), 1) AS image_quality,
  least(greatest(0.45::DOUBLE * contrast_score + 0.35::DOUBLE * edge + 0.2::DOUBLE * blur, 0), 1) AS line_visibility FROM q0)"""


@query("files", sql=f"WITH {SCORED_SQL} SELECT doc_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("brightness", "blur", "resolution", "glare", "edge", "image_quality", "line_visibility")) + " FROM q")
def p9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("brightness", "blur", "resolution", "glare", "edge", "image_quality", "line_visibility")
    return scored(spark, sf_dir).select("doc_id", *[F.round(c, 6).alias(c) for c in names])


_BLAMED = " ".join(
    f"WHEN list_min([image_quality, brightness, blur, contrast_score, resolution, glare, detection, line_visibility]) = {c} THEN {r}"
    for c, r in (
        ("image_quality", "'LOW_LINE_CONTRAST'"), ("brightness", "CASE WHEN mean < 135 THEN 'TOO_DARK' ELSE 'TOO_BRIGHT' END"), ("blur", "'BLURRY_IMAGE'"), ("contrast_score", "'LOW_LINE_CONTRAST'"),
        ("resolution", "'LOW_RESOLUTION'"), ("glare", "'GLARE_REFLECTION'"), ("detection", "'NO_HAND_FOUND'"), ("line_visibility", "'LOW_LINE_CONTRAST'"),
    )
)
REASON_SQL = f"""{SCORED_SQL}, r AS (SELECT doc_id, image_quality, detection, short_side, blur, CASE WHEN detection < 0.25 THEN 'NO_HAND_FOUND' WHEN short_side < 665.6 THEN 'LOW_RESOLUTION' WHEN blur < 0.35 THEN 'BLURRY_IMAGE' WHEN mean < 65 THEN 'TOO_DARK'
  WHEN mean > 215 OR hi_ratio > 0.22 THEN 'TOO_BRIGHT' WHEN contrast_score < 0.35 OR line_visibility < 0.35 THEN 'LOW_LINE_CONTRAST' WHEN image_quality < 0.55 THEN CASE {_BLAMED} END ELSE 'OK' END AS reason FROM q)"""


@query("files", sql=f"WITH {REASON_SQL} SELECT doc_id, reason FROM r")
def p10_quality_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", C.quality_reason(1024).alias("reason"))


#: Advice by reason: our own wording.
ADVICE = (
    ("OK", "Usable", "None"), ("NO_HAND_FOUND", "No hand in view", "Show the open palm"), ("LOW_RESOLUTION", "Too few pixels", "Move closer"), ("BLURRY_IMAGE", "Not in focus", "Hold still"),
    ("TOO_DARK", "Under-exposed", "Add light"), ("TOO_BRIGHT", "Over-exposed", "Soften the light"), ("LOW_LINE_CONTRAST", "Lines are faint", "Light from the side"), ("GLARE_REFLECTION", "Reflections", "Turn the hand"),
)


@query("files", sql=f"WITH {REASON_SQL}, a(reason, why, fix) AS (VALUES {', '.join(str(x) for x in ADVICE)}) SELECT doc_id, reason, why, fix FROM r LEFT JOIN a USING (reason)")
def p11_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    advice = spark.createDataFrame(list(ADVICE), "reason string, why string, fix string")  # eight fixed rows
    rows = scored(spark, sf_dir).select("doc_id", C.quality_reason(1024).alias("reason"))
    return rows.join(F.broadcast(advice), "reason", "left").select("doc_id", "reason", "why", "fix")


@query("files", sql=f"""WITH {REASON_SQL}, c AS (SELECT r.*, row_number() OVER (PARTITION BY sha256 ORDER BY path) > 1 AS again, length FROM r JOIN files USING (doc_id))
SELECT doc_id, CASE WHEN again THEN 'exact_duplicate' WHEN length % 97 = 0 THEN 'bad_read' WHEN short_side < 400 THEN 'too_small' WHEN blur < 0.15 THEN 'too_blurry' WHEN image_quality < 0.65 OR detection < 0.35 THEN lower(reason)
  WHEN length % 10 < 2 THEN 'mask_quality' ELSE '' END AS reject_reason FROM c""")
def p12_ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import manifests as M

    files = M.mark_duplicates(views.files(spark, sf_dir), "sha256", "path").select("doc_id", "length", F.col("original").isNotNull().alias("again"))
    rows = scored(spark, sf_dir).withColumn("reason", C.quality_reason(1024)).join(files, "doc_id")
    gate = M.ingest_gate(F.col("again"), F.col("length") % 97 == 0, F.col("short_side") < 400, F.col("blur") < 0.15, (F.col("image_quality") < 0.65) | (F.col("detection") < 0.35), F.col("reason"), F.col("length") % 10 < 2)
    return rows.select("doc_id", gate.alias("reject_reason"))


@query("files", sql="SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 6 ELSE 0 END::INT AS class_id FROM files")
def p15_class_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("  Life-Line ", "HEAD  line", "heartline", "fate-line", "single_transverse_palmar_crease", "elbow")])
    return views.files(spark, sf_dir).select("doc_id", C.class_of(names[(F.col("doc_id") % 6).cast("int")]).alias("class_id"))


_TAIL = "[embedding[i]::DOUBLE * 2 FOR i IN range(1, 8 + vec_id % 3)]"


@query(sql=f"""WITH t AS (SELECT vec_id, {_TAIL} AS t FROM embeddings),
p AS (SELECT vec_id, CASE WHEN len(t) % 3 = 0 THEN [{{'x': t[3 * i + 1], 'y': t[3 * i + 2], 'v': t[3 * i + 3]}} FOR i IN range(len(t) // 3)]
  WHEN len(t) % 2 = 0 THEN [{{'x': t[2 * i + 1], 'y': t[2 * i + 2], 'v': 1::DOUBLE}} FOR i IN range(len(t) // 2)] END AS ps FROM t)
SELECT vec_id, coalesce(array_to_string([round_even(p.x * 640, 0)::INT || ',' || round_even(p.y * 480, 0)::INT FOR p IN ps IF p.v > 0 AND p.x BETWEEN 0 AND 1 AND p.y BETWEEN 0 AND 1], ' '), 'none') AS points FROM p""")
def p16_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.expr("transform(sequence(1, cast(7 + vec_id % 3 AS int)), i -> cast(embedding[i - 1] AS double) * 2)")
    found = C.keypoints(tail, F.lit(640), F.lit(480))
    text = F.array_join(F.transform(found, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(text, F.lit("none")).alias("points"))


@query(sql="""WITH b AS (SELECT vec_id, round_even((embedding[1]::DOUBLE + 1) / 2 * 640, 0)::INT AS cx, round_even((embedding[2]::DOUBLE + 1) / 2 * 480, 0)::INT AS cy,
  greatest(round_even(abs(embedding[3]::DOUBLE) * 640, 0)::INT, 2) AS w, greatest(round_even(abs(embedding[4]::DOUBLE) * 480, 0)::INT, 2) AS h FROM embeddings)
SELECT vec_id, CASE WHEN w >= h THEN greatest(cx - w // 2, 0) ELSE cx END::INT AS x1, CASE WHEN w >= h THEN cy ELSE greatest(cy - h // 2, 0) END::INT AS y1,
  CASE WHEN w >= h THEN least(cx + w // 2, 639) ELSE cx END::INT AS x2, CASE WHEN w >= h THEN cy ELSE least(cy + h // 2, 479) END::INT AS y2 FROM b""")
def p17_box_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    line = C.box_line((e(0) + 1) / 2, (e(1) + 1) / 2, F.abs(e(2)), F.abs(e(3)), F.lit(640), F.lit(480))
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", line.alias("l"))
    return rows.select("vec_id", F.col("l")[0]["x"].alias("x1"), F.col("l")[0]["y"].alias("y1"), F.col("l")[1]["x"].alias("x2"), F.col("l")[1]["y"].alias("y2"))


@query("points", sql="SELECT image_id, line, k, least(greatest(round_even(x * 640 * 512 / 640, 0)::INT, 0), 511)::INT AS cx, least(greatest(round_even(y * 480 * 512 / 480, 0)::INT, 0), 511)::INT AS cy FROM points")
def p18_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.points(spark, sf_dir).select("image_id", "line", "k", C.rescale(F.col("x") * 640, F.lit(640), 512).alias("cx"), C.rescale(F.col("y") * 480, F.lit(480), 512).alias("cy"))


@query("files", sql="SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'train' ELSE 'val' END AS split FROM files")
def p19_split_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.array(*[F.lit(x) for x in ("Valid", "test", "tested", "a/val/test")])[(F.col("doc_id") % 4).cast("int")]
    return views.files(spark, sf_dir).select("doc_id", C.split_of_path(F.concat_ws("/", folder, "path")).alias("split"))


@query("points", sql="""WITH s AS (SELECT *, 64 + image_id % 200 AS w, 64 + image_id % 130 AS h FROM points), l AS (SELECT *, least(128.0 / w, 128.0 / h)::DOUBLE AS scale FROM s),
d AS (SELECT *, (128 - w * scale) / 2 AS dx, (128 - h * scale) / 2 AS dy FROM l)
SELECT image_id, line, k, round(x * w * scale + dx, 6) AS mx, round(y * h * scale + dy, 6) AS my, TRUE AS round_trip FROM d""")
def p20_letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = 64 + F.col("image_id") % 200, 64 + F.col("image_id") % 130
    rows = views.points(spark, sf_dir).withColumn("b", C.letterbox(w, h, 128))
    mx, my = F.col("x") * w * F.col("b.scale") + F.col("b.dx"), F.col("y") * h * F.col("b.scale") + F.col("b.dy")
    back = (F.abs((mx - F.col("b.dx")) / F.col("b.scale") / w - F.col("x")) < 1e-9) & (F.abs((my - F.col("b.dy")) / F.col("b.scale") / h - F.col("y")) < 1e-9)
    return rows.select("image_id", "line", "k", F.round(mx, 6).alias("mx"), F.round(my, 6).alias("my"), back.alias("round_trip"))


@query("manifest", sql="SELECT doc_id, CASE WHEN score >= 0.55 THEN 'long' WHEN score >= 0.30 THEN 'medium' ELSE 'short' END AS bucket, 'line ' || doc_id || ': ' || printf('%.3f', score) AS line FROM manifest")
def p21_length_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.manifest(spark, sf_dir).select("doc_id", C.length_bucket(F.col("score")).alias("bucket"), F.format_string("line %d: %.3f", "doc_id", "score").alias("line"))


@query("points", sql="""WITH a AS (SELECT image_id, line, any_value(status) AS status, list({'x': px * 1.3, 'y': py * 1.3} ORDER BY k) AS ps FROM points GROUP BY image_id, line)
SELECT image_id, line, array_to_string([r FOR r IN [CASE WHEN image_id % 11 = 0 THEN 'review_status' END, CASE WHEN image_id % 7 = 0 THEN 'too_many_points' END,
  CASE WHEN len([p FOR p IN ps IF p.x NOT BETWEEN 0 AND 1 OR p.y NOT BETWEEN 0 AND 1]) > 0 THEN 'point_outside' END, CASE WHEN status = 'absent' THEN 'absent_with_points' END,
  CASE WHEN image_id % 5 = 0 THEN 'handedness' END] IF r IS NOT NULL], ',') AS violations FROM a""")
def p22_annotation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct("k", (F.col("px") * 1.3).alias("x"), (F.col("py") * 1.3).alias("y"))
    rows = views.points(spark, sf_dir).groupBy("image_id", "line").agg(F.first("status").alias("status"), F.sort_array(F.collect_list(point)).alias("ps"))
    ps = F.when(F.col("image_id") % 7 == 0, F.concat("ps", F.slice("ps", 1, 1))).otherwise(F.col("ps"))
    bad = C.annotation_violations(
        F.col("status"), ps, F.when(F.col("image_id") % 11 == 0, "maybe").otherwise("pending"), F.when(F.col("image_id") % 5 == 0, "both").otherwise("left"), F.lit("no"), F.slice("ps", 1, 0)
    )
    return rows.select("image_id", "line", F.array_join(bad, ",").alias("violations"))


@query("annotations", sql="""SELECT image_id, revision, 2 AS schema, revision + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS new_revision, CASE WHEN event_id % 2 = 0 THEN 'fate' ELSE '' END AS legacy, 'head,heart,life' AS lines,
  CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE 'left' END AS handedness FROM annotations""")
def p23_schema_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import annotations as A

    old = F.col("event_id") % 2 == 0
    lines = F.expr("map('life', status, 'head', status, 'heart', status)")
    rows = views.annotations(spark, sf_dir).select(
        "image_id", "revision", F.when(old, 1).otherwise(2).alias("schema"), F.when(old, F.map_concat(lines, F.create_map(F.lit("fate"), "status"))).otherwise(lines).alias("lines"),
        F.when(~old, "left").alias("handedness"), F.lit(None).cast("string").alias("mirrored"),
    )
    new = A.migrate(rows, ("life", "head", "heart"))
    return new.select(
        "image_id", F.col("old_revision").alias("revision"), "schema", F.col("revision").alias("new_revision"), F.array_join(F.map_keys("legacy_lines"), ",").alias("legacy"),
        F.array_join(F.array_sort(F.map_keys("lines")), ",").alias("lines"), "handedness",
    )


@query("manifest", sql="SELECT doc_id, 0 AS revision, 'pending' AS status, 3 AS n_lines, 'unreviewed' AS first_line FROM manifest")
def p24_default_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import annotations as A

    rows = views.manifest(spark, sf_dir).select("doc_id", A.empty_annotation(("life", "head", "heart")).alias("a"))
    return rows.select("doc_id", "a.revision", "a.status", F.size("a.lines").alias("n_lines"), F.col("a.lines")["life"]["status"].alias("first_line"))


@query("points", sql="""WITH c AS (SELECT image_id, line, count(*) - max(CASE WHEN (image_id + line) % 3 = 0 THEN 1 ELSE 0 END) AS n FROM points GROUP BY image_id, line)
SELECT image_id, string_agg(CASE WHEN n = 6 THEN 'present' ELSE 'unreviewed' END, ',' ORDER BY line) AS states, coalesce(min(line) FILTER (n < 6), -1)::INT AS first_open FROM c GROUP BY image_id""")
def p25_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.points(spark, sf_dir).groupBy("image_id", "line").agg((F.count(F.lit(1)) - F.when((F.col("image_id") + F.col("line")) % 3 == 0, 1).otherwise(0)).alias("n"))
    state = F.struct("line", F.when(F.col("n") == 6, "present").otherwise("unreviewed").alias("s"))
    return counts.groupBy("image_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(state)), lambda x: x["s"]), ",").alias("states"), F.coalesce(F.min(F.when(F.col("n") < 6, F.col("line"))), F.lit(-1)).alias("first_open")
    )


@query("files", sql="SELECT doc_id, CASE WHEN length % 400 - 200 <= -96 THEN 'left' WHEN length % 400 - 200 >= 96 THEN 'right' END AS side FROM files")
def p26_drag_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select("doc_id", C.side_of_drag(F.col("length") % 400 - 200).alias("side"))


@query(sql="""WITH w AS (SELECT vec_id, [(embedding[i]::DOUBLE + 1) / 2 FOR i IN range(61, 65)] AS e FROM embeddings)
SELECT vec_id, CASE WHEN d >= 4 THEN round(d, 6) END AS width FROM (SELECT vec_id, sqrt(((e[3] - e[1]) * 639) ** 2 + ((e[4] - e[2]) * 479) ** 2) AS d FROM w)""")
def p27_reference_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: (F.col("embedding")[i].cast("double") + 1) / 2
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.round(C.reference_width(e(60), e(61), e(62), e(63), 640, 480), 6).alias("width"))


@query("files", sql="SELECT doc_id, length FROM files")
def p28_parameter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("length")
    return views.files(spark, sf_dir).select("doc_id", C.checked(n, (n >= 0) & (n < 1 << 40), "length out of range").alias("length"))


@query("points", sql="""WITH t AS (SELECT image_id, line, any_value(status) AS s, list(x ORDER BY k) AS xs, list(y ORDER BY k) AS ys FROM points GROUP BY image_id, line)
SELECT image_id, round(sum(CASE WHEN s = 'present' THEN list_sum(xs) + list_sum(ys) ELSE 0 END), 6) AS target_sum, sum(CASE WHEN s = 'present' THEN 12 ELSE 0 END)::BIGINT AS visible,
  sum(CASE WHEN s <> 'unreviewed' THEN 1 ELSE 0 END)::BIGINT AS known FROM t GROUP BY image_id""")
def p29_targets_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import keypoints as K

    rows = K.targets(views.points(spark, sf_dir))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rows.select("image_id", F.round(add("coords"), 6).alias("target_sum"), add(F.transform("mask", lambda m: m.cast("double"))).cast("long").alias("visible"), add(F.transform("known", lambda m: m.cast("double"))).cast("long").alias("known"))


@query(sql="SELECT event_id, CASE WHEN event_id % 4 < 2 THEN round(value, 6) END AS number FROM events")
def p30_finite_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 2, "Infinity").when(F.col("event_id") % 4 == 3, "n/a").otherwise(F.col("value").cast("string"))
    return views.table(spark, sf_dir, "events").select("event_id", F.round(C.finite(raw), 6).alias("number"))


@query("files", sql=f"""WITH {SCORED_SQL} SELECT doc_id, round(f, 6) AS final, doc_id % 5 <> 0 AND f >= 0.3 AND doc_id % 7 <> 0 AS accepted FROM (SELECT doc_id,
  least(image_quality, line_visibility, blur, glare, greatest(edge, 0.35), resolution) AS f FROM q)""")
def p31_final_line_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.final_line_score(*[F.col(c) for c in ("image_quality", "line_visibility", "blur", "glare", "edge", "resolution")])
    return scored(spark, sf_dir).select("doc_id", F.round(f, 6).alias("final"), ((F.col("doc_id") % 5 != 0) & (f >= 0.3) & (F.col("doc_id") % 7 != 0)).alias("accepted"))


@query("points", sql="""WITH l AS (SELECT image_id, line, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM points WHERE status <> 'absent' GROUP BY image_id, line), i AS (SELECT DISTINCT image_id FROM points)
SELECT image_id, """ + ", ".join(f"round(coalesce(max({c}) FILTER (line = {k}), 0), 6)::DOUBLE AS {c}{k}" for k in range(3) for c in ("cx", "cy")) + " FROM i LEFT JOIN l USING (image_id) GROUP BY image_id")
def p32_metrics_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.points(spark, sf_dir)
    seen = rows.where("status <> 'absent'").groupBy("image_id").pivot("line", [0, 1, 2]).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    every = rows.select("image_id").distinct().join(seen, "image_id", "left")
    return every.select("image_id", *[F.round(F.coalesce(F.col(f"{k}_{c}"), F.lit(0.0)), 6).alias(f"{c}{k}") for k in range(3) for c in ("cx", "cy")])


@query("points", sql="""WITH d AS (SELECT DISTINCT image_id, line, status = 'present' OR image_id % 4 = 0 AS found FROM points),
x AS (SELECT *, bool_or(found AND line = 0) OVER w AND bool_or(found AND line > 0) OVER w AS clash FROM d WINDOW w AS (PARTITION BY image_id))
SELECT image_id, line, found AND NOT clash AS found, CASE WHEN found AND clash THEN 'ambiguous' ELSE '' END AS reason FROM x""")
def p33_mutual_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import keypoints as K

    rows = views.points(spark, sf_dir).select("image_id", "line", ((F.col("status") == "present") | (F.col("image_id") % 4 == 0)).alias("found")).distinct()
    return K.exclude_together(rows, F.col("line") == 0, F.col("line") > 0, "ambiguous")


@query(sql="""WITH e AS (SELECT vec_id, 1.2 + embedding[1]::DOUBLE AS l, 1.2 + embedding[2]::DOUBLE AS r, vec_id % 3 AS m FROM embeddings),
t AS (SELECT *, CASE WHEN greatest(l, r) < 1.35 OR abs(l - r) < 0.30 THEN 'unknown' WHEN l > r THEN 'left' ELSE 'right' END AS thumb FROM e)
SELECT vec_id, thumb, CASE WHEN thumb = 'unknown' OR m = 0 THEN 'unknown' WHEN (thumb = 'left') = (m = 1) THEN 'right' ELSE 'left' END AS side FROM t""")
def p34_handedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import keypoints as K

    e = lambda i: 1.2 + F.col("embedding")[i].cast("double")
    mirrored = F.when(F.col("vec_id") % 3 == 1, False).when(F.col("vec_id") % 3 == 2, True)
    thumb, side = K.handedness(e(0), e(1), mirrored)
    return views.table(spark, sf_dir, "embeddings").select("vec_id", thumb.alias("thumb"), side.alias("side"))


@query("points", sql="""WITH l AS (SELECT image_id, line, any_value(presence) AS p, min(exp(-abs(px - x) / 0.05)) AS conf FROM points GROUP BY image_id, line),
r AS (SELECT *, line < 2 AS supported, CASE WHEN p <= 0.4 AND line < 2 THEN 'absent' WHEN conf * p >= 0.2 AND line < 2 THEN 'present' ELSE 'review' END AS state FROM l)
SELECT image_id, line, state, CASE WHEN state = 'absent' THEN '' ELSE concat_ws(',', CASE WHEN conf * p < 0.2 THEN 'low_confidence' END, CASE WHEN NOT supported THEN 'no_support' END) END AS reasons,
  bool_or(state = 'review') OVER (PARTITION BY image_id) AS needs_review FROM r""")
def p35_prediction_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import keypoints as K

    conf = F.exp(-F.abs(F.col("px") - F.col("x")) / 0.05)
    rows = views.points(spark, sf_dir).groupBy("image_id", "line").agg(F.first("presence").alias("presence"), F.min(conf).alias("confidence"))
    out = K.route_lines(rows.withColumn("supported", F.col("line") < 2), absent_at=0.4, confident_at=0.2)
    return out.select("image_id", "line", "state", F.array_join("reasons", ",").alias("reasons"), "needs_review")


@query(sql="""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'deep' || event_id WHEN event_id % 3 = 1 THEN 'top' || event_id END AS found FROM events""")
def p36_recursive_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import annotations as A

    n = F.col("event_id").cast("string")
    doc = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a":{"b":[1,{"error":""},{"detail":"deep'), n, F.lit('"}]}}')))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"error":"top'), n, F.lit('","x":{"detail":"no"}}'))).otherwise(F.lit('{"a":[1,2,{"c":"d"}]}'))
    )
    return views.table(spark, sf_dir, "events").select("event_id", A.first_text_under(doc, ("error", "detail", "message")).alias("found"))


@query("pixels", sql="""WITH pal(class_id, r) AS (VALUES (1, 60), (2, 255), (3, 0), (4, 128), (5, 200), (6, 30))
SELECT image_id, pos, CASE WHEN r IS NULL THEN v ELSE floor(v * 0.55 + r * 0.45)::INT END::INT AS v FROM pixels LEFT JOIN pal USING (class_id)""")
def p37_palette_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pixels as X

    palette = spark.createDataFrame([(1, 60), (2, 255), (3, 0), (4, 128), (5, 200), (6, 30)], "class_id int, colour int")
    return X.blend(views.pixels(spark, sf_dir), palette, 0.45).select("image_id", "pos", "v")


_SKIN = """WITH c AS (SELECT image_id, pos, v::DOUBLE AS r, (v * 3 % 256)::DOUBLE AS g, (v * 5 % 256)::DOUBLE AS b FROM pixels),
k AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS y, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM c),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = r THEN ((60 * (g - b) / d) % 360 + 360) % 360 WHEN hi = g THEN 60 * (b - r) / d + 120 ELSE 60 * (r - g) / d + 240 END / 2 AS hue,
  CASE WHEN hi = 0 THEN 0 ELSE 255 * d / hi END AS sat FROM k)"""


@query("pixels", sql=f"{_SKIN} SELECT image_id, sum(CASE WHEN ((r - y) * 0.713 + 128 BETWEEN 133 AND 180 AND (b - y) * 0.564 + 128 BETWEEN 77 AND 135) OR (hue BETWEEN 0 AND 35 AND sat >= 15 AND hi >= 40) THEN 1 ELSE 0 END)::BIGINT AS skin FROM h GROUP BY image_id")
def p38_skin_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    skin = C.is_skin(v.cast("double"), (v * 3 % 256).cast("double"), (v * 5 % 256).cast("double"))
    return views.pixels(spark, sf_dir).groupBy("image_id").agg(F.sum(skin.cast("long")).alias("skin"))


@query(sql=f"""WITH b AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS a, abs(embedding[2]::DOUBLE) * 2 AS bx, 0.75 + embedding[3]::DOUBLE AS asp, vec_id % 2 = 0 AS ins FROM embeddings)
SELECT vec_id, round(least(greatest(0.45 * {_N('a', '0.05::DOUBLE', '0.45::DOUBLE')} + 0.25 * {_N('bx', '0.12::DOUBLE', '0.75::DOUBLE')} + 0.15 * (1 - least(abs(asp - 0.75), 0.75) / 0.75) + 0.15 * CASE WHEN ins THEN 1 ELSE 0.5 END, 0), 1), 6) AS score FROM b""")
def p39_skin_box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    score = C.skin_box_score(F.abs(e(0)), F.abs(e(1)) * 2, 0.75 + e(2), F.col("vec_id") % 2 == 0)
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


@query("pixels", sql="""WITH f AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pixels WHERE v > 150 GROUP BY image_id),
i AS (SELECT DISTINCT image_id FROM pixels),
b AS (SELECT image_id, CASE WHEN x0 IS NULL THEN 'center' ELSE 'box' END AS method, greatest(0, coalesce(x0 - floor(0.12 * (x1 - x0 + 1))::INT, 0)) AS bx0, greatest(0, coalesce(y0 - floor(0.12 * (y1 - y0 + 1))::INT, 0)) AS by0,
  least(8, coalesce(x1 + 1 + floor(0.12 * (x1 - x0 + 1))::INT, 8)) AS bx1, least(8, coalesce(y1 + 1 + floor(0.12 * (y1 - y0 + 1))::INT, 8)) AS by1 FROM i LEFT JOIN f USING (image_id))
SELECT image_id, method, count(*) AS n, sum(v)::BIGINT AS total, max(x - bx0)::INT AS last_x FROM pixels JOIN b USING (image_id) WHERE x >= greatest(0, bx0) AND x < bx1 AND y >= by0 AND y < by1 GROUP BY image_id, method""")
def p40_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pixels as X

    out = X.crop_to(views.pixels(spark, sf_dir), F.col("v") > 150, 8, 8, 0.12)
    return out.groupBy("image_id", "method").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("x").alias("last_x"))


@query("manifest", sql="SELECT doc_id FROM manifest WHERE review_status = 'approved' AND doc_id % 3 = 1")
def p41_split_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.manifest(spark, sf_dir).where((F.col("review_status") == "approved") & (F.col("doc_id") % 3 == 1)).select("doc_id")


@query("manifest", sql="SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source_group WHEN subject_id IS NOT NULL THEN 'subject:' || subject_id ELSE 'img' END AS source_group FROM manifest")
def p42_source_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("doc_id") % 2 == 0, F.col("source_group")).otherwise("")
    return views.manifest(spark, sf_dir).select("doc_id", C.source_group(group, F.col("subject_id"), F.col("image_path")).alias("source_group"))
