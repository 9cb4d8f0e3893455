"""Queries of joins, set operations and top-k (J*, U*, T*, S8, S15, S21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import manifests as M
from . import views
from .registry import query


@query("files", sql="SELECT path, sha256, length, nullif(min(path) OVER (PARTITION BY sha256), path) AS original FROM files")
def s8_directory_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mark_duplicates(views.files(spark, sf_dir), "sha256", "path").select("path", "sha256", "length", "original")


@query("files", sql="SELECT path, sha256 FROM files")
def s9_file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select("path", "sha256")


@query("manifest", sql="SELECT image_path, coalesce(r_status, review_status) AS review_status, score FROM manifest JOIN (SELECT image_path, CASE WHEN doc_id % 4 = 0 THEN 'checked' END AS r_status FROM manifest WHERE review_status = 'approved') USING (image_path)")
def j1_review_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.manifest(spark, sf_dir)
    review = rows.where("review_status = 'approved'").select("image_path", F.when(F.col("doc_id") % 4 == 0, "checked").alias("r_status"))
    return rows.join(review, "image_path").select("image_path", F.coalesce("r_status", "review_status").alias("review_status"), "score")


@query("manifest", "files", sql="""WITH q AS (SELECT doc_id, image_path, CASE WHEN doc_id % 3 = 0 THEN 'given/' || doc_id END AS source_path FROM manifest)
SELECT image_path, coalesce(q.source_path, f.path) AS source_path, coalesce(q.source_path, f.path) IS NULL AS unmatched FROM q LEFT JOIN files f ON f.doc_id = q.doc_id AND f.doc_id % 7 <> 1""")
def j2_fill_source_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = views.manifest(spark, sf_dir).select("doc_id", "image_path", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("given/"), F.col("doc_id").cast("string"))).alias("source_path"))
    source = views.files(spark, sf_dir).where("doc_id % 7 <> 1").select("doc_id", "path")
    out = queue.join(source, "doc_id", "left").withColumn("source_path", F.coalesce("source_path", "path"))
    return out.select("image_path", "source_path", F.col("source_path").isNull().alias("unmatched"))


@query("manifest", sql="""WITH r AS (SELECT CASE WHEN doc_id % 50 = 3 THEN 'img/none' || doc_id ELSE image_path END AS image_path FROM manifest UNION ALL SELECT image_path FROM manifest WHERE doc_id % 40 = 1)
SELECT image_path, 'missing' AS problem, count(*) AS n FROM r WHERE image_path NOT IN (SELECT image_path FROM manifest) GROUP BY image_path
UNION ALL SELECT image_path, 'repeated', count(*) FROM r GROUP BY image_path HAVING count(*) > 1""")
def j3_referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.manifest(spark, sf_dir)
    path = F.when(F.col("doc_id") % 50 == 3, F.concat(F.lit("img/none"), F.col("doc_id").cast("string"))).otherwise(F.col("image_path"))
    review = rows.select(path.alias("image_path")).unionByName(rows.where("doc_id % 40 = 1").select("image_path"))
    missing = review.join(rows, "image_path", "left_anti").groupBy("image_path").agg(F.lit("missing").alias("problem"), F.count(F.lit(1)).alias("n"))
    return missing.unionByName(M.duplicate_keys(review, "image_path").select("image_path", F.lit("repeated").alias("problem"), "n"))


@query("files", sql="""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source_group || '/' || doc_id || '.txt' WHEN doc_id % 3 = 1 THEN 'labels/' || doc_id || '.txt' END AS matched FROM files""")
def j4_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.files(spark, sf_dir).select("doc_id", "source_group", F.regexp_replace("path", r"\.png$", ".txt").alias("label"))
    flat = F.concat(F.lit("labels/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    known = files.where("doc_id % 3 = 0").select(F.col("label").alias("p")).unionByName(files.where("doc_id % 3 < 2").select(flat.alias("p")))
    return M.first_match(files.select("doc_id", "label"), F.array("label", flat), known, "p").select("doc_id", "matched")


@query("manifest", sql="SELECT doc_id FROM manifest WHERE review_status <> 'approved' AND doc_id % 9 <> 0")
def j5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.manifest(spark, sf_dir).select("doc_id", "review_status", "image_path")
    approved, excluded = rows.where("review_status = 'approved'"), rows.where("doc_id % 9 = 0")
    return rows.join(approved, "image_path", "left_anti").join(excluded, "image_path", "left_anti").select("doc_id")


@query("files", sql="SELECT doc_id FROM files WHERE doc_id % 4 <> 0 AND sha256 NOT IN (SELECT sha256 FROM files WHERE doc_id % 4 = 0)")
def j6_known_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.files(spark, sf_dir)
    known = files.where("doc_id % 4 = 0")
    return files.join(known, "path", "left_anti").join(known, "sha256", "left_anti").select("doc_id")


@query("manifest", sql="""WITH h AS (SELECT * FROM manifest WHERE doc_id % 10 = 0) SELECT doc_id, CASE WHEN subject_id IN (SELECT subject_id FROM h WHERE subject_id IS NOT NULL) THEN 'held_out_subject'
  WHEN source_group IN (SELECT source_group FROM h) THEN 'held_out_source' WHEN sha256 IN (SELECT sha256 FROM h) THEN 'held_out_content' END AS reason FROM manifest WHERE doc_id % 10 <> 0""")
def j7_hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.manifest(spark, sf_dir)
    keys = [("subject_id", "held_out_subject"), ("source_group", "held_out_source"), ("sha256", "held_out_content")]
    return M.hold_out_reason(rows.where("doc_id % 10 <> 0"), rows.where("doc_id % 10 = 0"), keys).select("doc_id", "reason")


@query("annotations", sql="""WITH b AS (SELECT DISTINCT image_id, 'pending' AS status, 'none' AS note FROM annotations),
c AS (SELECT image_id, arg_max(status, revision) AS status, arg_max(note, revision) AS note FROM annotations GROUP BY image_id HAVING image_id % 2 = 0)
SELECT image_id, coalesce(c.status, b.status) AS status, coalesce(c.note, b.note) AS note FROM b LEFT JOIN c USING (image_id)""")
def j10_metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.annotations(spark, sf_dir)
    base = log.select("image_id").distinct().select("image_id", F.lit("pending").alias("status"), F.lit("none").alias("note"))
    return A.upsert(base, A.latest(log.where("image_id % 2 = 0").select("image_id", "revision", "status", "note"), ["image_id"], F.col("revision")), "image_id", ["status", "note"])


@query("manifest", sql="SELECT m.doc_id, 'pending' AS review_status, concat_ws('; ', CASE WHEN m.doc_id % 2 = 0 THEN 'was ' || m.review_status END, CASE WHEN m.doc_id % 6 = 0 THEN 'noted' END) AS notes FROM manifest m")
def j11_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.manifest(spark, sf_dir)
    old = rows.where("doc_id % 2 = 0").select("doc_id", F.col("review_status").alias("old"), F.when(F.col("doc_id") % 6 == 0, "noted").alias("note"))
    notes = F.concat_ws("; ", F.concat(F.lit("was "), "old"), "note")
    return rows.join(old, "doc_id", "left").select("doc_id", F.lit("pending").alias("review_status"), notes.alias("notes"))


@query("pixels", sql="SELECT image_id, y, x, a.class_id AS target, b.pred_id AS pred FROM pixels a JOIN pixels b USING (image_id, y, x) WHERE b.pos % 5 <> 0")
def j12_aligned_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = views.pixels(spark, sf_dir)
    target, pred = pixels.select("image_id", "y", "x", F.col("class_id").alias("target")), pixels.where("pos % 5 <> 0").select("image_id", "y", "x", F.col("pred_id").alias("pred"))
    return target.join(pred, ["image_id", "y", "x"])


CLASS_NAMES = ((0, "background"), (1, "palm_area"), (2, "life_line"), (3, "head_line"), (4, "heart_line"), (5, "minor_line"), (6, "simian_line"))


@query("pixels", sql=f"WITH c(class_id, name) AS (VALUES {', '.join(map(str, CLASS_NAMES))}) SELECT name, count(*) AS n FROM pixels JOIN c USING (class_id) GROUP BY name")
def j17_class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(CLASS_NAMES), "class_id int, name string")  # one row a class
    counts = views.pixels(spark, sf_dir).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(names), "class_id").select("name", "n")


@query("manifest", "annotations", sql="""SELECT doc_id, a.status, a.status IS NULL AS missing FROM manifest LEFT JOIN (SELECT image_id, arg_max(status, revision) AS status FROM annotations WHERE image_id % 3 <> 0 GROUP BY image_id) a ON a.image_id = doc_id""")
def j18_annotation_of_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = A.latest(views.annotations(spark, sf_dir).where("image_id % 3 <> 0").select("image_id", "revision", "status"), ["image_id"], F.col("revision"))
    rows = views.manifest(spark, sf_dir).select("doc_id").join(last, F.col("doc_id") == F.col("image_id"), "left")
    return rows.select("doc_id", "status", F.col("status").isNull().alias("missing"))


@query("files", "manifest", sql="SELECT m.doc_id, m.sha256 AS stored, f.sha256 AS found FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'stale' ELSE sha256 END AS sha256 FROM manifest) m JOIN files f USING (doc_id) WHERE m.sha256 <> f.sha256")
def j19_content_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = views.manifest(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 13 == 0, "stale").otherwise(F.col("sha256")).alias("stored"))
    return stored.join(views.files(spark, sf_dir).select("doc_id", F.col("sha256").alias("found")), "doc_id").where("stored <> found")


@query("files", sql="SELECT source_group AS key, count(DISTINCT length % 3) AS n FROM files GROUP BY source_group HAVING count(DISTINCT length % 3) > 1")
def j20_conflicting_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.files(spark, sf_dir).select(F.col("source_group").alias("key"), (F.col("length") % 3).alias("v"))
    return M.conflicting_keys(rows, "key", ["v"])


@query("files", sql="SELECT path, length FROM files ORDER BY path")
def t1_deterministic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select("path", "length").orderBy("path")


@query("files", sql="""WITH o AS (SELECT path, length % 3 <> 0 AS valid, row_number() OVER (ORDER BY sha256('7|' || path)) AS rn, count(*) FILTER (length % 3 <> 0) OVER (ORDER BY sha256('7|' || path)) AS ok FROM files),
l AS (SELECT coalesce(min(rn) FILTER (ok = 100), 1000000000) AS last FROM o) SELECT path, valid FROM o, l WHERE rn <= last""")
def t2_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_valid(views.files(spark, sf_dir), "7", "path", F.col("length") % 3 != 0, 100).select("path", "valid")


@query("members", sql="SELECT ordinal, CASE WHEN row_number() OVER (PARTITION BY archive ORDER BY ordinal) > 20 THEN 'max_images' ELSE '' END AS reason FROM members")
def t3_image_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import archives

    return archives.cap_members(views.members(spark, sf_dir), F.lit(True), 20).select("ordinal", "reason")


@query("files", sql="SELECT path FROM files ORDER BY sha256, path LIMIT 25")
def t4_report_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).orderBy("sha256", "path").limit(25).select("path")


@query("files", sql="SELECT path FROM files ORDER BY path LIMIT 40 OFFSET 60")
def t5_offset_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select("path").orderBy("path").offset(60).limit(40)


@query("pixels", sql="SELECT image_id, min(pos) FILTER (v = hi)::INT AS brightest, min(pos) FILTER (v = lo)::INT AS darkest FROM (SELECT *, max(v) OVER w AS hi, min(v) OVER w AS lo FROM pixels WINDOW w AS (PARTITION BY image_id)) GROUP BY image_id")
def t6_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = F.max_by("pos", F.struct("v", -F.col("pos"))), F.min_by("pos", F.struct("v", "pos"))
    return views.pixels(spark, sf_dir).groupBy("image_id").agg(high.alias("brightest"), low.alias("darkest"))


@query("manifest", "files", sql="SELECT doc_id, source_group, review_status, NULL::DOUBLE AS length FROM manifest WHERE review_status = 'approved' UNION ALL SELECT doc_id, source_group, NULL, length FROM files WHERE doc_id % 2 = 0")
def u1_union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = views.manifest(spark, sf_dir).where("review_status = 'approved'").select("doc_id", "source_group", "review_status")
    return reviewed.unionByName(views.files(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", "source_group", F.col("length").cast("double").alias("length")), allowMissingColumns=True)


@query("files", sql="SELECT path, length FROM files WHERE doc_id % 3 <> 0")
def u2_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.files(spark, sf_dir)
    return files.join(files.where("doc_id % 3 = 0").select("path"), "path", "left_anti").select("path", "length")


@query("files", sql="""WITH u AS (SELECT sha256, path, 0 AS part FROM files WHERE doc_id % 2 = 0 UNION ALL SELECT sha256, path, 1 FROM files WHERE doc_id % 2 = 1)
SELECT sha256, path FROM u QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY part, path) = 1""")
def u3_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.files(spark, sf_dir).select("sha256", "path", "doc_id")
    return M.union_keep_first(files.where("doc_id % 2 = 0"), files.where("doc_id % 2 = 1"), "sha256", "path").select("sha256", "path")


@query("files", "manifest", sql="SELECT source_group, (SELECT count(DISTINCT source_group) FROM files) = (SELECT count(DISTINCT source_group) FROM manifest) AS same_size, source_group IN (SELECT source_group FROM manifest) AS known FROM (SELECT DISTINCT source_group FROM files)")
def u4_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = views.files(spark, sf_dir).select("source_group").distinct(), views.manifest(spark, sf_dir).select("source_group").distinct()
    sizes = left.agg(F.count(F.lit(1)).alias("a")).join(right.agg(F.count(F.lit(1)).alias("b"))).select((F.col("a") == F.col("b")).alias("same_size"))
    known = left.join(right.withColumn("known", F.lit(True)), "source_group", "left")
    return known.join(F.broadcast(sizes)).select("source_group", "same_size", F.coalesce("known", F.lit(False)).alias("known"))


@query("files", sql="SELECT path FROM files WHERE doc_id % 5 = 0")
def u5_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.files(spark, sf_dir).select("path", "doc_id")
    return files.join(files.where("doc_id % 5 = 0").select("path"), "path", "left_semi").select("path")


@query("members", sql=r"""WITH m AS (SELECT *, CASE WHEN NOT (replace(name, '\', '/') LIKE '/%' OR regexp_matches(replace(name, '\', '/'), '^[A-Za-z]:') OR list_contains(string_split(replace(name, '\', '/'), '/'), '..')) THEN name END AS safe FROM members),
a AS (SELECT *, CASE WHEN safe IS NULL OR name LIKE '%/' THEN 'unsafe_path' WHEN NOT regexp_matches(lower(name), '\.(jpg|jpeg|png|bmp|webp|tif|tiff)$') THEN 'extension' WHEN size < 1 OR size > 4000 THEN 'size' END AS r FROM m),
d AS (SELECT *, row_number() OVER (PARTITION BY archive, name, r IS NULL ORDER BY ordinal) AS again FROM a),
f AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN again > 1 THEN 'duplicate' END AS r2 FROM d)
SELECT ordinal, coalesce(r2, CASE WHEN row_number() OVER (PARTITION BY archive, r2 IS NULL ORDER BY ordinal) > 30 THEN 'max_images' END, '') AS reason FROM f""")
def s6_member_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import archives

    return archives.admit(views.members(spark, sf_dir), largest=4000, max_images=30).select("ordinal", "reason")


@query("members", sql="SELECT archive, CASE WHEN count(*) > 36 THEN 'too_many_members' WHEN sum(size) > 60000 THEN 'expanded_size' ELSE '' END AS reason, count(*) AS members, sum(size)::BIGINT AS bytes FROM members GROUP BY archive")
def s26_archive_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import archives

    return archives.admit_archives(views.members(spark, sf_dir), most_members=36, most_bytes=60_000)


@query(sql="""SELECT vec_id, (CASE WHEN vec_id % 3 = 2 THEN 0 ELSE 5 + vec_id % 4 END)::INT AS n, CASE WHEN vec_id % 3 = 2 THEN NULL ELSE round(list_sum([embedding[i]::DOUBLE FOR i IN range(1, 6 + vec_id % 4)]), 6) END AS total FROM embeddings""")
def s15_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import labels

    numbers = F.expr("transform(slice(embedding, 1, cast(5 + vec_id % 4 AS int)), x -> cast(cast(x AS double) AS string))")
    line = F.when(F.col("vec_id") % 3 == 2, F.concat_ws(" ", F.slice(numbers, 1, 4), F.lit("what"))).otherwise(F.concat(F.lit("  "), F.array_join(numbers, "  ")))
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", labels.numbers(line).alias("v"))
    return rows.select("vec_id", F.coalesce(F.size("v"), F.lit(0)).alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("points", sql="""WITH l AS (SELECT image_id, line, string_agg(CASE WHEN status = 'present' THEN printf('%.6f %.6f 2', x, y) ELSE '0 0 0' END, ' ' ORDER BY k) AS t FROM points GROUP BY image_id, line)
SELECT image_id, '0 0.5 0.5 1 1 ' || string_agg(t, ' ' ORDER BY line) AS label FROM l GROUP BY image_id""")
def s17_pose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import labels

    return labels.pose_lines(views.points(spark, sf_dir))


@query("pixels", sql=f"WITH c(class_id, name) AS (VALUES {', '.join(map(str, CLASS_NAMES))}) SELECT class_id, name, class_id IN (SELECT class_id FROM pixels) AS used FROM c")
def s21_class_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(CLASS_NAMES), "class_id int, name string")
    used = views.pixels(spark, sf_dir).select("class_id").distinct().withColumn("used", F.lit(True))
    return names.join(used, "class_id", "left").select("class_id", "name", F.coalesce("used", F.lit(False)).alias("used"))


@query("files", sql="SELECT path, row_number() OVER (ORDER BY path) AS ordinal FROM files WHERE doc_id % 3 <> 0")
def s24_remaining_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.files(spark, sf_dir)
    left = files.join(files.where("doc_id % 3 = 0").select("path"), "path", "left_anti").select("path")
    return M.numbered(left, ["path"], "ordinal")


@query("pixels", sql="SELECT image_id, count(*) AS bad FROM pixels WHERE class_id + pos % 3 NOT BETWEEN 0 AND 6 GROUP BY image_id")
def s4_mask_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(i,) for i, _ in CLASS_NAMES], "value int")
    rows = views.pixels(spark, sf_dir).select("image_id", (F.col("class_id") + F.col("pos") % 3).alias("value"))
    return rows.join(F.broadcast(names), "value", "left_anti").groupBy("image_id").agg(F.count(F.lit(1)).alias("bad"))
