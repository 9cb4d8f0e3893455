"""Queries that write files in the shared folder and read them back, and streams that run
over what is available into a table (S10 to S13, S16, S18 to S20, S22, S23, ST9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import classifier as L
from ..operators.graph import folder, written
from ..sources import labels, tables
from ..streaming import frames as S
from ..streaming import logs
from . import views
from .q_pixels import _MODEL, FEATURES, training
from .registry import query


@query("manifest", sql="SELECT doc_id::VARCHAR AS doc_id, image_path, source_group, review_status FROM manifest")
def s10_read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "manifest-csv")
    views.manifest(spark, sf_dir).select("doc_id", "image_path", "source_group", "review_status").write.option("header", True).csv(path)
    return tables.read_manifest(spark, path)


@query("manifest", "files", sql="""SELECT image_path AS path, NULL::VARCHAR AS length, review_status FROM manifest
UNION ALL SELECT path, length::VARCHAR, NULL FROM files""")
def s11_write_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of different columns in one CSV, gaps empty."""
    path = folder(spark, "manifests-csv")
    parts = [views.manifest(spark, sf_dir).select(F.col("image_path").alias("path"), "review_status"), views.files(spark, sf_dir).select("path", "length")]
    tables.write_manifest(parts, path, ["path"])
    return tables.read_manifest(spark, path)


@query("points", sql="SELECT image_id, line, k, round(x, 6) AS x, round(y, 6) AS y, status FROM points")
def s12_document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "points-json")
    tables.write_documents(views.points(spark, sf_dir).select("image_id", "line", "k", "x", "y", "status"), path)
    return tables.read_documents(spark, path, "image_id long, line int, k int, x double, y double, status string").select("image_id", "line", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "status")


@query("points", sql="SELECT CASE WHEN presence > 0.5 THEN 'auto_labels' ELSE 'manual_review' END AS route, image_id, line, k FROM points")
def s13_routed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "routed-json")
    tables.write_routed(views.points(spark, sf_dir).select("image_id", "line", "k", "presence"), F.col("presence") > 0.5, path)
    return spark.read.schema("image_id long, line int, k int, presence double, route string").json(path).select("route", "image_id", "line", "k")


@query(sql="""SELECT r_name AS region, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1)::INT AS class_id, n_name AS name
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def s16_class_name_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One names file a region."""
    path = folder(spark, "names")
    nations = views.table(spark, sf_dir, "nation").join(views.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: F.concat(F.lit("  - "), n["n_name"]))
    text = nations.groupBy("r_name").agg(F.concat(F.lit("names:\n"), F.array_join(names, "\n")).alias("value"))
    text.write.partitionBy("r_name").text(path)
    found = labels.class_names(spark, path)
    region = F.url_decode(F.regexp_extract("path", "r_name=([^/]+)", 1))
    return found.select(F.url_decode(region).alias("region"), "class_id", "name")


@query("annotations", sql="SELECT image_id, arg_max(status, event_id) AS status FROM annotations GROUP BY image_id")
def s18_annotation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last states over the base rows, as documents."""
    path, log = folder(spark, "annotations-json"), views.annotations(spark, sf_dir)
    base = log.select("image_id").distinct().withColumn("status", F.lit("pending"))
    tables.write_documents(A.upsert(base, A.latest(log.select("image_id", "event_id", "status"), ["image_id"], F.col("event_id")), "image_id", ["status"]), path)
    return tables.read_documents(spark, path, "image_id long, status string")


@query("files", sql="""SELECT path AS source_path, array_to_string([x FOR x IN [CASE WHEN doc_id % 5 = 0 THEN 'repeated' END, CASE WHEN doc_id % 4 = 1 THEN 'unknown_path' END, CASE WHEN doc_id % 3 = 2 THEN 'mirrored' END,
  CASE WHEN doc_id % 7 = 6 THEN 'handedness' END] IF x IS NOT NULL], ',') AS violations FROM files, (SELECT unnest([0, 1]) AS i) WHERE i = 0 OR doc_id % 5 = 0""")
def s19_metadata_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, files = folder(spark, "metadata-csv"), views.files(spark, sf_dir)
    rows = files.withColumn("i", F.explode(F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    mirrored = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("perhaps")), (F.col("doc_id") % 3 + 1).cast("int"))
    hand = F.when(F.col("doc_id") % 7 == 6, "both").when(F.col("doc_id") % 7 == 5, "left").otherwise("unknown")
    rows.select(F.col("path").alias("source_path"), F.lit(None).cast("string").alias("subject_id"), "source_group", mirrored.alias("mirrored"), hand.alias("handedness")).write.option("header", True).csv(path)
    good, bad = tables.import_metadata(spark, path, files.where("doc_id % 4 <> 1").select("path"))
    return good.select("source_path", F.lit("").alias("violations")).unionByName(bad.select("source_path", F.array_join("violations", ",").alias("violations")))


@query("pixels", sql=f"WITH {_MODEL} SELECT class_id, feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(prior, 6) AS prior FROM model")
def s20_stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "model")
    tables.save_model(L.fit(training(spark, sf_dir), FEATURES, 7), path, "1")
    return tables.load_model(spark, path, "1").select("class_id", "feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "prior")])


@query("manifest", sql="""WITH r AS (SELECT *, CASE review_status WHEN 'rejected' THEN 'low_quality' ELSE '' END AS reason FROM manifest)
SELECT (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT CASE reason WHEN '' THEN 'accepted' ELSE reason END AS k, count(*) AS n FROM r GROUP BY 1)) AS counts,
  (SELECT count(DISTINCT source_group) FROM r) AS groups, (SELECT string_agg(image_path, ',' ORDER BY image_path) FROM (SELECT image_path FROM r WHERE reason <> '' ORDER BY image_path LIMIT 20)) AS rejected,
  coalesce((SELECT arg_min('image ' || doc_id, image_path) FROM r WHERE reason <> '' AND subject_id IS NULL), 'no error') AS error""")
def s22_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.manifest(spark, sf_dir).withColumn("path", F.col("image_path")).withColumn("reason", F.when(F.col("review_status") == "rejected", "low_quality").otherwise(""))
    errors = F.when((F.col("reason") != "") & F.col("subject_id").isNull(), F.concat(F.lit("image "), F.col("doc_id").cast("string")))
    found = tables.report(rows, "reason", "source_group", 20, errors)
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select(F.array_join(F.array_sort(pairs), ",").alias("counts"), "groups", F.array_join(F.transform("rejected", lambda r: r["path"]), ",").alias("rejected"), "error")


def _table_of(stream: DataFrame, name: str) -> DataFrame:
    """What a stream yields over all files that are there, as a table."""
    spark = stream.sparkSession
    path = folder(spark, name)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _frame_files(spark: SparkSession, sf_dir: str, files: int) -> str:
    path = folder(spark, "frames-json")
    views.frames(spark, sf_dir).select("camera", "generation", "frame_id", "ts", F.col("lines").cast("int").alias("lines"), "m1", "m2", "m3", "m4").repartition(files).write.json(path)
    return path


@query("frames", sql="SELECT camera, generation, frame_id, round(m1, 6) AS m1 FROM frames")
def s23_frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = S.read_frames(spark, _frame_files(spark, sf_dir, 4), 2)
    return _table_of(stream.select("camera", "generation", "frame_id", "m1"), "frames").select("camera", "generation", "frame_id", F.round("m1", 6).alias("m1"))


@query("files", sql="SELECT DISTINCT sha256 FROM files")
def st9_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each content that arrives within the watermark."""
    path = folder(spark, "arrivals")
    written(views.files(spark, sf_dir), "arrivals").select("sha256", F.expr("timestamp_seconds(1700000000 + doc_id % 3600)").alias("ts")).write.json(path)
    stream = spark.readStream.schema("sha256 string, ts timestamp").option("maxFilesPerTrigger", 1000).json(path)
    return _table_of(logs.first_seen(stream), "first").select("sha256")
