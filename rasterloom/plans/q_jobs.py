"""Queries of pluggable jobs and composed loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import pixels as X
from ..operators import polylines as R
from ..operators import scoring as S
from . import loops, views
from .q_pixels import FEATURES
from .q_pixels import _METRICS as METRICS_SQL
from .registry import query


@query("pixels", sql="SELECT image_id, round(avg(v) / 255, 6) AS score FROM pixels GROUP BY image_id")
def x1_pluggable_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rasters = views.pixels(spark, sf_dir).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("values"))
    return S.scored(rasters, S.MeanScorer()).select("image_id", F.round("score", 6).alias("score"))


@query()
def x2_pluggable_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.thin_masks(views.pixels(spark, sf_dir).where("class_id = 2"), R.thinned).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql="SELECT vec_id, i::INT AS field, round(embedding[i + 1]::DOUBLE, 6) AS value FROM embeddings, (SELECT unnest(range(6)) AS i) ")
def x3_label_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.array_join(F.expr("transform(slice(embedding, 1, 6), x -> cast(cast(x AS double) AS string))"), " ")
    views.table(spark, sf_dir, "embeddings").select("vec_id", line.alias("line")).createOrReplaceTempView("_label_lines")
    spark.udtf.register("label_fields", S.LabelFields)
    return spark.sql("SELECT vec_id, field, round(value, 6) AS value FROM _label_lines, LATERAL label_fields(line)")


@query("frames", sql="SELECT camera, generation, round(avg(m1), 6) AS mean, round(quantile_cont(m1, 0.8), 6) AS p80 FROM frames GROUP BY camera, generation")
def x4_grouped_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The p80 as a grouped-aggregate pandas UDF beside the built-in mean."""
    rows = views.frames(spark, sf_dir)
    mean = rows.groupBy("camera", "generation").agg(F.round(F.avg("m1"), 6).alias("mean"))
    p80 = rows.groupBy("camera", "generation").agg(S.p80("m1").alias("p80"))
    return mean.join(p80, ["camera", "generation"]).select("camera", "generation", "mean", F.round("p80", 6).alias("p80"))


@query()
def x5_pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = G.written(G.grouped_manifest(views.manifest(spark, sf_dir)), "manifest")
    return loops.pseudo_labels(manifest, views.pixels(spark, sf_dir), FEATURES, confidence=0.30)


@query("manifest", sql="""WITH o AS (SELECT *, score > 0.45 AS valid, sha256('q|' || image_path) AS h FROM manifest), r AS (SELECT *, count(*) FILTER (valid) OVER (ORDER BY h) AS ok FROM o)
SELECT printf('review_%04d', row_number() OVER (ORDER BY image_path)) AS review_id, image_path, review_status FROM r WHERE valid AND ok <= 100""")
def x6_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.review_queue(views.manifest(spark, sf_dir), "q", 100).select("review_id", "image_path", "review_status")


@query()
def x7_label_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("life", "Head-Line", "heart line", "elbow")])
    numbers = F.expr("transform(slice(embedding, 1, cast(5 + 2 * (2 + vec_id % 3) AS int)), x -> (cast(x AS double) + 1) / 2)")
    labels = views.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.concat(F.element_at(F.array(F.lit("train/"), F.lit("val/"), F.lit("test/")), (F.col("vec_id") % 3 + 1).cast("int")), F.col("vec_id").cast("string")).alias("path"),
        names[(F.col("vec_id") % 4).cast("int")].alias("class_name"), numbers.alias("numbers"),
    )
    segments = loops.converted_labels(labels, 32, 32)
    drawn = R.rasterised(segments.drop("split"), 2)
    return drawn.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), F.max("class_id").alias("class_id"))


@query("pixels", sql=f"WITH {METRICS_SQL} SELECT 'bridge' AS dataset, 'all' AS split, class_id, support, round(iou, 6) AS iou, round(dice, 6) AS dice FROM s")
def x8_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = loops.evaluation(views.pixels(spark, sf_dir), {"dataset": F.lit("bridge"), "split": F.lit("all")})
    return out.select("dataset", "split", "class_id", "support", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


@query()
def k5_pseudo_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = loops.pseudo_masks(views.pixels(spark, sf_dir), 8, 8, F.lit("left"), quantile=0.75, least_score=0.2)
    return report.select("image_id", F.round("line_ratio", 6).alias("line_ratio"), "minor_pixels", "main_lines", F.round("mask_quality", 6).alias("mask_quality"))
