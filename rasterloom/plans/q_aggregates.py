"""Queries of aggregations over manifests and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classifier as C
from ..operators import manifests as M
from . import views
from .q_columns import REASON_SQL, scored
from .registry import query


@query("files", sql="SELECT sha256, min(path) AS path, count(*) AS n FROM files GROUP BY sha256")
def a1_exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).groupBy("sha256").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))


@query("files", sql=f"WITH {REASON_SQL} SELECT CASE WHEN reason = 'OK' THEN 'accepted' ELSE lower(reason) END AS reason, count(*) AS n FROM r GROUP BY 1")
def a2_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import columns

    reason = F.nullif(columns.quality_reason(1024), F.lit("OK"))
    rows = scored(spark, sf_dir).select(F.coalesce(F.lower(reason), F.lit("accepted")).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("files", sql="SELECT count(DISTINCT source_group) AS groups, count(*) AS files FROM files")
def a3_source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).agg(F.countDistinct("source_group").alias("groups"), F.count(F.lit(1)).alias("files"))


@query("manifest", sql="SELECT source_group, count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'rejected') AS rejected FROM manifest GROUP BY source_group")
def a5_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.manifest(spark, sf_dir).groupBy("source_group").pivot("review_status", ["pending", "approved", "rejected"]).count().na.fill(0)


@query("points", sql="SELECT line, count(DISTINCT image_id) FILTER (status = 'present' AND image_id % 10 > 1) AS positives FROM points GROUP BY line")
def a22_positive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = (F.col("status") == "present") & (F.col("image_id") % 10 > 1) & (F.col("k") == 0)
    return views.points(spark, sf_dir).groupBy("line").agg(F.sum(one.cast("long")).alias("positives"))


@query("manifest", sql="SELECT CASE WHEN score >= 0.52 THEN 'accepted' WHEN score >= 0.48 THEN 'review' ELSE 'skipped' END AS route, count(*) AS n FROM manifest GROUP BY 1")
def a23_routing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.when(F.col("score") >= 0.52, "accepted").when(F.col("score") >= 0.48, "review").otherwise("skipped")
    return views.manifest(spark, sf_dir).groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("manifest", sql="SELECT source_group, array_to_string(list_sort(list(DISTINCT review_status)), ',') AS provenance, bool_and(review_status = 'pending') AS all_pending FROM manifest GROUP BY source_group")
def a26_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.manifest(spark, sf_dir).groupBy("source_group").agg(
        F.array_join(F.sort_array(F.collect_set("review_status")), ",").alias("provenance"), F.every(F.col("review_status") == "pending").alias("all_pending")
    )


@query("history", sql="""WITH RECURSIVE h AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i FROM history WHERE val_loss IS NOT NULL),
f(i, best, best_epoch, stale, stopped) AS (SELECT 0::BIGINT, 'inf'::DOUBLE, -1, 0, -1 UNION ALL
  SELECT h.i, CASE WHEN f.stopped < 0 AND h.val_loss < f.best - 1e-6 THEN h.val_loss ELSE f.best END, CASE WHEN f.stopped < 0 AND h.val_loss < f.best - 1e-6 THEN h.epoch ELSE f.best_epoch END,
    CASE WHEN f.stopped >= 0 THEN f.stale WHEN h.val_loss < f.best - 1e-6 THEN 0 ELSE f.stale + 1 END,
    CASE WHEN f.stopped >= 0 THEN f.stopped WHEN NOT h.val_loss < f.best - 1e-6 AND f.stale + 1 >= 5 THEN h.epoch ELSE -1 END
  FROM f JOIN h ON h.i = f.i + 1)
SELECT best, best_epoch, stopped FROM f ORDER BY i DESC LIMIT 1""")
def a27_early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.early_stopping(views.history(spark, sf_dir).where("val_loss IS NOT NULL"), patience=5)


@query("manifest", sql="SELECT source_group, count(*) AS n FROM manifest GROUP BY source_group HAVING count(*) > 20")
def large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3's duplicate check in its general form."""
    return M.duplicate_keys(views.manifest(spark, sf_dir), "source_group").where("n > 20")
