"""Queries of window functions and batch twins of streams (W1 to W14, ST1, ST8, ST10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import manifests as M
from ..operators import windows as W
from . import views
from .registry import query


@query("files", sql="SELECT path, printf('review_%06d', row_number() OVER (ORDER BY path)) AS review_id FROM files")
def w1_sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.numbered(views.files(spark, sf_dir), ["path"])
    return rows.select("path", F.format_string("review_%06d", "n").alias("review_id"))


@query("files", sql="SELECT path, ((row_number() OVER (ORDER BY path) - 1) // 40 + 1)::BIGINT AS page FROM files")
def w2_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.numbered(views.files(spark, sf_dir), ["path"])
    return rows.select("path", F.expr("(n - 1) div 40 + 1").alias("page"))


@query("manifest", sql="""SELECT doc_id, coalesce(min(CASE WHEN review_status = 'pending' THEN doc_id END) OVER (PARTITION BY source_group ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
  min(CASE WHEN review_status = 'pending' THEN doc_id END) OVER (PARTITION BY source_group ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS next_pending FROM manifest""")
def w3_next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.next_pending(views.manifest(spark, sf_dir), "source_group", "doc_id", F.col("review_status") == "pending").select("doc_id", "next_pending")


@query("manifest", sql="SELECT doc_id, row_number() OVER (ORDER BY review_status = 'pending', doc_id) <= 120 AS queued FROM manifest")
def w4_quota_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quota_queue(views.manifest(spark, sf_dir), "review_status", "doc_id", 120).select("doc_id", "queued")


_STABLE = ", ".join(f"avg({m}) OVER w AS a{i}, stddev_pop({m}) OVER w AS s{i}" for i, m in enumerate(("m1", "m2", "m3", "m4")))


@query("frames", sql=f"""WITH a AS (SELECT frame_id, count(*) OVER w AS n, {_STABLE} FROM frames WINDOW w AS (PARTITION BY camera ORDER BY ts, frame_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, [x FOR x IN [{', '.join(f'CASE WHEN a{i} > 0.03 THEN s{i} / a{i} END' for i in range(4))}] IF x IS NOT NULL] AS r FROM a)
SELECT frame_id, n >= 3 AND len(r) > 0 AND round(list_aggregate(r, 'quantile_cont', 0.8), 9) < 0.6 AS stable FROM b""")
def w5_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.stability(views.frames(spark, sf_dir), ["m1", "m2", "m3", "m4"], limit=0.6).select("frame_id", "stable")


@query("annotations", sql="SELECT image_id, max(revision) AS revision, arg_max(status, revision) AS status, arg_max(event_id, revision) AS event_id FROM annotations GROUP BY image_id")
def w11_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(views.annotations(spark, sf_dir).select("image_id", "revision", "status", "event_id"), ["image_id"], F.col("revision"))


@query("annotations", sql="SELECT event_id, lag(status) OVER (PARTITION BY image_id ORDER BY revision) AS previous, least(revision - 1, 30)::BIGINT AS undo_depth FROM annotations")
def w12_undo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.undo_history(views.annotations(spark, sf_dir), "image_id", "revision", "status").select("event_id", "previous", "undo_depth")


@query(sql="""WITH c AS (SELECT vec_id, i::INT AS component, embedding[i + 1]::DOUBLE AS s0, embedding[i + 9]::DOUBLE AS s1, embedding[i + 17]::DOUBLE AS s2 FROM embeddings, (SELECT unnest(range(8)) AS i)),
a AS (SELECT vec_id, arg_max(component, (s0, -component)) AS c0 FROM c WHERE s0 >= 0.05 GROUP BY vec_id),
b AS (SELECT c.vec_id, arg_max(component, (s1, -component)) AS c1 FROM c LEFT JOIN a USING (vec_id) WHERE s1 >= 0.05 AND component IS DISTINCT FROM c0 GROUP BY c.vec_id),
d AS (SELECT c.vec_id, arg_max(component, (s2, -component)) AS c2 FROM c LEFT JOIN a USING (vec_id) LEFT JOIN b USING (vec_id) WHERE s2 >= 0.05 AND component IS DISTINCT FROM c0 AND component IS DISTINCT FROM c1 GROUP BY c.vec_id)
SELECT vec_id, 'life' AS line, c0 AS component FROM a UNION ALL SELECT vec_id, 'head', c1 FROM b UNION ALL SELECT vec_id, 'heart', c2 FROM d""")
def w13_exclusive_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = views.table(spark, sf_dir, "embeddings").withColumn("component", F.explode(F.sequence(F.lit(0), F.lit(7))))
    score = lambda k: F.expr(f"cast(embedding[component + {8 * k}] AS double)")
    rows = vecs.select("vec_id", "component", score(0).alias("life"), score(1).alias("head"), score(2).alias("heart"))
    return W.assign_exclusively(rows, "vec_id", "component", ["life", "head", "heart"], 0.05)


@query("frames", sql="SELECT frame_id, count(*) OVER (PARTITION BY camera ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS in_window FROM frames")
def w14_trailing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames(spark, sf_dir).select("camera", "frame_id", "ts")
    return W.trailing_count(rows, "camera", F.unix_micros(F.col("ts").cast("timestamp")), 60_000_000).select("frame_id", "in_window")


@query("frames", sql="SELECT camera, max(frame_id) AS frame_id, arg_max(m1, frame_id) AS m1 FROM frames GROUP BY camera")
def st1_latest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(views.frames(spark, sf_dir).select("camera", "frame_id", "m1"), ["camera"], F.col("frame_id"))


@query("annotations", sql="""WITH RECURSIVE n AS (SELECT image_id, revision AS i, event_id, greatest(base_revision - 1, 0) AS base FROM annotations),
f(image_id, i, now, ok) AS (SELECT DISTINCT image_id, 0::BIGINT, 0::BIGINT, FALSE FROM n UNION ALL SELECT n.image_id, n.i, f.now + (n.base = f.now)::BIGINT, n.base = f.now FROM f JOIN n ON n.image_id = f.image_id AND n.i = f.i + 1)
SELECT n.event_id, f.ok AS accepted, f.now AS current FROM f JOIN n ON n.image_id = f.image_id AND n.i = f.i""")
def st8_revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.annotations(spark, sf_dir).select("image_id", "revision", F.greatest(F.col("base_revision") - 1, F.lit(0)).cast("long").alias("base"), "event_id")
    return A.accepted_edits(log, "image_id", "revision", "base").select("event_id", "accepted", "current")


@query("annotations", sql="SELECT image_id, arg_max(status, event_id) AS status, arg_max(note, event_id) AS note FROM annotations GROUP BY image_id")
def st10_status_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.annotations(spark, sf_dir)
    base = log.select("image_id").distinct().select("image_id", F.lit("pending").alias("status"), F.lit("").alias("note"))
    last = A.latest(log.select("image_id", "event_id", "status", "note"), ["image_id"], F.col("event_id"))
    return A.upsert(base, last, "image_id", ["status", "note"])
