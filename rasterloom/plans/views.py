"""Bridge views: the driver's tables seen as files, manifests, rasters and frames.

Each view exists twice, as a DataFrame and as DuckDB SQL for the oracles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing: path, source_group, length, sha256 of the content."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".png"))).alias("path"),
        F.col("source").alias("source_group"),
        F.col("n_chars").alias("length"),
        F.sha2("text", 256).alias("sha256"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members with awkward names."""
    base = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    png, kind = F.concat(base, F.lit(".png")), F.col("page_id") % 11
    name = (
        F.when(kind == 0, F.concat(F.lit("../"), png)).when(kind == 1, F.concat(F.lit("/"), png)).when(kind == 2, F.concat(F.lit("C:\\"), png))
        .when(kind == 3, F.concat(base, F.lit("/"))).when(kind == 4, F.lit("dup/name.png")).when(kind == 5, F.concat(base, F.lit(".txt"))).otherwise(png)
    )
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("a"), (F.col("page_id") % 7).cast("string")).alias("archive"), F.col("page_id").alias("ordinal"), name.alias("name"), F.length("html").cast("long").alias("size")
    )


def _hash(embedding: str) -> str:
    """The median is an argument of the outer lambda, so that it is sorted for once a row."""
    middle = f"element_at(array_sort(slice({embedding}, 2, 63)), 32)"
    return f"transform(array({middle}), m -> aggregate(sequence(1, 63), 0L, (a, i) -> a | if({embedding}[i] > m, shiftleft(1L, i - 1), 0L)))[0]"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """63-bit perceptual hashes with copies of 0 to 8 flipped bits."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.expr(_hash("embedding")).alias("h"))
    copies = own.where("vec_id % 5 = 0").select((F.col("vec_id") + 1_000_000).alias("id"), F.expr("h ^ (shiftleft(1L, cast(vec_id % 9 AS int)) - 1L)").alias("h"))
    return own.select(F.col("vec_id").alias("id"), "h").unionByName(copies)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with review state."""
    docs, vecs, labels = (table(spark, sf_dir, t) for t in ("documents", "embeddings", "labels"))
    # digests go into the joins, not texts and vectors
    docs = docs.select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    vecs = vecs.select("vec_id", F.expr(_hash("embedding")).alias("phash"), ((F.col("embedding")[0].cast("double") + 1) / 2).alias("score"))
    joined = docs.join(vecs, docs.doc_id == vecs.vec_id).join(labels.select(F.col("doc_id").alias("l_id"), "quality"), F.col("doc_id") == F.col("l_id"), "left")
    return joined.select(
        "doc_id",
        F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_path"),
        F.col("source").alias("source_group"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("s"), F.expr("doc_id div 3").cast("string"))).alias("subject_id"),
        "sha256",
        "phash",
        F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending").alias("review_status"),
        "score",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 rasters with mask and prediction."""
    vecs = table(spark, sf_dir, "embeddings")
    return vecs.select("vec_id", "label", F.posexplode("embedding").alias("pos", "value")).select(
        F.col("vec_id").alias("image_id"), "pos", F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"),
        F.floor((F.col("value").cast("double") + 1) * 127.5).cast("int").alias("v"),
        F.pmod(F.col("label") + F.col("pos") % 2, F.lit(7)).alias("class_id"),
        F.pmod(F.col("label") + F.col("pos") % 2 + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0), F.lit(7)).alias("pred_id"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six keypoints of three lines an image: truth, prediction and state."""
    e = lambda i: F.expr(f"cast(embedding[{i}] AS double)")
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = vecs.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    x, y = (e("12 * line + 2 * k") + 1) / 2, (e("12 * line + 2 * k + 1") + 1) / 2
    shift, state = e("36 + k") / 10, (F.col("vec_id") + F.col("line")) % 3
    return rows.select(
        F.col("vec_id").alias("image_id"), "line", "k", x.alias("x"), y.alias("y"), (x + shift).alias("px"), (y + shift).alias("py"),
        F.when(state == 0, "present").when(state == 1, "absent").otherwise("unreviewed").alias("status"), ((e("48 + line") + 1) / 2).alias("presence"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision log: who edits which revision of an image's annotation."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumn("revision", F.row_number().over(order))
    return events.select(
        F.col("user_id").alias("image_id"), F.col("revision").cast("long").alias("revision"), (F.col("revision") - F.col("event_id") % 3).cast("long").alias("base_revision"),
        "event_id", F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "click", "rejected").otherwise("pending").alias("status"), F.col("props").alias("note"), "ts",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live frames of four cameras with four metrics."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    v = F.coalesce(F.col("value"), F.lit(0.0))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("camera"), k.alias("k"), F.expr("coalesce(cast(get_json_object(props, '$.k') AS bigint), 0) div 40").alias("generation"), F.col("event_id").alias("frame_id"), "ts",
        v.alias("m1"), (v / 2).alias("m2"), (v / 4).alias("m3"), (v / 8).alias("m4"), (F.col("event_id") % 3 + 1).alias("lines"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training history: one epoch a day."""
    day = F.datediff(F.to_date("ts"), F.lit("2000-01-01"))
    return table(spark, sf_dir, "events").groupBy(day.alias("epoch")).agg(
        F.round(F.avg("value"), 6).alias("train_loss"), F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("val_loss")
    )


_HASH = "list_sum([CASE WHEN embedding[i + 1] > list_sort(embedding[2:64])[32] THEN (1::BIGINT << (i - 1)) ELSE 0 END FOR i IN range(1, 64)])::BIGINT"

SQL = {
    "files": "files AS (SELECT doc_id, source || '/' || doc_id || '.png' AS path, source AS source_group, n_chars AS length, sha256(text) AS sha256 FROM documents)",
    "members": r"""members0 AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS base FROM pages),
members AS (SELECT 'a' || (page_id % 7) AS archive, page_id AS ordinal, CASE page_id % 11 WHEN 0 THEN '../' || base || '.png' WHEN 1 THEN '/' || base || '.png'
  WHEN 2 THEN 'C:\' || base || '.png' WHEN 3 THEN base || '/' WHEN 4 THEN 'dup/name.png' WHEN 5 THEN base || '.txt' ELSE base || '.png' END AS name, length(html)::BIGINT AS size FROM members0)""",
    "hashes": f"""hashes0 AS (SELECT vec_id, {_HASH} AS h FROM embeddings),
hashes AS (SELECT vec_id AS id, h FROM hashes0 UNION ALL SELECT vec_id + 1000000, xor(h, (1::BIGINT << (vec_id % 9)::INT) - 1) FROM hashes0 WHERE vec_id % 5 = 0)""",
    "manifest": f"""manifest AS (SELECT d.doc_id, 'img/' || d.doc_id || '.png' AS image_path, source AS source_group, CASE WHEN d.doc_id % 5 <> 0 THEN 's' || (d.doc_id // 3) END AS subject_id,
  sha256(text) AS sha256, {_HASH} AS phash, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS review_status, (embedding[1]::DOUBLE + 1) / 2 AS score
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "pixels": """pixels0 AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS value FROM embeddings),
pixels AS (SELECT vec_id AS image_id, pos::INT AS pos, (pos // 8)::INT AS y, (pos % 8)::INT AS x, floor((value::DOUBLE + 1) * 127.5)::INT AS v,
  ((label + pos % 2) % 7)::INT AS class_id, ((label + pos % 2 + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 7)::INT AS pred_id FROM pixels0)""",
    "points": """points0 AS (SELECT vec_id, embedding AS e, l.line, m.k FROM embeddings, (SELECT unnest(range(3)) AS line) l, (SELECT unnest(range(6)) AS k) m),
points AS (SELECT vec_id AS image_id, line::INT AS line, k::INT AS k, (e[12 * line + 2 * k + 1]::DOUBLE + 1) / 2 AS x, (e[12 * line + 2 * k + 2]::DOUBLE + 1) / 2 AS y,
  (e[12 * line + 2 * k + 1]::DOUBLE + 1) / 2 + e[37 + k]::DOUBLE / 10 AS px, (e[12 * line + 2 * k + 2]::DOUBLE + 1) / 2 + e[37 + k]::DOUBLE / 10 AS py,
  CASE (vec_id + line) % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' ELSE 'unreviewed' END AS status, (e[49 + line]::DOUBLE + 1) / 2 AS presence FROM points0)""",
    "annotations": """annotations0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events),
annotations AS (SELECT user_id AS image_id, revision, revision - event_id % 3 AS base_revision, event_id,
  CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'rejected' ELSE 'pending' END AS status, props AS note, ts FROM annotations0)""",
    "frames": """frames AS (SELECT user_id % 4 AS camera, coalesce((props->>'$.k')::BIGINT, 0) AS k, coalesce((props->>'$.k')::BIGINT, 0) // 40 AS generation, event_id AS frame_id, ts,
  coalesce(value, 0) AS m1, coalesce(value, 0) / 2 AS m2, coalesce(value, 0) / 4 AS m3, coalesce(value, 0) / 8 AS m4, event_id % 3 + 1 AS lines FROM events)""",
    "history": """history AS (SELECT date_diff('day', DATE '2000-01-01', ts::DATE)::INT AS epoch, round(avg(value), 6) AS train_loss,
  round(avg(value) FILTER (event_type = 'purchase'), 6) AS val_loss FROM events GROUP BY 1)""",
}


def with_views(views: Sequence[str], body: str) -> str:
    """`body` (a SELECT, or WITH ... SELECT) with the views in front of it."""
    body = body.strip()
    if not views:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[v] for v in views)
    if body.upper().startswith("WITH"):
        return head + ",\n" + body[len("WITH RECURSIVE" if recursive else "WITH") :]
    return head + "\n" + body
