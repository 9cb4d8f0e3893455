"""Queries of the similarity graph and the leakage audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from . import views
from .registry import query


@query("hashes", sql="SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM hashes a JOIN hashes b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 6")
def j9_near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.row_pairs(views.hashes(spark, sf_dir))


@query("hashes", sql="SELECT id, min(id) OVER (PARTITION BY h) AS value FROM hashes")
def j9_hash_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hash_members(views.hashes(spark, sf_dir))


@query("hashes", sql="WITH v AS (SELECT h, min(id) AS id FROM hashes GROUP BY h) SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM v a JOIN v b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 6")
def j9_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of distinct hashes; `j9_hash_members` tells each row's."""
    return G.value_pairs(views.hashes(spark, sf_dir))


@query("hashes", sql="SELECT id FROM hashes a WHERE id % 3 <> 0 AND EXISTS (SELECT 1 FROM hashes b WHERE b.id % 3 = 0 AND bit_count(xor(a.h, b.h)) <= 6)")
def j8_hold_out_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.hashes(spark, sf_dir).withColumnRenamed("h", "phash")
    free = rows.where("id % 3 <> 0")
    return free.join(G.near_any(free, rows.where("id % 3 = 0")), F.col("phash") == F.col("h"), "left_semi").select("id")


_EDGES = """e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM manifest a JOIN manifest b ON a.doc_id <> b.doc_id AND (a.sha256 = b.sha256 OR a.subject_id = b.subject_id OR bit_count(xor(a.phash, b.phash)) <= 6)),
r AS (SELECT doc_id AS id, doc_id AS root FROM manifest UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
g AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""
_SPLIT = f"""WITH RECURSIVE {_EDGES},
k AS (SELECT root, left(sha256(string_agg(image_path, chr(10) ORDER BY image_path)), 16) AS group_id, count(*) AS n FROM g JOIN manifest ON doc_id = id GROUP BY root),
o AS (SELECT *, row_number() OVER (ORDER BY sha256('42|' || group_id)) AS place, count(*) OVER () AS total FROM k),
s AS (SELECT root, group_id, CASE WHEN place <= greatest(1, total // 10) THEN 'test' WHEN place <= 2 * greatest(1, total // 10) THEN 'val' ELSE 'train' END AS split FROM o)"""


@query("manifest", sql=f"WITH RECURSIVE {_EDGES} SELECT id, root FROM g")
def g1_transitive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grouped_manifest(views.manifest(spark, sf_dir)).select(F.col("doc_id").alias("id"), F.col("group_root").alias("root"))


@query("manifest", sql=f"{_SPLIT} SELECT root, group_id FROM s")
def g2_group_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grouped_manifest(views.manifest(spark, sf_dir)).select(F.col("group_root").alias("root"), "group_id").distinct()


@query("manifest", sql=f"{_SPLIT} SELECT id, split FROM g JOIN s USING (root)")
def w9_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grouped_manifest(views.manifest(spark, sf_dir)).select(F.col("doc_id").alias("id"), "split")


@query("manifest", sql=f"{_SPLIT} SELECT split, count(*) AS samples, count(DISTINCT group_id) AS groups FROM g JOIN s USING (root) GROUP BY split")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 over G1, G2 and W9: the flagship."""
    return G.split_summary(G.grouped_manifest(views.manifest(spark, sf_dir)))


@query("manifest", sql="""WITH m AS (SELECT *, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM manifest),
u AS (SELECT 'sha256' AS kind, sha256 AS value, split FROM m UNION ALL SELECT 'subject_id', subject_id, split FROM m WHERE subject_id IS NOT NULL UNION ALL SELECT 'source_group', source_group, split FROM m)
SELECT kind, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM u GROUP BY kind, value HAVING count(DISTINCT split) > 1""")
def g3_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "val").otherwise("train")
    return G.leaks(views.manifest(spark, sf_dir).withColumn("split", split), ["sha256", "subject_id", "source_group"])


@query("manifest", sql="SELECT split_basis, count(*) AS n FROM (SELECT CASE WHEN subject_id IS NOT NULL THEN 'subject+perceptual' ELSE 'perceptual; not subject-independent' END AS split_basis FROM manifest) GROUP BY 1")
def g4_split_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grouped_manifest(views.manifest(spark, sf_dir)).groupBy("split_basis").agg(F.count(F.lit(1)).alias("n"))
