"""Queries over files that Spark writes from the tables first: images, archives, lines and
run summaries (S1 to S3, S5, S7, S14, S25)."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import folder, written
from ..sources import archives, files, ranges, tables
from . import views
from .registry import query


def _below(path: Column, top: str) -> Column:
    """The path from `top`'s last part on."""
    return F.substring_index(path, f"/{top.rsplit('/', 1)[1]}/", -1)


def _document_files(spark: SparkSession, sf_dir: str) -> str:
    """Each document as a file, three fifths of them with an image's extension. Rows that share
    a name, or have none, stand in folders of their own; `n` and `t` tell null texts from others."""
    top = folder(spark, "document-files")
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    again = written(docs.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL OR source IS NULL"), "repeated-names")
    own = F.lit("")
    if not again.isEmpty():
        same = docs["doc_id"].eqNullSafe(again["doc_id"]) & docs["source"].eqNullSafe(again["source"])
        docs = docs.join(again, same, "left").select(*[docs[c] for c in docs.columns], "n")
        own = F.when(F.col("n").isNotNull(), F.col("row").cast("string")).otherwise("")
    kind = F.element_at(F.array(*map(F.lit, ("png", "JPG", "txt", "Tiff", "json"))), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = F.concat(F.lit("."), F.coalesce(kind, F.lit("txt")))
    name = F.coalesce(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), kind), F.concat(F.lit("unnamed"), kind))
    place = F.concat(F.when(F.col("text").isNull(), "n").otherwise("t"), own)
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    ranges.put(docs.select(F.concat_ws("/", F.lit(top), place, name).alias("path"), content.alias("content")))
    return top


_IMAGE_FILES = "SELECT source || '/' || doc_id || '.' || ['png', 'JPG', 'txt', 'Tiff', 'json'][doc_id % 5 + 1] AS name, octet_length(encode(text)) AS length FROM documents WHERE doc_id % 5 NOT IN (2, 4)"


@query(sql=_IMAGE_FILES)
def s1_image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _document_files(spark, sf_dir)
    place, name = _below(F.col("path"), top), F.regexp_replace(_below(F.col("path"), top), "^[^/]*/", "")
    return files.listing(spark, top).select(F.when(name.contains("/"), name).alias("name"), F.when(place.startswith("t"), F.col("length")).alias("length"))


@query(sql=f"SELECT count(*) AS images FROM ({_IMAGE_FILES})")
def s2_image_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.listing(spark, _document_files(spark, sf_dir)).agg(F.count(F.lit(1)).alias("images"))


#: Widths and heights that the probed files declare, by vec_id modulo 6.
_SIDES = ((8, 8), (9000, 8), (5000, 4000), (0, 0), (640, 480), (64, 32))


@query(sql="""SELECT vec_id, CASE WHEN vec_id % 6 IN (3, 4) THEN NULL ELSE [8, 9000, 5000, 0, 0, 64][vec_id % 6 + 1] END AS width, CASE WHEN vec_id % 6 IN (3, 4) THEN NULL ELSE [8, 8, 4000, 0, 0, 32][vec_id % 6 + 1] END AS height,
  ['', 'pixel_limit', 'pixel_limit', 'bad_read', 'file_size_limit', ''][vec_id % 6 + 1] AS reason FROM embeddings""")
def s3_bounded_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of PNG and JPEG files, of files that are neither, and of too large ones."""
    top, kind = folder(spark, "headers"), F.col("vec_id") % 6
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in _SIDES]), (kind + 1).cast("int"))
    hexed = lambda n, c: F.lpad(F.hex(c), n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(8, pick(0)), hexed(8, pick(1)), F.lit("0800000000"))
    jpeg = F.concat(F.lit("FFD8FFE000044A46FFC0001108"), hexed(4, pick(1)), hexed(4, pick(0)), F.lit("0300000000000000"))
    head = F.when(kind == 5, jpeg).when(kind == 3, F.lit("00")).otherwise(png)
    body = F.encode(F.repeat(F.to_json("embedding"), F.when(kind == 4, 40).otherwise(1)), "UTF-8")
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.unhex(head), body).alias("content"))
    ranges.put(rows.select(F.concat(F.lit(f"{top}/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), "content"))
    found = files.probed(spark, top, max_bytes=10_000)
    return found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), "width", "height", "reason")


#: Quotas of the archive queries: members and bytes of an archive, bytes of a member.
_MEMBERS, _BYTES, _MEMBER = 100, 90_000, 4_000


def _zipped(group: pa.Table) -> pa.Table:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for ordinal, name, content in sorted(zip(*(group.column(c).to_pylist() for c in ("ordinal", "name", "content")))):
            z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED if ordinal % 2 else zipfile.ZIP_STORED)
    return pa.table({"path": [group.column("path")[0].as_py()], "content": pa.array([out.getvalue()], pa.binary())})


def _archives(spark: SparkSession, sf_dir: str) -> str:
    """The pages in ZIP files, of up to 147 members, by runs of 256 pages."""
    top = folder(spark, "archives")
    html = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("ordinal"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    rows = views.members(spark, sf_dir).select("ordinal", "name").join(html, "ordinal")
    name = F.concat(F.lit(f"{top}/"), F.expr("ordinal div 256").cast("string"), F.lit("-"), F.least(F.col("ordinal") % 7, F.lit(3)).cast("string"), F.lit(".zip"))
    content = F.when(F.col("name").endswith("/"), F.lit(b"")).otherwise(F.col("content"))
    ranges.put(rows.select("ordinal", "name", content.alias("content"), name.alias("path")).groupBy("path").applyInArrow(_zipped, "path string, content binary"))
    return top


_DIRECTORY = f"""d AS (SELECT page_id // 256 || '-' || least(page_id % 7, 3) || '.zip' AS archive, (row_number() OVER (PARTITION BY page_id // 256, least(page_id % 7, 3) ORDER BY page_id) - 1)::BIGINT AS ordinal,
  name, name LIKE '%/' AS is_dir, CASE WHEN name LIKE '%/' THEN '' ELSE coalesce(html, '') END AS html FROM pages JOIN members ON page_id = members.ordinal),
e AS (SELECT *, octet_length(encode(html))::BIGINT AS size, count(*) OVER a AS members, sum(octet_length(encode(html))) OVER a AS bytes FROM d WINDOW a AS (PARTITION BY archive)),
r AS (SELECT *, CASE WHEN members > {_MEMBERS} THEN 'too_many_members' WHEN bytes > {_BYTES} THEN 'expanded_size' WHEN NOT is_dir AND size > {_MEMBER} THEN 'member_size_limit' ELSE '' END AS reason FROM e)"""


@query("members", sql=f"WITH {_DIRECTORY} SELECT archive, ordinal, name, is_dir, size, reason FROM r")
def s5_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories against the quotas; no member is read."""
    top = _archives(spark, sf_dir)
    found = archives.within(archives.directory(spark, top), _MEMBERS, _BYTES, _MEMBER)
    return found.select(_below(F.col("archive"), top).alias("archive"), "ordinal", "name", "is_dir", "size", "reason")


@query("members", sql=f"WITH {_DIRECTORY} SELECT archive, ordinal, reason, CASE WHEN reason = '' AND NOT is_dir THEN sha256(html) END AS sha256 FROM r")
def s7_member_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of the members that keep the quotas, by byte ranges."""
    top = _archives(spark, sf_dir)
    found = archives.read_zips(spark, top, _MEMBER, _MEMBERS, _BYTES)
    return found.select(_below(F.col("archive"), top).alias("archive"), "ordinal", "reason", F.sha2("content", 256).alias("sha256"))


@query(sql="""WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS rows FROM documents)
SELECT ordinal, CASE WHEN doc_id % 7 <> 3 THEN doc_id END AS doc_id, CASE WHEN doc_id % 7 <> 3 THEN n_chars END AS n_chars, CASE WHEN doc_id % 7 = 3 THEN substr('{"doc_id": ' || doc_id || repeat('é', 600), 1, 500) END AS head
FROM n WHERE ordinal >= rows // 4 AND ordinal < rows // 4 + rows // 2""")
def s14_line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle half of a JSON-lines folder, a seventh of whose lines is malformed."""
    path, docs = folder(spark, "lines"), views.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    broken = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.repeat(F.lit("é"), 600))
    line = F.when(F.col("doc_id") % 7 == 3, broken).otherwise(F.to_json(F.struct("doc_id", "n_chars")))
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    rows = docs.count()
    good, bad = tables.read_lines(spark, path, "doc_id long, n_chars long", rows // 4, rows // 2, split=20_000)
    return good.withColumn("head", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@query(sql="""SELECT coalesce(lang, 'und') AS run, count(*) AS images, sum(n_chars)::BIGINT AS chars, count(*) % 2 = 0 AS has_review FROM documents GROUP BY 1""")
def s25_run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each language, half of them, by their size, with a review queue."""
    top = folder(spark, "runs")
    runs = views.table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("und")).alias("run")).agg(F.count(F.lit(1)).alias("images"), F.sum("n_chars").alias("chars"))
    ranges.put(runs.select(F.concat(F.lit(f"{top}/"), "run", F.lit("/summary.json")).alias("path"), F.encode(F.to_json(F.struct("images", "chars")), "UTF-8").alias("content")))
    ranges.put(runs.where("images % 2 = 0").select(F.concat(F.lit(f"{top}/"), "run", F.lit("/review/review.csv")).alias("path"), F.lit(b"review_id\n").alias("content")))
    reviews = tables.runs_with_reviews(spark, top).withColumn("has_review", F.lit(True))
    found = tables.read_runs(spark, top).select("run", "images", "chars").join(reviews, "run", "left")
    return found.withColumn("has_review", F.coalesce("has_review", F.lit(False)))
