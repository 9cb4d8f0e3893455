"""Label text files: number lines, class names, pose export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbers(line: Column) -> Column:
    """A line's numbers, or null if it has fewer than five fields or one is no number."""
    fields = F.split(F.trim(line), r"\s+")
    found = F.transform(fields, lambda x: x.try_cast("double"))
    return F.when((F.size(fields) >= 5) & F.forall(found, lambda x: x.isNotNull()), found)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path and numbers of each well-formed line of the label files under `path`."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    return text.select(F.input_file_name().alias("path"), numbers(F.col("value")).alias("numbers")).where("numbers IS NOT NULL")


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """(path, class_id, name) from the three usual forms of a `names:` entry: an inline
    list, a list of dashes, or numbered keys."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    body = F.regexp_extract("value", r"(?ms)^names:[ \t]*(.*?)(?=^\w|\z)", 1)
    inline = F.filter(F.split(F.regexp_extract(body, r"\[([^\]]*)\]", 1), ","), lambda x: F.trim(x) != "")
    dashed = F.regexp_extract_all(body, F.lit(r"(?m)^\s*-\s*(.+?)\s*$"), 1)
    keyed = F.regexp_extract_all(body, F.lit(r"(?m)^\s*(\d+\s*:\s*.+?)\s*$"), 1)
    clean = lambda x: F.trim(F.regexp_replace(x, "[\"']", ""))
    ordinal = lambda xs: F.transform(xs, lambda x, i: F.struct(i.alias("class_id"), clean(x).alias("name")))
    numbered = F.transform(keyed, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("class_id"), clean(F.regexp_replace(x, r"^\d+\s*:\s*", "")).alias("name")))
    found = F.when(F.size(keyed) > 0, numbered).when(F.size(dashed) > 0, ordinal(dashed)).otherwise(ordinal(inline))
    return text.select("path", F.explode(found).alias("c")).select("path", "c.class_id", "c.name")


def pose_lines(points: DataFrame) -> DataFrame:
    """One label line per image: the whole-image box and x y v of each keypoint."""
    shown = F.col("status") == "present"
    one = F.when(shown, F.format_string("%.6f %.6f 2", "x", "y")).otherwise("0 0 0")
    ordered = F.sort_array(F.collect_list(F.struct("line", "k", one.alias("t"))))
    image = points.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda p: p["t"]), " ").alias("t"))
    return image.select("image_id", F.concat(F.lit("0 0.5 0.5 1 1 "), "t").alias("label"))


def write_pose(points: DataFrame, splits: DataFrame, path: str) -> None:
    """Label lines in a folder for each split."""
    pose_lines(points).join(splits, "image_id").select(F.col("label").alias("value"), "split").write.partitionBy("split").mode("overwrite").text(path)
