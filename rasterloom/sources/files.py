"""Image listings by tasks, bounded reads, and decoding through Spark's image source."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import IMAGE_SUFFIXES
from .ranges import dealt, opened, walked

MAX_BYTES, MAX_PIXELS, MAX_SIDE = 20 << 20, 16_000_000, 8192
#: Files that a task reads, about.
TASK_FILES = 1000


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """All image files under `path`, also those of no bytes: path, length, modificationTime."""
    return walked(spark, path).where(is_image(F.col("path")))


def count_images(spark: SparkSession, path: str) -> int:
    return listing(spark, path).select("path").count()


def png_size(data: bytes) -> tuple[int, int] | None:
    if data[:8] != b"\x89PNG\r\n\x1a\n" or len(data) < 24:
        return None
    return struct.unpack(">II", data[16:24])


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 if kind in (0xFF, 0xD8, 0x01) or 0xD0 <= kind <= 0xD7 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def probed(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, length, sha256, width, height, reason: limits are checked on the listing and
    the header, before anything is decoded."""
    images = listing(spark, path).select("path", "length")
    small = images.where(F.col("length") <= max_bytes)
    large = images.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("string").alias("sha256"), *[F.lit(None).cast("int").alias(c) for c in ("width", "height")])

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sums, found = [], []
            for name in pdf["path"]:
                with opened(name) as file:
                    content = file.read()
                sums.append(hashlib.sha256(content).hexdigest())
                found.append(png_size(content) or jpeg_size(content) or (None, None))
            yield pdf.assign(sha256=sums, width=pd.array([w for w, _ in found], "Int32"), height=pd.array([h for _, h in found], "Int32"))

    read = dealt(small, tasks=-(-small.count() // TASK_FILES)).mapInPandas(sizes, "path string, length long, sha256 string, width int, height int")
    both = read.unionByName(large)
    w, h = F.col("width"), F.col("height")
    reason = (
        F.when(F.col("length") > max_bytes, "file_size_limit").when(w.isNull(), "bad_read")
        .when((w > MAX_SIDE) | (h > MAX_SIDE) | (w.cast("long") * h > MAX_PIXELS), "pixel_limit").otherwise("")
    )
    return both.withColumn("reason", reason)


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Decoded rasters of valid images: path, height, width, nChannels, data."""
    image = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return image.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def pixels_of(rasters: DataFrame) -> DataFrame:
    """Single-channel rasters as pixel rows (path, y, x, v)."""
    gray = rasters.where("nChannels = 1")
    values = F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("int"))
    rows = gray.select("path", "width", F.posexplode(values).alias("pos", "v"))
    return rows.select("path", F.expr("pos div width").cast("int").alias("y"), (F.col("pos") % F.col("width")).alias("x"), "v")
