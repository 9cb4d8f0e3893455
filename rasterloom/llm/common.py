"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of the white space that counts as a separator of words.
SPACES = r"[\x20\x09-\x0D]+"


def give_back() -> None:
    """Called at the end of a Python task: idle workers live on, so what the task has freed
    goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new
    temporary folder where that is unset in local mode (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """`df` written to the shared folder and read back: later steps read the table
    instead of running its lineage again, also after executors are lost. Files have at most
    `rows` rows, if that is given: writers and readers hold a file of few large rows whole."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a table of ids that is broadcast; above it, the join shuffles.
BROADCAST_IDS = 1_000_000


def small_side(ids: DataFrame) -> DataFrame:
    """A written table of ids as the side of a join: broadcast if it is small."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def mark(text: Column) -> Column:
    """Tells rows of one id by their texts."""
    return F.xxhash64(text)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` without the rows that the written table `gone` (id, mark) names; null ids
    and null texts count as values."""
    same = docs[id_col].cast("long").eqNullSafe(gone["id"]) & mark(docs[text_col]).eqNullSafe(gone["mark"])
    return docs.join(small_side(gone), same, "left_anti")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out of all training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
