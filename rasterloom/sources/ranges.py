"""Byte ranges of files, read and written by tasks through Arrow's file systems.

Spark lists the files (`listed`), or tasks do (`walked`); a task then opens only the bytes it needs, so that one large file is
shared by many tasks and nothing is held whole."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import written


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; plain paths are local ones."""
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)
    return fs.FileSystem.from_uri(path)


def opened(path: str) -> pa.NativeFile:
    system, name = located(path)
    return system.open_input_file(name)


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of all files below `path`; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


#: Tasks that list the folders of one depth, at most; entries handed on at a time.
LISTING_TASKS, ENTRIES = 1000, 10_000
_ENTRY = pa.schema([("path", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))])


def _entries(folder: str) -> Iterator[tuple]:
    system, name = located(folder)
    top = folder.removesuffix(name)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(name) as found:
            for x in found:
                at = x.stat()
                yield top + x.path, x.is_dir(), at.st_size, datetime.fromtimestamp(at.st_mtime, timezone.utc)
    else:
        for x in system.get_file_info(fs.FileSelector(name)):
            yield top + x.path, x.type == fs.FileType.Directory, x.size, x.mtime


def walked(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of all files below `path`, also of those of no bytes,
    which Spark's listing leaves out. Tasks list the folders, one depth after another, and
    write what they find, so that the driver holds no file's name."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for entry in _entries(folder):
                    rows.append(entry)
                    if len(rows) == ENTRIES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], schema=_ENTRY)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], schema=_ENTRY)

    files, folders, n = None, spark.createDataFrame([(path.rstrip("/"),)], "path string"), 1
    while n:
        level = written(dealt(folders, tasks=min(n, LISTING_TASKS)).mapInArrow(found, "path string, is_dir boolean, length long, modificationTime timestamp"), "listing")
        here = level.where("NOT is_dir").drop("is_dir")
        files = here if files is None else files.unionByName(here)
        folders = level.where("is_dir").select("path")
        n = folders.count()
    return files


#: Most tasks that rows naming pieces of work are dealt to.
MOST_TASKS = 100_000


def dealt(rows: DataFrame, *by, tasks: int | None = None) -> DataFrame:
    """`rows`, which name pieces of work, dealt to `tasks` tasks (one a row if None). A number
    is given so that Spark does not join partitions because their rows are small."""
    return rows.repartition(min(MOST_TASKS, max(1, rows.count() if tasks is None else tasks)), *by)


def put(files: DataFrame) -> None:
    """Writes each row (path, content) as a file. A task that runs again writes the same."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, made = 0, set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                system, name = located(path)
                if (top := name.rsplit("/", 1)[0]) not in made:
                    made = made if len(made) < ENTRIES else set()
                    system.create_dir(top, recursive=True)
                    made.add(top)
                with system.open_output_stream(name) as out:
                    out.write(content.as_py())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    files.select("path", "content").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
