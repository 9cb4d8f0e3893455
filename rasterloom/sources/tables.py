"""Manifest files: CSV, JSON and JSON lines, reports and stored models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import written
from .ranges import dealt, listed, opened


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with all columns as text; an empty one is an error."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if rows.isEmpty():
        raise ValueError(f"the manifest {path} has no rows")
    return rows


def write_manifest(parts: Sequence[DataFrame], path: str, first: Sequence[str] = ()) -> None:
    """CSV of several tables: preferred columns first, the others sorted, gaps empty."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    lead = [c for c in first if c in rows.columns]
    rows.select(*lead, *sorted(c for c in rows.columns if c not in lead)).write.mode("overwrite").option("header", True).csv(path)


def no_nans(rows: DataFrame) -> DataFrame:
    """`rows`, with a failure of the job where a double is NaN or infinite."""
    doubles = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")]
    for c in doubles:
        bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        rows = rows.withColumn(c, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c)))
    return rows


def write_documents(rows: DataFrame, path: str) -> None:
    no_nans(rows).write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a schema; a malformed one is an error."""
    return no_nans(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def write_routed(rows: DataFrame, accepted: Column, path: str) -> None:
    """JSON lines in one folder for labels that pass and one for those to review."""
    route = F.when(accepted, "auto_labels").otherwise("manual_review")
    rows.withColumn("route", route).write.mode("overwrite").partitionBy("route").json(path)


#: Bytes of a split of the line index; bytes read at a time.
SPLIT, PIECE = 64 << 20, 1 << 20
_LINES = "path string, start long, bytes long, lines long"


def line_index(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """One row for each split of the files below `path`, in their order: path, start, bytes,
    lines that begin in it, and `first`, the number of lines before it. It is written, to be
    kept with the files. Splits are counted by many tasks; only the running sum, of a row a
    split, is one task's."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for name, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(name) as file:  # a line begins after each line feed but the file's last byte
                    file.seek(max(0, start - 1))
                    left, n = size - int(start == 0), int(start == 0)
                    while left > 0 and (piece := file.read(min(PIECE, left))):
                        n, left = n + piece.count(b"\n"), left - len(piece)
                lines.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64())], ["path", "start", "bytes", "lines"])

    files = listed(spark, path).where("length > 0")
    splits = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))))
    splits = splits.select("path", "start", F.least(F.lit(split), F.col("length") - F.col("start")).cast("long").alias("bytes"))
    before = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    lines = dealt(splits, "path", "start").mapInArrow(counted, _LINES)
    return written(lines.withColumn("first", F.coalesce(F.sum("lines").over(before), F.lit(0)).cast("long")), "line-index")


def slice_lines(index: DataFrame, offset: int, count: int) -> DataFrame:
    """ordinal, value: lines `offset` to ``offset + count`` of an indexed file or folder. Only
    the splits that hold them are opened, and each only as far as the last line."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, size, first in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "bytes", "first"))):
                with opened(name) as file:
                    yield from _split_lines(file, start, size, first, offset, offset + count)

    needed = index.where((F.col("first") < offset + count) & (F.col("first") + F.col("lines") > offset))
    return dealt(needed, "path", "start").mapInArrow(lines, "ordinal long, value string")


def _split_lines(file: pa.NativeFile, start: int, size: int, ordinal: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Lines with numbers from `low` to `high` that begin in the split."""
    file.seek(max(0, start - 1))
    at, rest, skip = max(0, start - 1), b"", start > 0
    while ordinal < high:
        piece = file.read(PIECE)
        *whole, tail = (rest + piece).split(b"\n")
        if not piece:
            whole, tail = ([tail] if tail else []), b""
        found, numbers = [], []
        for line in whole:
            if skip:
                skip = False
            elif at >= start + size or ordinal >= high:
                ordinal = high
                break
            else:
                if ordinal >= low:
                    found.append(line.decode("utf-8-sig" if at == 0 else "utf-8", "replace").rstrip("\r"))
                    numbers.append(ordinal)
                ordinal += 1
            at += len(line) + 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.string())], ["ordinal", "value"])
        rest = tail
        if not piece or at >= start + size:
            break


def read_lines(spark: SparkSession, path: str, schema: str, offset: int, count: int, index: DataFrame | None = None, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Records `offset` to ``offset + count`` of JSON-lines files, and the malformed ones
    among them with their first 500 characters. An `index` that is kept saves its count."""
    lines = slice_lines(line_index(spark, path, split) if index is None else index, offset, count)
    parsed = lines.withColumn("record", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("record._corrupt_record").isNotNull() | F.col("record").isNull()
    return parsed.where(~bad).select("ordinal", "record.*").drop("_corrupt_record"), parsed.where(bad).select("ordinal", F.substring("value", 1, 500).alias("head"))


def import_metadata(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata rows that may be used, and the others with the rules they break."""
    rows = spark.read.option("header", True).schema("source_path string, subject_id string, source_group string, mirrored string, handedness string").csv(path)
    counts = rows.groupBy("source_path").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("source_path", F.lit(True).alias("_twice"))
    marked = rows.join(counts, "source_path", "left").join(known.select(F.col("path").alias("_known")).distinct(), F.col("source_path") == F.col("_known"), "left")
    rules = F.array_compact(F.array(
        F.when(F.col("_twice"), "repeated"), F.when(F.col("_known").isNull(), "unknown_path"),
        F.when(~F.coalesce("mirrored", F.lit("unknown")).isin("unknown", "yes", "no"), "mirrored"), F.when(~F.coalesce("handedness", F.lit("unknown")).isin("unknown", "left", "right"), "handedness"),
    ))
    marked = marked.withColumn("violations", rules).drop("_twice", "_known")
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def report(rows: DataFrame, reason: str, group: str, sample: int, errors: Column | None = None, fallback: str = "no error") -> DataFrame:
    """One row: counts by reason, number of groups, the first rejected paths, and the first
    error text in path order, or the fallback text where no row has one."""
    blank = F.coalesce(F.nullif(F.col(reason), F.lit("")), F.lit("accepted"))
    counts = rows.groupBy(blank.alias("r")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "n")))).alias("counts"))
    groups = rows.agg(F.countDistinct(group).alias("groups"))
    shown = rows.where(F.col(reason) != "").select("path", reason).orderBy("path").limit(sample).agg(F.array_sort(F.collect_list(F.struct("path", reason))).alias("rejected"))
    text = F.nullif(errors, F.lit("")) if errors is not None else F.lit(None).cast("string")
    error = rows.agg(F.coalesce(F.min_by(text, F.when(text.isNotNull(), F.col("path"))), F.lit(fallback)).alias("error"))
    return counts.join(groups).join(shown).join(error)  # four tables of one row


def save_model(model: DataFrame, path: str, version: str) -> None:
    """Parameters as Parquet, with a metadata row of version, size and digest."""
    model.write.mode("overwrite").parquet(f"{path}/parameters")
    digest(model).withColumn("version", F.lit(version)).write.mode("overwrite").json(f"{path}/metadata")


def digest(model: DataFrame) -> DataFrame:
    row = F.sha2(F.to_json(F.struct(*sorted(model.columns))), 256)
    return model.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("digest"))


def load_model(spark: SparkSession, path: str, version: str) -> DataFrame:
    model, meta = no_nans(spark.read.parquet(f"{path}/parameters")), spark.read.json(f"{path}/metadata").first()
    found = digest(model).first()
    if (meta.version, meta.rows, meta.digest) != (version, found.rows, found.digest):
        raise ValueError(f"the model in {path} is not version {version} or was changed")
    return model


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of all runs below `path`, with the run's name."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").json(path)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"), "*").orderBy("run")


def runs_with_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Names of the runs that own a review queue, from the listing alone."""
    return listed(spark, path, "review.csv").where(F.col("path").endswith("/review/review.csv")).select(F.element_at(F.split("path", "/"), -3).alias("run")).distinct()
