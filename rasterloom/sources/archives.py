"""Archive members: ZIP files as a table, quotas before any read, and admission rules.

`directory` reads the central directory at each archive's end and nothing else; `within`
compares its counts and declared sizes with the quotas; `contents` then reads the members'
byte ranges, many tasks an archive. What a member declares is not trusted: it is unpacked
up to one byte over its limit and held against its declared size and checksum."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ranges import dealt, listed, opened

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
#: Limits of an archive: members, declared bytes of all, bytes of one member.
MOST_MEMBERS, MOST_BYTES, MEMBER_LIMIT = 50_000, 8 << 30, 100 << 20
#: Members of a directory that are handed on at a time; bytes read at a time; bytes of content
#: that a task holds before it hands them on, and packed bytes that a task reads, about.
ROWS, PIECE, HELD, TASK_BYTES = 10_000, 1 << 20, 32 << 20, 64 << 20

DIRECTORY = "archive string, ordinal long, name string, is_dir boolean, size long, packed long, method int, flags int, crc long, offset long, reason string"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]


def _batch(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in schema.split(", ")])


def directory(spark: SparkSession, path: str) -> DataFrame:
    """One row for each member of each ZIP file below `path`, from the directories alone; a
    file without one is a row of ordinal -1 and the reason ``bad_archive`` (Spark's listing
    leaves out files of no bytes; `archive_name_reason` tells of them). Archives are the
    unit of tasks here: a directory is some 50 bytes a member."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with opened(archive) as file:
                    try:
                        infos = zipfile.ZipFile(file).infolist()
                    except (zipfile.BadZipFile, OSError, ValueError, struct.error):
                        yield _batch([(archive, -1, None, False, 0, 0, 0, 0, 0, 0, "bad_archive")], _TYPES, DIRECTORY)
                        continue
                for at in range(0, len(infos), ROWS):
                    rows = [(archive, at + i, m.filename, m.is_dir(), m.file_size, m.compress_size, m.compress_type, m.flag_bits, m.CRC, m.header_offset, "") for i, m in enumerate(infos[at : at + ROWS])]
                    yield _batch(rows, _TYPES, DIRECTORY)

    return dealt(listed(spark, path, "*.zip").select("path"), "path").mapInArrow(members, DIRECTORY)


def within(members: DataFrame, most_members: int = MOST_MEMBERS, most_bytes: int = MOST_BYTES, member_limit: int = MEMBER_LIMIT) -> DataFrame:
    """`reason` from what the directories declare: ``too_many_members`` or ``expanded_size``
    for all of an archive, then ``member_size_limit`` for one member."""
    totals = members.groupBy("archive").agg(F.count(F.lit(1)).alias("_members"), F.sum(F.greatest("size", F.lit(0))).alias("_bytes"))
    whole = F.when(F.col("_members") > most_members, "too_many_members").when(F.col("_bytes") > most_bytes, "expanded_size")
    one = F.when(~F.col("is_dir") & (F.col("size") > member_limit), "member_size_limit")
    return members.join(totals, "archive").withColumn("reason", F.coalesce(F.nullif("reason", F.lit("")), whole, one, F.lit(""))).drop("_members", "_bytes")


def _unpacked(file: pa.NativeFile, offset: int, packed: int, method: int, most: int) -> tuple[bytes | None, int]:
    """The member at `offset`, or None where it is longer than `most`, and its checksum."""
    file.seek(offset)
    head = file.read(30)
    if head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile("no member here")
    file.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    parts, total, crc = [], 0, 0
    while packed > 0 and total <= most:
        raw = file.read(min(PIECE, packed))
        if not raw:
            raise zipfile.BadZipFile("cut off")
        packed -= len(raw)
        while raw and total <= most:
            piece = inflate.decompress(raw, most + 1 - total) if inflate else raw
            raw = inflate.unconsumed_tail if inflate else b""
            parts.append(piece)
            total += len(piece)
            crc = zlib.crc32(piece, crc)
            if inflate and inflate.eof:
                raw = b""
    return (b"".join(parts) if total <= most else None), crc


def contents(members: DataFrame, member_limit: int = MEMBER_LIMIT) -> DataFrame:
    """`members` with `content`: null where there is a reason, which is ``unreadable`` for a
    member that is encrypted, packed by another method, cut off or not what it declares,
    and ``member_size_limit`` for one that unpacks to more than the limit."""
    schema = DIRECTORY + ", content binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, file, open_path = [], 0, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                archive, _, _, is_dir, size, packed, method, flags, crc, offset, reason = row
                content = None
                if not reason and not is_dir:
                    if archive != open_path:
                        file, open_path = opened(archive), archive
                    try:
                        if flags & 1 or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                            raise zipfile.BadZipFile("encrypted or packed by another method")
                        content, found = _unpacked(file, offset, packed, method, member_limit)
                        if content is None:
                            reason = "member_size_limit"
                        elif found != crc or len(content) != size:
                            content, reason = None, "unreadable"
                    except (zipfile.BadZipFile, zlib.error, OSError, struct.error):
                        reason = "unreadable"
                rows.append((*row[:-1], reason, content))
                held += len(content or b"")
                if held > HELD or len(rows) == ROWS:
                    yield _batch(rows, [*_TYPES, pa.binary()], schema)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, [*_TYPES, pa.binary()], schema)

    # members next to each other in an archive go to one task, about TASK_BYTES a group
    group = F.floor(F.col("offset") / TASK_BYTES)
    columns = [c.split()[0] for c in DIRECTORY.split(", ")]
    packed_bytes = members.where("reason = ''").agg(F.sum("packed")).first()[0] or 0
    rows = dealt(members, "archive", group, tasks=packed_bytes // TASK_BYTES + 1)
    return rows.sortWithinPartitions("archive", "offset").select(*columns).mapInArrow(read, schema)


def read_zips(spark: SparkSession, path: str, member_limit: int = MEMBER_LIMIT, most_members: int = MOST_MEMBERS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All members of all archives that keep the quotas, with their content."""
    return contents(within(directory(spark, path), most_members, most_bytes, member_limit), member_limit)


def cap_members(members: DataFrame, admitted: Column, most: int) -> DataFrame:
    """Adds `reason`: members of an archive after the first `most` admitted ones."""
    order = Window.partitionBy("archive", admitted).orderBy("ordinal")
    return members.withColumn("reason", F.when(admitted & (F.row_number().over(order) > most), "max_images").otherwise(""))


def admit(members: DataFrame, largest: int = 100 << 20, max_images: int = 20_000) -> DataFrame:
    """Adds `reason`, empty for admitted members: path, extension, size, repeated name,
    then the cap on images. An archive is the unit: its members are numbered together."""
    name = F.col("name")
    kind = "|".join(IMAGE_SUFFIXES)
    rule = (
        F.when(C.safe_member_path(name).isNull() | name.endswith("/"), "unsafe_path").when(~F.lower(name).rlike(rf"\.({kind})$"), "extension")
        .when((F.col("size") < 1) | (F.col("size") > largest), "size")
    )
    rows = members.withColumn("_rule", rule)
    again = F.row_number().over(Window.partitionBy("archive", "name", F.col("_rule").isNull()).orderBy("ordinal")) > 1
    rows = rows.withColumn("_rule", F.when(F.col("_rule").isNotNull(), F.col("_rule")).when(again, "duplicate"))
    capped = cap_members(rows, F.col("_rule").isNull(), max_images)
    return capped.withColumn("reason", F.coalesce("_rule", "reason")).drop("_rule")


def admit_archives(members: DataFrame, most_members: int, most_bytes: int) -> DataFrame:
    """Per archive: `reason` from the declared counts and sizes, without content."""
    out = members.groupBy("archive").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"))
    reason = F.when(F.col("members") > most_members, "too_many_members").when(F.col("bytes") > most_bytes, "expanded_size").otherwise("")
    return out.select("archive", reason.alias("reason"), "members", "bytes")


def archive_name_reason(path: Column, length: Column, most: int) -> Column:
    """Why a file is no usable archive, from its listing alone."""
    low = F.lower(path)
    return (
        F.when(~low.rlike(r"\.(zip|rar)$"), "extension").when(low.rlike(r"\.part\d+\.rar$"), "multipart").when(length == 0, "empty").when(length > most, "compressed_size").otherwise("")
    )
