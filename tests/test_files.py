"""Archives read by byte ranges under quotas, and lines found through an index of splits."""

from __future__ import annotations

import json
import random
import struct
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.plans import q_files, registry
from rasterloom.sources import archives, files, ranges, tables


def archive(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)


def read(spark, path, **limits):
    return {(r.archive.rsplit("/", 1)[1], r.ordinal): r for r in archives.read_zips(spark, str(path), **limits).collect()}


def test_quotas_come_before_any_read(spark, tmp_path, monkeypatch):
    archive(tmp_path / "many.zip", [(f"{i}.png", b"x") for i in range(6)])
    archive(tmp_path / "wide.zip", [(f"{i}.png", b"x" * 300) for i in range(3)])
    archive(tmp_path / "fits.zip", [("a.png", b"y" * 100), ("d/", b""), ("b.png", b"y" * 101), ("c.png", b"")])
    (tmp_path / "bad.zip").write_bytes(b"PK no directory")
    (tmp_path / "empty.zip").write_bytes(b"")
    found = read(spark, tmp_path, member_limit=100, most_members=5, most_bytes=800)
    assert {r.reason for (a, _), r in found.items() if a == "many.zip"} == {"too_many_members"}
    assert {r.reason for (a, _), r in found.items() if a == "wide.zip"} == {"expanded_size"}
    assert [found["fits.zip", i].reason for i in range(4)] == ["", "", "member_size_limit", ""]
    assert found["fits.zip", 0].content == b"y" * 100 and found["fits.zip", 1].content is None and found["fits.zip", 3].content == b""
    assert found["bad.zip", -1].reason == "bad_archive" and ("empty.zip", -1) not in found
    assert all(r.content is None for r in found.values() if r.reason)


def test_headers_that_lie(spark, tmp_path):
    """A member that unpacks to more than it declares is cut at one byte over the limit."""
    archive(tmp_path / "lie.zip", [("bomb.png", b"\0" * 5_000_000), ("small.png", b"z" * 60), ("sum.png", b"q" * 60)])
    data = bytearray((tmp_path / "lie.zip").read_bytes())
    at = [i for i in range(len(data)) if data[i : i + 4] == b"PK\1\2"]
    data[at[0] + 24 : at[0] + 28] = struct.pack("<I", 50)  # declared size
    data[at[1] + 24 : at[1] + 28] = struct.pack("<I", 59)
    data[at[2] + 16 : at[2] + 20] = struct.pack("<I", 1)  # checksum
    (tmp_path / "lie.zip").write_bytes(data)
    found = read(spark, tmp_path, member_limit=100)
    assert [found["lie.zip", i].reason for i in range(3)] == ["member_size_limit", "unreadable", "unreadable"]


def test_cut_off_encrypted_and_other_methods(spark, tmp_path):
    archive(tmp_path / "lzma.zip", [("a.png", b"a" * 500)], zipfile.ZIP_LZMA)
    archive(tmp_path / "stored.zip", [("a.png", b"a" * 3_000_000), ("b.png", bytes(range(256)) * 9000)], zipfile.ZIP_STORED)
    archive(tmp_path / "locked.zip", [("a.png", b"a")])
    data = bytearray((tmp_path / "locked.zip").read_bytes())
    data[data.index(b"PK\1\2") + 8] |= 1
    (tmp_path / "locked.zip").write_bytes(data)
    archive(tmp_path / "moved.zip", [("a.png", b"a" * 50)])
    data = bytearray((tmp_path / "moved.zip").read_bytes())
    data[0:4] = b"XXXX"
    (tmp_path / "moved.zip").write_bytes(data)
    found = read(spark, tmp_path)
    assert {a: r.reason for (a, i), r in found.items() if i == 0} == {"lzma.zip": "unreadable", "stored.zip": "", "locked.zip": "unreadable", "moved.zip": "unreadable"}
    assert found["stored.zip", 0].content == b"a" * 3_000_000 and found["stored.zip", 1].content == bytes(range(256)) * 9000


def test_members_of_one_archive_are_shared_by_tasks(spark, tmp_path, monkeypatch):
    archive(tmp_path / "one.zip", [(f"{i}.png", random.Random(i).randbytes(5000)) for i in range(40)], zipfile.ZIP_STORED)
    monkeypatch.setattr(archives, "TASK_BYTES", 20_000)
    rows = archives.contents(archives.directory(spark, str(tmp_path)))
    assert rows.where("content IS NOT NULL AND length(content) = size").count() == 40
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_the_queries_meet_every_reason(spark):
    found = q_files.s7_member_contents(spark, "/root/testdata/sf0.01").groupBy("reason").count().collect()
    assert {r.reason for r in found} == {"", "too_many_members", "expanded_size", "member_size_limit"}


@pytest.mark.parametrize("split", [1, 2, 7, 64, 1000])
def test_every_slice_of_every_split(spark, tmp_path, split):
    rng = random.Random(split)
    texts = {"a.jsonl": "", "b.jsonl": "\n", "c.jsonl": "".join("é" * rng.randrange(9) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(12)), "d.jsonl": "x\ny\nno end"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    lines = [line.rstrip("\r") for name in sorted(texts) for line in (texts[name][:-1] if texts[name].endswith("\n") else texts[name]).split("\n") if texts[name]]
    index = tables.line_index(spark, str(tmp_path), split)
    for offset, count in ((0, 1000), (3, 4), (len(lines) - 1, 5), (0, 1), (len(lines), 3)):
        found = sorted((r.ordinal, r.value) for r in tables.slice_lines(index, offset, count).collect())
        assert found == list(enumerate(lines))[offset : offset + count]


def test_a_slice_opens_only_its_splits(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text("".join(json.dumps({"a": i}) + "\n" for i in range(5000)))
    index = tables.line_index(spark, str(tmp_path), 1000)
    good, bad = tables.read_lines(spark, str(tmp_path), "a int", 2500, 10, index)
    assert [r.a for r in good.orderBy("ordinal").collect()] == list(range(2500, 2510)) and bad.count() == 0
    assert index.where("first < 2510 AND first + lines > 2500").count() <= 2
    assert "Sort" not in good._jdf.queryExecution().executedPlan().toString()


def test_a_byte_order_mark_and_malformed_records(spark, tmp_path):
    (tmp_path / "l.jsonl").write_bytes(b'\xef\xbb\xbf{"a":1}\n{bad ' + b"x" * 900 + b'\n\n{"a":4}')
    good, bad = tables.read_lines(spark, str(tmp_path), "a int", 0, 10)
    assert sorted((r.ordinal, r.a) for r in good.collect()) == [(0, 1), (3, 4)]
    assert sorted((r.ordinal, len(r.head)) for r in bad.collect()) == [(1, 500), (2, 0)]


def test_runs_with_reviews(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run / "review").mkdir(parents=True)
        (tmp_path / run / "summary.json").write_text("{}")
    (tmp_path / "r2/review/review.csv").write_text("id\n")
    assert [r.run for r in tables.runs_with_reviews(spark, str(tmp_path)).collect()] == ["r2"]


def test_the_listing_has_files_of_no_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "ENTRIES", 2)
    for name, data in (("a/1.png", b""), ("a/b/2 %20.JPG", b"xy"), ("a/b/3.txt", b"z"), ("4.tif", b"q" * 9), ("_c/5.png", b"")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "none").mkdir()
    for top in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        found = {(r.path.split(f"{tmp_path}/")[1], r.length) for r in files.listing(spark, top).collect()}
        assert found == {("a/1.png", 0), ("a/b/2 %20.JPG", 2), ("4.tif", 9), ("_c/5.png", 0)}
    assert {r.reason for r in files.probed(spark, str(tmp_path), 5).collect()} == {"bad_read", "file_size_limit"}
    assert files.listing(spark, str(tmp_path / "none")).count() == 0


def test_image_files_of_odd_documents(spark, tmp_path):
    """Empty and null texts, repeated names, and rows without a name, against the SQL."""
    rows = [(0, "", "s"), (1, None, "s"), (2, "", "s"), (3, "é", "s"), (3, "other", "s"), (3, "other", "s"), (5, "x", None), (5, "", None), (4, "y", None), (None, "z", "s"), (6, "", "a b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    key = lambda r: tuple(map(str, r))
    for query in (q_files.s1_image_listing, q_files.s2_image_count):
        want = duck.execute(registry.ORACLES[query.__name__]).fetchall()
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)
