"""Operators on small fixtures with known answers."""

import json
import math
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import columns as C
from rasterloom.operators import annotations as A
from rasterloom.operators import graph as G
from rasterloom.operators import keypoints as K
from rasterloom.operators import manifests as M
from rasterloom.operators import pixels as X
from rasterloom.operators import polylines as R
from rasterloom.operators import windows as W
from rasterloom.plans import loops
from rasterloom.sources import archives, files, labels, tables


def png(grid: np.ndarray) -> bytes:
    """A gray PNG file."""
    h, w = grid.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in grid.astype("u1"))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def raster(spark, grid, image_id=1):
    rows = [(image_id, y, x, int(v)) for (y, x), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v int")


def test_paths(spark):
    rows = spark.createDataFrame([("a/./b//c.png",), ("../x",), ("/x",), ("C:\\x",), ("",), ("a\\b",), (None,)], "p string")
    assert [r[0] for r in rows.select(C.safe_member_path(F.col("p"))).collect()] == ["a/b/c.png", None, None, None, None, "a/b", None]
    assert [r[0] for r in rows.limit(1).select(C.normalised_path(F.lit("a/../../b"))).collect()] == [None]


def test_human_bytes(spark):
    rows = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 30,), (3 << 50,)], "n long")
    assert [r[0] for r in rows.select(C.human_bytes(F.col("n"))).collect()] == ["0.0 B", "1023.0 B", "1.5 KB", "5.0 GB", "3072.0 TB"]


def test_image_listing_and_limits(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.PNG").write_bytes(png(np.arange(64).reshape(8, 8)))
    (tmp_path / "a/bad.jpg").write_bytes(b"no image")
    (tmp_path / "a/note.txt").write_text("x")
    assert files.count_images(spark, str(tmp_path)) == 2
    got = {r.path.rsplit("/", 1)[1]: r for r in files.probed(spark, str(tmp_path)).collect()}
    assert (got["x.PNG"].width, got["x.PNG"].height, got["x.PNG"].reason) == (8, 8, "") and got["bad.jpg"].reason == "bad_read"
    pixels = files.pixels_of(files.decoded(spark, str(tmp_path / "a/b")))
    assert sorted((r.y, r.x, r.v) for r in pixels.collect()) == [(i // 8, i % 8, i) for i in range(64)]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, data in (("ok.png", b"1"), ("../up.png", b"2"), ("d/", b""), ("t.txt", b"3"), ("big.png", b"x" * 50), ("empty.png", b"")):
            z.writestr(name, data)
    (tmp_path / "broken.zip").write_bytes(b"zip?")
    rows = archives.read_zips(spark, str(tmp_path), member_limit=20)
    by_name = {r.name: r for r in rows.collect()}
    assert by_name["ok.png"].content == b"1" and by_name["big.png"].reason == "member_size_limit" and by_name[None].reason == "bad_archive"
    admitted = archives.admit(rows.where("ordinal >= 0").drop("reason"), largest=20)
    assert {r.name: r.reason for r in admitted.collect()} == {"ok.png": "", "../up.png": "unsafe_path", "d/": "unsafe_path", "t.txt": "extension", "big.png": "size", "empty.png": "size"}
    assert [r[0] for r in spark.sql("VALUES ('a.part1.rar', 5), ('a.zip', 0), ('a.zip', 50), ('a.7z', 5), ('a.ZIP', 5)").select(archives.archive_name_reason(F.col("col1"), F.col("col2"), 20)).collect()] == ["multipart", "empty", "compressed_size", "extension", ""]


def test_tables(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, b string"), spark.createDataFrame([(2, 0.5)], "k int, a double")
    tables.write_manifest([a, b], str(tmp_path / "m"), ["k"])
    back = tables.read_manifest(spark, str(tmp_path / "m"))
    assert back.columns == ["k", "a", "b"] and back.count() == 2
    with pytest.raises(Exception):
        tables.write_documents(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "d"))
    tables.write_routed(spark.createDataFrame([(1, True), (2, False)], "i int, ok boolean"), F.col("ok"), str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["route=auto_labels", "route=manual_review"]
    (tmp_path / "l.jsonl").write_text("\n".join(['{"a":1}', "{bad", '{"a":3}', '{"a":4}']))
    good, bad = tables.read_lines(spark, str(tmp_path / "l.jsonl"), "a int", 1, 2)
    assert [r.a for r in good.collect()] == [3] and [r.head for r in bad.collect()] == ["{bad"]
    (tmp_path / "meta.csv").write_text("source_path,subject_id,source_group,mirrored,handedness\na,s,g,yes,left\na,s,g,yes,left\nb,s,g,maybe,left\nc,s,g,no,right\n")
    ok, wrong = tables.import_metadata(spark, str(tmp_path / "meta.csv"), spark.createDataFrame([("a",), ("b",), ("c",)], "path string"))
    assert [r.source_path for r in ok.collect()] == ["c"] and sorted(r.violations[0] for r in wrong.collect()) == ["mirrored", "repeated", "repeated"]


def test_model_store(spark, tmp_path):
    model = spark.createDataFrame([(0, "gray", 0.5), (1, "gray", 0.7)], "class_id int, feature string, mean double")
    tables.save_model(model, str(tmp_path / "m"), "v1")
    assert tables.load_model(spark, str(tmp_path / "m"), "v1").count() == 2
    with pytest.raises(ValueError):
        tables.load_model(spark, str(tmp_path / "m"), "v2")
    model.withColumn("mean", F.lit(0.1)).write.mode("overwrite").parquet(str(tmp_path / "m/parameters"))
    with pytest.raises(ValueError):
        tables.load_model(spark, str(tmp_path / "m"), "v1")


def test_runs_and_report(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "summary.json").write_text(json.dumps({"status": "ok", "images": 3}))
    assert [r.run for r in tables.read_runs(spark, str(tmp_path)).collect()] == ["r1", "r2"]
    rows = spark.createDataFrame([("a", "", "g"), ("b", "bad_read", "g"), ("c", "bad_read", "h")], "path string, reason string, grp string")
    got = tables.report(rows, "reason", "grp", 1).first()
    assert got.counts == {"accepted": 1, "bad_read": 2} and got.groups == 2 and [r.path for r in got.rejected] == ["b"]


def test_label_files(spark, tmp_path):
    for i, text in enumerate(("names: [life, 'head line']\nnc: 2\n", "nc: 2\nnames:\n  - life\n  - head line\n", "names:\n  0: life\n  1: head line\nnc: 2\n")):
        (tmp_path / f"d{i}.yaml").write_text(text)
        got = labels.class_names(spark, str(tmp_path / f"d{i}.yaml"))
        assert sorted((r.class_id, r.name) for r in got.collect()) == [(0, "life"), (1, "head line")]
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.txt").write_text("0 0.5 0.5 0.6 0.6 0.2 0.2 0.7 0.3 0.5 0.8 0.6 0.9\n1 2 3\n0 a b c d\n")
    rows = labels.read_lines(spark, str(tmp_path / "l"))
    assert [len(r.numbers) for r in rows.collect()] == [13]
    points = rows.select(C.keypoints(F.slice("numbers", 6, 100), F.lit(10), F.lit(10)).alias("p")).first().p
    assert [(p.x, p.y) for p in points] == [(2, 2), (7, 3), (5, 8), (6, 9)]


def test_twenty_thousand_duplicates(spark):
    rows = spark.range(20_001).select(F.format_string("d/%05d.png", "id").alias("path"), F.lit("same").alias("sha256"))
    got = M.mark_duplicates(rows, "sha256", "path")
    assert got.where("original IS NULL").count() == 1 and got.where("original = 'd/00000.png'").count() == 20_000


def test_numbered(spark):
    rows = M.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"])
    assert sorted((r.k, r.n) for r in rows.collect()) == [(i, i + 1) for i in range(1000)]


def test_banded_join_is_lossless(spark):
    rng = random.Random(12)
    hashes = [rng.getrandbits(63) for _ in range(400)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 8))) for h in hashes[:150]]
    got = {(r.a, r.b) for r in G.row_pairs(spark.createDataFrame(list(enumerate(hashes)), "id long, h long")).collect()}
    want = {(i, j) for i in range(550) for j in range(i + 1, 550) if (hashes[i] ^ hashes[j]).bit_count() <= 6}
    assert got == want
    with pytest.raises(ValueError):
        G.near_pairs(spark.createDataFrame([(1, 1)], "id long, h long"), 7)


def test_components_of_a_long_chain(spark):
    nodes, edges = spark.range(200), spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 99")
    got = G.connected(nodes, edges)
    assert sorted((r.root, r.n) for r in got.groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()) == [(0, 100), (100, 100)]


def test_split_needs_three_groups(spark):
    with pytest.raises(ValueError):
        G.split_groups(spark.range(2).withColumnRenamed("id", "g"), "g", "1")
    got = G.split_groups(spark.range(30).withColumnRenamed("id", "g"), "g", "1").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"test": 3, "val": 3, "train": 24}


def test_confusion_known_answer(spark):
    rows = spark.createDataFrame([(0, 0), (1, 2), (1, 1), (2, 2)], "class_id int, pred_id int")
    got = {r.class_id: r for r in X.class_metrics(X.confusion(rows, 7)).collect()}
    assert got[1].iou == 0.5 and abs(got[1].dice - 2 / 3) < 1e-12 and got[4].iou is None and len(got) == 7


def skeleton(spark, cells):
    rows = spark.createDataFrame([(1, y, x, 1) for y, x in cells], "image_id long, y int, x int, v int")
    return R.principal_paths(X.edges8(rows, F.col("v") > 0)).first()


def test_principal_paths(spark):
    assert abs(skeleton(spark, [(5, x) for x in range(41)]).length - 40) < 1e-9
    assert abs(skeleton(spark, [(i, i) for i in range(41)]).length - 40 * math.sqrt(2)) < 1e-9
    branch = [(50, x) for x in range(101)] + [(50 - i, 50) for i in range(1, 20)]
    assert abs(skeleton(spark, branch).length - 100) < 1e-9
    two = [(0, x) for x in range(20)] + [(9, x) for x in range(18)]
    assert skeleton(spark, two).reason == "dominance"


def test_thinning_and_response(spark):
    grid = np.zeros((20, 40), int)
    grid[8:12, 3:37] = 1
    thin = R.thinned(grid > 0)
    assert 0 < thin.sum() < 40 and not (thin & (grid == 0)).any()
    line = np.full((16, 16), 200)
    line[8] = 50
    rows = spark.createDataFrame([(1, 16, 16, bytearray(line.astype("u1").tobytes()))], "image_id long, height int, width int, data binary")
    out = np.frombuffer(R.line_response(rows).first().response, "u1").reshape(16, 16)
    assert (out[8] == 150).all() and out[:7].max() == 0


def test_pixel_components_and_radius(spark):
    grid = np.zeros((9, 9))
    grid[1:8, 1:8] = 9
    pixels = raster(spark, grid)
    assert X.components(pixels, F.col("v") > 0).select("label").distinct().count() == 1
    got = X.inscribed(pixels, F.col("v") > 0).first()
    assert (got.radius, got.cy, got.cx) == (4.0, 4, 4)


def curve_of(spark, points, w, h):
    rows = spark.createDataFrame([([p[0] for p in points], [p[1] for p in points], 120.0)], "xs array<double>, ys array<double>, palm_width double")
    return R.curves(rows, w, h).first()


def test_curve_lengths(spark):
    assert abs(curve_of(spark, [(0.2 + 0.12 * i, 0.5) for i in range(6)], 501, 401).length - 300) < 1e-6
    arc = [(0.5 * math.cos(t), 0.5 * math.sin(t)) for t in np.linspace(0, math.pi / 2, 6)]
    assert abs(curve_of(spark, arc, 401, 401).length - math.pi * 100) < 0.6
    assert "collapsed" in curve_of(spark, [(0.5, 0.5)] * 6, 401, 401).reasons


def test_resample_and_crossing(spark):
    rows = [(1, 0, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (0.5, 0.0), (0.5, 1.0)])]
    points = spark.createDataFrame(rows, "image_id long, line int, k int, x double, y double")
    got = {r.i: (r.x / 200, r.y / 100) for r in K.resample(points, 201, 101).collect()}
    assert np.allclose([got[1], got[3]], [(0.2, 0.0), (0.5, 0.2)])
    cross = [(1, 0, k, x, y) for k, (x, y) in enumerate([(0.1, 0.1), (0.9, 0.9), (0.9, 0.1), (0.1, 0.9)])]
    assert K.crossings(spark.createDataFrame(cross, points.schema), 101, 101).count() == 1 and K.crossings(points, 101, 101).count() == 0


def test_next_pending_wraps(spark):
    rows = spark.createDataFrame([("g", 0, "pending"), ("g", 1, "approved"), ("g", 2, "pending"), ("h", 3, "approved")], "g string, i int, s string")
    got = {r.i: r.next_pending for r in W.next_pending(rows, "g", "i", F.col("s") == "pending").collect()}
    assert got == {0: 2, 1: 2, 2: 0, 3: -1}


def test_migration_keeps_the_fourth_line(spark):
    rows = spark.sql("SELECT 1 AS schema, 4 AS revision, map('life', 'present', 'fate', 'present') AS lines, CAST(NULL AS string) AS handedness, CAST(NULL AS string) AS mirrored")
    got = A.migrate(rows, ("life", "head", "heart")).first()
    assert (got.revision, got.schema, got.lines, got.legacy_lines, got.handedness) == (5, 2, {"life": "present"}, {"fate": "present"}, "unknown")


def test_hold_out_reason(spark):
    rows = spark.createDataFrame([(1, "s1", "a"), (2, None, "b"), (3, "s3", "c")], "i int, subject_id string, sha256 string")
    held = spark.createDataFrame([("s1", "x"), (None, "b")], "subject_id string, sha256 string")
    got = {r.i: r.reason for r in M.hold_out_reason(rows, held, [("subject_id", "subject"), ("sha256", "content")]).collect()}
    assert got == {1: "subject", 2: "content", 3: None}


def test_hull_and_drawing(spark):
    corners = spark.createDataFrame([(1, 1.0, 1.0), (1, 5.0, 1.0), (1, 5.0, 5.0), (1, 1.0, 5.0), (1, 3.0, 3.0)], "image_id long, x double, y double")
    inside = R.inside_hull(raster(spark, np.zeros((8, 8))).select("image_id", "y", "x"), R.hulls(corners))
    assert inside.count() == 25
    seg = spark.createDataFrame([(1, 3, 0, 0, 3, 3), (1, 2, 0, 3, 3, 0)], "image_id long, class_id int, x1 int, y1 int, x2 int, y2 int")
    assert {(r.y, r.x): r.class_id for r in R.rasterised(seg).collect()}[(1, 1)] == 3


def test_pseudo_label_loop_needs_approved_rows(spark):
    rows = spark.createDataFrame([(1, "pending", "train", "s", "x", 5)], "doc_id long, review_status string, split string, subject_id string, sha256 string, phash long")
    with pytest.raises(ValueError):
        loops.pseudo_labels(rows, raster(spark, np.zeros((2, 2))), ("v",))


def test_numbers_are_consecutive_with_wide_rows(spark):
    """Other columns travel along: partitions must be cut once, whatever their size."""
    from rasterloom.operators import manifests

    rows = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("path"), F.repeat(F.sha2((-F.col("id")).cast("string"), 256), 8).alias("wide"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for parts, size in (("4", "64m"), ("64", "4m")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            got = manifests.numbered(rows, ["path"]).select("n", "path").toPandas().sort_values("path")
            assert got["n"].tolist() == list(range(1, 60_001))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_a_spiral(spark):
    """A path that winds through the whole raster is one component."""
    import numpy as np
    from rasterloom.operators import pixels as X

    grid = np.zeros((21, 21), int)
    y, x, dy, dx = 0, 0, 0, 1
    grid[0, 0] = 1
    for length in [20, 20, 20, *[n for k in range(18, 0, -2) for n in (k, k)]]:
        for _ in range(length):
            y, x = y + dy, x + dx
            grid[y, x] = 1
        dy, dx = dx, -dy
    got = X.components(raster(spark, grid), F.col("v") > 0).select("label").distinct().collect()
    assert [r.label for r in got] == [0]


def test_trailing_counts_across_slots(spark):
    from rasterloom.operators import windows

    times = [0, 5, 9, 10, 11, 19, 20, 20, 21, 40, 41, 95]
    rows = spark.createDataFrame([(1, t) for t in times], "camera int, t long")
    got = sorted((r.t, r.in_window) for r in windows.trailing_count(rows, "camera", F.col("t"), 12, 10).collect())
    assert got == sorted((t, sum(t - 12 <= u <= t for u in times)) for t in times)
