"""Known answers of the validity rules and of the resizes."""

from __future__ import annotations

import pytest
from rasterloom.operators import graph as G
from rasterloom.operators import keypoints as K
from rasterloom.operators import pixels as X

GOOD = [(0.1 + 0.15 * i, 0.5) for i in range(6)]
NAN = float("nan")
CASES = {
    "": (GOOD, 0.95, 100.0),
    "invalid_keypoints": ([*GOOD[:5], (NAN, 0.5)], 0.95, 100.0),
    "missing_keypoints": (GOOD[:5], 0.95, 100.0),
    "out_of_bounds": ([*GOOD[:5], (1.01, 0.5)], 0.1, 1.0),
    "invalid_palm_reference": (GOOD, 0.1, 3.99),
    "invalid_confidence": (GOOD, 1.2, 4.0),
    "low_keypoint_confidence": (GOOD, 0.89, 100.0),
    "low_keypoint_confidence,duplicate_or_collapsed_keypoints": ([*GOOD[:5], GOOD[4]], 0.5, 100.0),
    "duplicate_or_collapsed_keypoints": ([*GOOD[:5], (0.7005, 0.5)], 0.95, 1000.0),
    "keypoint_order_or_sharp_turn": ([*GOOD[:5], (0.6, 0.5)], 0.95, 100.0),
    "keypoint_self_intersection": ([(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.5, 0.8), (0.5, 0.1), (0.5, 0.05)], 0.95, 100.0),
    "low_keypoint_confidence,keypoint_order_or_sharp_turn,keypoint_self_intersection": ([(0.2, 0.5), (0.8, 0.5), (0.8, 0.55), (0.3, 0.2), (0.9, 0.21), (0.95, 0.3)], 0.2, 100.0),
}


def test_reasons_in_their_order(spark):
    rows = [(n, 0, k, x, y, c, palm) for n, (points, c, palm) in enumerate(CASES.values()) for k, (x, y) in enumerate(points)]
    rows += [(90, 0, k, x, None if k == 2 else y, 0.95, 100.0) for k, (x, y) in enumerate(GOOD)] + [(91, 0, k, x, y, None, 100.0) for k, (x, y) in enumerate(GOOD)] + [(92, 0, k, x, y, 0.95, None) for k, (x, y) in enumerate(GOOD)]
    df = spark.createDataFrame(rows, "image_id long, line int, k int, x double, y double, confidence double, palm_width double")
    got = {r.image_id: ",".join(r.reasons) for r in K.validity(df, 501, 401).collect()}
    assert got == dict(enumerate(CASES)) | {90: "invalid_keypoints", 91: "invalid_confidence", 92: "invalid_palm_reference"}
    assert {r.reasons[0] for r in K.validity(df, 1, 401).collect()} == {"invalid_keypoints"}
    assert K.validity(df.limit(0), 501, 401).count() == 0


def raster(spark, w, h, image=1):
    return [(image, y, x, 10 * y + x) for y in range(h) for x in range(w)]


@pytest.mark.parametrize(("w", "h", "size"), [(8, 8, 3), (8, 5, 13), (3, 7, 4), (1, 9, 5), (4, 4, 4), (5, 2, 2)])
def test_letterbox_and_area(spark, w, h, size):
    df = spark.createDataFrame(raster(spark, w, h), "image_id long, y int, x int, v int")
    scale = size / max(w, h)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    x0, y0 = (size - nw) // 2, (size - nh) // 2
    got = {(r.y, r.x): r.v for r in X.letterbox_nearest(df, size, 7).collect()}
    inside = lambda y, x: y0 <= y < y0 + nh and x0 <= x < x0 + nw
    assert got == {(y, x): 10 * ((y - y0) * h // nh) + (x - x0) * w // nw if inside(y, x) else 7 for y in range(size) for x in range(size)}
    if scale <= 1:
        share = lambda o, s, n, side: max(0, min((o + 1) * side, (s + 1) * n) - max(o * side, s * n))
        found = {(r.y, r.x): r.v for r in X.resize_area(df, size).collect()}
        assert set(found) == {(y, x) for y in range(nh) for x in range(nw)}
        for (y, x), v in found.items():
            parts = [(share(y, sy, nh, h) * share(x, sx, nw, w), 10 * sy + sx) for sy in range(h) for sx in range(w)]
            assert abs(v - sum(p * s for p, s in parts) / sum(p for p, _ in parts)) < 1e-9


def test_values_and_members_hold_all_pairs(spark):
    rows = [(i, h) for i, h in enumerate([0, 0, 1, 1, 1, 127, 63, 2**62, 2**62 + 3, 2**40 - 1])]
    df = spark.createDataFrame(rows, "id long, h long")
    value = {r.id: r.value for r in G.hash_members(df).collect()}
    near = {(r.a, r.b): r.distance for r in G.value_pairs(df).collect()}
    assert len(near) < len(G.row_pairs(df).collect())
    for r in G.row_pairs(df).collect():
        a, b = sorted((value[r.a], value[r.b]))
        assert (0 if a == b else near[a, b]) == r.distance
