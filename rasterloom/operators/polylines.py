"""Polyline and raster jobs: curve length, rasterisation, hulls, perceptual hashes,
thinning and principal paths. A polyline or raster is one row or group and the parallel
unit; numpy works on it inside a task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = 257
#: A curve is cut off for shape outside these (turn in degrees is checked on its points).
MAX_CURVATURE, LENGTH_RATIO = 35.0, (0.08, 3.5)


def natural_coordinates(points: np.ndarray) -> np.ndarray:
    """Chord-length parameters, 0 to 1."""
    steps = np.hypot(*np.diff(points, axis=0).T)
    u = np.r_[0.0, np.cumsum(steps)]
    return u / u[-1]


def cubic_pieces(u: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Coefficients (degree, piece) of the not-a-knot cubic through (u, values)."""
    n, h = len(u) - 1, np.diff(u)
    a, b = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
    for i in range(1, n):  # continuity of the first derivative, in second derivatives
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((values[i + 1] - values[i]) / h[i] - (values[i] - values[i - 1]) / h[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[n, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    return np.array([values[:-1], (values[1:] - values[:-1]) / h - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m) / (6 * h)])


def curve(points: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Length, sampled points and curvature at the samples of the cubic through points."""
    u = natural_coordinates(points)
    x, y = (cubic_pieces(u, c) for c in points.T)

    def at(t: np.ndarray, order: int) -> np.ndarray:
        k = np.clip(np.searchsorted(u, t, side="right") - 1, 0, len(u) - 2)
        d = t - u[k]
        out = []
        for c in (x[:, k], y[:, k]):
            out.append([c[0] + d * (c[1] + d * (c[2] + d * c[3])), c[1] + d * (2 * c[2] + 3 * d * c[3]), 2 * c[2] + 6 * d * c[3]][order])
        return np.array(out).T

    nodes, weights = np.polynomial.legendre.leggauss(24)
    length = 0.0
    for lo, hi in zip(u[:-1], u[1:]):
        t = (lo + hi) / 2 + (hi - lo) / 2 * nodes
        length += (hi - lo) / 2 * float(weights @ np.hypot(*at(t, 1).T))
    t = np.linspace(0, 1, SAMPLES)
    d1, d2 = at(t, 1), at(t, 2)
    bend = np.abs(d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]) / np.maximum(np.hypot(*d1.T) ** 3, 1e-12)
    return length, at(t, 0), bend


def curves(lines: DataFrame, width: int, height: int) -> DataFrame:
    """`lines` has xs, ys (arrays of normal coordinates) and palm_width; adds length,
    curvature and reasons."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            length, bend, reasons = [], [], []
            for xs, ys, palm in zip(pdf["xs"], pdf["ys"], pdf["palm_width"]):
                p = np.array([xs, ys], float).T * [width - 1, height - 1]
                if len(p) < 4 or not np.isfinite(p).all() or (np.hypot(*np.diff(p, axis=0).T) < max(0.25, palm * 0.002)).any():
                    length.append(None)
                    bend.append(None)
                    reasons.append(["collapsed"])
                    continue
                size, sampled, k = curve(p)
                found = []
                if (sampled < -0.01).any() or (sampled > np.array([width - 1, height - 1]) + 0.01).any():
                    found.append("overshoot")
                if (k * palm).max() > MAX_CURVATURE:
                    found.append("curvature")
                if not LENGTH_RATIO[0] <= size / palm <= LENGTH_RATIO[1]:
                    found.append("length")
                length.append(size)
                bend.append(float((k * palm).max()))
                reasons.append(found)
            yield pdf.assign(length=pd.array(length, "Float64"), curvature=pd.array(bend, "Float64"), reasons=reasons)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.mapInPandas(measure, f"{fields}, length double, curvature double, reasons array<string>")


def rasterised(segments: DataFrame, thickness: int = 1) -> DataFrame:
    """Pixels of segments (image_id, class_id, x1, y1, x2, y2), one value a pixel: the
    highest class drawn there."""
    steps = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")), F.lit(1))
    on = segments.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    part = F.col("_i") / F.col("_n")
    x, y = F.bround(F.col("x1") + part * (F.col("x2") - F.col("x1"))).cast("int"), F.bround(F.col("y1") + part * (F.col("y2") - F.col("y1"))).cast("int")
    reach = F.sequence(F.lit(-((thickness - 1) // 2)), F.lit(thickness // 2))
    wide = on.select("image_id", "class_id", x.alias("x"), y.alias("y")).withColumn("_dx", F.explode(reach)).withColumn("_dy", F.explode(reach))
    return wide.groupBy("image_id", (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x")).agg(F.max("class_id").alias("class_id"))


def hulls(points: DataFrame) -> DataFrame:
    """Convex hull of each image's points (x, y) as directed edges (x1, y1, x2, y2)."""

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ps = sorted(set(zip(pdf["x"], pdf["y"])))
        half = []
        for order in (ps, ps[::-1]):
            part: list = []
            for p in order:
                while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]) <= 0:
                    part.pop()
                part.append(p)
            half += part[:-1]
        rows = [(key[0], *a, *b) for a, b in zip(half, half[1:] + half[:1])] if len(half) > 2 else []
        return pd.DataFrame(rows, columns=["image_id", "x1", "y1", "x2", "y2"])

    return points.groupBy("image_id").applyInPandas(chain, "image_id long, x1 double, y1 double, x2 double, y2 double")


def inside_hull(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """The pixels that lie on the inner side of every edge of their image's hull."""
    c = F.col
    side = (c("x2") - c("x1")) * (c("y") - c("y1")) - (c("y2") - c("y1")) * (c("x") - c("x1")) >= 0
    joined = pixels.join(edges, "image_id").groupBy("image_id", "y", "x").agg(F.every(side).alias("_in"))
    return joined.where("_in").drop("_in")


def dct_terms(rasters: np.ndarray) -> np.ndarray:
    """The lowest 8 x 8 DCT terms of square rasters, given as rows. Terms that are equal differ
    by their rounding, and which of them is over the median hangs on it: so products and sums
    are taken pixel after pixel, in the order that the query's SQL writes them."""
    side = math.isqrt(rasters.shape[1])
    low = range(min(8, side))
    scale = np.array([math.sqrt((2.0 if k else 1.0) / side) for k in low])
    cos = np.array([[math.cos(math.pi * (2 * i + 1) * k / (2 * side)) for k in low] for i in range(side)])
    out = np.zeros((len(rasters), len(low), len(low)))
    for pos in range(side * side):
        y, x = divmod(pos, side)
        out += rasters[:, pos, None, None] * scale[:, None] * cos[y][:, None] * scale * cos[x]
    return out


def perceptual_hash(values: Column) -> Column:
    """16 hex digits: signs (against the median) of the 63 lowest DCT terms after the
    first of a square raster, given as an array, lowest bit first."""

    @F.pandas_udf("string")
    def hashed(rows: pd.Series) -> pd.Series:
        out, lengths = pd.Series("", rows.index, "object"), rows.map(len)
        for n in lengths.unique():
            same = rows[lengths == n]
            low = dct_terms(np.array(same.tolist(), float).reshape(len(same), n)).reshape(len(same), -1)[:, 1:]
            bits = low > np.median(low, axis=1, keepdims=True)
            out[same.index] = [f"{sum(1 << i for i in np.flatnonzero(b).tolist()):016x}" for b in bits]
        return out

    return hashed(values)


def thinned(grid: np.ndarray, rounds: int = 100) -> np.ndarray:
    """One-pixel skeleton of a boolean raster: border pixels are peeled in two alternating
    passes while that keeps what they connect."""
    g = np.pad(grid.astype(bool), 1)
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    for _ in range(rounds):
        before = g.sum()
        for skip in ((0, 2, 4, 6), (0, 2, 6, 4)):
            around = np.array([np.roll(g, (-dy, -dx), (0, 1)) for dy, dx in ring])
            n, s, e, w = around[0], around[4], around[2], around[6]
            count = around.sum(axis=0)
            rises = (~around & np.roll(around, -1, axis=0)).sum(axis=0)
            blocked = (n & e & s) | (e & s & w) if skip[2] == 4 else (n & e & w) | (n & s & w)
            g &= ~(g & (count >= 2) & (count <= 6) & (rises == 1) & ~blocked)
        if g.sum() == before:
            break
    return g[1:-1, 1:-1]


def thin_masks(pixels: DataFrame, skeletonise: Callable[[np.ndarray], np.ndarray] = thinned) -> DataFrame:
    """Skeleton pixels of each image's mask pixels, by an injected thinning function."""

    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = pdf["y"].min(), pdf["x"].min()
        grid = np.zeros((pdf["y"].max() - y0 + 1, pdf["x"].max() - x0 + 1), bool)
        grid[pdf["y"] - y0, pdf["x"] - x0] = True
        y, x = np.nonzero(skeletonise(grid))
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": y + y0, "x": x + x0})

    return pixels.select("image_id", "y", "x").groupBy("image_id").applyInPandas(job, "image_id long, y int, x int")


def principal_paths(edges: DataFrame, least_pixels: int = 5, coverage: float = 0.60, dominance: float = 0.65) -> DataFrame:
    """Longest shortest path between endpoints of each image's largest skeleton part:
    length, its share of the part's pixels and of all pixels, and a reason if it fails."""
    import heapq

    def job(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[tuple, dict[tuple, float]] = {}
        for y, x, y2, x2, w in zip(pdf["y"], pdf["x"], pdf["y2"], pdf["x2"], pdf["weight"]):
            near.setdefault((y, x), {})[(y2, x2)] = w
            near.setdefault((y2, x2), {})[(y, x)] = w
        parts, seen = [], set()
        for node in near:
            if node not in seen:
                part, todo = {node}, [node]
                while todo:
                    for other in near[todo.pop()]:
                        if other not in part:
                            part.add(other)
                            todo.append(other)
                seen |= part
                parts.append(part)
        part = max(parts, key=len)
        ends = [n for n in part if len(near[n]) == 1]
        row = [key[0], None, len(part) / len(near), None, ""]
        columns = ["image_id", "length", "dominance", "coverage", "reason"]
        if len(part) < least_pixels:
            row[4] = "too_short"
        elif not 2 <= len(ends) <= 32:
            row[4] = "endpoints"
        if row[4]:
            return pd.DataFrame([row], columns=columns)
        best, path = 0.0, 0
        for start in ends:
            far, steps, heap = {start: 0.0}, {start: 1}, [(0.0, start)]
            while heap:
                d, node = heapq.heappop(heap)
                if d > far[node]:
                    continue
                for other, w in near[node].items():
                    if d + w < far.get(other, np.inf):
                        far[other], steps[other] = d + w, steps[node] + 1
                        heapq.heappush(heap, (d + w, other))
            for stop in ends:
                if far.get(stop, 0) > best:
                    best, path = far[stop], steps[stop]
        row[1], row[3] = best, path / len(part)
        row[4] = "coverage" if row[3] < coverage else "dominance" if row[2] < dominance else ""
        return pd.DataFrame([row], columns=columns)

    return edges.groupBy("image_id").applyInPandas(job, "image_id long, length double, dominance double, coverage double, reason string")


def line_measures(paths: DataFrame, palms: DataFrame, least_ratio: float = 0.08) -> DataFrame:
    """Length of a line in palm widths (twice the inscribed radius), and if it counts."""
    ratio = F.col("length") / (2 * F.col("radius"))
    return paths.join(palms, "image_id").withColumn("length_norm", ratio).withColumn("detected", F.coalesce((F.col("reason") == "") & (ratio >= least_ratio), F.lit(False)))


def line_response(rasters: DataFrame, lengths: tuple[int, ...] = (5, 9, 13), angles: int = 6) -> DataFrame:
    """Directional black-hat response of rasters (image_id, height, width, data): the most
    that closing along any of a fan of short lines adds to a pixel."""

    def shift(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
        y, x = np.clip(np.arange(a.shape[0]) + dy, 0, a.shape[0] - 1), np.clip(np.arange(a.shape[1]) + dx, 0, a.shape[1] - 1)
        return a[np.ix_(y, x)]

    def response(grid: np.ndarray) -> np.ndarray:
        best = np.zeros(grid.shape)
        for size in lengths:
            for k in range(angles):
                t, reach = np.pi * k / angles, size // 2
                offsets = {(round(r * np.sin(t)), round(r * np.cos(t))) for r in range(-reach, reach + 1)}
                wide = np.max([shift(grid, *o) for o in offsets], axis=0)
                best = np.maximum(best, np.min([shift(wide, *o) for o in offsets], axis=0) - grid)
        return best

    def job(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [response(np.frombuffer(d, "u1").reshape(h, w).astype(float)).astype("u1").tobytes() for h, w, d in zip(pdf["height"], pdf["width"], pdf["data"])]
            yield pdf.assign(response=out)

    return rasters.select("image_id", "height", "width", "data").mapInPandas(job, "image_id long, height int, width int, data binary, response binary")
