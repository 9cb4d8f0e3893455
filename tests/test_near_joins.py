"""Joins by keys of hashes: never through the driver, and the hash against plain code."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rasterloom.operators import graph as G
from rasterloom.plans import views


def hashes(spark, n, seed):
    rng = random.Random(seed)
    rows, seen = [], []
    for i in range(n):
        h = rng.choice(seen) if seen and rng.random() < 0.5 else rng.getrandbits(63)
        for _ in range(rng.randrange(9)):
            h ^= 1 << rng.randrange(63)
        seen.append(h)
        rows.append((i, h))
    return rows, spark.createDataFrame(rows, "id long, h long")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_not_broadcast(spark):
    rows, df = hashes(spark, 300, 1)
    near = G.near_pairs(df)
    values = sorted({h for _, h in rows})
    want = {(a, b, (a ^ b).bit_count()) for a in values for b in values if a < b and (a ^ b).bit_count() <= 6}
    assert {tuple(r) for r in near.collect()} == want and want
    assert "BroadcastExchange" not in plan(near)


def test_held_out_keys_are_not_broadcast(spark):
    rows, df = hashes(spark, 200, 2)
    df = df.withColumnRenamed("h", "phash")
    near = G.near_any(df.where("id % 3 <> 0"), df.where("id % 3 = 0"))
    held = {h for i, h in rows if i % 3 == 0}
    want = {h for i, h in rows if i % 3 and any((h ^ g).bit_count() <= 6 for g in held)}
    assert {r.h for r in near.collect()} == want and want
    assert "BroadcastExchange" not in plan(near)


def test_the_median_is_sorted_for_once(spark):
    """An embedding's hash against plain code; the sort stands outside of the loop over bits."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.25]) for _ in range(64)]) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    floats = {r.vec_id: r.embedding for r in df.collect()}
    plain = lambda e: sum(1 << (i - 1) for i in range(1, 64) if e[i] > sorted(e[1:])[31]) if e else 0
    found = df.select("vec_id", F.expr(views._hash("embedding")).alias("h"))
    assert {r.vec_id: r.h for r in found.collect()} == {k: plain(e) for k, e in floats.items()}
    text = views._hash("embedding")
    assert text.index("array_sort") < text.index("sequence")
