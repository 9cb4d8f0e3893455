"""Scans over ranges and blocks against plain loops, with groups cut many times."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import annotations as A
from rasterloom.operators import windows as W


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_edits_in_blocks(spark, block):
    rng = random.Random(block)
    rows, expected = [], {}
    for key in (1, 2, 3, None):
        now, n = 0, {1: 60, 2: 1, 3: 25, None: 20}[key]
        for seq in range(1, n + 1):
            base = rng.choice([now, now, now, now + 1, max(0, now - 1), 0, None])
            ok = base == now
            now += ok
            rows.append((key, seq, base, "x"))
            expected[key, seq] = ok, now
    log = spark.createDataFrame(rows, "key long, seq long, base long, block string").repartition(5)
    got = {(r.key, r.seq): (bool(r.accepted), r.current) for r in A.accepted_edits(log, "key", "seq", "base", block).collect()}
    assert got == expected
    assert A.accepted_edits(log.limit(0), "key", "seq", "base", block).count() == 0


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_next_pending_over_ranges(spark, many_ranges):
    rng = random.Random(1)
    rows = [(g, i, rng.random() < p) for g, n, p in (("a", 200, 0.03), ("b", 40, 0.0), ("c", 1, 1.0), ("d", 30, 0.5), (None, 20, 0.2)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, p boolean")
    got = {(r.g, r.i): r.next_pending for r in W.next_pending(df, "g", "i", F.col("p")).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((i, p) for h, i, p in rows if h == g)
        for at, (i, _) in enumerate(mine):
            turn = mine[at + 1 :] + mine[:at]
            assert got[g, i] == next((j for j, p in turn if p), -1)
    assert W.ranged(df, "g", "i").where("g = 'a'").select("_part").distinct().count() > 1


@pytest.mark.parametrize("stretch", [1, 5, 100_000])
def test_stability_by_stretches(spark, many_ranges, stretch):
    import numpy as np

    rng = random.Random(2)
    rows = [(c, i, i // 2, rng.choice([0.5, 0.52, 0.9]), rng.choice([0.01, 0.4])) for c, n in ((1, 60), (2, 2), (3, 14)) for i in range(n)]
    got = {(r.camera, r.frame_id): r.stable for r in W.stability(spark.createDataFrame(rows, "camera long, frame_id long, ts long, m1 double, m2 double"), ["m1", "m2"], limit=0.3, stretch=stretch).collect()}
    assert len(got) == len(rows)
    for c in (1, 2, 3):
        mine = [r for r in rows if r[0] == c]
        for at, r in enumerate(mine):
            x = np.array([m[3:] for m in mine[max(0, at - 11) : at + 1]])
            mean, std = x.mean(axis=0), x.std(axis=0)
            use = mean > 0.03
            assert got[c, r[1]] == bool(len(x) >= 3 and use.any() and round(float(np.percentile(std[use] / mean[use], 80)), 9) < 0.3)


def test_positions(spark, many_ranges):
    rows = [(g, i) for g, n in (("a", 100), ("b", 3)) for i in range(n)]
    got = Counter((r.g, r.i, r._n) for r in W.positions(spark.createDataFrame(rows, "g string, i long"), "g", "i").collect())
    assert got == Counter((g, i, i) for g, i in rows)
