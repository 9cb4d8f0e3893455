"""Perceptual hashes of rasters with equal transform terms, against the SQL."""

from __future__ import annotations

import random

import duckdb

from rasterloom.plans import registry

#: An image of `check_s`; two of its terms are 0.875, the median.
TIED = """143 138 131 137 130 103 148 150 118 104 112 138 118 134 114 141 124 90 158 122 143 119 143 146 119 134 105 138 116 152 115 95
121 134 141 119 128 140 136 150 121 104 104 153 140 149 140 117 141 119 146 118 136 133 139 116 135 122 154 108 111 109 130 115"""


def test_equal_terms_round_as_in_the_sql(spark, tmp_path):
    rng = random.Random(4)
    rasters = [list(map(int, TIED.split())), [7] * 64]
    for _ in range(60):  # few values, and mirror images
        half = [[rng.choice((0, 1, 255)) for _ in range(4)] for _ in range(8)]
        rasters.append([v for row in half for v in row + row[::-1]])
        rasters.append([rng.randrange(2) for _ in range(64)])
    rows = [(i, [(v + 0.5) / 127.5 - 1 for v in r], 0) for i, r in enumerate(rasters)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = dict(duck.execute(registry.ORACLES["k1_perceptual_hash"]).fetchall())
    found = {r.image_id: r.phash for r in registry.QUERIES["k1_perceptual_hash"](spark, str(tmp_path)).collect()}
    assert found[0] == "62d8d5838edb0af0" and found == want
