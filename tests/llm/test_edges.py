"""Long conversations, large vectors and large groups of near copies."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterloom.llm import chat, near_dedup, queries, vector_search


def formatted(spark, convs):
    schema = "conv_id long, turns array<struct<role:string,text:string>>, formatted string, loss string, x int"
    df = spark.createDataFrame([(i, [(r, t) for r, t in turns], "?", "?", 0) for i, turns in convs.items()], schema)
    out = chat.format_conversations(df.drop("formatted", "loss")).withColumn("masked", chat.masked_text(F.col("formatted"), F.col("loss")))
    return {r.conv_id: r for r in out.collect()}


def test_spans_and_masks_of_long_conversations(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(["a", "é", "😀", "<|im_end|>", "\\", "\n", "x" * 700]) for _ in range(rng.choice((0, 1, 5))))
    convs = {n: [(rng.choice(["user", "assistant", "a\\n\nb"]), text()) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 257, 1000)}
    for n, r in formatted(spark, convs).items():
        assistants = [t for role, t in convs[n] if role == "assistant"]
        assert r.masked == "".join(assistants) and len(r.loss) == len(assistants)
        for span, t in zip(r.loss, assistants):
            assert r.formatted[span.start : span.end].replace("<\\|", "<|") == t


def test_a_conversation_of_many_turns_takes_seconds(spark):
    convs = {1: [("user" if i % 2 else "assistant", f"turn {i} " + "y" * (i % 80)) for i in range(16_000)]}
    formatted(spark, {0: convs[1][:10]})
    began = time.time()
    assert len(formatted(spark, convs)[1].masked) == sum(len(t) for role, t in convs[1] if role == "assistant")
    assert time.time() - began < 20


def test_chat_query_over_no_rows_and_extra_columns(spark, tmp_path):
    rows = spark.createDataFrame([], "conv_id long, turn int, role string, text string, loss string, turns string, formatted string")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op2_chat_format(spark, str(tmp_path)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(-1, 2, 34)]
    rows = spark.createDataFrame([(1, 0, None, None, "l", "t", "f"), (1, 0, None, None, "l", "t", "f"), (None, 1, "assistant", "", "l", "t", "f")], rows.schema)
    rows.write.parquet(str(tmp_path / "b/conversations.parquet"))
    assert {(r.conv_id, r.n_turns) for r in queries.op2_chat_format(spark, str(tmp_path / "b")).collect()} == {(-1, 2), (1, 2), (None, 1)}


def test_products_past_64_bits(spark):
    big = float(1 << 40)
    vecs = [(0, [big, big, -big]), (1, [big, big, 0.0]), (2, [-big, -big, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [big * 1e20] * 3), (0, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs], "vec_id long, vec array<double>, score string")
    got = [(r["item_id"], r["score"]) for r in vector_search.top_k(df.where("vec_id = 0 AND vec[0] > 1"), df, 10).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (4, 2**63 - 1), (3, 1 << 40), (2, -(2**63 - 1))]
    assert vector_search.top_k(df.where("vec_id = 0"), df, 1).count() == 1  # the smaller of its vectors
    assert vector_search.top_k(df.limit(0), df, 3).count() == vector_search.top_k(df, df.limit(0), 3).count() == 0


def test_links_of_a_block_are_fewer_than_its_rows():
    """A second centre with many near copies, none of which the leader is linked to."""
    rng = np.random.default_rng(1)
    for m in (50, 200):
        base = rng.integers(1, 1 << 62, 200, dtype="i8").astype("u8")
        seqs = [base.copy() for _ in range(m)]
        for i, s in enumerate(seqs):
            s[i % 200] = np.uint64(i + 7)
        far = rng.integers(1, 1 << 62, 200, dtype="i8").astype("u8")
        ids = [i.to_bytes(4, "big") for i in range(m)] * 2 + [b"zz"]
        group = pa.table({"id": pa.array(ids, pa.binary()), "rest": [True] * m + [False] * (m + 1), "linked": [False] * (2 * m) + [True], "seq": pa.array([s.tobytes() for s in [*seqs, *seqs, far]], pa.binary())})
        links = near_dedup._crossed(group)
        assert len(links) == m - 1
        joined = {ids[0]}
        pairs = list(zip(links.column("a").to_pylist(), links.column("b").to_pylist()))
        for _ in range(m):
            joined |= {x for p in pairs if joined & set(p) for x in p}
        assert joined == set(ids[:m])


def test_vector_tiles_are_not_broadcast(spark, monkeypatch):
    """Both sides of the tiles' join are shuffled, and few items are not dealt to many groups."""
    monkeypatch.setattr(vector_search, "TILE", 8)
    rows = [(i, [(i * 7919 + j * 31) % 19 - 9 for j in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    found = vector_search.top_k(df.where("vec_id % 10 = 0"), df, 4)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(q, r + 1, *best) for q, v in rows if q % 10 == 0 for r, best in enumerate((i, s) for s, i in sorted((-dot(v, w), i) for i, w in rows if i != q)[:4])}
    assert {(r.query_id, r["rank"], r.item_id, -r.score) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
