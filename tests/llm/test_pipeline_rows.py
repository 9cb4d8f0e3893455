"""The pipeline's stages row by row against plain versions, with odd rows and without any."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from rasterloom.llm import queries

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


def test_stages_by_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["toxicity"](spark, docs, SF)
    flagged = {r.doc_id for r in queries.op9_toxicity(spark, SF).where("predicted = 1").collect()}
    assert ids(kept) == [(i, t) for i, t in ids(docs) if i not in flagged]

    first: dict[str, int] = {}
    for i, text in ids(docs):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text), i)
    assert [i for i, _ in ids(stages["exact_dedup"](spark, docs, SF))] == sorted(first.values())

    one = {r.doc_id for r in stages["near_dedup"](spark, docs, SF).select("doc_id").collect()}
    groups: dict[int, set[int]] = {}
    for r in queries.op5_near_dedup(spark, SF).collect():
        groups.setdefault(r.class_id, set()).add(r.doc_id)
    assert all(len(members & one) == 1 for members in groups.values()) and one == {min(m) for m in groups.values()}

    coded = {r.doc_id: r for r in stages["bpe"](spark, docs, SF).collect()}
    assert coded == {r.doc_id: r for r in queries.op10_bpe(spark, SF).collect()}


@pytest.mark.parametrize("rows", [0, 6])
def test_odd_rows_and_none(spark, tmp_path, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None), (1, ""), (1, ""), (2, None), (3, "long " * 60_000), (4, "a b\tc")][:rows]
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    for f in docs.schema:
        if f.name not in frame.columns:
            frame = frame.selectExpr("*", f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}")
    frame.select(*docs.columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[:2] == ["doc_id", "n_tokens"] and got.count() <= rows
