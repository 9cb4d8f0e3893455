"""Language-model scores against a dictionary-wise version of the same model."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import lm_scoring as lm

SCHEMA = "doc_id long, text string, train boolean, id string, words int"


def rows(n: int = 120) -> list[tuple]:
    import random

    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "été"]
    found = []
    for i in range(n):
        words = [vocabulary[min(41, int(rng.expovariate(0.15)))] for _ in range(rng.choice((0, 1, 3, 20, 60)))]
        found.append((i, " \t".join(words), i % 4 != 2, "x", 0))
    found += [(n, None, True, "x", 0), (n + 1, "", False, "x", 0), (n + 2, " \n ", True, "x", 0), (None, "w1 w2 W3", None, None, None), (0, found[0][1], True, "x", 0), (n + 3, "zz yy w1", False, "x", 0)]
    return found + [(n + 4, "w0 w1 " * 900 + "end", True, "x", 0), (n + 5, "w3 w0 w1 w2 " * 700, False, "x", 0)]


def tokens(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return ["<s>", *[w for w in re.split(r"[\x20\x09-\x0D]+", low) if w], "</s>"]


def plain(data: list[tuple], order: int) -> tuple[dict, callable]:
    counts = {k: Counter() for k in range(1, order + 1)}
    for _, text, train, *_ in data:
        if train is not False:
            t = tokens(text)
            for k in counts:
                counts[k].update(tuple(t[i - k + 1 : i + 1]) for i in range(max(k - 1, 0), len(t)))
    starts = counts[1].get(("<s>",), 0)
    words = Counter({w: c for w, c in counts[1].items() if w != ("<s>",)})
    total, known = sum(words.values()), len(words)

    def stats(c: Counter) -> tuple:
        values = list(c.values())
        return len(values), values.count(1), values.count(2)

    discount, power = {}, {}
    _, n1, n2 = stats(words)
    discount[1] = n1 / (n1 + 2 * n2) if n1 else 0.5
    for k in range(2, order + 1):
        distinct, n1, n2 = stats(counts[k])
        discount[k] = min(0.999, max(0.001, n1 / (n1 + 2 * n2))) if n1 else 0.5
        sizes = Counter()
        sums = Counter()
        for h, c in (words if k == 2 else counts[k - 1]).items():
            sizes[int(math.log2(c))] += 1
            sums[int(math.log2(c))] += c
        low, high = 0.0, 1.0
        for _ in range(40):
            a = (low + high) / 2
            low, high = (a, high) if sum(n * (sums[b] / n) ** a for b, n in sizes.items()) < distinct else (low, a)
        power[k] = (low + high) / 2

    def p(history: tuple, w: str) -> float:
        if not history:
            if not total:
                return 1.0
            return max(words.get((w,), 0) - discount[1], 0) / total + discount[1] * known / total / (known + 1)
        seen = starts if history == ("<s>",) else counts[len(history)].get(history, 0)
        if not seen:
            return p(history[1:], w)
        k = len(history) + 1
        b = discount[k] * seen ** (power[k] - 1)
        return (1 - b) * counts[k].get((*history, w), 0) / seen + b * p(history[1:], w)

    return {"total": total, "known": known, "words": words}, p


@pytest.mark.parametrize(("order", "block_words"), [(1, 10**6), (2, 50), (3, 300)])
def test_scores_equal_the_dictionary_version(spark, order, block_words, monkeypatch):
    monkeypatch.setattr(lm, "ranges_for", lambda n: 4)
    data = rows()
    base, p = plain(data, order)
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = lm.score(docs, F.col("train"), order=order, block_words=block_words).collect()
    assert len(found) == len(data)
    expected = Counter()
    for doc_id, text, train, *_ in data:
        t = tokens(text)
        total = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t)))
        plain_base = sum(math.log10((base["words"].get((w,), 0) + 1) / (base["total"] + base["known"] + 1)) for w in t[1:])
        expected[(doc_id, train is not False, len(t) - 1, sum((w,) in base["words"] for w in t[1:]), round(plain_base, 5), round(total, 5))] += 1
    assert Counter((r["id"], r["train"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in found) == expected
    assert {r["train_tokens"] for r in found} == {base["total"]}


def test_probabilities_have_the_sum_one():
    data = rows(40)
    base, p = plain(data, 3)
    vocabulary = [w for (w,) in base["words"]] + ["<unknown>"]
    for history in [(), ("<s>",), ("w0",), ("w0", "w1"), ("<s>", "w1"), ("never", "w1")]:
        assert abs(sum(p(history, w) for w in vocabulary) - 1) < 1e-9


def test_no_rows_and_no_training_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lm.score(none, F.col("train")).collect() == []
    held = spark.createDataFrame([(1, "a b", False, "x", 0), (2, None, False, "x", 0)], SCHEMA)
    assert sorted((r["id"], r["n_tokens"], r["n_known"], r["score"], r["base_score"]) for r in lm.score(held, F.col("train")).collect()) == [(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]


def test_held_out_documents_score_above_unigrams(spark):
    from rasterloom.llm import queries

    found = queries.op11_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.9 * found[1]
