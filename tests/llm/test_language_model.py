"""Nearest-centroid languages by brute force, copies, and the bound on languages."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rasterloom.llm import language_id, queries

SCHEMA = "doc_id long, text string, lang string, source string"
SYLLABLES = {"aa": ["ka", "to", "mi", "su"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["ção", "lh", "ent", "os"], "dd": ["жи", "на", "ст", "ов"]}


def corpus():
    rng = random.Random(4)
    word = lambda parts: "".join(rng.choices(parts, k=rng.randrange(1, 4)))
    rows = []
    for i in range(240):
        lang = rng.choice([*SYLLABLES])
        rows.append((i, " ".join(word(SYLLABLES[lang]) for _ in range(rng.randrange(1, 40))), lang, "s"))
    rows += [(300 + i, rows[i][1], rows[i][2], None) for i in range(5) for _ in range(20)]
    return rows + [(900, "Ka To. 12 mi!", None, "s"), (901, None, "aa", "s"), (902, "", "bb", "s"), (903, "1 2 ½", "cc", "s"), (904, "漢字 漢字", None, None)]


def plain_counts(text):
    data = (" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode()
    return Counter((int.from_bytes(data[i : i + 3], "big") * 2654435761 % 2**32) >> (32 - 13) for i in range(len(data) - 2))


def plain_model(rows):
    """Document frequencies, spherical k-means from far-apart seeds, and radii, by loops."""
    train = [(t, g) for _, t, g in rows if g is not None and t is not None and any(c.isalpha() for c in t)]
    df = Counter(b for t, _ in train for b in set(plain_counts(t)))
    idf = lambda b: math.log((1 + len(train)) / (1 + df[b])) + 1

    def vector(t):
        v = {b: math.log(1 + n) * idf(b) for b, n in plain_counts(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / norm for b, x in v.items()}

    dot = lambda a, b: sum(x * b.get(k, 0.0) for k, x in a.items())
    centroids = []
    for lang in sorted({g for _, g in train}):
        texts = {t for t, g in train if g == lang}
        order = sorted(texts, key=lambda t: (np.array(sorted(c := plain_counts(t)), "i4").tobytes(), np.array([c[b] for b in sorted(c)], "i4").tobytes()))
        xs = [vector(t) for t in order]
        seeds = [0]
        while len(seeds) < min(4, len(xs)):
            seeds.append(min(range(len(xs)), key=lambda i: max(dot(xs[i], xs[j]) for j in seeds)))
        cs = [xs[i] for i in seeds]
        for _ in range(15):
            to = [max(range(len(cs)), key=lambda j: dot(x, cs[j])) for x in xs]
            for j in range(len(cs)):
                if j in to:
                    total = Counter()
                    for x, t in zip(xs, to):
                        if t == j:
                            total.update(x)
                    cs[j] = dict(total)
            norms = [math.sqrt(dot(c, c)) for c in cs]
            cs = [{b: x / n for b, x in c.items()} for c, n in zip(cs, norms)]
        near = [max((dot(x, c), -j) for j, c in enumerate(cs)) for x in xs]
        for j, c in enumerate(cs):
            own = [1 - s for s, k in near if -k == j] or [1 - s for s, _ in near]
            centroids.append((lang, c, 1.25 * float(np.quantile(own, 0.99))))
    return vector, dot, centroids


def test_predictions_equal_a_plain_reckoning(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.op3_language_id(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, r)
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    vector, dot, centroids = plain_model([(i, t, g) for i, t, g, _ in rows if not held[i]])
    for i, text, *_ in rows:
        assert got[i].held_out == held[i]
        if not text or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        v = vector(text)
        scores = [(dot(v, c), lang, radius) for lang, c, radius in centroids]
        best = max(s for s, *_ in scores)
        assert abs(got[i].score - best) < 1e-4
        assert got[i].lang_pred in {lang for s, lang, _ in scores if s > best - 1e-4}
        if all(abs(1 - s - radius) > 1e-3 for s, _, radius in scores if s > best - 1e-4):
            assert got[i].rejected == all(1 - s > radius for s, _, radius in scores if s > best - 1e-4)


def test_copies_and_shared_ids_come_once(spark):
    rows = [(None, "the same text", "en", None)] * 3000 + [(7, f"word {chr(97 + i % 26) * (i // 26 + 1)}", "en", None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    alone = spark.createDataFrame([*dict.fromkeys(rows)], SCHEMA)
    a, b = language_id.fit(df, per_language=10_000), language_id.fit(alone, per_language=10_000)
    assert a.languages == b.languages and a.centroids.shape == b.centroids.shape
    assert language_id.predict(df, a).count() == len(rows) and language_id.predict(df.limit(0), a).count() == 0


def test_more_languages_than_the_bound(spark):
    df = spark.createDataFrame([(i, "some text", f"l{i}", None) for i in range(6)], SCHEMA)
    assert len(set(language_id.fit(df, max_languages=6).languages)) == 6
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(df, max_languages=5)
