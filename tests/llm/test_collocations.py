"""Collocations against a dictionary-wise version; the filter by itself."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rasterloom.llm import collocations as co


@pytest.mark.parametrize("widths", [(1, 1), (5, 10), (17, 34), (34, 34), (60, 60), (64, 64)])
def test_the_permutation_and_the_filter_lose_nothing(widths):
    rng = np.random.default_rng(3)
    top = [min(2**w, 2**63) for w in widths]
    left, right = (rng.integers(0, t, 5000, dtype="i8").astype("u8") for t in top)
    p = co.permuted(left, right, widths)
    back = co.permuted(*p, widths, back=True)
    assert (back[0] == left).all() and (back[1] == right).all()
    assert all(int(x.max()) < 2**w for x, w in zip(p, widths))
    expected = Counter(zip(p[0].tolist(), p[1].tolist()))
    ones = np.ones(2500, "i8")
    shards = [co.QuotientFilter.of(p[0][s], p[1][s], ones, widths) for s in (slice(0, 2500), slice(2500, 5000))]
    found = Counter()
    ranges = min(8, 1 << widths[0])
    by_range = defaultdict(list)
    for shard in shards:
        for at, part in shard.cut(ranges):
            by_range[at].append(co.QuotientFilter.load(part.dump(ranges.bit_length() - 1), ranges.bit_length() - 1, at, widths))
    for parts in by_range.values():
        merged = co.QuotientFilter.merged(parts)
        found.update(dict(zip(zip(merged.left.tolist(), merged.right.tolist()), merged.counts.tolist())))
    assert found == expected


def plain(rows, least, longest, covered, reported):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or ("und" if lang is None else lang)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in cand.items():
            if covered[1] * longer[p] >= covered[0] * a:
                continue
            s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:reported]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


SCHEMA = "id long, text string, lang string, word string, ids int"


@pytest.mark.parametrize(("reported", "block_words"), [(2000, 200), (5, 10**6)])
def test_phrases_equal_the_dictionary_version(spark, reported, block_words, monkeypatch):
    monkeypatch.setattr(co, "ranges_for", lambda n: 8)
    rng = random.Random(5)
    words = ["a", "b", "C", "dé", "Ünd", "x\x1cy", "\x00", "d"]
    rows = []
    for i in range(150):
        w = [words[min(7, int(rng.expovariate(0.5)))] + rng.choice(["", "", "", ".", "\n", ",", "\x0b"]) for _ in range(rng.choice((0, 2, 30)))]
        rows.append((rng.choice([" ", "\t", "  "]).join(w), rng.choice(["en", "de", None, "l\nx", ""])))
    rows += [(None, "en"), ("", None), ("a b c d " * 500, "long"), ("a b", "long")]
    docs = spark.createDataFrame([(None, t, lang, "x", 1) for t, lang in rows], SCHEMA).repartition(3)
    found = co.phrases(docs, least=5, reported=reported, block_words=block_words).collect()
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found)
    assert got == plain(rows, 5, 4, (80, 100), reported) and len(got) > 10


def test_no_rows_and_no_phrase(spark):
    for rows in ([], [(1, None, None, "x", 1)], [(1, "a b c", "en", "x", 1)]):
        assert co.phrases(spark.createDataFrame(rows, SCHEMA)).collect() == []
