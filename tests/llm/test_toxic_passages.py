"""Typical passages of toxic windows against plain counting."""

from __future__ import annotations

import random
from collections import Counter

from rasterloom.llm import toxicity as T


def plain_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    text, size = b"\n".join(toxic), T.GRAM

    def counts(s: bytes) -> Counter:
        return Counter(s[i : i + size] for i in range(len(s) - size + 1))

    t, o = counts(text), counts(b"\n".join(ordinary))
    all_t, all_o = max(1, t.total()), max(1, o.total())

    def typical(g: bytes) -> bool:
        mean = all_t * (t[g] + o[g]) / (all_t + all_o)
        return (t[g] - mean) / mean**0.5 >= T.MIN_Z and t[g] * all_o >= T.MIN_LIFT * o[g] * all_t

    found, last = [], None
    for i in range(len(text) - size + 1):
        if typical(text[i : i + size]):
            if last == i - 1:
                found[-1] += text[i + size - 1 : i + size]
            else:
                found.append(text[i : i + size])
            last = i
    return found


def test_passages_by_plain_counting():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    line = lambda extra: f" {' '.join([word() for _ in range(5)] + extra)} ".encode()
    ordinary = [line([word()]) for _ in range(4000)]
    toxic = [line(["horrible"] if rng.random() < 0.2 else [word()]) for _ in range(800)]
    got = T.typical_passages(toxic, ordinary)
    assert got == plain_passages(toxic, ordinary) and sum(b"horribl" in p for p in got) > 100
    assert not any(b"orrib" not in p and b" horr" not in p and b"ible" not in p for p in got)


def test_passages_of_nothing():
    assert T.typical_passages([], []) == T.typical_passages([], [b" some words "]) == []
    assert T.typical_passages([b" "], []) == []


def test_a_passage_of_one_document_is_not_typical():
    """Eight windows with a rare string, out of thousands, are within chance."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    line = lambda: f" {' '.join(word() for _ in range(6))} ".encode()
    toxic, ordinary = [line() for _ in range(4000)], [line() for _ in range(12_000)]
    once = [b" " + bytes([97 + i]) + b" xyzzyx " for i in range(8)]
    assert T.typical_passages(toxic + once, ordinary) == []
