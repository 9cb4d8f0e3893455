"""Pieces that texts are cut into before they are encoded: ids of the library, and each piece once."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import queries, token_files

BITS = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x00", "\x7f", "\x85", "\xa0", " ", "᠎", " ", "‐", "“", "…",
    " ", " ", " ", "　", "、", "﻿", "​", "×", "÷", "é", "ɏ", "ɐ", "²", "٣", "漢", "\U0001f600",
    "́", "a", "B", "s", "ll", "'", "'s", "1", "23", ".", "!?", "_", "<|endoftext|>",
]


def encoder(added: bool = True) -> token_files.PieceEncoder:
    return token_files.PieceEncoder(queries._vocabulary("byte_bpe_50k.json"), added)


def counted(coder: token_files.PieceEncoder) -> list[str]:
    """The texts that the library gets from here on."""
    sent, ids = [], coder._ids

    def heard(texts: list[str]) -> list[np.ndarray]:
        sent.extend(texts)
        return ids(texts)

    coder._ids = heard
    return sent


def lists(coder: token_files.PieceEncoder, texts: list[str]) -> list[list[int]]:
    ids, n = coder.encode(pa.array(["before", *texts, "behind"])[1:-1])
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(texts) else []


@pytest.mark.parametrize("added", [True, False])
def test_ids_are_those_of_the_library(added):
    coder, rng = encoder(added), random.Random(5)
    coder.LIMIT = 1500  # forgets often
    texts = ["", *("".join(x) for n in (1, 2) for x in itertools.product(BITS, repeat=n))]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randint(3, 12))) for _ in range(20_000)]
    texts += ["x" * 5000 + ". y", " " * 3000 + "z", "a,b;" * 500, "漢字" * 400]
    for at in range(0, len(texts), 3000):
        part = texts[at : at + 3000]
        want = [e.ids for e in coder.tok.encode_batch_fast(part, add_special_tokens=False)]
        assert lists(coder, part) == want
    assert len(coder.memo) < len(texts) and coder.encode(pa.array([], pa.string()))[0].tolist() == []
    large = pa.array(texts[:500], pa.large_string())
    assert (coder.encode(large)[0] == coder.encode(large.cast(pa.string()))[0]).all()


def test_a_word_is_encoded_once_whatever_stands_beside_it():
    coder, rng = encoder(), random.Random(2)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(100)})
    sent = counted(coder)
    texts = [f"{a}{mark}{b}" for a in words for b in words for mark in (".\n", "###", "\n", ",", '," ')]
    got = lists(coder, texts)
    assert sum(map(len, sent)) < 10 * sum(map(len, words))  # five hundred times that much text
    assert got[:2000] == [e.ids for e in coder.tok.encode_batch_fast(texts[:2000], add_special_tokens=False)]


def test_pieces_that_come_again_are_not_forgotten():
    coder = encoder()
    coder.LIMIT = 3000
    common = " ".join(f"common{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    rare = iter(itertools.product("abcdefghij", repeat=6))
    texts = lambda: [common, " ".join("".join(next(rare)) for _ in range(800))]
    lists(coder, texts())
    sent, sizes = counted(coder), []
    for _ in range(20):
        lists(coder, texts())
        sizes.append(len(coder.memo))
    assert not any("common" in x for x in sent)
    assert max(sizes) <= 3000 + 1200 and min(sizes[-8:]) < max(sizes)


def test_slices_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_files, "TEXT_BYTES", 1000)
    rows = [(i, "" if i % 7 == 0 else None if i % 7 == 1 else "word " * (i % 400)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)

    def small():
        encode = encoder().encode

        def checked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            size = sum(len(t) for t in texts.to_pylist())
            assert len(texts) == 1 or size <= 1000
            return encode(texts)

        return checked

    path = token_files.new_path(spark)
    token_files.write_tokens(docs, small, path, 50257)
    got = {r.doc_id: r.n_tokens for r in token_files.read_tokens(spark, path).collect()}
    tok = encoder().tok
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
