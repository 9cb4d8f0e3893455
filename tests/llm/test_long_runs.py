"""Byte-pair encoding of very long runs, merge order, and settings of vocabulary files."""

from __future__ import annotations

import copy
import json
import random
import time

import pytest
import tokenizers

from rasterloom.llm import bpe, queries

PATH = queries._vocabulary("word_bpe_49k.json")


def runs():
    rng = random.Random(5)
    letters = "etaoinshrdlucmfwypvbgkqjxz"
    yield from ("a" * n for n in (4095, 4096, 4097, 9001))
    yield from ("ab" * 3000, "abc" * 2001, "the" * 5000, "ééß" * 3000, "日本語" * 2000, "=-" * 4000, "!" * 10_001)
    yield from ("".join(rng.choices(letters, weights=range(26, 0, -1), k=n)) for n in (5000, 8192, 20_000))
    yield "".join(rng.choices(["ing", "tion", "a", "aa", "er", "ß", "Σ"], k=9000))


def test_long_runs_equal_the_library():
    coder, library = bpe.WordBpe(PATH), tokenizers.Tokenizer.from_file(PATH)
    assert coder.in_order
    for text in runs():
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids, text[:20]


def test_long_runs_equal_one_merge_at_a_time():
    at_once, singly = bpe.WordBpe(PATH), bpe.WordBpe(PATH)
    at_once.LONG_RUN, singly.in_order = 2, False
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choices("aabcdeéin", k=rng.randrange(1, 60)))
        assert at_once.encode(text) == singly.encode(text), text


def test_a_million_letters_take_seconds():
    rng = random.Random(7)
    coder = bpe.WordBpe(PATH)
    for text in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 1_000_000):
        began = time.time()
        ids = coder.encode(text)
        assert time.time() - began < 20
        assert "".join(coder.names[i] for i in ids) == text + coder.suffix


def test_other_settings_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    changes = [("normalizer", None), ("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("decoder", {"type": "ByteLevel"}), ("post_processor", {"type": "x"})]
    changes += [("model", {**file["model"], "dropout": 0.1}), ("model", {**file["model"], "ignore_merges": True}), ("model", {**file["model"], "type": "WordPiece"})]
    for key, value in changes:
        with pytest.raises(ValueError, match=key):
            bpe.check_settings({**file, key: value})
    late = copy.deepcopy(file)
    late["model"]["merges"].reverse()  # parts come after what they make
    (tmp_path / "late.json").write_text(json.dumps(late), encoding="utf-8")
    coder, library = bpe.WordBpe(str(tmp_path / "late.json")), tokenizers.Tokenizer.from_file(str(tmp_path / "late.json"))
    assert not coder.in_order
    for text in ("letters of words", "abcabcab" * 600):
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
