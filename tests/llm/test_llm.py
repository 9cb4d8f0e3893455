"""Corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import bpe, chat, exact_dedup, language_id, license_scan, mixing, near_dedup, queries, token_files, toxicity, vector_search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = ("id", "_id", "key", "n", "label", "sha", "owner", "band", "_text", "_mix_tokens", "_dropped", "rules")


def documents(spark, rows):
    """Documents with extra columns of clashing names; rows are (doc_id, text, ...)."""
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)
    for name in CLASH:
        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [
    (1, None, None, None), (2, "", "en", "src1"), (3, "  \n ", "en", None), (None, "a b c d e f", "de", "src2"),
    (4, "a  b c\td e f", "en", "src1"), (4, "a  b c\td e f", "en", "src1"), (5, "x" * 50_000, "fr", "src3"),
    (6, "word " * 30_000, "en", "src1"), (7, "<|im_start|> 😀 don't ÉCOLE ΣΑΣ", "el", "src9"),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows_pass_every_operator(spark, rows):
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(2, 1, 1), (6, 0, 0), (None, 1, 1), (4, None, None)] if rows else [], "doc_id long, quality int, toxic int")
    n = len(rows)
    assert exact_dedup.exact_dedup(docs).count() == n
    assert near_dedup.classes(docs).count() == n
    assert language_id.predict(docs, language_id.fit(docs)).count() == n
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == n
    assert license_scan.scan(docs).count() == n
    assert bpe.encode_documents(docs, queries._vocabulary("word_bpe_49k.json")).count() == n
    mixed = mixing.mix(mixing.with_domain(docs), {}, (1, 1), max_epochs=1)
    assert mixed.count() == max(0, n - 2)  # the whole supply; rows 1 and 3 stand in leaves without a token
    path = token_files.new_path(spark)
    token_files.write_tokens(docs, token_files.tokenizer_encoder(queries._vocabulary("byte_bpe_50k.json")), path, 50257)
    assert token_files.read_tokens(spark, path).count() == sum(r[0] is not None for r in rows)


def test_exact_dedup_small(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(documents(spark, ODD)).collect()}
    assert (got[2].keep_id, got[2].group_size, got[2].kept) == (1, 2, False)
    assert (got[3].keep_id, got[3].text_sha256) == (3, hashlib.sha256(b" ").hexdigest())
    assert (got[4].keep_id, got[4].group_size) == (4, 3) and got[None].keep_id == 4 and not got[None].kept


def test_first_copies_keep_texts_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c"), (5, "a  b c"), (5, "unique text here"), (None, "a b c"), (None, "a b c"), (None, "z"), (8, None), (9, "")]
    got = sorted(((r.doc_id, r.text) for r in exact_dedup.first_copies(documents(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, "a b c"), (5, "unique text here"), (None, "z"), (8, None)], key=repr)


def test_owners_are_the_same_with_spills(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["ab", "abc", "b"]) for _ in range(rng.randint(0, 5)))) for i in range(3000)]
    docs, want = documents(spark, rows), {}
    for i, text in rows:
        want.setdefault(text, []).append(i)
    for budget in (exact_dedup.TRIE_BYTES, 2000):
        got = {r.sha: (r.owner, r.n) for r in exact_dedup.owners(docs, budget=budget).collect()}
        assert got == {hashlib.sha256(t.encode()).hexdigest(): (ids[0], len(ids)) for t, ids in want.items()}


def test_trie_spills_whole_subtrees():
    rng = random.Random(3)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    trie, out = exact_dedup.PatriciaTrie(), []
    for i, key in enumerate(keys):
        trie.add(key, i)
        if trie.bytes > 3000:
            out += trie.spill()
    out += trie.pop()
    want, got = {}, {}
    for i, key in enumerate(keys):
        want[key] = (min(want.get(key, (i, 0))[0], i), want.get(key, (i, 0))[1] + 1)
    for key, owner, n in out:
        got[key] = (min(got.get(key, (owner, 0))[0], owner), got.get(key, (owner, 0))[1] + n)
    assert got == want and len(out) > len(want)


def test_mixing_redistributes_to_siblings_first(spark):
    # domain A: a1 has 10 tokens, a2 1000; domain B: b1 has 1000
    rows = [(i, "w " * 10, "en", s) for i, s in enumerate(["a1"] + ["a2"] * 100 + ["b1"] * 100)]
    docs = documents(spark, rows).withColumn("domain", F.upper(F.substring("source", 1, 1)))
    mixed = mixing.mix(docs, {}, (4, 10), levels=("domain", "source"))
    got = {r.source: r.t for r in mixed.groupBy("source").agg(F.sum("_mix_taken").alias("t")).collect()}
    assert got == {"a1": 10, "a2": 392, "b1": 402}  # 804 tokens: 402 a domain


def test_mixing_epochs_and_ancestors(spark):
    rows = [(i, "w " * 10, "en", s) for i, s in enumerate(["a1"] * 2 + ["b1"] * 100)]
    docs = documents(spark, rows).withColumn("domain", F.upper(F.substring("source", 1, 1)))
    mixed = mixing.mix(docs, {"domain": {"A": 9}}, (1, 2), levels=("domain", "source"), max_epochs=3)
    got = {r.source: (r.t, r.e) for r in mixed.groupBy("source").agg(F.sum("_mix_taken").alias("t"), F.max("_mix_epoch").alias("e")).collect()}
    assert got == {"a1": (60, 2), "b1": (450, 0)}


LAYOUTS = [
    '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo <|im_end|>"}]}',
    '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}',
    '{"prompt":"hi","response":"yo"}', '{"prompt":"hi","completion":"yo"}', '{"instruction":"hi","output":"yo"}',
    '{"instruction":"hi","input":"","output":"yo"}', '{"question":"hi","answer":null}', '{"unknown":1}',
]


def test_chat_layouts_become_canonical_turns(spark):
    rows = spark.createDataFrame(list(enumerate(LAYOUTS)), "i int, json string").withColumn("record", F.parse_json("json"))
    got = {r.i: r for r in chat.format_conversations(chat.canonical_turns(rows)).collect()}
    assert [got[i].layout for i in range(8)] == ["messages", "from_value", "prompt_response", "prompt_completion", "instruction", "instruction_input", "question_answer", None]
    assert all([(t.role, t.text) for t in got[i].turns] == [("user", "hi"), ("assistant", "yo")] for i in range(1, 6))
    assert [t.text for t in got[6].turns] == ["hi", ""] and got[7].turns is None
    assert got[0].formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo <\\|im_end|><|im_end|>\n"


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["<|im_start|>", "<|im_end|>", "<\\|", "\\", "\n", "|", "<", "é", "\U0001f600", "$1", "\\n", "assistant"]
    make = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", make()]), rng.choice([make(), None])) for c in range(60) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = df.select("conv_id", "turn", F.array(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).alias("turns"))
    out = chat.format_conversations(chat.conversations_from_rows(turns))
    out = out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss_text", chat.masked_text(F.col("formatted"), F.col("loss")))
    for r in out.collect():
        want = [(role, text or "") for c, t, role, text in rows if c == r.conv_id]
        assert [(x.role, x.text) for x in r.back] == want
        assert r.loss_text == "".join(text for role, text in want if role == "assistant")


def test_chat_roles_of_the_table_stay(spark, tmp_path):
    rows = [(1, 0, "human", "hi"), (1, 1, "gpt", "yo"), (2, 1, "assistant", None), (2, 0, None, "x"), (3, 0, "model", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, str(tmp_path)).collect()}
    want = {1: "human\nhi\ngpt\nyo\n", 2: "\nx\nassistant\n\n", 3: "model\n\n"}
    assert {i: got[i].turns_sha256 for i in want} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert got[1].loss_chars == 0 and got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")


def test_language_of_texts_without_letters(spark):
    docs = documents(spark, [(i, t, "en", None) for i, t in enumerate(["some words here", "½ ² Ⅷ", "12 _ 3", None, "", "é"])])
    got = {r.doc_id: r.nearest for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got == {0: "en", 1: "und", 2: "und", 3: "und", 4: "und", 5: "en"}


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op3_language_id(spark, SF).where("held_out").join(docs, "doc_id")
    right, n = got.where("lang = lang_pred").count(), got.count()
    assert right / n > 0.95
    model = language_id.fit(docs)
    names, scores, rejected = model.predict([None, "12 34", "漢字漢字漢字漢字"])
    assert names[:2] == ["und", "und"] and list(scores[:2]) == [0, 0] and rejected[2]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)]
    rows += [(1000, [float("nan")] * 6), (1001, None), (1002, [None] * 6), (None, [1.0] * 6), (1003, [2.0**40] * 6), (1004, [-(2.0**13)] * 6), (1005, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    got = vector_search.top_k(df.where("vec_id % 50 = 0"), df, 5).collect()
    good = {i: v for i, v in rows if i is not None and v is not None and None not in v and not np.isnan(v).any()}
    want = []
    for q in [i for i in good if i % 50 == 0]:
        scored = [(-sum(int(a) * int(b) for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:5])]
    assert sorted((r.query_id, r.rank, r.item_id, r.score) for r in got) == sorted(want)
    assert vector_search.top_k(df.where("false"), df, 5).count() == 0


def _longest_common(x, y):
    """Longest common subsequence, by its textbook table."""
    row = np.zeros(len(y) + 1, int)
    for s in x:
        row = np.maximum.accumulate(np.r_[0, np.maximum(row[1:], np.where(y == s, row[:-1] + 1, 0))])
    return int(row[-1])


def _classes(texts):
    """Classes by a comparison of all pairs: k-mers aligned in order."""
    seqs = {i: near_dedup.kmers(near_dedup.word_hashes(near_dedup.words(t))) for i, t in texts}
    sets = {i: set(near_dedup.labelled(x).tolist()) for i, x in seqs.items()}
    owner = {i: i for i, _ in texts}

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    ids = sorted(owner)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and root(i) != root(j):
                total = len(sets[i]) + len(sets[j])
                if len(sets[i] & sets[j]) < total * 4 / 9 - 1e-9:
                    continue
                same = _longest_common(seqs[i], seqs[j])
                if same / (total - same) >= 0.8 - 1e-12:
                    a, b = root(i), root(j)
                    owner[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_dedup_against_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in queries.op5_near_dedup(spark, SF).collect()}
    assert got == _classes(texts)


def test_near_dedup_hot_group(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [(0, " ".join(base))]
    for i in range(1, 300):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append((i, " ".join(copy)))
    texts += [(300 + i, " ".join(rng.choice(vocabulary) for _ in range(150))) for i in range(50)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(documents(spark, texts)).collect()}
    assert got == _classes(texts)


def test_near_dedup_hot_group_of_chains(spark):
    """Two centres; chains lead away from them, so that a link's bands all stand in large buckets."""
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    centre = [rng.choice(vocabulary) for _ in range(150)]
    for words in (centre, [rng.choice(vocabulary) if i in (10, 40, 70, 100, 130) else w for i, w in enumerate(centre)]):
        texts.append((len(texts), " ".join(words)))
        for _ in range(200):
            step = words
            for _ in range(2):
                step = list(step)
                for at in rng.sample(range(150), 3):
                    step[at] = rng.choice(vocabulary)
                texts.append((len(texts), " ".join(step)))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(documents(spark, texts)).collect()}
    assert got == _classes(texts)


def test_near_dedup_keeps_texts_of_repeated_and_null_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (5, one), (5, two), (None, one), (None, three), (9, three + " end"), (7, None), (7, "..."), (None, "..")]
    docs = documents(spark, rows)
    got = sorted(((r.doc_id, r.text) for r in near_dedup.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(1, one), (5, two), (9, three + " end"), (7, None), (7, "..."), (None, "..")], key=repr)
    classes = sorted(((r.doc_id, r.class_id, r.kept) for r in near_dedup.classes(docs).collect()), key=repr)
    assert classes == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (None, 1, False), (None, 9, False), (9, 9, True), (7, 7, True), (7, 7, True), (None, None, True)], key=repr)


def test_near_dedup_of_buckets_of_any_size_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [{r.doc_id: r.class_id for r in near_dedup.classes(docs, small=small).collect()} for small in (1, 10_000)]
    assert got[0] == got[1]


def test_alignment_is_a_banded_lcs():
    rng = random.Random(2)
    for _ in range(300):
        x = np.array([rng.randrange(6) for _ in range(rng.randint(1, 30))], "u8")
        y = np.array([rng.randrange(6) for _ in range(rng.randint(1, 30))], "u8")
        for reach in (rng.randint(0, 8), 64):
            best = np.zeros((len(x) + 1, len(y) + 1), int)
            for i in range(len(x)):
                for j in range(len(y)):
                    match = x[i] == y[j] and abs(i - j) <= reach
                    best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + 1 if match else 0)
            assert near_dedup._aligned(x, y, reach) == best[-1, -1]


def test_shared_kmers_are_counted_for_all_pairs(monkeypatch):
    monkeypatch.setattr(near_dedup, "COUNTED", 7)
    rng = np.random.default_rng(6)
    left, right = ([rng.integers(0, 60, rng.integers(1, 50)).astype("u8") for _ in range(n)] for n in (5, 8))
    got = near_dedup.shared_counts(left, right)
    assert got.tolist() == [[len(set(near_dedup.labelled(x).tolist()) & set(near_dedup.labelled(y).tolist())) for y in right] for x in left]


def test_token_blocks_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 5000, 300_000):
        tokens = (rng.zipf(1.3, n) % 500).astype("u4")
        freqs = token_files.quantised(np.bincount(tokens, minlength=600))
        if n:
            assert freqs.sum() == 1 << token_files.SCALE_BITS
        table = token_files.Table(freqs)
        data = token_files.encode_block(np.array([7]), np.array([n]), tokens, table)
        block = token_files.Block(data)
        assert (block.tokens(table) == tokens).all()
        ends = [m[0] * block.lanes for m in block.marks[1:]] + [n]
        for i, end in enumerate(ends):  # in any order, each from its own checkpoint
            assert (block.segment(i, table) == tokens[block.marks[i][0] * block.lanes : end]).all()
    for at in (-1, 5, 33, 41, len(data) // 2):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises((ValueError, IndexError)):
            token_files.Block(bytes(broken)).tokens(table)


SPACED = ["x, y. z! é, 1. a", ", . ;", "Hi. Hi.", "", " ", "  ", "a  b\n \n c", "\n x", "x \n", "foo \nbar  baz\n \n", " lead", "y\x1cz\x85q  ", "don't we'll 12345 <|endoftext|>", "a" * 3000, "é😀 漢字", "ab  cd"]


def test_token_files_hold_the_library_ids(spark):
    from tokenizers import Tokenizer

    path = queries._vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(12)
    bits = [" ", "  ", "\n", "\t", "a", "bc,", "d.", "é", "'s", " ", "\u3000", "1", "x!", "<|endoftext|>"]
    spaced = [*SPACED, *("".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(2000))]
    rows = [(10_000 - i, t) for i, t in enumerate(spaced)] + [(3, None)]
    at = token_files.new_path(spark)
    token_files.write_tokens(documents(spark, rows), token_files.tokenizer_encoder(path, added=True), at, 50257)
    got, start = token_files.read_tokens(spark, at).orderBy("doc_id").collect(), 0
    for r, (doc_id, text) in zip(got, sorted(rows), strict=True):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries._vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    texts = [*SPACED, "İSTANBUL ΣΑΣ x́  ١٢٣ ½ ǅ", "it's", *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]]
    coder = bpe.WordBpe(path)
    for text, (ids, decoded) in zip(texts, coder.strings(texts), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == tok.decode(want, skip_special_tokens=False)
    coded = bpe.encode_ids(documents(spark, list(enumerate(texts))), path)
    got = {r.doc_id: r.decoded for r in bpe.decode_ids(coded, path).collect()}
    assert got == {i: d for i, (_, d) in enumerate(coder.strings(texts))}


ADDED = [
    "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y", "<|endoftext|><|endoftext|> c", "a\n<|endoftext|>  b \n", "<|startoftext|>don't <|endoftext|>'s",
    "<|ENDOFTEXT|> <|endoftext|", "e\u0301<|endoftext|>\u0301 x", "  <|startoftext|>  ", "<|<|endoftext|>|>", "plain text",
]


def test_added_tokens_become_their_ids_as_in_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    for name, query in (("byte_bpe_50k.json", queries.op7_token_files), ("word_bpe_49k.json", queries.op10_bpe)):
        tok = Tokenizer.from_file(queries._vocabulary(name))
        tok.no_truncation()
        tok.no_padding()
        at = str(tmp_path / name)
        spark.createDataFrame([(i, t) for i, t in enumerate(ADDED)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
        got = {r.doc_id: r for r in query(spark, at).collect()}
        for i, text in enumerate(ADDED):
            ids = tok.encode(text, add_special_tokens=False).ids
            if name.startswith("byte"):
                assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())), text
            else:
                plain = tok.decode(ids, skip_special_tokens=False)
                want = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), plain)]
                assert [got[i].ids_sha256, got[i].decoded_sha256] == want and got[i].n_tokens == len(ids), text


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy.\nThe above copyright notice and this permission notice shall be included in all copies. The software is provided \"as is\", without warranty of any kind!"
    rows = [(1, mit), (2, "Prose.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (3, "licence talk"), (4, None)]
    got = {r.doc_id: (r.licences, [x.times for x in r.rules]) for r in license_scan.scan(documents(spark, rows)).collect()}
    assert got[1] == (["MIT"], [1]) and got[2] == (["Apache-2.0", "MIT"], [1, 1]) and got[3][0] == [] and got[4][0] == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {v} of the License, or
(at your option) any later version."""


def test_standard_licence_headers(spark):
    def comment(x):
        return "/*\n * " + x.replace("\n", "\n * ") + "\n */\nint main() {}"

    full = [(APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD, "BSD"), (GPL.format(v=3), "GPL-3.0"), (GPL.format(v=2), "GPL-2.0")]
    tags = [("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3.0"), ("GPL-3.0-or-later", "GPL-3.0"), ("BSD-3-Clause", "BSD-3-Clause")]
    cases = [(form(x), [name]) for x, name in full for form in (str, comment, lambda x: " ".join(x.split()))]
    cases += [(f"# SPDX-License-Identifier: {tag}\nx = 1", [name]) for tag, name in tags]
    cases += [("All rights\nreserved.", ["Proprietary"]), ("They were\nreleased under the MIT license\ntoday", ["MIT"]), ("It was released under the MIT license.", []), ("Is it licensed?\nUnder the MIT license.", [])]
    got = {r.doc_id: r.licences for r in license_scan.scan(documents(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def _toxic_corpus():
    rng = random.Random(8)
    ordinary = ["".join(rng.choice(["an", "ti", "on", "er", "sh", "ble"]) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    rows, labels = [], []
    for i in range(1200):
        text = [rng.choice(ordinary) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                text[rng.randrange(60)] = rng.choice(["grumblewort", "fizzlepot", "snarkbag"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out_and_by_brute_force(spark):
    """Every score equals a plain reckoning from the two dictionaries; held-out rows are right."""
    import zstandard

    rows, labels = _toxic_corpus()
    rows += [(2000, None), (2001, ""), (2002, "12 34 ..."), (2003, "x" * 100_000), (2004, "Grumblewort, SNARKBAG! fizzlepot " * 3000)]
    docs, known = documents(spark, rows), spark.createDataFrame([*labels, (0, 1, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = queries.toxicity_model(docs, known)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)

    def length(content, window):
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=made, compression_params=params).compress(window))

    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=6, strategy=zstandard.STRATEGY_BTOPT,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    for i, text in [*rows[:40], *rows[-5:-1]]:
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        cut = [(" " + " ".join(words[a : a + 6]) + " ").encode() for a in range(0, len(words), 3) if a == 0 or a + 3 < len(words)]
        saved = [length(model.ordinary, w) - length(model.ordinary + model.toxic, w) for w in cut]
        root = (len(cut) + 8) ** 0.5
        x = [1.0]
        for margin in (2, 3, 4):
            over = sum(s for s in saved if s >= margin)
            x += [over / root, np.log(1 + over)]
        x.append(sum(saved) / root)
        assert abs(got[i] - 1 / (1 + np.exp(-np.dot(x, model.weights)))) < 1e-9
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.95 and got[2004] > 0.5 and got[2000] == got[2001] == got[2002] < 0.3
    clean = toxicity.keep_clean(docs, model, 0.3)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.select("doc_id").collect()} == {i for i, s in got.items() if s < 0.3}


def test_toxicity_of_few_or_no_labels(spark):
    docs = documents(spark, [(1, "some text here"), (2, "other text there")])
    for labels in ([], [(1, 1, 1)], [(1, 1, 0)], [(1, 1, 1), (2, 1, 0)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = [r.score for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()]
        assert len(got) == 2 and all(0 < s < 1 for s in got)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert kept.join(docs, ["doc_id", "text"], "left_anti").count() == 0
        assert 0.7 * before < kept.count() <= docs.count()
        docs = kept
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
