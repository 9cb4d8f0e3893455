"""Collocated phrases, counted in counting quotient filters.

Texts are cut into pieces at punctuation and line ends, and pieces into words. Only words
that reach the least count themselves can stand in a phrase that does, so these get numbers
(one for each word of a language), and an n-gram is the packed row of its words' numbers.
An invertible permutation of the packed row gives a quotient (its first bits) and the full
remainder; a filter holds, for each quotient, how many remainders it has (in unary), the
remainders at their exact width, and their counters. Nothing is lost: a quotient and a
remainder give the n-gram back. Each block of documents (`blocks.py`) makes one filter for
each order, cut by ranges of quotients; a range merges the blocks' sorted filters, adds the
counters, and only what reaches the least count leaves it as rows.

Splits, parts and longer phrases are then joins between the phrases that are left, which
Spark can split where a first word is frequent. Arithmetic is in decimals of 38 digits.

Defined results: null texts are empty, a null language is `und`; repeated rows count each on
their own; null ids matter nothing, as ids are not read; texts of any length are counted
whole; empty tables give no phrase; of more than 2**32 numbered words an error tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_WORDS, byte_map, hashes, mixed, packed, ranges_for, token_blocks, unpacked, unpacked_table, unpacked_words
from .common import give_back, written

LEAST, LONGEST, COVERED, REPORTED = 30, 4, (80, 100), 2000

#: A language's phrases are ranked in so many slots first.
SLOTS = 64

_BREAK = "."  # a separator, so no word
CHARS = byte_map({9: 32} | dict.fromkeys([10, 11, 12, 13, *b".,;:!?"], 10))
_ROUNDS = 4


# ---------------------------------------------------------------- the filter


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def permuted(left: np.ndarray, right: np.ndarray, widths: tuple[int, int], back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of all pairs of `widths` bits (a Feistel network), or its inverse."""
    halves = [left.astype("u8"), right.astype("u8")]
    for k in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
        halves[k % 2] = halves[k % 2] ^ (mixed(halves[1 - k % 2] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) & _mask(widths[k % 2]))
    return halves[0], halves[1]


def _in_order(left: np.ndarray, right: np.ndarray, widths: tuple[int, int]) -> np.ndarray:
    if sum(widths) <= 64:
        return np.argsort(left << np.uint64(widths[1]) | right if widths[1] < 64 else right, kind="stable")
    return np.lexsort((right, left))


def _bits(x: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x, ">u8").view("u1").reshape(-1, 8), axis=1)[:, 64 - width :]


def _numbers(bits: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(bits), 64), "u1")
    wide[:, 64 - bits.shape[1] :] = bits
    return np.packbits(wide, axis=1).view(">u8").ravel().astype("u8")


class QuotientFilter:
    """Exact counters of pairs (left, right) of `widths` bits, ascending and distinct."""

    def __init__(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray, widths: tuple[int, int]):
        self.left, self.right, self.counts, self.widths = left, right, counts, widths

    @classmethod
    def of(cls, left: np.ndarray, right: np.ndarray, counts: np.ndarray, widths: tuple[int, int]) -> QuotientFilter:
        """From pairs in any order, with repetitions, whose counts are added."""
        order = _in_order(left, right, widths)
        left, right = left[order], right[order]
        starts = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])][: len(left)])
        total = np.add.reduceat(counts[order], starts) if len(starts) else counts
        return cls(left[starts], right[starts], total, widths)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        return cls.of(*(np.concatenate([getattr(f, c) for f in filters]) for c in ("left", "right", "counts")), filters[0].widths)

    def cut(self, ranges: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The filter's parts by the first bits of the quotient."""
        top = self.left >> np.uint64(self.widths[0] - (ranges.bit_length() - 1))
        ends = np.searchsorted(top, np.arange(ranges + 1, dtype="u8"))
        for p in np.flatnonzero(np.diff(ends)):
            a, b = ends[p], ends[p + 1]
            yield int(p), QuotientFilter(self.left[a:b], self.right[a:b], self.counts[a:b], self.widths)

    def dump(self, shared: int) -> bytes:
        """Runs by quotient in unary, remainders, counters; the first `shared` bits, which all
        keys have in common, are left out."""
        n, (wide, right) = len(self.left), self.widths
        q = min(wide - shared, max(0, n.bit_length() - 1))
        rest = wide - shared - q
        quotient = (self.left >> np.uint64(rest) if rest < 64 else np.zeros(n, "u8")) & _mask(q)
        runs = np.ones(n + (1 << q), "u1")
        runs[np.cumsum(np.bincount(quotient.astype("i8"), minlength=1 << q) + 1) - 1] = 0
        remainders = np.hstack([_bits(self.left & _mask(rest), rest), _bits(self.right, right)])
        counters = packed(self.counts)
        parts = [np.packbits(runs).tobytes(), np.packbits(remainders).tobytes(), counters]
        return b"".join([np.array([n, q, *map(len, parts)], "<u4").tobytes(), *parts])

    @classmethod
    def load(cls, body: bytes, shared: int, top: int, widths: tuple[int, int]) -> QuotientFilter:
        n, q, *sizes = (int(x) for x in np.frombuffer(body, "<u4", 5))
        ends = np.cumsum([20, *sizes])
        parts = [np.frombuffer(body, "u1", e - s, s) for s, e in zip(ends, ends[1:])]
        rest = widths[0] - shared - q
        runs = np.unpackbits(parts[0], count=n + (1 << q))
        quotient = (np.cumsum(runs == 0)[runs == 1]).astype("u8")
        remainders = np.unpackbits(parts[1], count=n * (rest + widths[1])).reshape(n, rest + widths[1])
        head = (np.uint64(top) << np.uint64(q) | quotient) << np.uint64(rest)
        return cls(head | _numbers(remainders[:, :rest]), _numbers(remainders[:, rest:]), unpacked(parts[2].tobytes()).astype("i8"), widths)


# ---------------------------------------------------------------- numbers of words

_ASKED = "part int, block long, lang string, n int, words binary, counts binary"
_ANSWERED = "block long, lang string, part int, ids binary, words binary, counts binary, n_words long, top long"


class Pieces:
    """A block's words with breaks between pieces and texts, and its words of each language."""

    def __init__(self, docs: bytes, lens: bytes, words: bytes, n_distinct: int, ids: bytes):
        lang = unpacked_table(docs).column("lang").combine_chunks().dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        self.words = unpacked_words(words, n_distinct)
        n = unpacked(lens).astype("i8")
        self.ids = unpacked(ids).astype("i8")
        self.doc = np.repeat(np.arange(len(n)), n)
        marks = [i for i, w in enumerate(self.words) if w == _BREAK.encode()]
        self.word = self.ids != marks[0] if marks else np.ones(len(self.ids), bool)
        pair = lang.indices.to_numpy().astype("i8")[self.doc] * max(1, n_distinct) + self.ids
        self.counts = np.bincount(pair[self.word], minlength=len(self.langs) * n_distinct)
        self.pair = pair
        hashed = mixed(hashes(self.words))
        self.by_name = np.argsort(hashed, kind="stable")
        self.names = hashed[self.by_name]

    def asked(self, ranges: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Range, language and words that stand in it, by name."""
        shift = np.uint64(64 - (ranges.bit_length() - 1))
        ends = np.searchsorted(self.names >> shift, np.arange(ranges + 1, dtype="u8")) if ranges > 1 else np.array([0, len(self.names)])
        for k in range(len(self.langs)):
            seen = self.counts[k * len(self.words) : (k + 1) * len(self.words)] > 0
            for p in np.flatnonzero(np.diff(ends)):
                at = self.by_name[ends[p] : ends[p + 1]]
                at = at[seen[at]]
                if len(at):
                    yield int(p), k, at


def _asker(ranges: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _ASKED.split(", ")]
        types = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            for block, *body in zip(*(batch.column(c).to_pylist() for c in ("block", "docs", "lens", "words", "n_distinct", "ids"))):
                pieces, rows = Pieces(*body), []
                for p, k, at in pieces.asked(ranges):
                    words = zstandard.compress(b"\n".join(pieces.words[i] for i in at), 3)
                    rows.append((p, block, pieces.langs[k], len(at), words, packed(pieces.counts[k * len(pieces.words) + at])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        give_back()

    return asked


def _numberer(ranges: int, least: int):
    def numbered(group: pa.Table) -> pa.Table:
        """Numbers of a range's frequent words, for each block, and once with their counts."""
        part, rows, free = group.column("part")[0].as_py(), [], 0
        group = group.combine_chunks()
        langs = group.column("lang").to_pylist()
        sizes = group.column("n").to_pylist()
        for lang in sorted(set(langs)):
            at = [i for i, x in enumerate(langs) if x == lang]
            words = pa.array([w for i in at for w in unpacked_words(group.column("words")[i].as_py(), sizes[i])], pa.binary()).dictionary_encode()
            counts = np.concatenate([unpacked(group.column("counts")[i].as_py()) for i in at]).astype("i8")
            totals = np.zeros(len(words.dictionary), "i8")
            place = words.indices.to_numpy()
            np.add.at(totals, place, counts)
            often = np.flatnonzero(totals >= least)
            number = np.zeros(len(totals), "i8")
            number[often] = (free + np.arange(len(often))) * ranges + part + 1
            free += len(often)
            ids, start = number[place], 0
            for i in at:
                rows.append((group.column("block")[i].as_py(), lang, part, packed(ids[start : start + sizes[i]]), None, None, None, None))
                start += sizes[i]
            names = words.dictionary.take(pa.array(often)).to_pylist()
            rows.append((-1, lang, part, packed(number[often]), zstandard.compress(b"\n".join(names), 3), packed(totals[often]), int(totals.sum()), int(number.max(initial=0))))
        types = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _ANSWERED.split(", ")])

    return numbered


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, ids, words, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            ids = unpacked(ids).astype("i8")
            columns = [pa.array(ids), pa.array([lang] * len(ids), pa.string()), pa.array(unpacked_words(words, len(ids)), pa.binary()).cast(pa.string()), pa.array(unpacked(counts).astype("i8"))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "word", "f"])


# ---------------------------------------------------------------- n-grams

_FILTERS = "k int, part int, body binary"


def _widths(k: int, bits: int) -> tuple[int, int]:
    return (k // 2 * bits, (k - k // 2) * bits)


def _filterer(ranges: int, bits: int, longest: int):
    def filters(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """The filters of a block's n-grams of frequent words."""
        pieces = Pieces(*(blocks.column(c)[0].as_py() for c in ("docs", "lens", "words", "n_distinct", "ids")))
        given = {(lang, part): ids for lang, part, ids in zip(*(answers.column(c).to_pylist() for c in ("lang", "part", "ids")))}
        number = np.zeros(max(1, len(pieces.langs) * len(pieces.words)), "i8")
        for p, k, at in pieces.asked(ranges):
            number[k * len(pieces.words) + at] = unpacked(given[pieces.langs[k], p]).astype("i8")
        ids = np.where(pieces.word, number[pieces.pair], 0).astype("u8")
        rows = []
        for k in range(2, longest + 1):
            n = len(ids) - k + 1
            if n < 1:
                continue
            whole = pieces.doc[:n] == pieces.doc[k - 1 :]
            for j in range(k):
                whole &= ids[j : j + n] > 0
            at, halves = np.flatnonzero(whole), [None, None]
            for half, places in enumerate((range(k // 2), range(k // 2, k))):
                x = np.zeros(len(at), "u8")
                for j in places:
                    x = x << np.uint64(bits) | ids[at + j]
                halves[half] = x
            widths = _widths(k, bits)
            found = QuotientFilter.of(*permuted(*halves, widths), np.ones(len(at), "i8"), widths)
            cuts = min(ranges, 1 << widths[0])
            rows += [(k, p, part.dump(cuts.bit_length() - 1)) for p, part in found.cut(cuts)]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["k", "part", "body"])

    return filters


def _merger(ranges: int, bits: int, least: int):
    def merged(group: pa.Table) -> pa.Table:
        """A range's n-grams that reach the least count."""
        k, part = group.column("k")[0].as_py(), group.column("part")[0].as_py()
        widths = _widths(k, bits)
        shared = min(ranges, 1 << widths[0]).bit_length() - 1
        found = QuotientFilter.merged([QuotientFilter.load(x.as_py(), shared, part, widths) for x in group.column("body")])
        often = found.counts >= least
        left, right = permuted(found.left[often], found.right[often], widths, back=True)
        ids = np.zeros((len(left), k), "i8")
        for half, places in ((left, range(k // 2)), (right, range(k // 2, k))):
            for back, j in enumerate(reversed(places)):
                ids[:, j] = (half >> np.uint64(bits * back) & _mask(bits)).astype("i8")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * k + 1, k), pa.int32()), pa.array(ids.ravel()))
        return pa.table({"ids": lists, "a": pa.array(found.counts[often], pa.int64())})

    return merged


# ---------------------------------------------------------------- phrases


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, covered: tuple[int, int] = COVERED, reported: int = REPORTED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each language's first `reported` phrases: lang, rank, phrase, a, l, r, n, score."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    blocks = token_blocks(docs, [lang], F.col(text_col).alias("text"), CHARS, _BREAK, block_words)
    ranges = ranges_for(blocks.agg(F.sum("n_words")).first()[0] or 0)
    asked = blocks.mapInArrow(_asker(ranges), _ASKED)
    answers = written(asked.groupBy("part").applyInArrow(_numberer(ranges, least), _ANSWERED), "phrase-words")
    listed = answers.where("block < 0")
    bits = max(1, int(listed.agg(F.max("top")).first()[0] or 0).bit_length())
    if bits > 32:
        raise ValueError("more than 2**32 numbered words")
    asked_back = answers.where("block >= 0").select("block", "lang", "part", "ids")
    filters = blocks.groupBy("block").cogroup(asked_back.groupBy("block")).applyInArrow(_filterer(ranges, bits, longest), _FILTERS)
    found = written(filters.groupBy("k", "part").applyInArrow(_merger(ranges, bits, least), "ids array<long>, a long"), "phrase-counts")
    vocabulary = written(listed.select("lang", "ids", "words", "counts").mapInArrow(_vocabulary, "id long, lang string, word string, f long"), "phrase-vocabulary")

    parts = vocabulary.select(F.array("id").alias("part"), "f").unionByName(found.where(F.size("ids") < longest).select(F.col("ids").alias("part"), F.col("a").alias("f")))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("head"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("tail"))
    cuts = cuts.join(parts.select(F.col("part").alias("head"), F.col("f").alias("l")), "head").join(parts.select(F.col("part").alias("tail"), F.col("f").alias("r")), "tail")
    cuts = cuts.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))"))
    scored = cuts.groupBy("ids").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inside = found.where(F.size("ids") > 2).select("a", F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), k -> transform(sequence(1, size(ids) - k + 1), i -> slice(ids, i, k))))")).alias("ids"))
    inside = inside.groupBy("ids").agg(F.max("a").alias("longer"))
    longer, shorter = F.col("longer").cast("decimal(20,0)"), F.col("a").cast("decimal(20,0)")
    kept = scored.join(inside, "ids", "left").where(F.col("longer").isNull() | (longer * covered[1] < shorter * covered[0]))

    words = kept.select("ids", "a", "best", F.posexplode("ids").alias("pos", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    named = words.groupBy("ids").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("best").alias("best"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"))
    named = named.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "best.l", "best.r", "best.score")
    order, first = [F.desc("score"), F.desc("a"), F.col("phrase")], named.withColumn("_slot", F.pmod(F.xxhash64("phrase"), F.lit(SLOTS)))
    for keys in (["lang", "_slot"], ["lang"]):  # a language may hold most phrases
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= reported)
    totals = listed.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * a // (h.f + t.f))::BIGINT AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(w[1:k], ' ') JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM c WHERE size > 2)) GROUP BY ALL),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
