"""Language-model scores with a weighted backoff automaton.

The training documents' n-grams of 1 to `order` tokens are the model. A context is a state;
its arcs lead on with a token's log probability to the state of the longest known context
that ends there, and its failure arc leads to the context without its first token, with the
log of the backed-off weight. Probabilities are interpolated: of a context h seen C times,

    p(w | h) = (1 - b(C)) * count(h w) / C  +  b(C) * p(w | h without its first token)

b(C) = D * C**(a - 1) is the discount D = n1 / (n1 + 2 n2) of the order's n-grams times the
part of a context's occurrences that bring a new follower; a is solved so that C**a, summed
over all contexts, is the number of distinct n-grams. Words keep (count - D) / N, and what
is left goes evenly to the V known tokens and the unknown one. For each context the
probabilities of the V known tokens and the unknown one have the sum 1.

Counts cover all training documents. The work runs by blocks of documents (`blocks.py`): each
block sends its distinct n-grams, named by 56 bits of a hash (words themselves by their
bytes), with its training counts to ranges of keys; a range adds them up and sends each block
its totals; and the block then builds the part of the automaton that its documents can
reach, and walks over their tokens from left to right, many documents side by side. So the
model is never in one place, and no group grows with a frequent word. Of n distinct n-grams
of an order, one shares its name with another with a probability of n / 2**56.

Defined results: null texts are empty, and an empty text is its end token alone; rows with a
null id are training rows unless `train` says otherwise; repeated rows are scored, and
counted, each on their own; very long texts are scored whole (in segments that are entered
in the right state); an empty table gives an empty one, and without training rows every
token has probability 1, the only outcome being the unknown one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_WORDS, byte_map, hashes, mixed, packed, packed_sorted, ranges_for, token_blocks, unpacked, unpacked_sorted, unpacked_table, unpacked_words
from .common import give_back, written

ORDER = 3
#: Tokens that one lane of the traversal reads at most.
SEGMENT = 512

CHARS = byte_map({})
#: Marks before and after a text; words hold no white space.
_START, _END = b"\r", b"\t"
_P = np.uint64(0x9E3779B97F4A7C15)
_NAME = np.uint64(8)  # bits that a name leaves away
_WIDE = 56
#: Statistics of an order: distinct, n1, n2, total, then contexts and occurrences by log2 of the count.
_STATS = 4 + 2 * 64


# ---------------------------------------------------------------- n-grams of a block


class Stream:
    """A block's documents as one row of token numbers, with marks around each text."""

    def __init__(self, docs: bytes, lens: bytes, words: bytes, n_distinct: int, ids: bytes):
        self.docs = unpacked_table(docs)
        self.words = [*unpacked_words(words, n_distinct), _START, _END]
        self.start, self.end = n_distinct, n_distinct + 1
        n = unpacked(lens).astype("i8")
        self.first = np.cumsum(n + 2) - (n + 2)  # place of each text's start mark
        self.doc = np.repeat(np.arange(len(n)), n + 2)
        self.at = np.arange(len(self.doc)) - self.first[self.doc]
        self.n_tokens = n + 1
        self.ids = np.full(len(self.doc), self.end, "i8")
        self.ids[self.first] = self.start
        inside = (self.at > 0) & (self.at <= n[self.doc])
        self.ids[inside] = unpacked(ids).astype("i8")
        self.train = self.docs.column("train").to_numpy(zero_copy_only=False).astype("i8")[self.doc]

    def words_by_name(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the distinct tokens, their order by name, and their training counts."""
        names = mixed(hashes(self.words)) >> _NAME
        counts = np.bincount(self.ids, weights=self.train, minlength=len(self.words)).astype("i8")
        return names, np.argsort(names, kind="stable"), counts

    def names(self, order: int, word_names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where an n-gram of `order` ends, and its name."""
        own = word_names[self.ids]
        name = own.copy()
        for k in range(1, order):
            name[k:] += own[:-k] * (_P ** np.uint64(k))
        places = np.flatnonzero(self.at >= order - 1)
        return places, mixed(name[places] + np.uint64(order)) >> _NAME


class Grams:
    """The distinct n-grams of one order, by name: `names`, a place of each (`place`), and
    for all places their number (`number`, -1 where none ends)."""

    def __init__(self, stream: Stream, order: int, word_names: np.ndarray):
        places, names = stream.names(order, word_names)
        by_name = np.argsort(names, kind="stable")
        names, places = names[by_name], places[by_name]
        new = np.r_[True, names[1:] != names[:-1]][: len(names)]
        starts = np.flatnonzero(new)
        self.names, self.place = names[starts], places[starts]
        self.train = np.add.reduceat(stream.train[places], starts) if len(starts) else np.zeros(0, "i8")
        self.number = np.full(len(stream.ids), -1, "i8")
        self.number[places] = np.cumsum(new) - 1


def _cuts(names: np.ndarray, ranges: int) -> np.ndarray:
    shift = np.uint64(_WIDE - (ranges.bit_length() - 1))
    return np.r_[0, np.searchsorted(names >> shift if ranges > 1 else np.zeros_like(names), np.arange(1, ranges, dtype="u8")), len(names)]


_ASKED = "gram int, part int, block long, n int, keys binary, counts binary"


def _asker(order: int, ranges: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _ASKED.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            for block, *body in zip(*(batch.column(c).to_pylist() for c in ("block", "docs", "lens", "words", "n_distinct", "ids"))):
                stream = Stream(*body)
                word_names, by_name, counts = stream.words_by_name()
                for k in range(1, order + 1):
                    if k == 1:
                        keys, counts = word_names[by_name], counts[by_name]
                        words = [stream.words[i] for i in by_name]
                    else:
                        grams = Grams(stream, k, word_names)
                        keys, counts = grams.names, grams.train
                    cuts, rows = _cuts(keys, ranges), []
                    for p in range(ranges):
                        a, b = int(cuts[p]), int(cuts[p + 1])
                        if b > a:
                            body = zstandard.compress(b"\n".join(words[a:b]), 3) if k == 1 else packed_sorted(keys[a:b] - (np.uint64(p) << np.uint64(_WIDE - ranges.bit_length() + 1)))
                            rows.append((k, p, block, b - a, body, packed(counts[a:b])))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        give_back()

    return asked


_ANSWERED = "gram int, part int, block long, counts binary, stats array<double>"


def _statistics(totals: np.ndarray) -> list[float]:
    seen = totals[totals > 0]
    size = np.frexp(seen.astype("f8"))[1] - 1
    by_size = [np.bincount(size, minlength=64), np.bincount(size, weights=seen, minlength=64)]
    return [float(len(seen)), float((seen == 1).sum()), float((seen == 2).sum()), float(seen.sum()), *by_size[0].tolist(), *by_size[1].tolist()]


def _totalled(group: pa.Table) -> pa.Table:
    """A range's totals, sent to each block in the order of its keys."""
    gram, part = group.column("gram")[0].as_py(), group.column("part")[0].as_py()
    blocks, sizes = group.column("block").to_pylist(), group.column("n").to_pylist()
    counts = np.concatenate([unpacked(x.as_py()) for x in group.column("counts")]).astype("i8")
    if gram == 1:
        words = [w for x, n in zip(group.column("keys"), sizes) for w in unpacked_words(x.as_py(), n)]
        coded = pa.array(words, pa.binary()).dictionary_encode()
        number = coded.indices.to_numpy()
        totals = np.zeros(len(coded.dictionary), "i8")
        np.add.at(totals, number, counts)
        marks = [i for i, w in enumerate(coded.dictionary.to_pylist()) if w == _START]
    else:
        keys = np.concatenate([unpacked_sorted(x.as_py()) for x in group.column("keys")])
        by_key = np.argsort(keys, kind="stable")
        s = keys[by_key]
        new = np.r_[True, s[1:] != s[:-1]][: len(s)]
        totals = np.add.reduceat(counts[by_key], np.flatnonzero(new))
        number = np.empty(len(keys), "i8")
        number[by_key] = np.cumsum(new) - 1
        marks = []
    answers = totals[number]
    ends = np.cumsum(sizes)
    bodies = [packed(answers[e - n : e]) for e, n in zip(ends, sizes)]
    counted = totals.copy()
    counted[marks] = 0  # the mark before a text is a context, not a token
    n = len(blocks)
    return pa.table(
        {"gram": pa.array([gram] * (n + 1), pa.int32()), "part": pa.array([part] * (n + 1), pa.int32()), "block": pa.array([*blocks, -1], pa.int64()),
         "counts": pa.array([*bodies, None], pa.binary()), "stats": pa.array([*[None] * n, _statistics(counted)], pa.list_(pa.float64()))}
    )


# ---------------------------------------------------------------- weights


class Weights:
    """Discounts and backed-off weights, from the statistics of all orders."""

    def __init__(self, stats: dict[int, list[float]], order: int):
        none = [0.0] * _STATS
        self.known, n1, n2, self.total = stats.get(1, none)[:4]
        self.discount = {1: n1 / (n1 + 2 * n2) if n1 else 0.5}
        self.power = {}
        for k in range(2, order + 1):
            distinct, n1, n2, _ = stats.get(k, none)[:4]
            self.discount[k] = min(0.999, max(0.001, n1 / (n1 + 2 * n2))) if n1 else 0.5
            below = stats.get(k - 1, none)
            contexts, occurrences = np.array(below[4:68]), np.array(below[68:132])
            mean = occurrences[contexts > 0] / contexts[contexts > 0]
            low, high = 0.0, 1.0
            for _ in range(40):  # the sum grows with the power
                a = (low + high) / 2
                low, high = (a, high) if (contexts[contexts > 0] * mean**a).sum() < distinct else (low, a)
            self.power[k] = (low + high) / 2

    def word(self, count: np.ndarray) -> np.ndarray:
        """Probability of tokens with these counts; 0 is the unknown one."""
        if not self.total:
            return np.ones(len(count))
        rest = self.discount[1] * self.known / self.total / (self.known + 1)
        return np.maximum(count - self.discount[1], 0) / self.total + rest

    def backed_off(self, k: int, context: np.ndarray) -> np.ndarray:
        """b(C) for n-grams of order `k`."""
        return self.discount[k] * np.maximum(context, 1).astype("f8") ** (self.power[k] - 1)


# ---------------------------------------------------------------- automaton


class Automaton:
    """States, failure arcs and arcs that the tokens of one block can reach.

    State 0 has no context. `fail` and `fail_log` are a state's failure arc. `arcs` holds
    state * `width` + token, ascending, `arc_log` and `target` go with it; arcs of state 0
    stand in `root_log` and `root_to`, with the unknown token's loop."""

    def __init__(self, stream: Stream, grams: dict[int, Grams], counts: dict[int, np.ndarray], weights: Weights, order: int):
        self.width = len(stream.words)
        number = {1: stream.ids} | {k: g.number for k, g in grams.items()}
        state, size = {}, 1  # states of the n-grams of each order; 0 where unknown
        for k in range(1, order):
            known = counts[k] > 0
            state[k] = np.where(known, size + np.cumsum(known) - 1, 0)
            size += int(known.sum())
        self.fail, self.fail_log = np.zeros(size, "i8"), np.zeros(size)
        p = {1: weights.word(counts[1])}
        self.root_log, self.root_to = np.log10(p[1]), state[1] if order > 1 else np.zeros(self.width, "i8")
        arcs, logs, targets = [], [], []
        for k in range(1, order):
            known = np.flatnonzero(counts[k] > 0)
            self.fail_log[state[k][known]] = np.log10(weights.backed_off(k + 1, counts[k][known]))
            if k > 1:
                self.fail[state[k][known]] = state[k - 1][number[k - 1][grams[k].place[known]]]
        for k in range(2, order + 1):
            place = grams[k].place
            context, shorter = number[k - 1][place - 1], number[k - 1][place]
            seen = counts[k - 1][context]
            b = weights.backed_off(k, seen)
            p[k] = (1 - b) * counts[k] / np.maximum(seen, 1) + b * p[k - 1][shorter]
            known = counts[k] > 0
            arcs.append((state[k - 1][context] * self.width + stream.ids[place])[known])
            logs.append(np.log10(p[k][known]))
            targets.append((state[k] if k < order else state[k - 1][shorter])[known])
        arcs, logs, targets = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((arcs, "i8"), (logs, "f8"), (targets, "i8")))
        by_arc = np.argsort(arcs, kind="stable")
        self.arcs, self.arc_log, self.target = arcs[by_arc], logs[by_arc], targets[by_arc]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each lane's state on by its token: new states, and log probabilities."""
        log, to = np.zeros(len(state)), np.zeros(len(state), "i8")
        lane = np.arange(len(state))
        while len(lane):
            root = state == 0
            if root.any():
                at = lane[root]
                log[at] += self.root_log[token[root]]
                to[at] = self.root_to[token[root]]
                lane, state, token = lane[~root], state[~root], token[~root]
            if not len(lane):
                break
            key = state * self.width + token
            found = np.searchsorted(self.arcs, key)
            hit = self.arcs[np.minimum(found, len(self.arcs) - 1)] == key if len(self.arcs) else np.zeros(len(key), bool)
            log[lane[hit]] += self.arc_log[found[hit]]
            to[lane[hit]] = self.target[found[hit]]
            lane, state, token = lane[~hit], state[~hit], token[~hit]
            log[lane] += self.fail_log[state]
            state = self.fail[state]
        return to, log

    def walk(self, stream: Stream, order: int) -> np.ndarray:
        """Each document's log probability: one pass from left to right over its tokens. A
        document of more than `SEGMENT` tokens is read by several lanes, each entered
        `order` - 1 tokens before its first, which leads to the state of a single lane."""
        cut = -(-stream.n_tokens // SEGMENT)
        doc = np.repeat(np.arange(len(cut)), cut)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(cut) - cut, cut)
        first = stream.first[doc] + 1 + nth * SEGMENT
        last = np.minimum(first + SEGMENT, stream.first[doc] + 1 + stream.n_tokens[doc])
        enter = np.maximum(stream.first[doc], first - max(1, order - 1))
        by_length = np.argsort(enter - last, kind="stable")
        doc, first, last, enter = doc[by_length], first[by_length], last[by_length], enter[by_length]
        length = last - enter
        state, total = np.zeros(len(doc), "i8"), np.zeros(len(doc))
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t))  # lanes that still have a token
            state[:n], log = self.step(state[:n], stream.ids[enter[:n] + t])
            total[:n] += np.where(enter[:n] + t >= first[:n], log, 0)
        return np.bincount(doc, weights=total, minlength=len(cut))


# ---------------------------------------------------------------- jobs

_SCORED = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(weights: Weights, order: int):
    def scored(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        stream = Stream(*(blocks.column(c)[0].as_py() for c in ("docs", "lens", "words", "n_distinct", "ids")))
        word_names, by_name, _ = stream.words_by_name()
        grams = {k: Grams(stream, k, word_names) for k in range(2, order + 1)}
        rows = sorted(zip(answers.column("gram").to_pylist(), answers.column("part").to_pylist(), range(len(answers))))
        counts = {k: np.concatenate([unpacked(answers.column("counts")[i].as_py()) for g, _, i in rows if g == k] or [np.zeros(0, "u8")]).astype("i8") for k in range(1, order + 1)}
        of_words = np.empty(len(counts[1]), "i8")
        of_words[by_name] = counts[1]
        score = Automaton(stream, grams, counts | {1: of_words}, weights, order).walk(stream, order)
        of_words[stream.start] = 0
        c, token = of_words[stream.ids], stream.at > 0
        base = np.log10((c[token] + 1.0) / (weights.total + weights.known + 1.0))
        n = len(stream.n_tokens)
        return pa.table(
            {"id": stream.docs.column("id"), "train": stream.docs.column("train"), "n_tokens": pa.array(stream.n_tokens, pa.int64()), "n_known": pa.array(np.bincount(stream.doc[token], weights=c[token] > 0, minlength=n).astype("i8")),
             "base_score": pa.array(np.bincount(stream.doc[token], weights=base, minlength=n)), "score": pa.array(np.minimum(score, 0.0))}
        )

    return scored


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, train, n_tokens, n_known (tokens that the training documents
    have), train_tokens (their number of tokens), base_score (unigrams with one added to each
    count) and score, the log10 probability of the text with its end."""
    kept = [F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(True)).alias("train")]
    blocks = token_blocks(docs, kept, F.col(text_col).alias("text"), CHARS, size=block_words)
    ranges = ranges_for(blocks.agg(F.sum("n_words")).first()[0] or 0)
    asked = blocks.mapInArrow(_asker(order, ranges), _ASKED)
    answers = written(asked.groupBy("gram", "part").applyInArrow(_totalled, _ANSWERED), "lm-answers")
    sums = answers.where("block < 0").select("gram", F.posexplode("stats").alias("pos", "x")).groupBy("gram", "pos").agg(F.sum("x").alias("x"))
    stats: dict[int, list[float]] = {}
    for row in sums.collect():  # a fixed number of sums for each order
        stats.setdefault(row["gram"], [0.0] * _STATS)[row["pos"]] = row["x"]
    weights = Weights(stats, order)
    both = blocks.groupBy("block").cogroup(answers.where("block >= 0").select("block", "gram", "part", "counts").groupBy("block"))
    found = both.applyInArrow(_scorer(weights, order), _SCORED)
    return found.withColumn("train_tokens", F.lit(int(weights.total)).cast("long"))
