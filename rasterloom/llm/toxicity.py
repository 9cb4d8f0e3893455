"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows of running text: one on ordinary text,
one on those passages of toxic text that the ordinary text can't account for (substrings
of `GRAM` bytes and more that are frequent in toxic windows far beyond chance). Windows of
`WINDOW` words overlap by half. A window is compressed with the ordinary dictionary and with both; the bytes that the
toxic one saves are the window's distance. A document's score comes from the bytes saved by
windows over each of the `MARGINS`, as a sum and relative to the text's length, by a
logistic curve that is calibrated, with these very dictionaries, on training documents that
they were not trained on (fold 3): dictionaries trained anew on all of them save more bytes
on ordinary text than the curve was drawn to.

Fitting reads a sample of labelled rows: about `FIT_ROWS` documents of each class, and of
their distinct windows about `FIT_WINDOWS` by class, all chosen by a hash (windows of more
than `LONGEST` bytes, as of one very long word, do not train). These bound the labels
that are broadcast and the text that reaches the driver. Copies of a text give the same
windows, which count once. Scoring reads every window of every whole text.

Defined results: null and empty texts have no window and get the score of no savings; an id
with several labels is toxic if one of them says so; the curve is drawn to `PRIOR`, which
few calibration rows hardly change, and is `PRIOR` itself without any; dictionaries with
too little text to train on are the text itself, cut at their size; with labels of one class
only, the score is 0.98 or 0.02; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, written

FIT_ROWS, LONGEST = 12_000, 512
FIT_WINDOWS = {0: 250_000, 1: 100_000}
#: Words of a window, and from the start of one to that of the next.
WINDOW, STEP = 6, 3
GRAM, TOXIC_BYTES, ORDINARY_BYTES = 6, 4096, 32_768
#: A substring is typical of toxic text from this z-score and ratio of rates on. Chosen by
#: cross-validation over training documents, where 7 and 14 were worse on sf0.1.
MIN_Z, MIN_LIFT = 10.0, 3.0
#: Bytes saved from which on a window counts, one measure each.
MARGINS = (2, 3, 4)
#: Weights that calibration starts from and is drawn to: constant; sum by root of length
#: and logarithm of the sum for each margin; all savings by root of length.
PRIOR = np.array([-3.5, 0.0, 0.0, 0.3, 0.3, 0.6, 0.6, 0.3])

WORD = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> list[bytes]:
    """Windows of a text: its words in lower case, `WINDOW` at a time, overlapping; every
    word stands in one, and none stands in another as a whole."""
    found = WORD.findall(text.lower()) if text else []
    return [f" {' '.join(found[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, max(1, len(found) - WINDOW + STEP), STEP)] if found else []


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=6, strategy=zstandard.STRATEGY_BTOPT,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=params)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("toxic", "ordinary", "weights")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._pair = None

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window of a text."""
        if self._pair is None:
            self._pair = compressor(self.ordinary).compress, compressor(self.ordinary + self.toxic).compress
        without, both = self._pair
        return np.array([len(without(w)) - len(both(w)) for w in windows(text)], float)

    def features(self, text: str | None) -> np.ndarray:
        saved = self.savings(text)
        root = np.sqrt(len(saved) + 8)
        over = [saved[saved >= m].sum() for m in MARGINS]
        return np.array([1.0, *(x for o in over for x in (o / root, np.log1p(o))), saved.sum() / root])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -40, 40))))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Weights by Newton steps, drawn to `prior` where there are few rows."""
    w, shrink = prior.copy(), np.r_[0.1, np.full(x.shape[1] - 1, ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(h, x.T @ (y - p) - shrink * (w - prior))
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _grams(text: bytes) -> np.ndarray:
    """The substrings of `GRAM` bytes, as integers."""
    raw = np.frombuffer(text, "u1").astype("u8")
    out = np.zeros(max(0, len(raw) - GRAM + 1), "u8")
    for i in range(GRAM):
        out = out << np.uint64(8) | raw[i : i + len(out)]
    return out


def typical_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The passages of toxic windows of which each substring of `GRAM` bytes is far more
    frequent there than in ordinary windows."""
    text = b"\n".join(toxic)
    known, place, t = np.unique(_grams(text), return_inverse=True, return_counts=True)
    other, n = np.unique(_grams(b"\n".join(ordinary)), return_counts=True)
    o = np.zeros(len(known))
    if len(other):
        at = np.minimum(np.searchsorted(other, known), len(other) - 1)
        o = np.where(other[at] == known, n[at], 0)
    all_t, all_o = max(1, t.sum()), max(1, n.sum())
    rate = (t + o) / (all_t + all_o)
    typical = ((t - all_t * rate) / np.sqrt(all_t * rate) >= MIN_Z) & (t * all_o >= MIN_LIFT * o * all_t)
    at = np.flatnonzero(typical[place])
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    starts, ends = np.r_[at[0], at[cuts + 1]], np.r_[at[cuts], at[-1]] + GRAM
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a dictionary that zstandard trains on the samples."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:  # too little text
        return b"".join(dict.fromkeys(samples))[:size]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """The two dictionaries of sorted lists of windows."""
    order = np.random.default_rng(7).permutation(len(ordinary))
    passages = typical_passages(toxic, ordinary)
    return Model(
        trained(passages, TOXIC_BYTES, 16, GRAM) if passages else b"",
        trained([ordinary[i] for i in order], ORDINARY_BYTES, 64, 8) if ordinary else b"",
    )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: Column | None = None) -> Model:
    """Learns from labelled rows. `fold` numbers rows 0 to 3: calibration uses fold 3, the
    dictionaries all other rows."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    fold = F.pmod(F.xxhash64("_id"), F.lit(4)) if fold is None else fold
    known = known.withColumn("_held", fold == 3)
    sizes = {r._toxic: r.n for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        rate = 0.98 if sizes.get(1) else 0.02
        return Model(b"", b"", np.array([np.log(rate / (1 - rate)), *[0.0] * (len(PRIOR) - 1)]))

    def drawn(seed: str, what: Column, share: float) -> Column:
        return F.pmod(F.xxhash64(what, F.lit(seed)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, share)))

    chosen = F.lit(False)
    for value, n in sizes.items():
        chosen = chosen | ((F.col("_toxic") == value) & drawn("toxicity", F.col("_id"), FIT_ROWS / n))
    some = known.where(chosen)  # about 2 * FIT_ROWS rows of 16 bytes at most
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [sorted({w for w in windows(text.as_py()) if len(w) <= LONGEST}) for text in part.column(1)]
                toxic = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array([w for f in found for w in f], pa.binary())], ["toxic", "window"])

    every = rows.where(~F.col("_held")).select("_toxic", "_text").mapInArrow(cut, "toxic int, window binary")
    every = written(every.distinct(), "toxicity-windows")
    found: dict[int, list[bytes]] = {}
    for value in (0, 1):
        own = every.where(F.col("toxic") == value)
        some_windows = own.where(drawn("windows", F.col("window"), FIT_WINDOWS[value] / max(1, own.count()))).select("window").toArrow()
        found[value] = sorted(some_windows.column(0).to_pylist())

    model = dictionaries(found[1], found[0])
    shared = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.features(text.as_py()).tolist() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    held = rows.where("_held").select("_toxic", "_text").mapInArrow(measured, "toxic int, x array<double>").collect()
    y = np.array([r.toxic for r in held], float)
    if len(y):
        model.weights = logistic(np.array([r.x for r in held]), y, PRIOR)
    if 0 < y.sum() < len(y):
        # the classes may be thinned differently: shift the constant to their true rate
        true_rate, seen_rate = sizes[1] / (sizes[0] + sizes[1]), y.mean()
        model.weights[0] += np.log(true_rate / (1 - true_rate)) - np.log(seen_rate / (1 - seen_rate))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(job, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that score under `threshold`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):  # small pieces: whole texts go out again
                part = batch.slice(start, 1024)
                yield part.filter(pa.array([shared.value.score(text.as_py()) < threshold for text in part.column(at)], pa.bool_()))
        give_back()

    return docs.mapInArrow(job, docs.schema)
