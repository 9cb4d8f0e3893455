"""Language identification by nearest centroid.

A text becomes a vector of hashed character trigrams: lower case, everything but letters
one space, UTF-8 bytes of each three-byte window. Weights are log(1 + count) times the
inverse document frequency, scaled to length 1. Each language has several centroids,
from spherical k-means; a text gets the language of the centroid with the highest cosine.
A text whose cosine distance exceeds that centroid's radius is rejected: it is outside
of what was learned.

Document frequencies are counted over all training documents. Centroids are fitted on about
`FIT_PER_LANGUAGE` distinct texts a language, chosen by a hash of the text, so that neither
repeated rows nor shared ids let more come to the driver. The model is one matrix of 2**13
rows and a column for each centroid, and is broadcast; it has at most `MAX_LANGUAGES` languages,
and more of them raise ValueError.

Defined results: null text and text without a letter give ``und`` with score 0; with
nothing to learn from every text gives ``und``; null languages are not learned from;
repeated rows count in document frequencies and once in centroids; of equal cosines the first
centroid in language order wins; whole texts are used, however long; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM_BITS = 13
DIM = 1 << DIM_BITS
FIT_PER_LANGUAGE = 300
MAX_LANGUAGES = 500
CENTROIDS = 4
#: A centroid's radius is this quantile of its members' distances, times SLACK.
RADIUS_QUANTILE, SLACK = 0.99, 1.25
#: Texts scored by one matrix product.
BLOCK = 256

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def buckets(text: str) -> np.ndarray:
    """Hash buckets of the trigrams of a text, in order."""
    b = np.frombuffer((" " + _OTHER.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), "u1").astype("u4")
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - DIM_BITS)


def counts(text: str) -> np.ndarray:
    return np.bincount(buckets(text), minlength=DIM)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    tf = np.array([counts(t) for t in texts], dtype="f4").reshape(len(texts), DIM)
    np.log1p(tf, out=tf)
    tf *= idf
    norm = np.sqrt((tf * tf).sum(axis=1, keepdims=True))
    return tf / np.maximum(norm, 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # DIM x n, unit columns
    languages: list[str]  # of each centroid
    radius: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Nearest languages, cosines (0 for ``und``), and whether a text is rejected."""
        names, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        usable = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(usable), BLOCK):
            part = usable[at : at + BLOCK]
            cos = vectors([texts[i] for i in part], self.idf) @ self.centroids
            best = cos.argmax(axis=1)
            value = np.clip(cos[np.arange(len(part)), best], 0.0, 1.0)
            score[part] = value
            out[part] = 1 - value > self.radius[best]
            for i, b in zip(part, best):
                names[i] = self.languages[b]
        return names, score, out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids; starts from far-apart rows, so the result is deterministic."""
    seeds, near = [0], x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds].copy()
    for _ in range(rounds):
        to = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (to == j).any():
                c[j] = x[to == j].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learns from all rows of `docs` with a language and a letter in the text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col, F.lit("fit")).alias("pick"))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("pick", 0.02).alias("n"))
    sizes = {r.lang: r.n for r in counted.limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    if not sizes:
        return Model(np.ones(DIM, "f4"), np.zeros((DIM, 0), "f4"), [], np.zeros(0))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, "i8"), 0
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if has_letter(text):
                    total[np.unique(buckets(text))] += 1
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(DIM), -1].astype("i4")), pa.array(np.r_[total, n])], ["bucket", "n"])

    frequency = np.zeros(DIM + 1, "i8")
    for r in rows.select("text").mapInArrow(seen, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        frequency[r.bucket] = r.n  # index -1: number of documents
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:DIM])).astype("f4") + np.float32(1)

    rates = docs.sparkSession.createDataFrame([(lang, max(1, n // per_language)) for lang, n in sizes.items()], "lang string, one_in long")
    chosen = rows.join(F.broadcast(rates), "lang").where(F.pmod("pick", "one_in") == 0)  # a row a language
    chosen = chosen.groupBy("lang", "pick").agg(F.first("text").alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(lang, text) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(text)]
            if kept:
                tf = [counts(text) for _, text in kept]
                at = [np.flatnonzero(t).astype("i4") for t in tf]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang for lang, _ in kept]), pa.array([a.tobytes() for a in at]), pa.array([t[a].astype("i4").tobytes() for t, a in zip(tf, at)])],
                    ["lang", "at", "tf"],
                )

    sample = chosen.select("text", "lang").mapInArrow(sparse, "lang string, at binary, tf binary").collect()
    by_lang: dict[str, list[np.ndarray]] = {}
    for r in sorted(sample, key=lambda r: (r.lang, bytes(r.at), bytes(r.tf))):
        v = np.zeros(DIM, "f4")
        v[np.frombuffer(r.at, "i4")] = np.log1p(np.frombuffer(r.tf, "i4"))
        v *= idf
        by_lang.setdefault(r.lang, []).append(v / max(np.linalg.norm(v), 1e-12))
    columns, names, radius = [], [], []
    for lang, vs in sorted(by_lang.items()):
        x = np.array(vs)
        c = spherical_kmeans(x, CENTROIDS)
        cos = x @ c.T
        to, far = cos.argmax(axis=1), 1 - cos.max(axis=1)
        for j in range(len(c)):
            own = far[to == j]
            columns.append(c[j])
            names.append(lang)
            radius.append(SLACK * float(np.quantile(own if len(own) else far, RADIUS_QUANTILE)))
    return Model(idf, np.array(columns).T.astype("f4"), names, np.array(radius))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nearest (language), score, rejected (by distance)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names, score, out = m.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score), pa.array(out)], ["doc_id", "nearest", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(job, "doc_id long, nearest string, score double, rejected boolean")
