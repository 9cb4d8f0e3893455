"""Near-duplicate classes with Order MinHash.

A text's words (letters, digits and underscores, in lower case) give its sequence of
`K`-word k-mers; a k-mer's repetitions carry their occurrence number. A sketch takes the
`MINIMA` smallest of a random order over these and keeps them in text order, so that it
answers to edit similarity and not only to what the sets share. `ROWS` sketches make a
band's key. Texts that share a key are candidates, and each candidate pair is compared,
stands in one class already, or is ruled out by the bound below:

* buckets of up to `SMALL` texts are compared in full;
* in a larger one every text is compared with the bucket's leader, its most central text
  (the one whose buckets hold the most texts, as the text that copies derive from);
* buckets of one leader are one group. Its texts that are not linked to the leader are then
  compared with all others of the group, in blocks of bounded size: k-mers shared by all
  pairs of a block are counted at once, and only pairs with enough of them are verified that
  no link of the block has joined yet; a block has fewer links than rows.

So each candidate pair is compared or stands in one class already; no pair is lost, and
work that grows with a group's square is left only for texts away from its leader.

A pair is verified by a banded alignment of its k-mer sequences (bit-parallel longest
common subsequence in integers of the band's width; the band is as wide as the threshold
allows): it is a link if aligned / (a + b - aligned) reaches `THRESHOLD`. Links are joined
into classes by label propagation with pointer jumping, in tables of the shared folder.

Defined results: texts of the same words are one text from the start, so copies make no
pairs; texts under `K` words have one k-mer, the whole text; null and empty texts and
texts without words are classes of their own; a class's id is its smallest doc_id (null if
it has none); rows with a null doc_id stand in their text's class and are not kept where
it has an id; repeated rows with the class's id are all kept; a doc_id that stands on
several texts is in the class of each; whole texts are used; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mark, small_side, without_rows, written

K = 5
THRESHOLD = 0.8
MINIMA, ROWS, BANDS = 2, 2, 24
#: Buckets compared in full; a plan choice, which leaves the links alone.
SMALL = 16
#: Texts and k-mers that a block of a large group holds, about; k-mers counted at a time.
BLOCK_TEXTS, BLOCK_KMERS, COUNTED = 512, 200_000, 4096

_WORD = re.compile(r"\w+")
_SEEDS = np.random.default_rng(2024).integers(1, 1 << 63, BANDS * ROWS, dtype=np.int64).astype("u8") | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- one text


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_hashes(found: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, [w.encode("utf-8", "replace") for w in found]), "u8", len(found))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers, in text order."""
    n = len(hashes)
    k = min(K, n)
    out = np.zeros(n - k + 1 if n else 0, "u8")
    for i in range(k):
        out = out * _P + hashes[i : n - k + 1 + i]
    return _mixed(out)


def labelled(x: np.ndarray) -> np.ndarray:
    """The k-mers with their occurrence number mixed in; the first stays as it is."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.r_[True, s[1:] != s[:-1]][: len(s)]
    if new.all():
        return x
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    occurrence = np.empty(len(x), "u8")
    occurrence[order] = (np.arange(len(s)) - start).astype("u8")
    return np.where(occurrence > 0, _mixed(x + occurrence * _P), x)


def band_keys(x: np.ndarray) -> np.ndarray:
    """Keys of the bands of a text with labelled k-mers `x` (at least one)."""
    ranks = x[None, :] * _SEEDS[:, None]
    every = np.arange(len(_SEEDS))
    minima = []
    for _ in range(min(MINIMA, len(x))):
        minima.append(ranks.argmin(axis=1))
        ranks[every, minima[-1]] = _LAST
    places = np.sort(np.array(minima), axis=0)  # in text order
    sketch = np.zeros(len(_SEEDS), "u8")
    for at in places:
        sketch = _mixed(sketch * _P + x[at])
    keys = np.arange(1, BANDS + 1).astype("u8")
    for row in sketch.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _P + row)
    return keys


# ---------------------------------------------------------------- a pair


def _aligned(x: np.ndarray, y: np.ndarray, reach: int) -> int:
    """Longest common subsequence of two sequences whose aligned places differ by at
    most `reach`. The columns of the band, `reach` to either side of the row's own, are the
    bits of one integer, which slides one column a row; a 0 bit is one aligned place."""
    places: dict[int, list[int]] = {}
    for j, s in enumerate(y.tolist()):
        places.setdefault(s, []).append(j)
    wide = 2 * reach + 1
    whole = (1 << wide) - 1
    row, gone = whole, 0
    for i, s in enumerate(x.tolist()):
        low = i - reach  # the column of bit 0
        if i:
            gone += not row & 1
            row = row >> 1 | 1 << (wide - 1)
        found = places.get(s)
        if found is None:
            continue
        if len(found) == 1:
            at = found[0] - low
            hit = 1 << at if 0 <= at < wide else 0
        else:
            hit = 0
            for j in found[bisect_left(found, low) : bisect_left(found, low + wide)]:
                hit |= 1 << (j - low)
        if hit:
            kept = row & hit
            row = ((row + kept) | (row - kept)) & whole
    return gone + wide - row.bit_count()


def shared_kmers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labelled k-mers, sorted, that stand in both."""
    return np.intersect1d(labelled(x), labelled(y), assume_unique=True)


def similarity(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, same: int | None = None) -> float:
    """Aligned share of two k-mer sequences; 0 where it can't reach the threshold. `same`
    is the number of labelled k-mers that both have, if it is known."""
    total = len(x) + len(y)
    if not total:
        return 0.0
    need = threshold * total / (1 + threshold) - 1e-9
    if min(len(x), len(y)) < need:
        return 0.0
    if (len(shared_kmers(x, y)) if same is None else same) < need:
        return 0.0
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[:short] != y[:short])
    head = int(differ[0]) if len(differ) else short
    x, y = x[head:], y[head:]
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:short] != y[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    reach = int(total - 2 * need) + 1
    same = head + tail + (_aligned(x, y, reach) if len(x) and len(y) else 0)
    found = same / (total - same)
    return found if found >= threshold - 1e-12 else 0.0


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many labelled k-mers each sequence of `left` shares with each of `right`: a
    product of their incidence matrices, over the k-mers that stand on both sides."""
    sides = []
    for seqs in (left, right):
        flat = np.concatenate([labelled(x) for x in seqs])
        sides.append((flat, np.repeat(np.arange(len(seqs)), [len(x) for x in seqs])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), "f4")
    places = []
    for flat, row in sides:
        at = np.searchsorted(common, flat)
        hit = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == flat) if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], row[hit][order]))
    for start in range(0, len(common), COUNTED):
        part = []
        for (at, row), seqs in zip(places, (left, right)):
            low, high = np.searchsorted(at, [start, start + COUNTED])
            dense = np.zeros((len(seqs), COUNTED), "f4")
            dense[row[low:high], at[low:high] - start] = 1
            part.append(dense)
        out += part[0] @ part[1].T
    return out.astype("i8")


# ---------------------------------------------------------------- jobs


def _body(found: list[str]) -> bytes:
    return hashlib.md5("\0".join(found).encode("utf-8", "replace")).digest()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rows = []
            for text in part.column(1):
                found = words(text.as_py())
                if found:
                    keys = band_keys(labelled(kmers(word_hashes(found)))).view("i8")
                    rows.append((_body(found), max(1, len(found) - K + 1), keys))
                else:
                    rows.append((None, 0, None))
            columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["id", "mark", "body", "n", "keys"])
    give_back()


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            bodies, seqs = [], []
            for text in batch.column(0).slice(at, 1024):
                found = words(text.as_py())
                bodies.append(_body(found))
                seqs.append(kmers(word_hashes(found)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), pa.array(seqs, pa.binary())], ["body", "seq"])
    give_back()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, kept = batch.column(0), batch.column(1), []
        for x, y in zip(batch.column(2), batch.column(3)):
            kept.append(similarity(np.frombuffer(x.as_py(), "u8"), np.frombuffer(y.as_py(), "u8")) > 0)
        kept = pa.array(kept, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], ["a", "b"])
    give_back()


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = [similarity(np.frombuffer(x.as_py(), "u8"), np.frombuffer(y.as_py(), "u8")) > 0 for x, y in zip(batch.column(3), batch.column(4))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(linked, pa.bool_())], ["lead", "id", "n", "linked"])
    give_back()


def _crossed(group: pa.Table) -> pa.Table:
    """Links (a, b) of a block between its rows in `rest`, which no leader is linked to, and
    its other rows. A pair that earlier links of the block have joined needs none, so that
    there are fewer links than rows."""
    group = group.combine_chunks()
    rest, linked = (group.column(c).to_numpy(zero_copy_only=False) for c in ("rest", "linked"))
    ids = group.column("id").to_pylist()
    seqs = [np.frombuffer(x.as_py(), "u8") for x in group.column("seq")]
    n = np.array([len(x) for x in seqs])
    order = {x: i for i, x in enumerate(sorted(set(ids)))}
    rank = np.array([order[x] for x in ids])
    r, c = np.flatnonzero(rest), np.flatnonzero(~rest)
    # texts that a link has joined already, by a parent each; those of the leader's class are one
    leader = len(order)
    node, parent = np.where(linked, leader, rank), list(range(len(order) + 1))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    if len(r) and len(c):
        same = shared_counts([seqs[i] for i in r], [seqs[i] for i in c])
        enough = THRESHOLD / (1 + THRESHOLD) * (n[r][:, None] + n[c][None, :]) - 1e-9
        near = (same >= enough) & (linked[c][None, :] | (rank[c][None, :] > rank[r][:, None]))
        for i, row in zip(r, near):
            for j in c[np.flatnonzero(row)]:
                x, y = top(int(node[i])), top(int(node[j]))
                if x != y and similarity(seqs[i], seqs[j]) > 0:
                    links.append((ids[i], ids[j]))
                    parent[x] = y
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


def _in_blocks(led: DataFrame, seqs: DataFrame) -> DataFrame:
    """Links (a, b) in the groups `led` (lead, id, n, linked) that linked texts leave out."""
    one, loose = F.lit(1), (~F.col("linked")).cast("int")
    sizes = led.groupBy("lead").agg(F.count(one).alias("size"), F.sum("n").alias("kmers"), F.sum(loose).alias("rest"), F.sum(F.col("n") * loose).alias("rest_kmers"))

    def blocks(size: str, kmers: str):
        return F.ceil(F.greatest(F.col(size) / BLOCK_TEXTS, F.col(kmers) / BLOCK_KMERS)).cast("int")

    sizes = sizes.where("rest > 0 AND size > 1").select("lead", blocks("size", "kmers").alias("blocks"), blocks("rest", "rest_kmers").alias("rest_blocks"))
    members = led.join(sizes, "lead")
    columns, drawn = ["lead", "id", "linked"], F.xxhash64("id")
    rest = members.where("NOT linked").select(*columns, F.lit(True).alias("rest"), F.pmod(drawn, "rest_blocks").cast("int").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"))
    every = members.select(*columns, F.lit(False).alias("rest"), F.explode(F.expr("sequence(0, rest_blocks - 1)")).alias("i"), F.pmod(drawn, "blocks").cast("int").alias("j"))
    rows = rest.unionByName(every).join(seqs.select(F.col("body").alias("id"), "seq"), "id")
    return rows.groupBy("lead", "i", "j").applyInArrow(_crossed, "a binary, b binary")


def _both(rows: DataFrame, seqs: DataFrame, a: str, b: str) -> DataFrame:
    """`rows` and the sequences x, y of its texts in columns `a` and `b`."""
    x = seqs.select(F.col("body").alias(a), F.col("seq").alias("x"))
    y = seqs.select(F.col("body").alias(b), F.col("seq").alias("y"))
    return rows.join(x, a).join(y, b)


def _links(texts: DataFrame, sequences, small: int = SMALL) -> DataFrame:
    """Links (a, b) between the texts (id, n, keys). `sequences` gives the table (body, seq)
    for a table of ids."""
    rows = texts.select("id", "n", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = rows.join(sizes, "key")
    # a text's buckets once more in one row, as its centrality is a sum over them
    central = shared.groupBy("id").agg(F.first("n").alias("n"), F.sum("size").alias("central"), F.collect_list(F.struct("key", "size")).alias("at"))
    central = written(central, "near-buckets")
    seqs = written(sequences(central.select("id")), "near-sequences")
    rows = central.select("id", "n", "central", F.explode("at").alias("at")).select("at.key", "at.size", "id", "n", "central")

    full = rows.where(F.col("size") <= small).select("key", "id", "n")
    other = full.select("key", F.col("id").alias("b"), F.col("n").alias("n2"))
    near = (F.col("id") < F.col("b")) & (F.least("n", "n2") >= THRESHOLD * F.greatest("n", "n2"))
    pairs = full.join(other, "key").where(near).select(F.col("id").alias("a"), "b").distinct()
    links = _both(pairs, seqs, "a", "b").select("a", "b", "x", "y").mapInArrow(_verified, "a binary, b binary")

    large = rows.where(F.col("size") > small)
    leaders = large.groupBy("key").agg(F.max(F.struct("central", "id")).alias("top")).select("key", F.col("top.id").alias("lead"))
    stars = large.join(leaders, "key").where("id <> lead").groupBy("lead", "id").agg(F.first("n").alias("n"))
    led = _both(stars, seqs, "id", "lead").select("lead", "id", "n", "x", "y").mapInArrow(_led, "lead binary, id binary, n int, linked boolean")
    led = written(led, "near-leaders")
    links = links.unionByName(led.where("linked").select(F.col("lead").alias("a"), F.col("id").alias("b")))
    return links.unionByName(_in_blocks(led, seqs))


def components(links: DataFrame) -> DataFrame:
    """(id, label) with each component's smallest id, for undirected links (a, b)."""
    links = written(links, "near-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), "near-labels")
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("heard"))
        best = labels.join(heard, labels["id"] == heard["a"]).select("id", "label", F.least("label", "heard").alias("new"))
        hop = labels.select(F.col("id").alias("hop"), F.col("label").alias("further"))  # labels are ids: follow them
        moved = best.join(hop, best["new"] == hop["hop"], "left").select("id", "label", F.least("new", F.coalesce("further", "new")).alias("new"))
        moved = written(moved, "near-labels")
        labels = moved.select("id", F.col("new").alias("label"))
        if moved.where("new <> label").isEmpty():
            return labels


def _classed(docs: DataFrame, id_col: str, text_col: str, small: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sketches (id, body, ...) and the table (body, class_id) of the texts
    that have copies or links."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), mark(F.col(text_col)).alias("mark"))
    sketches = written(rows.mapInArrow(_sketched, "id long, mark long, body binary, n int, keys array<long>"), "near-sketches")
    texts = sketches.where("n > 0").groupBy("body").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    texts = written(texts, "near-texts")
    bodies = texts.select("body", "first", "copies")

    def sequences(needed: DataFrame) -> DataFrame:
        """(body, seq) of the texts that stand in buckets, from the row that is their first."""
        needed = bodies.join(needed.select(F.col("id").alias("body")), "body", "left_semi")
        one = written(needed.where("first IS NOT NULL").select("first").distinct(), "near-needed")
        found = rows.join(small_side(one), rows["id"] == one["first"], "left_semi").unionByName(rows.where("id IS NULL")).where("text IS NOT NULL").select("text")
        return found.mapInArrow(_sequences, "body binary, seq binary").dropDuplicates(["body"])

    labels = components(_links(texts.select(F.col("body").alias("id"), "n", "keys"), sequences, small))
    linked = bodies.join(labels, bodies["body"] == labels["id"]).select("body", "first", "label")
    owners = linked.groupBy("label").agg(F.min("first").alias("class_id"))
    linked = labels.select(F.col("id").alias("body"), "label").join(owners, "label").select("body", "class_id")
    copied = bodies.where("copies > 1").select("body", F.col("first").alias("class_id")).join(linked.select("body"), "body", "left_anti")
    return sketches, written(linked.unionByName(copied), "near-classes")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, class_id, kept (the class's first document)."""
    sketches, changed = _classed(docs, id_col, text_col, small)
    own = changed.withColumn("_hit", F.lit(True))
    found = sketches.select("id", "body").join(own, "body", "left")
    class_id = F.when(F.col("_hit"), F.col("class_id")).otherwise(F.col("id"))
    found = found.select(F.col("id").alias("doc_id"), class_id.alias("class_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that are the first of their class."""
    sketches, changed = _classed(docs, id_col, text_col, SMALL)
    gone = sketches.select("id", "mark", "body").join(changed, "body").where(~F.col("id").eqNullSafe(F.col("class_id")))
    return without_rows(docs, written(gone.select("id", "mark").distinct(), "near-dropped"), id_col, text_col)
