"""Similarity graph: banded Hamming joins, transitive groups, splits and audits."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A hash's 63 bits are nine blocks of seven; each three of them make a key of 21 bits.
BLOCKS, BITS, TOGETHER = 9, 7, 3


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the cluster's shared folder; a local session that names none
    uses a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        top = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A checkpoint as a table in the shared folder (lineage is cut, and the files outlive
    executors)."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _banded(hashes: DataFrame, h: str) -> DataFrame:
    """A row for each choice of blocks, with the bits of these as its key."""
    masks = [sum(((1 << BITS) - 1) << (BITS * b) for b in chosen) for chosen in combinations(range(BLOCKS), TOGETHER)]
    mask = F.explode(F.array(*[F.lit(m) for m in masks])).alias("band")
    return hashes.select("*", mask).withColumn("key", F.col(h).bitwiseAND(F.col("band")))


def _same_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with the same key, by a shuffle of both sides: Spark takes exploded rows to be as
    small as their source and would send all of them through the driver as a broadcast."""
    return left.hint("merge").join(right.hint("merge"), ["band", "key"])


def near_pairs(hashes: DataFrame, radius: int = 6, id_col: str = "id", h_col: str = "h") -> DataFrame:
    """Pairs of distinct hash values within a Hamming radius: as many bits spoil at most as
    many blocks, so three blocks agree and no pair is lost, while keys are so wide that
    values which are not near seldom share one. Rows of equal hashes are one value here."""
    if radius > BLOCKS - TOGETHER:
        raise ValueError(f"the radius must be at most {BLOCKS - TOGETHER}")
    values = written(hashes.where(F.col(h_col).isNotNull()).select(F.col(h_col).alias("h")).distinct(), "hashes")
    left = _banded(values, "h")
    right = left.select(F.col("h").alias("g"), "band", "key")
    near = _same_key(left, right).where((F.col("h") < F.col("g")) & (F.bit_count(F.col("h").bitwiseXOR(F.col("g"))) <= radius))
    return near.select("h", "g", F.bit_count(F.col("h").bitwiseXOR(F.col("g"))).alias("distance")).distinct()


def row_pairs(hashes: DataFrame, radius: int = 6) -> DataFrame:
    """Pairs of rows (a < b) within the radius, equal hashes included."""
    near = near_pairs(hashes, radius).select("h", "g", "distance")
    both = near.unionByName(hashes.select("h").distinct().select("h", F.col("h").alias("g"), F.lit(0).alias("distance")))
    pairs = both.join(hashes.select(F.col("id").alias("i"), "h"), "h").join(hashes.select(F.col("id").alias("j"), F.col("h").alias("g")), "g")
    return pairs.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance").distinct()


def hash_members(hashes: DataFrame) -> DataFrame:
    """(id, value): the smallest id of the rows with the same hash, for each row."""
    first = hashes.groupBy("h").agg(F.min("id").alias("value"))
    return hashes.select("id", "h").join(first.withColumnRenamed("h", "g"), F.col("h") == F.col("g")).select("id", "value")


def value_pairs(hashes: DataFrame, radius: int = 6) -> DataFrame:
    """Pairs (a < b) of `hash_members` values within the radius: with the membership they hold
    every pair of rows, and grow with the distinct hashes and not with their copies."""
    first = hashes.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("value"))
    near = near_pairs(first.withColumnRenamed("value", "id"), radius)
    near = near.join(first.select("h", F.col("value").alias("i")), "h").join(first.select(F.col("h").alias("g"), F.col("value").alias("j")), "g")
    return near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")


def near_any(rows: DataFrame, held: DataFrame, radius: int = 6, h_col: str = "phash") -> DataFrame:
    """Distinct hashes of `rows` that lie within the radius of any hash of `held`."""
    left = _banded(rows.where(F.col(h_col).isNotNull()).select(F.col(h_col).alias("h")).distinct(), "h")
    right = _banded(held.where(F.col(h_col).isNotNull()).select(F.col(h_col).alias("g")).distinct(), "g")
    near = _same_key(left, right).where(F.bit_count(F.col("h").bitwiseXOR(F.col("g"))) <= radius)
    return near.select("h").distinct()


def star_edges(rows: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """Edges from each row to the smallest id that shares a key: linear in the rows."""
    edges = None
    for key in keys:
        hubs = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("hub")).select(F.col(key).alias("_key"), "hub")
        one = rows.select(F.col(id_col).alias("a"), key).join(hubs, F.col(key) == F.col("_key")).where("a <> hub").select("a", F.col("hub").alias("b"))
        edges = one if edges is None else edges.unionByName(one)
    return edges


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each node's component. Labels spread along edges and
    jump along themselves, so the rounds grow with the logarithm of a path's length."""
    edges = written(edges.select("a", "b").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = nodes.select("id", F.col("id").alias("root"))
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("heard"))
        best = labels.join(heard, labels["id"] == heard["a"], "left").select("id", "root", F.least("root", F.coalesce("heard", "root")).alias("new"))
        hop = best.select(F.col("id").alias("hop"), F.col("new").alias("further"))
        moved = best.join(hop, best["new"] == hop["hop"]).select("id", "root", F.least("new", "further").alias("new"))
        moved = written(moved, "labels")
        labels = moved.select("id", F.col("new").alias("root"))
        if moved.where("new <> root").isEmpty():
            return labels


def group_identity(members: DataFrame, group: str, order: str, path: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 of a group's paths, one a line, in order. A
    group is one output row by definition, and so is the list of its paths."""
    paths = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("place"), F.col(path).alias("path")))), lambda x: x["path"])
    return members.groupBy(group).agg(F.substring(F.sha2(F.array_join(paths, "\n"), 256), 1, 16).alias("group_id"))


def split_groups(groups: DataFrame, group: str, seed: str) -> DataFrame:
    """(group, split): a tenth of the groups, at least one each, to test and to val, in
    the order of a seeded hash. The two cuts are found from counts of the hash's prefixes;
    only groups of the prefix that a cut falls in are sorted."""
    n = groups.select(group).distinct()
    size = n.count()
    if size < 3:
        raise ValueError(f"at least 3 independent groups are needed, found {size}")
    take = max(1, size // 10)
    keyed = n.withColumn("_order", F.sha2(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")), 256))
    prefix = F.substring("_order", 1, 4)
    counts = sorted((r.p, r.n) for r in keyed.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 65,536 rows

    def cut(place: int) -> str:
        for value, size in counts:
            if place <= size:
                break
            place -= size
        return keyed.where(prefix == value).select("_order").orderBy("_order").limit(place).agg(F.max("_order")).first()[0]

    test, val = cut(take), cut(2 * take)
    return keyed.select(group, F.when(F.col("_order") <= test, "test").when(F.col("_order") <= val, "val").otherwise("train").alias("split"))


def leaks(rows: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Keys whose rows stand in more than one split: kind, value, splits."""
    out = None
    for key in keys:
        one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("value")).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
        one = one.select(F.lit(key).alias("kind"), "value", F.array_join("s", ",").alias("splits"))
        out = one if out is None else out.unionByName(one)
    return out


def grouped_manifest(manifest: DataFrame, seed: str = "42", radius: int = 6) -> DataFrame:
    """Adds group_root, group_id, split and split_basis to manifest rows: groups join what
    shares content, a subject or a near perceptual hash."""
    manifest = written(manifest, "manifest-rows")
    values = near_pairs(manifest.select(F.col("phash").alias("h")), radius, h_col="h")
    first = manifest.groupBy(F.col("phash").alias("h")).agg(F.min("doc_id").alias("i"))
    near = values.join(first, "h").join(first.select(F.col("h").alias("g"), F.col("i").alias("j")), "g").select(F.col("i").alias("a"), F.col("j").alias("b"))
    edges = star_edges(manifest, "doc_id", ["sha256", "subject_id", "phash"]).unionByName(near)
    roots = connected(manifest.select(F.col("doc_id").alias("id")), edges)
    rows = written(manifest.join(roots, manifest["doc_id"] == roots["id"]).drop("id").withColumnRenamed("root", "group_root"), "grouped")
    groups = written(group_identity(rows, "group_root", "image_path", "image_path"), "groups")
    rows = rows.join(groups.join(split_groups(groups, "group_id", seed), "group_id"), "group_root")
    return rows.withColumn("split_basis", F.when(F.col("subject_id").isNotNull(), "subject+perceptual").otherwise("perceptual; not subject-independent"))


def split_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("group_id").alias("groups"))


def leaves_of(edges: DataFrame) -> Column:
    """A node is an endpoint if it has one edge."""
    return F.col("degree") == 1


def degrees(edges: DataFrame, *node: tuple[str, str]) -> DataFrame:
    """Degree of each node; `node` pairs the columns of an edge's two ends."""
    a = edges.select("image_id", *[F.col(x).alias(x) for x, _ in node])
    b = edges.select("image_id", *[F.col(y).alias(x) for x, y in node])
    return a.unionByName(b).groupBy("image_id", *[x for x, _ in node]).agg(F.count(F.lit(1)).alias("degree"))
