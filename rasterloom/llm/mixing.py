"""Mixing sources to target weights by hierarchical budgeting.

The columns named in `levels` (domain, language, source) make a tree. A node's token
budget is dealt to its children by weight; a child whose supply (tokens times
`max_epochs`) is smaller than its share takes all of its supply, and what it leaves
goes to its siblings by weight. As a node never gets more than its subtree can supply,
a shortage reaches the ancestors' other children only when all siblings are full.
All steps are window functions over the small table of nodes, in exact integers.

A leaf with budget B and T tokens takes ``B div T`` whole epochs and then a prefix of
the next epoch. An epoch's order is the md5 of seed, epoch and id. The prefix is found
without sorting a leaf in one task: md5 prefixes are buckets, bucket sums locate the
one bucket that the budget ends in, and only that bucket's rows are sorted.

Defined results: a null level value is its own node ``''``; a null or empty text has 0
tokens and is taken where its place in the order lies before the end of the budget; a
leaf without a single token gives no rows; a weight of 0 or less shuts a node; repeated rows count as separate documents with equal
rank; an empty table gives an empty result; other columns pass through, but for names that
start with `_mix_`, which are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Most nodes for which the table of budgets is broadcast; above it, it is shuffled.
BROADCAST_NODES = 100_000


def count_tokens(text: Column) -> Column:
    """Words between white space: the unit of the budgets."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]], default: int) -> Column:
    out = F.lit(default)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _dealt(children: DataFrame, parents: Sequence[str], key: str) -> DataFrame:
    """Adds `budget` to `children` (columns weight, cap, parent_budget)."""
    order = Window.partitionBy(*parents).orderBy("ratio", key)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parents)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    df = (
        children.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("after", F.sum("weight").over(after))
        .withColumn("full", wide("cap") * F.col("after") <= (wide("parent_budget") - F.col("before")) * F.col("weight"))
        .withColumn("rest", F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(whole))
        .withColumn("share", F.expr("CASE WHEN full THEN cap ELSE CAST(rest AS decimal(38,0)) * weight div open_weight END"))
        .withColumn("left_over", F.col("parent_budget") - F.sum("share").over(whole))
        .withColumn("turn", F.when(~F.col("full"), F.sum(F.when(~F.col("full"), 1).otherwise(0)).over(order)))
    )
    extra = F.when(~F.col("full") & (F.col("turn") <= F.col("left_over")), 1).otherwise(0)
    return df.withColumn("budget", (F.col("share") + extra).cast("long")).select(*parents, key, "cap", "budget")


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    share: tuple[int, int],
    max_epochs: int = 1,
    default_weight: int = 1,
) -> DataFrame:
    """`leaves` has the level columns, `tokens` and `docs`; returns them with `budget`.

    The whole budget is the fraction `share` (numerator, denominator) of all tokens, or
    all that the open leaves can supply if that is less.
    """
    every = leaves.withColumn("alive", F.lit(True))
    for level in levels:
        every = every.withColumn("alive", F.col("alive") & (_weight(level, weights, default_weight) > 0))
    every = every.withColumn("cap", F.when(F.col("alive"), F.col("tokens") * max_epochs).otherwise(0))
    budgets = every.agg(
        F.least(F.expr(f"coalesce(sum(tokens), 0) * {share[0]} div {share[1]}"), F.coalesce(F.sum("cap"), F.lit(0))).alias("parent_budget")
    ).withColumn("_root", F.lit(1))
    parents: list[str] = ["_root"]
    every = every.withColumn("_root", F.lit(1))
    for level in levels:
        nodes = (
            every.where("alive").groupBy(*parents, level).agg(F.sum("cap").alias("cap"))
            .withColumn("weight", _weight(level, weights, default_weight))
            .join(budgets, parents)
        )
        budgets = _dealt(nodes, parents, level)
        parents = [*parents, level]
        budgets = budgets.select(*parents, F.col("budget").alias("parent_budget"))
    return every.join(budgets.withColumnRenamed("parent_budget", "budget"), parents, "left").select(
        *levels, "tokens", "docs", F.coalesce("budget", F.lit(0)).alias("budget")
    )


def _mix_rank(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    share: tuple[int, int],
    levels: Sequence[str] = ("domain", "lang", "source"),
    max_epochs: int = 1,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    default_weight: int = 1,
) -> DataFrame:
    """The rows of `docs`, all columns, once for each epoch that takes them, with
    `_mix_epoch`, `_mix_tokens` and `_mix_taken` (tokens of this row within the leaf's budget).
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("_mix_")])
    keys = [f"_mix_level{i}" for i in range(len(levels))]
    rows = docs.withColumn("_mix_tokens", count_tokens(F.col(text_col)))
    for key, level in zip(keys, levels):
        rows = rows.withColumn(key, F.coalesce(F.col(level).cast("string"), F.lit("")))
    by_key = {key: weights.get(level, {}) for key, level in zip(keys, levels)}

    slim = written(rows.select(*keys, F.col(id_col).alias("_id"), "_mix_tokens"), "mix-slim")
    leaves = written(slim.groupBy(*keys).agg(F.sum("_mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).coalesce(1), "mix-leaves")
    plan = leaf_budgets(leaves, keys, by_key, share, max_epochs, default_weight).select(
        *keys,
        F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END").cast("int").alias("_mix_full"),
        F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END").alias("_mix_rest"),
        # an md5 prefix of so many digits leaves about 60 to 1,000 documents to a bucket
        F.greatest(F.lit(1), F.ceil(F.log(16.0, F.greatest(F.col("docs") / 1000, F.lit(1.0))))).cast("int").alias("_mix_digits"),
    )
    plan = written(plan, "mix-plan")
    small = plan.count() <= BROADCAST_NODES
    side = F.broadcast if small else (lambda x: x)

    def placed(df: DataFrame, doc_id: Column, table: DataFrame) -> DataFrame:
        df = df.join(side(table), keys)
        df = df.withColumn("_mix_rank", _mix_rank(seed, F.col("_mix_full"), doc_id))
        return df.withColumn("_mix_bucket", F.expr("substring(_mix_rank, 1, _mix_digits)"))

    buckets = placed(slim, F.col("_id"), plan.where("_mix_rest > 0")).groupBy(*keys, "_mix_rest", "_mix_bucket").agg(F.sum("_mix_tokens").alias("bucket_tokens"))
    upto = Window.partitionBy(*keys).orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        buckets.withColumn("_mix_start", F.coalesce(F.sum("bucket_tokens").over(upto), F.lit(0)))
        .where("_mix_start < _mix_rest AND _mix_rest <= _mix_start + bucket_tokens")
        .select(*keys, F.col("_mix_bucket").alias("_mix_end"), "_mix_start")
    )
    plan = written(plan.join(ends, keys, "left"), "mix-ends")

    taken = placed(rows, F.col(id_col), plan.where("_mix_full > 0 OR _mix_rest > 0"))
    whole = taken.where("_mix_full > 0").withColumn("_mix_epoch", F.explode(F.expr("sequence(0, _mix_full - 1)"))).withColumn("_mix_taken", F.col("_mix_tokens"))
    prefix = taken.where("_mix_bucket < _mix_end").withColumn("_mix_epoch", F.col("_mix_full")).withColumn("_mix_taken", F.col("_mix_tokens"))
    order = Window.partitionBy(*keys).orderBy("_mix_rank", id_col, "_mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        taken.where("_mix_bucket = _mix_end")
        .withColumn("_mix_before", F.col("_mix_start") + F.coalesce(F.sum("_mix_tokens").over(order), F.lit(0)))
        .where("_mix_before < _mix_rest")
        .withColumn("_mix_epoch", F.col("_mix_full"))
        .withColumn("_mix_taken", F.least(F.col("_mix_tokens"), F.col("_mix_rest") - F.col("_mix_before")))
        .drop("_mix_before")
    )
    columns = [*docs.columns, "_mix_epoch", "_mix_tokens", "_mix_taken"]
    return whole.select(*columns).unionByName(prefix.select(*columns)).unionByName(last.select(*columns))


#: The query's targets; nodes that are not named weigh 1.
WEIGHTS = {
    "domain": {"web0": 4, "web1": 3, "web2": 2, "web3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 2, "src1": 3, "src2": 1, "src3": 2, "src4": 5},
}
SHARE, MAX_EPOCHS, SEED = (9, 10), 2, "mix-1"


def with_domain(docs: DataFrame) -> DataFrame:
    """Adds the tree's top level: four domains by the source's number."""
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return docs.withColumn("domain", F.concat(F.lit("web"), (number % 4).cast("string")))


def _case(column: str, weights: Mapping[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"


def _level_sql(name: str, parent: str, keys: list[str]) -> str:
    key, above = keys[-1], ", ".join(keys[:-1]) or "1"
    on = " AND ".join(f"p.{k} = c.{k}" for k in keys[:-1]) or "TRUE"
    cols = ", ".join(keys)
    return f"""
{name}_c AS (SELECT {cols}, {_case(key, WEIGHTS[key])} AS weight, sum(tokens) * {MAX_EPOCHS} AS cap FROM leaves GROUP BY {cols}),
{name}_a AS (SELECT c.*, p.budget AS pb FROM {name}_c c JOIN {parent} p ON {on}),
{name}_b AS (SELECT *,
  cap::HUGEINT * sum(weight) OVER (PARTITION BY {above} ORDER BY cap::DOUBLE / weight, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (pb - coalesce(sum(cap) OVER (PARTITION BY {above} ORDER BY cap::DOUBLE / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT * weight AS full_
  FROM {name}_a),
{name}_d AS (SELECT *, CASE WHEN full_ THEN cap ELSE
  (pb - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {above}))::HUGEINT * weight
    // sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY {above}) END AS share
  FROM {name}_b),
{name} AS (SELECT {cols}, (share + CASE WHEN NOT full_ AND
    sum(CASE WHEN full_ THEN 0 ELSE 1 END) OVER (PARTITION BY {above} ORDER BY cap::DOUBLE / weight, {key} ROWS UNBOUNDED PRECEDING)
      <= pb - sum(share) OVER (PARTITION BY {above}) THEN 1 ELSE 0 END)::BIGINT AS budget
  FROM {name}_d)"""


ORACLE = f"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         'web' || (coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '(\\d+)$', 1) AS INT), 0) % 4) AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM t GROUP BY ALL),
top AS (SELECT least(sum(tokens) * {SHARE[0]} // {SHARE[1]}, sum(tokens) * {MAX_EPOCHS}) AS budget FROM leaves),
{_level_sql("l1", "top", ["domain"])},
{_level_sql("l2", "l1", ["domain", "lang"])},
{_level_sql("l3", "l2", ["domain", "lang", "source"])},
plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN b.budget // tokens ELSE 0 END AS full_e, CASE WHEN tokens > 0 THEN b.budget % tokens ELSE 0 END AS rest
         FROM leaves l JOIN l3 b USING (domain, lang, source)),
d AS (SELECT t.*, full_e, rest, coalesce(sum(n) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('{SEED}:' || full_e || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM t JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(e AS INT) AS epoch, n::BIGINT AS n_tokens, n::BIGINT AS taken
FROM d, LATERAL (SELECT unnest(range(full_e::BIGINT)) AS e)
UNION ALL
SELECT doc_id, domain, lang, source, CAST(full_e AS INT), n::BIGINT, least(n, rest - before)::BIGINT FROM d WHERE before < rest
"""
