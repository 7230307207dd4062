"""Mixing sources to target weights down a tree of domain, language and source.

Only DataFrame operations. Budgets go from the root to the leaves: among the
children of a node the budget is split by weight; a child that cannot take its
share (it has its tokens ``max_epochs`` times over and no more) takes what it
has, and its shortage goes to its siblings by weight. What a node can take is
what its leaves can, so a shortage leaves a family only when all of it is
full. A leaf's budget buys whole epochs and a prefix, in tokens, of one more,
whose order is a seeded hash.

The running sum that finds the prefix never sorts a leaf in one task: hash
buckets of a leaf are summed first, and only the one bucket in which the
prefix ends is looked at row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.llm.rows import KEY, WORD
from seriatim.sources.shared import written

#: Hexadecimal digits of the hash that name a bucket: 4,096 buckets a leaf.
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _shared_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Each node's ``budget`` out of its parent's, by ``weight`` and up to ``cap``."""
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.col("cap").cast("double") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns(
        {
            "_cap": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "_weight": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "_all": F.sum("weight").over(family),
        }
    )
    rest = (F.col("_parent") - F.col("_cap")).cast("double") * F.col("weight")
    nodes = nodes.withColumn("_full", rest >= F.col("cap").cast("double") * (F.col("_all") - F.col("_weight")))
    nodes = nodes.withColumns(
        {
            "_full_cap": F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(family),
            "_full_weight": F.sum(F.when(F.col("_full"), F.col("weight")).otherwise(0)).over(family),
        }
    )
    left = (F.col("_parent") - F.col("_full_cap")).cast("double") * F.col("weight")
    part = F.floor(left / (F.col("_all") - F.col("_full_weight")))
    budget = F.when(F.col("_full"), F.col("cap")).otherwise(F.least(F.col("cap"), part))
    return nodes.withColumn("budget", budget.cast("bigint")).drop(
        "_cap", "_weight", "_all", "_full", "_full_cap", "_full_weight", "_parent"
    )


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: dict[str, str],
    share: tuple[int, int],
    max_epochs: int,
) -> DataFrame:
    """``levels``, ``tokens`` and ``budget`` of every leaf; ``leaves`` has ``levels`` and ``tokens``."""
    sized = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    whole = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_tokens"), F.coalesce(F.sum("cap"), F.lit(0)).alias("_cap"))
    root = whole.select(
        F.lit(0).alias("_root"),
        F.least(F.floor(F.col("_tokens") * share[0] / share[1]).cast("bigint"), F.col("_cap")).alias("_parent"),
    )
    above, parent = root, ["_root"]
    for depth, level in enumerate(levels, 1):
        path = list(levels[:depth])
        nodes = sized.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumns({"_root": F.lit(0), "weight": F.expr(weights.get(level, "1")).cast("bigint")})
        nodes = _shared_out(nodes.join(above, parent), parent, level)
        above = nodes.select("_root", *path, F.col("budget").alias("_parent"))
        parent = ["_root", *path]
    return nodes.select(*levels, "tokens", "budget")


def mixed(
    docs: DataFrame,
    levels: dict[str, str],
    weights: dict[str, str] | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    share: tuple[int, int] = (1, 1),
    max_epochs: int = 1,
    seed: int = 0,
) -> DataFrame:
    """The documents chosen: ``doc_id``, ``levels``, ``n_tokens``, ``epochs``, ``leaf_tokens``, ``leaf_budget``, ``_k1``, ``_k2``.

    ``levels`` names the tree from the root down, each an SQL expression over
    ``docs``; null counts as the empty name. ``weights`` gives by such an
    expression a positive whole number for a node from its own columns, 1
    where left out. The whole budget is
    ``share`` (numerator, denominator) of the table's tokens, whole words
    here. ``epochs`` says how often a document is taken: once for each whole
    epoch its leaf can pay, once more if it lies in the prefix of the next.
    Shares are rounded down to whole tokens. Texts without words cost nothing
    and come with their leaf's whole epochs or its prefix. Null or repeated
    ids stand; other columns play no part.
    """
    names = list(levels)
    named = docs.select(
        F.col(doc_id).alias("_id"),
        n_words(F.col(text)).alias("n_tokens"),
        *(F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(n) for n, c in levels.items()),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("_k1"),
        F.xxhash64(F.lit(7), F.col(text), F.col(doc_id)).alias("_k2"),
    )
    rows = written(named, "mixing")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, names, weights or {}, share, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    budgets = written(
        budgets.withColumn("_whole", whole).withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("tokens")), "budgets"
    )
    order = F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")
    )
    placed = rows.join(budgets, names).withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, DIGITS))
    leaf = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = placed.groupBy(*names, "_bucket").agg(F.sum("n_tokens").alias("_sum"), F.first("_rest").alias("_limit"))
    buckets = buckets.withColumn("_upto", F.sum("_sum").over(leaf)).select(
        *names,
        "_bucket",
        (F.col("_upto") - F.col("_sum")).alias("_from"),
        (F.col("_upto") <= F.col("_limit")).alias("_inside"),
    )
    placed = placed.join(buckets, [*names, "_bucket"])
    split = ~F.col("_inside") & (F.col("_from") <= F.col("_rest"))
    inner = Window.partitionBy(*names, "_bucket").orderBy("_order", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.where(split).withColumn("_inside", F.col("_from") + F.sum("n_tokens").over(inner) <= F.col("_rest"))
    chosen = placed.where(~split).unionByName(ends)
    taken = F.least(F.col("_whole") + F.col("_inside").cast("bigint"), F.lit(max_epochs))
    chosen = chosen.withColumn("epochs", taken.cast("bigint"))
    return chosen.where("epochs > 0").select(
        F.col("_id").alias(doc_id),
        *names,
        "n_tokens",
        "epochs",
        F.col("tokens").alias("leaf_tokens"),
        F.col("budget").alias("leaf_budget"),
        *KEY,
    )
