"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.sources.shared import discard, measured, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and its component's least node as ``label``, for every node of some link.

    Each round takes the least label among a node's neighbours and then the
    label of that label, so long chains halve as well; it is written to the
    shared folder, so a lost executor repeats one round at most.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("near")).where("node <> near")
    both = written(pairs.union(pairs.select("near", "node")).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("near")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("near"), "label"), "near")
        least = (
            near.select("node", "label", F.lit(None).cast("bigint").alias("old"))
            .union(labels.select("node", "label", F.col("label").alias("old")))
            .groupBy("node")
            .agg(F.min("label").alias("label"), F.max("old").alias("old"))
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = least.join(jump, "label", "left").select(
            "node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"
        )
        known, seen = measured(stepped, "labels", moved=F.count_if(F.col("label") != F.col("old")))
        discard(labels)
        labels = known
        if not seen["moved"]:
            discard(both)
            return labels.select("node", "label")
