"""Sharding by Karmarkar-Karp differencing, groups of equal texts kept whole.

The differencing runs in a tree. Groups of equal texts fall into cells by
hash, at most about ``CELL`` groups each; a task differences a cell: it keeps
combining the two partial partitions of largest spread, oppositely ordered.
What a cell leaves is a partial partition itself, and cells are differenced
the same way, ``FAN`` at a time, until one is left. The groups' places follow
the orders back down. No task sees more than a cell; a group of copies is one
row from the start.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.llm.rows import utf8_crc32, utf8_size
from seriatim.sources.shared import counted, written

CELL, FAN = 20_000, 4096
#: Rows of one numbered stretch of a shard.
STRETCH = 100_000


def differenced(sums: list[list[int]]) -> np.ndarray:
    """For each partial partition (sums by bin), the bin of the whole that each of its bins ends in."""
    bins = len(sums[0])
    nodes: list[tuple[int, int, list[int], list[int]]] = []
    heap = []
    for n, s in enumerate(sums):
        order = sorted(range(bins), key=s.__getitem__)
        heap.append((s[order[0]] - s[order[-1]], n, [s[k] for k in order], order))
    heapq.heapify(heap)
    count = len(sums)
    while len(heap) > 1:
        _, a, low, order_a = heapq.heappop(heap)
        _, b, high, order_b = heapq.heappop(heap)
        order_b = order_b[::-1]
        joint = [x + y for x, y in zip(low, high[::-1])]
        nodes.append((a, b, order_a, order_b))
        order = sorted(range(bins), key=joint.__getitem__)
        joint = [joint[k] for k in order]
        heapq.heappush(heap, (joint[0] - joint[-1], count, joint, order))
        count += 1
    # a node's bins are numbered as its two parts were laid against each other; the root's as they come
    place = np.zeros((count, bins), np.int64)
    place[count - 1] = np.arange(bins)
    for n in range(len(nodes) - 1, -1, -1):
        a, b, order_a, order_b = nodes[n]
        whole = place[len(sums) + n]
        place[a][order_a] = whole
        place[b][order_b] = whole
    return place[: len(sums)]


def _level(bins: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, at, size = (table.column(n).to_numpy() for n in ("node", "bin", "size"))
        names, own = np.unique(node, return_inverse=True)
        sums = np.zeros((len(names), bins), np.int64)
        sums[own, at] = size
        place = differenced(sums.tolist())
        return pa.table({"node": np.repeat(names, bins), "bin": np.tile(np.arange(bins), len(names)), "up": place.ravel()})

    return run


def _cell(bins: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # one order of the groups whatever order they arrive in
        table = table.sort_by([("size", "descending"), ("_g1", "ascending"), ("_g2", "ascending")])
        sums = [[s] + [0] * (bins - 1) for s in table.column("size").to_pylist()]
        place = differenced(sums)[:, 0]
        return table.append_column("bin", pa.array(place, pa.int64()))

    return run


def sharded(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16, cell: int = CELL, fan: int = FAN
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every document.

    The law is ``bytes``: the shards' sums of ``size`` (UTF-8 bytes plus one)
    are nearly equal. Documents of equal text share a shard; a null text is
    a group of its own beside the empty one. ``slot`` numbers a shard's rows
    from 0 without gaps; ``grown_shard`` is null under this law. Ids may be
    null or repeat; every row gets a slot. Other columns play no part.
    """
    t = F.col(text)
    rows = docs.select(
        F.col(doc_id).alias("_id"),
        (utf8_size(t) + 1).alias("size"),
        utf8_crc32(t).alias("text_crc32"),
        F.xxhash64(t).alias("_g1"),
        F.xxhash64(F.lit(7), t).alias("_g2"),
    )
    rows, n_rows = counted(rows, "sizes")
    groups, n = counted(rows.groupBy("_g1", "_g2").agg(F.sum("size").alias("size")), "groups")
    cells = max(1, -(-n // cell))
    groups = groups.withColumn("node", F.pmod("_g2", F.lit(cells)))
    own = written(
        groups.groupBy("node").applyInArrow(_cell(shards), "_g1 bigint, _g2 bigint, size bigint, node bigint, bin bigint"), "cells"
    )
    while cells > 1:
        sums = own.groupBy("node", "bin").agg(F.sum("size").alias("size"))
        above = sums.withColumn("above", F.expr(f"node div {fan}"))
        placed = above.groupBy("above").applyInArrow(_level(shards), "node bigint, bin bigint, up bigint")
        cells = -(-cells // fan)
        own = written(
            own.join(placed, ["node", "bin"]).select("_g1", "_g2", "size", F.expr(f"node div {fan}").alias("node"), F.col("up").alias("bin")),
            "cells",
        )
    stretches = max(1, n_rows // STRETCH)
    at = rows.join(own.select("_g1", "_g2", F.col("bin").cast("int").alias("shard")), ["_g1", "_g2"])
    at = at.withColumn("_part", F.pmod(F.xxhash64("_id", "_g1"), F.lit(stretches)))
    of_shard = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = at.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = before.select("shard", "_part", F.coalesce(F.sum("_n").over(of_shard), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("shard", "_part").orderBy("_id", "_g1", "_g2")
    numbered = at.withColumn("_nth", F.row_number().over(inner)).join(before, ["shard", "_part"])
    return numbered.select(
        F.col("_id").alias(doc_id),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + F.col("_nth") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
