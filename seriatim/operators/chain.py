"""Walks along previous and next links.

A link table has one row per node with at most one link out of it, so a walk
is a path that ends, or runs into itself. All nodes are placed on their chains
at once (``ranking``), and walks are read off: a walk from a seed is what its
path holds from the seed's place on, then what the path holds into which that
one leads, from where it leads to. Whatever the number of seeds on one chain, it
is worked out once, and only the result has a row for each seed and node.

The walk over whole paths goes by doubling: in round k every walk takes the
2^k-step jump from all it has reached, and only walks that filled the last round
go on. A round writes only what it newly reached, to the shared folder, so a
lost executor repeats one round at most. Jumps of earlier rounds are removed.

Paths are read in blocks of places, so a chain that holds a third of all nodes
is many join keys. A node many others link to (a third of all links may name the
same one) makes its join key hot on the side that repeats it; the other side has
the node once, so Spark splits the hot side at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.operators import ranking
from seriatim.operators.ranking import Ranks
from seriatim.sources.shared import counted, discard, measured, written


def _steps(edges: DataFrame, node: str, link: str) -> DataFrame:
    """The nodes with a record and the link out of each, written once: every round starts from them."""
    return written(edges.select(F.col(node).alias("_at"), F.col(link).alias("_to")), "steps")


def _same(columns: Sequence[str]) -> Column:
    """One key of all columns, in which nulls are equal."""
    return F.struct(*columns)


def _jumps(steps: DataFrame) -> DataFrame:
    """The links a walk can take: those that name a node with a record."""
    return steps.where(F.col("_to").isNotNull()).join(steps.select(F.col("_at").alias("_to")), "_to", "left_semi")


def _doubled(jump: DataFrame, name: str) -> DataFrame:
    """Jumps twice as far; those that would lead past a walk's end are gone."""
    on = jump.select(F.col("_at").alias("_to"), F.col("_to").alias("_next"))
    doubled = written(jump.join(on, "_to").select("_at", F.col("_next").alias("_to")), name)
    discard(jump)
    return doubled


def walk(
    edges: DataFrame,
    seeds: DataFrame,
    node: str,
    link: str,
    seed: str,
    *,
    stop: str | None = None,
    held: bool = False,
) -> DataFrame:
    """Every node a walk from each seed visits, with its ``depth``; the seed itself is depth 0.

    A walk ends where the link is null, names a node without a record, or a
    node it has already visited. A node whose boolean column ``stop`` is true
    counts as having no record. ``seeds`` has one row per walk; its columns are
    kept. Seeds without a record walk nowhere. ``held``: see ``ranking.ranked``.
    """
    return walk_ranked(ranking.ranked(edges, node, link, stop=stop, held=held), seeds, node, seed)


def walk_ranked(ranks: Ranks, seeds: DataFrame, node: str, seed: str) -> DataFrame:
    """``walk`` over chains already ranked."""
    parts = stretches(ranks, seeds, seed)
    last = F.expr(f"(_length - 1) DIV {ranking.SPAN}")
    first = F.when(F.col("_loop"), F.lit(0)).otherwise(F.expr(f"_entry DIV {ranking.SPAN}"))
    cut = parts.withColumn("_block", F.explode(F.sequence(first, last)))
    placed = ranks.placed.select(F.col("node").alias("_node"), F.col("path").alias("_path"), F.col("place").alias("_place"), F.col("block").alias("_block"))
    further = F.col("_place") - F.col("_entry")
    depth = F.col("_base") + F.when(F.col("_loop"), F.pmod(further, F.col("_length"))).otherwise(further)
    read = cut.join(placed, ["_path", "_block"]).where(F.col("_loop") | (further >= 0))
    return read.select(*seeds.columns, F.col("_node").alias(node), depth.cast("bigint").alias("depth"))


def stretches(ranks: Ranks, seeds: DataFrame, seed: str) -> DataFrame:
    """The stretches of paths that make up each walk.

    The seeds' columns, ``_hop`` from 0, ``_path``, its ``_length`` and ``_loop``,
    the place of ``_entry``, and as ``_base`` how deep the walk is there.
    """
    placed = ranks.placed.select(F.col("node").alias(seed), F.col("path").alias("_path"), F.col("place").alias("_entry"))
    lengths = ranks.paths.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("loop").alias("_loop"))
    none = F.lit(0).cast("bigint")
    begun = seeds.join(placed, seed).join(lengths, "_path")
    names = [*seeds.columns, "_hop", "_path", "_length", "_loop", "_entry", "_base"]
    first = begun.withColumns({"_hop": none, "_base": none}).select(*names)
    if not ranks.exits:
        return first
    first = written(first, "begun")
    leading = ranks.paths.where("exit_path IS NOT NULL").select(F.col("path").alias("_start"))
    starts = first.select(F.col("_path").alias("_start")).distinct().join(leading, "_start", "left_semi")
    passed = _stepped(ranks.paths.select("path", "exit_path"), starts, "path", "exit_path", "_start")
    hops = passed.withColumnRenamed("depth", "_hop").join(ranks.paths, "path")
    order = Window.partitionBy("_start").orderBy("_hop")
    entered = hops.withColumn("_entry", F.lag("exit_place").over(order))
    inside = F.when(F.col("_hop") > 0, F.col("length") - F.col("_entry"))
    before = F.coalesce(F.sum(inside).over(order.rowsBetween(Window.unboundedPreceding, -1)), none)
    rest = entered.withColumn("_before", before).where("_hop > 0").select(
        "_start", F.col("_hop"), F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("loop").alias("_loop"), "_entry", "_before"
    )
    own = first.select(*seeds.columns, F.col("_path").alias("_start"), (F.col("_length") - F.col("_entry")).alias("_first"))
    later = own.join(rest, "_start").withColumn("_base", F.col("_first") + F.col("_before"))
    return first.unionByName(later.select(*names))


def _stepped(edges: DataFrame, seeds: DataFrame, node: str, link: str, seed: str) -> DataFrame:
    """``walk`` by doubling, which writes a row for each walk and node."""
    steps = _steps(edges, node, link)
    starts = seeds.join(steps.select(F.col("_at").alias(seed)), seed, "left_semi")
    reach, held = counted(
        starts.select(*seeds.columns, F.col(seed).alias(node), F.lit(0).cast("bigint").alias("depth")), "walk"
    )
    jump = written(_jumps(steps).select("_at", "_to"), "jump")
    parts, step, going = [reach], 1, reach
    while held:
        further = (
            going.join(jump, going[node] == jump["_at"])
            .withColumn(node, F.col("_to"))
            .withColumn("depth", F.col("depth") + step)
            .drop("_at", "_to")
        )
        # The least depth per node is when a looping walk first came by; nodes it had before are not new.
        least = going.unionByName(further).groupBy(*seeds.columns, node).agg(F.min("depth").alias("depth"))
        last = 2 * step - 1
        part, seen = measured(least.where(F.col("depth") >= step), "walk", full=F.count_if(F.col("depth") == last))
        parts.append(part)
        # A walk that did not get as far as the jump allows has ended.
        held = seen["full"]
        if held:
            full = part.where(F.col("depth") == last).select(_same(seeds.columns).alias("_walk"))
            walks = reduce(DataFrame.unionByName, parts).withColumn("_walk", _same(seeds.columns))
            going = walks.join(full, "_walk", "left_semi").drop("_walk")
            jump, step = _doubled(jump, "jump"), 2 * step
    discard(jump)
    return reduce(DataFrame.unionByName, parts)


def links_inside(edges: DataFrame, node: str, link: str, title: str, starts: DataFrame | None = None) -> DataFrame:
    """The link table with those links nulled that lead out of an episode; every node keeps its record.

    A link leads out where the node it names has another ``title`` (null is a
    title like any other) or is one of ``starts``, a table of one column: the
    first pages of listed episodes. A walk from a start then stays in its episode.
    """
    onto = edges.select(F.col(node).alias("_onto"), F.struct(title).alias("_titled"))
    starts_one = F.lit(False)
    if starts is not None:
        first = starts.select(F.col(starts.columns[0]).alias("_onto"), F.lit(True).alias("_starts")).distinct()
        onto, starts_one = onto.join(first, "_onto", "left"), F.col("_starts").isNotNull()
    onto = onto.withColumn("_first", starts_one).select("_onto", "_titled", "_first")
    out = F.col("_first") | (F.col("_titled") != F.struct(title))
    kept = F.when(F.col("_onto").isNull() | ~out, F.col(link))
    return edges.join(onto, F.col(link) == F.col("_onto"), "left").withColumn(link, kept).select(*edges.columns)


def ends(edges: DataFrame, node: str, link: str, end: str) -> DataFrame:
    """Where the links from each node lead in the end; a node without a link is its own ``end``.

    For links that never come back to a node. One row per node throughout.
    """
    first = edges.select(F.col(node).alias("_at"), F.coalesce(link, node).alias("_to"))
    at, left = measured(first, "ends", moves=F.count_if(F.col("_to") != F.col("_at")))
    while left["moves"]:
        on = at.select(F.col("_at").alias("_to"), F.col("_to").alias("_next"))
        further = at.select("_at", "_to").join(on, "_to", "left").select(
            "_at", F.coalesce("_next", "_to").alias("_to"), (F.col("_next") != F.col("_to")).alias("_moved")
        )
        nearer, left = measured(further, "ends", moves=F.count_if("_moved"))
        discard(at)
        at = nearer
    return at.select(F.col("_at").alias(node), F.col("_to").alias(end))


def both_ways(edges: DataFrame, seeds: DataFrame, node: str, prev: str, next_: str, seed: str) -> DataFrame:
    """The reading order around each seed: what lies before it, the seed, what lies after.

    The walk goes back first; the walk on stops at the first node the walk back
    took. ``depth`` is negative before the seed.
    """
    held = written(edges.select(node, prev, next_), "edges")
    back = walk(held, seeds, node, prev, seed, held=True).withColumn("depth", -F.col("depth"))
    on = walk(held, seeds, node, next_, seed, held=True)
    # both are read twice: worked out again, each would shuffle all places again
    back, on = written(back, "back"), written(on, "on")
    keys = seeds.columns
    taken = on.where("depth > 0").join(back.select(*keys, node, F.col("depth").alias("_back")), [*keys, node])
    cut = taken.groupBy(*keys).agg(F.min("depth").alias("_cut"))
    ahead = (
        on.where("depth > 0")
        .join(cut, keys, "left")
        .where(F.col("_cut").isNull() | (F.col("depth") < F.col("_cut")))
        .drop("_cut")
    )
    return back.unionByName(ahead)


def link_audit(edges: DataFrame, node: str, prev: str, next_: str) -> DataFrame:
    """Links that do not hold up: one row per finding, as ``node``, ``link`` and ``problem``.

    ``dangling``: a link to a node without a record; ``one-way``: a next link
    whose target does not link back.
    """
    nodes = edges.select(F.col(node).alias("link"))
    named = edges.select(
        F.col(node).alias("node"),
        F.explode(F.array(F.struct(F.col(prev).alias("link")), F.struct(F.col(next_).alias("link")))).alias("_l"),
    ).select("node", "_l.link")
    dangling = named.where(F.col("link").isNotNull()).join(nodes, "link", "left_anti")
    back = edges.select(F.col(node).alias("link"), F.col(prev).alias("_back"))
    forward = edges.select(F.col(node).alias("node"), F.col(next_).alias("link")).where(F.col("link").isNotNull())
    one_way = forward.join(back, "link").where(~F.equal_null(F.col("_back"), F.col("node")))
    return dangling.select("node", "link", F.lit("dangling").alias("problem")).unionByName(
        one_way.select("node", "link", F.lit("one-way").alias("problem"))
    )


def in_cycles(edges: DataFrame, node: str, link: str) -> DataFrame:
    """The nodes that a walk from themselves comes back to.

    Where all nodes get to after 2^k steps shrinks with k until only cycles are
    left; once doubling the steps loses no node, none is left to lose.
    """
    jump = written(_jumps(_steps(edges, node, link)).select("_at", "_to"), "cycle")
    size, held = -1, jump.select("_to").distinct().count()
    while held != size and held > 0:
        size = held
        jump = _doubled(jump, "cycle")
        held = jump.select("_to").distinct().count()
    return jump.select(F.col("_to").alias(node)).distinct()
