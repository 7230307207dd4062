"""How far the sources of a language differ in their words.

Every (language, source) group and every language as a whole gives each term
that is common enough a smoothed share ``p`` in whole parts of ``SCALE``; two
shares differ by ``floor((p - q)^2 / q)``. A group is held against each other
source of its language over all terms, and term by term against the language.

Most terms are missing from most sources, so a pair's sum starts from the value
it would have if no source had any term, plus what each side's own counts
change, which needs no more than a histogram of counts per source. What is left
are corrections for terms that both sources have. They come from a
frequent-pattern tree: a term's row of non-zero counts, sources with most terms
first, is a path; equal rows enter once with their number, rows with a common
beginning share its nodes, and each pair of a node and one of its ancestors
gives one correction, times the terms that pass the node.

Rows are range-partitioned in path order, so a task holds whole subtrees, but
for those cut at its ends, and a language with most of the terms is split.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.llm.rows import texts_of
from seriatim.sources.shared import written

SCALE, LEAST_DOCS, TOP = 10**9, 3, 200
#: Letters of ASCII and everything beyond it make terms.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Counts a task holds before it hands them on, cells of one tree, and the parts a language's pairs are dealt in.
HELD, CELLS, DEALT = 300_000, 2_000_000, 16
#: Cells of a path that ranges go by.
HEAD = 6


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; a row without a term says that the group occurs."""
    times: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in times.items():
            words, n, seen = list(found), list(found.values()), docs[lang, source]
            for a in range(0, len(words) + 1, 50_000):
                some = [w.decode() for w in words[a : a + 50_000]] + [None] * (a == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()),
                        pa.array([source] * len(some), pa.string()),
                        pa.array(some, pa.string()),
                        pa.array(n[a : a + 50_000] + [0] * (a == 0), pa.int64()),
                        pa.array([seen[w] for w in words[a : a + 50_000]] + [0] * (a == 0), pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
        times.clear()
        docs.clear()

    for batch in batches:
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for group, text in zip(groups, texts_of(batch.column("_text"))):
            words = TERM.findall(text.lower())
            times.setdefault(group, Counter()).update(words)
            docs.setdefault(group, Counter()).update(set(words))
        if sum(map(len, times.values())) > HELD:
            yield from handed()
    yield from handed()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share in whole parts; null where the language has no term."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    all_ = F.nullif(total + terms, F.lit(0)).cast("decimal(19,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", above, all_)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tree_corrections(place: np.ndarray, p: np.ndarray, none: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> tuple:
    """Corrections of all pairs of sources, from the tree of some paths.

    Path by path, ``sizes`` long: each source's ``place`` (rising), its share
    ``p`` of the terms and the share ``none`` it gives terms it lacks; ``times``
    terms have the path. Paths are sorted. Returns places a and b and the sum of
    corrections to a held against b.
    """
    rows, longest = len(sizes), int(sizes.max(initial=0))
    row = np.repeat(np.arange(rows), sizes)
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, share, lacks = (np.full((rows, longest), -1, np.int64) for _ in range(3))
    at[row, col], share[row, col], lacks[row, col] = place, p, none
    # a row goes on from the row before it as far as both agree; further on it makes nodes of its own
    same = np.zeros((rows, longest), bool)
    same[1:] = (at[1:] == at[:-1]) & (share[1:] == share[:-1])
    same = np.logical_and.accumulate(same, axis=1)
    width = int(place.max(initial=0)) + 1
    keys, sums = [], []
    for d in range(1, longest):
        inside = at[:, d] >= 0
        made = np.flatnonzero(inside & ~same[:, d])
        first = np.maximum.accumulate(np.where(~same[:, d], np.arange(rows), 0))[inside]
        through = np.bincount(first, times[inside], rows)[made].astype(np.int64)
        for a in range(d):
            i, j = at[made, a], at[made, d]
            p, q, p0, q0 = share[made, a], share[made, d], lacks[made, a], lacks[made, d]
            keys += [i * width + j, j * width + i]
            sums += [
                through * (_f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)),
                through * (_f(q, p) - _f(q, p0) - _f(q0, p) + _f(q0, p0)),
            ]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(key), np.int64)
    np.add.at(out, where, np.concatenate(sums))
    return key // width, key % width, out


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        edges = [n for n in range(1, len(langs)) if langs[n] != langs[n - 1]]
        for a, b in zip([0, *edges], [*edges, len(langs)]):
            sizes = batch.column("path").slice(a, b - a).value_lengths().to_numpy()
            # a tree is as large as a padded table of its rows
            step = max(1, CELLS // max(1, int(sizes.max(initial=1))))
            for c in range(a, b, step):
                part = batch.slice(c, min(step, b - c))
                path = part.column("path")
                flat = path.flatten()
                i, j, value = tree_corrections(
                    *(flat.field(k).to_numpy().astype(np.int64) for k in range(3)),
                    path.value_lengths().to_numpy(),
                    part.column("times").to_numpy(),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[a]] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value)],
                    names=["lang", "a", "b", "value"],
                )


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, occurrences ``n`` and documents ``docs``; a null term for every group that occurs."""
    named = docs.select(
        F.col(text).alias("_text"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(d) for c, d in ((lang, "lang"), (source, "source"))),
    )
    found = named.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of every group's divergences.

    Part ``pair``: ``item`` is each other source of the language, ``value`` the
    sum over all kept terms, 0 where none is kept. Part ``term``: the ``top``
    kept terms that the group has more often than its language. Ranks go by
    falling value, then by the item's UTF-8 bytes. A term is kept in a language
    where ``least_docs`` of its documents hold it. Null texts, languages and
    sources are empty strings; every row is a document, so repeated rows count
    as often as they stand; other columns play no part; an empty table gives no
    rows. Values beyond 64 bits cannot come up below 10^9 terms a language.
    """
    counts = written(term_counts(docs, text, lang, source), "counts")
    terms = (
        counts.where("term IS NOT NULL")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("cells"))
        .where(F.col("docs") >= least_docs)
    )
    terms = written(terms.select("lang", "term", "all_n", "cells"), "terms")
    cells = terms.select("lang", "term", "all_n", F.explode("cells").alias("cell")).select("lang", "term", "all_n", "cell.*")

    # every group with its totals, the share it gives a term it lacks, and its place: most terms first
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("has"))
    groups = (
        counts.select("lang", "source")
        .distinct()
        .join(own, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "has", "terms", "lang_total"])
    )
    order = Window.partitionBy("lang").orderBy(F.desc("has"), "source")
    groups = groups.withColumn("none", _share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"))).withColumn("place", F.row_number().over(order))
    groups = written(groups, "groups")

    placed = cells.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    placed = written(placed.select("lang", "source", "term", "place", "p", "none", _share(F.col("all_n"), F.col("lang_total"), F.col("terms")).alias("q")), "placed")

    paths = (
        placed.groupBy("lang", "term")
        .agg(F.sort_array(F.collect_list(F.struct("place", "p", "none"))).alias("path"))
        .where(F.size("path") > 1)
        .groupBy("lang", "path")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    # ranges go by the head of a path, which keeps what Spark samples for them small
    tree = paths.repartitionByRange("lang", F.slice("path", 1, HEAD)).sortWithinPartitions("lang", "path")
    both = (
        tree.mapInArrow(_corrected, "lang string, a int, b int, value bigint")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("both"))
    )

    tally = (
        placed.groupBy("lang", "place", "p")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("lang", "place")
        .agg(F.collect_list(F.struct("p", "times")).alias("tally"))
    )
    sides = groups.join(tally, ["lang", "place"], "left").select("lang", "source", "place", "none", "terms", "tally")
    salts = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("salt")
    one = sides.select("lang", F.col("source"), F.col("place").alias("a"), F.col("none").alias("p0"), F.col("tally").alias("mine"), "terms", salts)
    other = sides.select(
        "lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("none").alias("q0"), F.col("tally").alias("theirs"),
        F.pmod(F.col("place"), F.lit(DEALT)).alias("salt"),
    )
    nothing = F.lit(0).cast("bigint")

    def changed(tally: str, value) -> Column:
        """What a side's own counts change: ``value`` of each share instead of that of no occurrence."""
        plain = _apart(F.col("p0"), F.col("q0"))
        return F.coalesce(F.aggregate(tally, nothing, lambda s, x: s + x["times"] * (value(x["p"]) - plain)), nothing)

    pairs = (
        one.join(other, ["lang", "salt"])
        .where("a <> b")
        .join(both, ["lang", "a", "b"], "left")
        .select(
            "lang",
            "source",
            F.lit("pair").alias("part"),
            "item",
            F.when(F.col("terms") == 0, nothing)
            .otherwise(
                F.col("terms") * _apart(F.col("p0"), F.col("q0"))
                + changed("mine", lambda p: _apart(p, F.col("q0")))
                + changed("theirs", lambda q: _apart(F.col("p0"), q))
                + F.coalesce("both", nothing)
            )
            .alias("value"),
        )
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    over = placed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    first = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.unionByName(first)
