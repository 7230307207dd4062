"""Hard negatives from embeddings, by lists that anchors of one cluster share.

Anchors are clustered by direction. For each cluster the candidates are sorted
once by an upper bound on their inner product with any member: a candidate at
angle ``t`` from the centroid is at least ``t - r`` from a member, if ``r`` is
the largest angle of a member, so a member of length ``l`` scores it at most
``l * |candidate| * cos(t - r)``. Every member walks the shared list until the
bound of what follows falls below the worst score it still holds on to, which
certifies that nothing further down belongs to its result.

Candidates are dealt to blocks and anchors to groups by a hash, and each pair
of a block and a group is one task's work, so no task holds more than a block
and a group, whatever label or vector is frequent. One pass finds each anchor's
positives, the next its negatives between the bounds the positives set; blocks
give a few rows for each anchor, of which the best of all blocks are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.sources.shared import counted, written

#: Rows of a block, anchors of a group, and anchors of a cluster inside it, on average.
BLOCK, GROUP, MEMBERS = 4096, 4096, 64
#: Candidates read off a list at a time.
STEP = 512
#: Rounding that bounds allow for: of angles, and of products in proportion.
SLACK = 1e-6
_EXACT = 2.0**53


def clusters_of(x: np.ndarray, members: int = MEMBERS) -> list[np.ndarray]:
    """Rows of each cluster: a few rounds of spherical k-means, begun from rows evenly apart."""
    unit = _unit(x)
    k = max(1, -(-len(x) // members))
    centre = unit[np.arange(k) * len(x) // k]
    for _ in range(5):
        own = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        size = np.sqrt((total * total).sum(axis=1))
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centre)
    own = (unit @ centre.T).argmax(axis=1)
    return [found for c in range(k) if len(found := np.flatnonzero(own == c))]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; a zero row stays zero."""
    size = _length(x)
    return x / np.where(size > 0, size, 1)[:, None]


def _length(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0)
    part = x / np.where(most > 0, most, 1)[:, None]
    return most * np.sqrt((part * part).sum(axis=1))


def shared_list(members: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates' order for a cluster, and in it each one's bound on its product with a member of length 1."""
    unit = _unit(members)
    centre = _unit(unit.sum(axis=0)[None])[0]
    widest = np.arccos(np.clip(unit @ centre, -1, 1)).max(initial=0) if centre.any() else np.pi
    angle = np.arccos(np.clip(_unit(rows) @ centre, -1, 1))
    bound = _length(rows) * np.cos(np.clip(angle - widest - SLACK, 0, np.pi))
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly: floats as far as they hold them, else Python's own numbers."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b)]
    found = np.clip(whole[0] @ whole[1].T, -(2**63), 2**63 - 1)
    return found.astype(np.int64)


class _Best:
    """The best ``most`` candidates of each slot: by score, then id, then row."""

    def __init__(self, slots: int, most: int) -> None:
        self.most, self.slots = most, slots
        self.slot, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        ids, row = np.concatenate([self.id, ids]), np.concatenate([self.row, row])
        order = np.lexsort((row, ids, ~score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        order = order[np.arange(len(slot)) - first < self.most]
        self.slot, self.score, self.id, self.row = np.sort(slot[np.arange(len(slot)) - first < self.most]), score[order], ids[order], row[order]

    def worst(self, none: np.ndarray) -> np.ndarray:
        """The score a slot's next candidate must reach; ``none`` where it still has room."""
        out = none.copy()
        n = np.bincount(self.slot, minlength=self.slots)
        last = np.cumsum(n) - 1
        full = n >= self.most
        out[full] = self.score[last[full]]
        return out


def walked(
    anchors: np.ndarray, anchor_label: np.ndarray, anchor_row: np.ndarray, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray,
    row: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int,
) -> _Best:
    """The best candidates of each slot, an anchor and one of its ranges of scores (``low`` to ``high``, a column a range).

    Candidates have the anchor's label (but are not the anchor itself), or with
    ``same`` false another label.
    """
    spans = low.shape[1]
    best = _Best(len(anchors) * spans, most)
    for members in clusters_of(anchors):
        order, bound = shared_list(anchors[members], rows)
        size = _length(anchors[members])
        on = np.arange(len(members))
        for a in range(0, len(order), STEP):
            # what follows scores at most this; the list ends for members that hold on to better ones
            slots = (members[on][:, None] * spans + np.arange(spans)).ravel()
            need = best.worst(low.ravel())[slots].reshape(len(on), spans)
            open_ = (low <= high)[members[on]]
            least = np.where(open_, need, np.iinfo(np.int64).max).min(axis=1).astype(float)
            reach = size[on] * bound[a]
            going = open_.any(axis=1) & (reach + SLACK * (1 + np.abs(reach)) >= least)
            on, need = on[going], need[going]
            if not len(on):
                break
            some = order[a : a + STEP]
            who = members[on]
            score = products(anchors[who], rows[some])
            fits = (labels[some][None, :] == anchor_label[who][:, None]) == same
            if same:
                fits &= row[some][None, :] != anchor_row[who][:, None]
            for k in range(spans):
                hit = fits & (score >= need[:, k, None]) & (score <= high[who, k, None])
                i, j = np.nonzero(hit)
                if len(i):
                    best.add(who[i] * spans + k, score[i, j], ids[some[j]], row[some[j]])
    return best


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


_INTS = np.iinfo(np.int64)
_FOUND = "anchor bigint, anchor_id bigint, span int, score bigint, id bigint, row bigint"


def _handed(best: _Best, anchor: np.ndarray, anchor_id: np.ndarray, spans: int) -> pa.Table:
    who = best.slot // spans
    columns = [anchor[who], anchor_id[who], (best.slot % spans).astype(np.int32), best.score, best.id, best.row]
    return pa.table([pa.array(c) for c in columns], names=[x.split()[0] for x in _FOUND.split(", ")])


def _none() -> pa.Table:
    none = np.zeros(0, np.int64)
    return _handed(_Best(0, 1), none, none, 1)


def _met(anchors: DataFrame, rows: DataFrame, groups: int, blocks: int, work) -> DataFrame:
    """``work`` on every block of rows with every group of anchors."""
    part, block = (F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(n)).cast("int") for seed, n in ((3, groups), (5, blocks)))
    left = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("block", block)
    right = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", part)
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(work, _FOUND)


def _foremost(found: DataFrame, by: list[str], most: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    every: int = 50,
    positives: int = 5,
    most: int = 3,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows whose id is divisible by ``every``. A component counts
    as ``floor(256 * x)``, a score is the inner product of whole numbers. An
    anchor's positives are the ``positives`` best other rows of its label; for
    each, its negatives are the ``most`` best rows of other labels with
    ``50 * positive_score <= 100 * negative_score <= 95 * positive_score``.
    Ties go to the smaller id. Rows with a null id, label or vector, a null or
    non-finite component, or a vector of another length than most take no part.
    Rows of one id are rows of their own, each an anchor and a candidate of the
    others. Scores beyond 64 bits count as the nearest number of 64 bits. An
    empty table gives no rows; other columns play no part.
    """
    spark = vectors.sparkSession
    held = vectors.select(
        F.col(vec_id).cast("bigint").alias("_id"), F.col(embedding).cast("array<double>").alias("_v"), F.col(label).cast("bigint").alias("_label")
    ).where("_id IS NOT NULL AND _label IS NOT NULL AND size(_v) > 0 AND NOT exists(_v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    sizes = held.groupBy(F.size("_v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    dims = sizes["dims"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                x = np.nan_to_num(np.floor(256 * x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_id", "_label")), pa.array([r.tobytes() for r in x], pa.binary())], names=["_row", "_id", "_label", "_vector"])

    numbered = held.where(F.size("_v") == dims).withColumn("_row", F.monotonically_increasing_id())
    rows, n = counted(numbered.mapInArrow(pack, "_row bigint, _id bigint, _label bigint, _vector binary"), "vectors")
    anchors, n_anchors = counted(rows.where(F.col("_id") % every == 0), "anchors")
    blocks, groups = max(1, -(-n // block)), max(1, -(-n_anchors // group))

    def positive(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _none()
        x, a = _matrix(left.column("_vector"), dims), _matrix(right.column("_vector"), dims)
        free = np.full((len(a), 1), _INTS.min), np.full((len(a), 1), _INTS.max)
        labels, of = _numbers(left, "_label"), _numbers(right, "_label")
        ids, row, own, own_id = _numbers(left, "_id"), _numbers(left, "_row"), _numbers(right, "_row"), _numbers(right, "_id")
        out = [_none()]
        for one in np.unique(of).tolist():
            k, c = np.flatnonzero(of == one), np.flatnonzero(labels == one)
            best = walked(a[k], of[k], own[k], x[c], labels[c], ids[c], row[c], *(f[k] for f in free), True, positives)
            out.append(_handed(best, own[k], own_id[k], 1))
        return pa.concat_tables(out)

    near = _foremost(_met(anchors, rows, groups, blocks, positive), ["anchor"], positives)
    near = written(near.select("anchor", "anchor_id", (F.col("rank") - 1).cast("int").alias("span"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    scores = near.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("span", "positive_score"))).alias("_scores"))
    ranged = written(
        anchors.join(scores, anchors["_row"] == scores["anchor"]).select(
            "_row", "_id", "_label", "_vector", F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.col("_scores")[k]).alias("_scores")
        ),
        "ranged",
    )

    def negative(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _none()
        x, a = _matrix(left.column("_vector"), dims), _matrix(right.column("_vector"), dims)
        flat = right.column("_scores").combine_chunks().flatten()
        none = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, positives)
        score = flat.fill_null(0).to_numpy().reshape(-1, positives)
        low, high = -(-score // 2), score - -(-score // 20)
        # without a positive, and below a negative one, no score fits
        low, high = np.where(none, 1, low), np.where(none, 0, high)
        own = _numbers(right, "_row")
        best = walked(a, _numbers(right, "_label"), own, x, _numbers(left, "_label"), _numbers(left, "_id"), _numbers(left, "_row"), low, high, False, most)
        return _handed(best, own, _numbers(right, "_id"), positives)

    found = _foremost(_met(ranged, rows, groups, blocks, negative), ["anchor", "span"], most)
    return found.select("anchor", "span", F.col("rank").cast("int"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        near, ["anchor", "span"]
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
