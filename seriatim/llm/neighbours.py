"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Largest inner product becomes nearest neighbour by one more coordinate that
brings every vector to the same length. The vectors are then projected at
random, once for every curve and each time with another shift, and a Hilbert
curve through the projection orders them. Curves are cut into range
partitions; a query looks at the partitions its window on the curve touches,
inner products there are exact, and the best of all curves are merged.

What is fitted is fitted on a bounded sample of ``SAMPLE`` vectors: the scale
of the projections, the cuts of the curves, and the window. The window is what
``QUERIES`` of the sampled vectors need to find ``RECALL`` of their true
neighbours, which one pass over all rows tells. Data with clusters get by with
small windows; vectors spread evenly in many dimensions need wide ones.
Every row is indexed, and copies of one vector are spread over cuts by a hash.
A row is sent once for each curve, and again only where more than ``AT_ONCE``
queries look at one partition. Where the sample cannot cut a curve finely enough,
rows of a partition are dealt by a hash, and its queries look at all parts.

Vectors much longer than the rest would press all others together on the
curves; they stand apart, and every query is held against them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriatim.sources.shared import counted

CURVES, DIMS, BITS = 8, 6, 10
SAMPLE, QUERIES, RECALL = 4096, 64, 0.97
#: Lengths beyond so many times that of nearly all sampled vectors stand apart.
LONG, NEARLY_ALL = 1.5, 0.99
#: Rows of one partition of a curve, and the queries that one task scores against it.
BLOCK, AT_ONCE = 8192, 4096
_U = np.uint64


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with whole coordinates below ``2 ** bits``.

    Skilling's transform: the coordinates' bits are turned, highest first, into
    those of the curve, then interleaved.
    """
    x = points.astype(_U).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = _U(1 << b)
        low = q - _U(1)
        for k in range(n):
            set_ = (x[k] & q) != 0
            swap = np.where(set_, _U(0), (x[0] ^ x[k]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = _U(1 << b)
        flip ^= np.where((x[n - 1] & q) != 0, q - _U(1), _U(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << _U(1)) | ((x[k] >> _U(b)) & _U(1))
    return key


@dataclass
class Index:
    """The curves: projections, their scale, the sorted sample keys that measure places, the cuts and the window."""

    length: float
    projections: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sample: np.ndarray
    cuts: list[np.ndarray]
    window: float

    def keys(self, vectors: np.ndarray, curve: int, query: bool) -> np.ndarray:
        size = np.sqrt((vectors * vectors).sum(axis=1))
        if query:
            whole = np.concatenate([vectors * (self.length / size)[:, None], np.zeros((len(vectors), 1))], axis=1)
        else:
            whole = np.concatenate([vectors, np.sqrt(np.maximum(0, self.length**2 - size**2))[:, None]], axis=1)
        at = whole @ self.projections[curve]
        unit = (at - self.low[curve]) / (self.high[curve] - self.low[curve])
        return hilbert(np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)

    def places(self, keys: np.ndarray, curve: int) -> np.ndarray:
        """The share of the sample before each key."""
        return np.searchsorted(self.sample[curve], keys) / max(1, self.sample.shape[1])


def _fitted(vectors: np.ndarray, length: float, blocks: int) -> Index:
    dims = vectors.shape[1] + 1
    rng = np.random.default_rng(dims)
    projections = np.stack([np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, : min(DIMS, dims)] for _ in range(CURVES)])
    index = Index(length, projections, np.zeros((CURVES, projections.shape[2])), np.ones((CURVES, projections.shape[2])), None, [], 1.0)
    size = np.sqrt((vectors * vectors).sum(axis=1))
    whole = np.concatenate([vectors, np.sqrt(np.maximum(0, length**2 - size**2))[:, None]], axis=1)
    keys = []
    for c in range(CURVES):
        at = whole @ projections[c]
        low, high = np.quantile(at, [0.005, 0.995], axis=0)
        width = np.maximum(high - low, 1e-12 * max(1.0, length))
        shift = rng.uniform(0, 0.25, size=len(low)) * width
        index.low[c], index.high[c] = low - shift, high + (0.25 * width - shift)
        keys.append(np.sort(index.keys(vectors, c, False)))
    index.sample = np.stack(keys)
    for c in range(CURVES):
        every = index.sample[c][(np.arange(1, blocks) * len(vectors)) // blocks]
        index.cuts.append(every)
    return index


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)
    return (x ^ (x >> _U(32))) * _U(0xBF58476D1CE4E5B9)


def _block(index: Index, keys: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
    """The partition of each key; a key that is several cuts at once is dealt among them by a hash of the id."""
    cuts = index.cuts[curve]
    low, high = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
    spread = (_mixed(ids) >> _U(33)).astype(np.int64) % (high - low + 1)
    return low + spread


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _best(ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:most]
    return ids[order], scores[order]


def _searched(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's best rows. Products in bulk choose; the scores themselves are summed row by row, so that copies tie."""
    reach = 1e-12 * (1 + np.sqrt((rows * rows).sum(axis=1)).max(initial=0))
    for a in range(0, len(queries), 256):
        bulk = queries[a : a + 256] @ rows.T
        for q, line in enumerate(bulk, a):
            line[ids == query_ids[q]] = -np.inf
            if len(line) > most:
                edge = np.partition(line, len(line) - most)[len(line) - most]
                near = reach * (1 + np.sqrt(queries[q] @ queries[q]))
                at = np.flatnonzero(line >= edge - near) if np.isfinite(edge) else np.arange(len(line))
            else:
                at = np.arange(len(line))
            at = at[ids[at] != query_ids[q]]
            exact = (rows[at] * queries[q]).sum(axis=1)
            yield q, *_best(ids[at], exact, most)


_FOUND = "query_id bigint, found array<struct<vec_id: bigint, score: double>>"


def _found(query_ids: list, ids: list, scores: list) -> pa.Table:
    bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    flat = pa.StructArray.from_arrays(
        [pa.array(np.concatenate([np.zeros(0, np.int64), *ids])), pa.array(np.concatenate([np.zeros(0), *scores]))], ["vec_id", "score"]
    )
    return pa.table([pa.array(query_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), flat)], names=["query_id", "found"])


def _merged(found: DataFrame, most: int) -> DataFrame:
    every = F.array_distinct(F.flatten(F.collect_list("found")))
    order = F.array_sort(F.transform(every, lambda x: F.struct((-x["score"]).alias("away"), x["vec_id"].alias("vec_id"), x["score"].alias("score"))))
    return found.groupBy("query_id").agg(F.slice(order, 1, most).alias("found"))


def _true_windows(rows: DataFrame, index: Index, some: np.ndarray, some_ids: np.ndarray, most: int) -> float:
    """The share of a curve on either side that finds ``RECALL`` of the sampled queries' true neighbours."""
    dims = some.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each query's best of all that the task has seen
        held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dims))) for _ in some]
        for batch in batches:
            x, ids = _matrix(batch.column("_vector"), dims), batch.column("_id").to_numpy()
            for q, i, s in _searched(some, some_ids, x, ids, most):
                at = {one: n for n, one in enumerate(ids.tolist())}
                near = x[[at[one] for one in i.tolist()]] if len(i) else x[:0]
                i, s, v = (np.concatenate(pair) for pair in zip(held[q], (i, s, near)))
                first = np.lexsort((i, -s))[:most]
                held[q] = i[first], s[first], v[first]
        for q, (i, s, v) in enumerate(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), q)), pa.array(i), pa.array(s), pa.array([r.tobytes() for r in v], pa.binary())], names=["q", "id", "score", "vector"]
            )

    near = rows.mapInArrow(run, "q bigint, id bigint, score double, vector binary")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    best = near.withColumn("place", place).where(F.col("place") <= most).groupBy("q").agg(F.collect_list("vector").alias("best"))
    apart = []
    for r in best.collect():
        if not r.best:
            continue
        true = np.stack([np.frombuffer(b, np.float64) for b in r.best])
        true = true[np.sqrt((true * true).sum(axis=1)) <= index.length]  # longer ones are found in any case
        least = np.full(len(true), 1.0)
        for c in range(CURVES):
            at = index.places(index.keys(some[r.q : r.q + 1], c, True), c)
            least = np.minimum(least, np.abs(index.places(index.keys(true, c, False), c) - at))
        apart.append(least)
    return float(np.quantile(np.concatenate(apart), RECALL)) + 0.01 if apart else 1.0


def nearest(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    every: int = 20,
    most: int = 20,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``most`` rows found nearest to each query.

    Queries are the rows whose id is divisible by ``every``; all rows but the
    query's own are candidates. Nearness is the inner product in double
    precision; ties go to the smaller id. Vectors that are null, all zero, of
    another length than most, or hold null or non-finite components take no
    part, nor do rows without an id. Rows of one id are one query and are
    never each other's neighbours. Other columns play no part.
    """
    spark = vectors.sparkSession
    held = vectors.select(F.col(vec_id).cast("bigint").alias("_id"), F.col(embedding).cast("array<double>").alias("_v")).where(
        "_id IS NOT NULL AND size(_v) > 0 AND NOT exists(_v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(_v, x -> x <> 0)"
    )
    sizes = held.groupBy(F.size("_v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if sizes is None:
        return empty
    dims = sizes["dims"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            size = np.sqrt((x * x).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(size)], names=["_id", "_vector", "_size"]
            )

    rows, n = counted(held.where(F.size("_v") == dims).mapInArrow(pack, "_id bigint, _vector binary, _size double"), "vectors")
    sample = rows.select("_id", "_vector", "_size").orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(SAMPLE).toArrow()
    some, some_ids = _matrix(sample.column("_vector").combine_chunks(), dims), sample.column("_id").to_numpy()
    length = LONG * float(np.quantile(sample.column("_size").to_numpy(), NEARLY_ALL))
    told = rows.agg(F.count_if(F.col("_size") > length).alias("long"), F.max(F.when(F.col("_size") <= length, F.col("_size"))).alias("length")).first()
    length = told["length"]
    kept = np.sqrt((some * some).sum(axis=1)) <= length
    index = _fitted(some[kept], length, max(1, min(-(-n // block), int(kept.sum()))))
    index.window = _true_windows(rows, index, some[kept][:QUERIES], some_ids[kept][:QUERIES], most)
    blocks = len(index.cuts[0]) + 1
    deals, long_deals = max(1, -(-n // (blocks * block))), -(-told["long"] // block)
    shared = spark.sparkContext.broadcast(index)

    schema = "curve int, block int, deal int, part int, _id bigint, _vector binary"

    def cells(curve: int, at: np.ndarray, deal: np.ndarray, part: np.ndarray, batch: pa.RecordBatch, row: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.broadcast_to(c, len(row)).astype(np.int32)) for c in (curve, at, deal, part)]
        return pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(pa.array(row)) for c in ("_id", "_vector"))], names=[c.split()[0] for c in schema.split(", ")])

    def indexed(parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                x, ids = _matrix(batch.column("_vector"), dims), batch.column("_id").to_numpy()
                far = batch.column("_size").to_numpy() > index.length
                own, rest = np.flatnonzero(far), np.flatnonzero(~far)
                deal = (_mixed(ids) >> _U(20)).astype(np.int64)
                for part in range(parts):
                    if len(own):
                        yield cells(-1, 0, deal[own] % long_deals, part, batch, own)
                    for c in range(CURVES if len(rest) else 0):
                        at = _block(index, index.keys(x[rest], c, False), ids[rest], c)
                        yield cells(c, at, deal[rest] % deals, part, batch, rest)

        return run

    def asked(parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                x, ids = _matrix(batch.column("_vector"), dims), batch.column("_id").to_numpy()
                every_row = np.arange(len(x))
                part = (_mixed(ids) >> _U(40)).astype(np.int64) % parts
                for deal in range(long_deals):
                    yield cells(-1, 0, deal, part, batch, every_row)
                for c in range(CURVES):
                    place = index.places(index.keys(x, c, True), c)
                    ends = [np.quantile(index.sample[c], np.clip(place + d, 0, 1), method="nearest") for d in (-index.window, index.window)]
                    low, high = np.searchsorted(index.cuts[c], ends[0], side="left"), np.searchsorted(index.cuts[c], ends[1], side="right")
                    n = high - low + 1
                    row = np.repeat(every_row, n)
                    at = np.repeat(low, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    for deal in range(deals):
                        yield cells(c, at, deal, part[row], batch, row)

        return run

    queries = rows.where(F.col("_id") % every == 0)
    # as many parts as keep the queries of the most asked partition within bounds
    crowd = queries.mapInArrow(asked(1), schema).groupBy("curve", "block", "deal").count().agg(F.max("count")).first()[0]
    parts = max(1, -(-(crowd or 0) // AT_ONCE))
    place = ["curve", "block", "deal", "part"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([], [], [])
        x, ids = _matrix(left.column("_vector").combine_chunks(), dims), left.column("_id").to_numpy()
        q, query_ids = _matrix(right.column("_vector").combine_chunks(), dims), right.column("_id").to_numpy()
        best = list(_searched(q, query_ids, x, ids, most))
        return _found([int(query_ids[b[0]]) for b in best], [b[1] for b in best], [b[2] for b in best])

    found = (
        rows.mapInArrow(indexed(parts), schema)
        .groupBy(*place)
        .cogroup(queries.mapInArrow(asked(parts), schema).groupBy(*place))
        .applyInArrow(search, _FOUND)
    )
    ranked = _merged(found, most).select("query_id", F.posexplode("found").alias("rank", "one"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "one.vec_id", "one.score")
