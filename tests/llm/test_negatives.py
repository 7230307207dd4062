"""Hard negatives beside brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from seriatim.llm import negatives


def brute(rows, every=50, positives=5, most=3):
    held = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, label) in enumerate(held):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, b, other) for b, (j, w, other) in enumerate(held) if b != a)
        for s, j, _, _ in [x for x in scored if x[3] == label][:positives]:
            fits = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:most]
            out += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(fits, 1)]
    return Counter(out)


def rows_of(seed, n, dims, labels, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    label = rng.integers(0, labels, n)
    x = (centres[label] + rng.normal(size=(n, dims))) * scale
    x[20:40], x[60:70] = x[20], 0
    return [(k, x[k].tolist(), int(label[k])) for k in range(n)]


@pytest.mark.parametrize("scale", [0.1, 1e6, 1e-4])
def test_same_rows_as_by_brute_force(spark, scale):
    rows = rows_of(1, 700, 8, 4, scale)
    rows += [(800, None, 1), (850, [1.0] * 8, None), (900, [1.0] * 7 + [None], 2), (950, [math.nan] * 8, 0), (1000, [math.inf] + [0.0] * 7, 1), (None, [1.0] * 8, 1)]
    rows += [rows[50], rows[50], rows[3]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS rank", "2 AS _row", "3 AS part")
    for block, group in ((4096, 4096), (100, 5)):
        got = negatives.hard_negatives(table, block=block, group=group).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        assert Counter(map(tuple, got.collect())) == brute(rows)


def test_few_rows_and_none(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 0.0], 1)], schema)
    assert negatives.hard_negatives(alone).collect() == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2), (3, [0.75, 0.0], 2), (4, [0.99, 0.0], 2), (5, [0.0, 1.0, 0.0], 2)]
    got = sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 3, 65536, 49152)]


def test_bounds_hold_and_lists_fall():
    rng = np.random.default_rng(7)
    members, rows = rng.normal(size=(40, 12)) + 2, rng.normal(size=(500, 12)) * rng.uniform(0.1, 5, (500, 1))
    for some in negatives.clusters_of(members, 8):
        order, bound = negatives.shared_list(members[some], rows)
        assert (np.diff(bound) <= 0).all()
        scores = (members[some] / np.linalg.norm(members[some], axis=1)[:, None]) @ rows[order].T
        assert (scores <= bound + 1e-4).all()


def test_walks_end_before_the_list_does(monkeypatch):
    """Members near their centroid read only the head of the list."""
    rng = np.random.default_rng(5)
    rows = np.floor(256 * np.concatenate([rng.normal(size=(200, 6)) * 0.02 + [1, 0, 0, 0, 0, 0], rng.normal(size=(6000, 6)) * 0.1]))
    anchors = rows[:30]
    read = []
    products = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b: read.append(len(b)) or products(a, b))
    none = np.full((30, 1), np.iinfo(np.int64).min), np.full((30, 1), np.iinfo(np.int64).max)
    label, row = np.zeros(len(rows), np.int64), np.arange(len(rows))
    best = negatives.walked(anchors, label[:30], row[:30], rows, label, row, row, *none, True, 5)
    assert len(best.slot) == 150 and max(read) <= negatives.STEP and sum(read) < len(rows) / 3
