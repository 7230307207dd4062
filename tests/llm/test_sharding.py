"""Sharding: equal texts together, balance, slots."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from seriatim.llm import sharding


@pytest.mark.parametrize("cell, fan", [(20_000, 4096), (60, 3)])
def test_whole_groups_balance_and_slots(spark, cell, fan):
    rng = random.Random(cell)
    rows = []
    for n in range(700):
        text = "é" * rng.randrange(1, 400) + str(n)
        rows += [(len(rows) + k, text) for k in range(rng.choice([1, 1, 1, 2, 9]))]
    rows += [(None, "null id"), (None, "null id"), (5, None), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS size", "2 AS shard")
    got = sharding.sharded(docs, cell=cell, fan=fan).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shard_of, sums, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        shard_of[r.size, r.text_crc32].add(r.shard)
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    for (size, _), shards in shard_of.items():
        assert len(shards) == 1 or size == 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(Counter((r.text_crc32, r.size) for r in got).items(), key=lambda x: x[0][1] * x[1])
    assert set(sums) == set(range(16)) and max(sums.values()) - min(sums.values()) <= largest[0][1] * largest[1] / 2


def test_differencing_of_known_numbers():
    place = sharding.differenced([[s, 0] for s in (8, 7, 6, 5, 4)])[:, 0]
    sums = Counter()
    for s, p in zip((8, 7, 6, 5, 4), place.tolist()):
        sums[p] += s
    assert sorted(sums.values()) == [14, 16]


def test_empty_table(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def differenced_with_members(sizes, bins):
    """Differencing that carries the members of every bin along."""
    parts = [(n, [(0, [])] * (bins - 1) + [(s, [n])]) for n, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[1][0][0] - p[1][-1][0], p[0]))
        (_, a), (_, b), *rest = parts
        joint = sorted(((x + y, m + k) for (x, m), (y, k) in zip(a, reversed(b))), key=lambda x: x[0])
        parts = [*rest, (made, joint)]
        made += 1
    return parts[0][1] if parts else []


@pytest.mark.parametrize("n, bins", [(1, 3), (2, 3), (40, 2), (90, 16), (300, 5)])
def test_same_shards_as_by_plain_differencing(spark, n, bins):
    rng = random.Random(n)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 300))) + f"{k:04}" for k in range(n)]
    times = [rng.choice([1, 1, 2, 30]) for _ in texts]
    rows = [(k, t) for k, (t, m) in enumerate(zip(texts, times)) for _ in range(m)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=bins).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    sizes = sorted(((len(t) + 1) * m for t, m in zip(texts, times)), reverse=True)
    want = differenced_with_members(sizes, bins)
    assert sorted(s for s, _ in want if s) == sorted(sums.values())
    assert sorted(k for _, m in want for k in m) == list(range(n)) and all(s == sum(sizes[k] for k in m) for s, m in want)
