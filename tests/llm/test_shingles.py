"""Groups of texts alike in four fifths of their shingles, beside brute force, and the pipeline's stage."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from seriatim.llm import shingles
from seriatim.llm.rows import KEY, keyed
from seriatim.llm.scoring import Hashes


def slow_set(text, words=5):
    parts = (text or "").lower().split()
    k = min(words, len(parts))
    return frozenset(tuple(parts[i : i + k]) for i in range(len(parts) - k + 1)) if parts else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def slow_groups(sets):
    left, out = set(range(len(sets))), set()
    while left:
        todo, group = [left.pop()], []
        while todo:
            a = todo.pop()
            group.append(a)
            near = {b for b in left if alike(sets[a], sets[b])}
            left -= near
            todo += near
        out.add(frozenset(group))
    return out


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def planted(rng, base, at):
    """A text with a similarity of ``at`` or little more to ``base``: its end is other words."""
    n = len(base) - 4
    kept = -int(-2 * n * at // (1 + at))
    return base[: kept + 4] + prose(rng, n - kept)


def rows_of(seed, bases):
    rng = random.Random(seed)
    rows = []
    for n in range(bases):
        base = prose(rng, rng.choice([40, 150, 600]))
        rows.append((n * 100, base))
        rows += [(n * 100 + 1 + k, planted(rng, base, at)) for k, at in enumerate((0.8, 0.85, 0.9, 0.79, 0.7, 0.5))]
        for m in range(rng.randrange(6)):
            text = list(base)
            for _ in range(rng.randrange(1, 5)):
                text[rng.randrange(len(text))] = "changed"
            rows.append((n * 100 + 50 + m, text))
    rows = [(i, " ".join(t)) for i, t in rows]
    return [*rows, (90001, None), (90002, ""), (90003, "One two"), (90004, "one  two"), (90005, "one"), (None, "one"), (7, "two words"), (7, "two words")]


@pytest.mark.parametrize("limit", [4096, 3])
def test_groups_as_by_brute_force(spark, limit):
    rows = rows_of(limit, 40)
    docs = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "group int, doc_id bigint, text string")
    got = shingles.near_duplicates(docs, cell_limit=limit).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.group, []).append(-1 if r.doc_id is None else r.doc_id)
    want = [sorted(-1 if rows[a][0] is None else rows[a][0] for a in g) for g in slow_groups([slow_set(t) for _, t in rows])]
    assert sorted(map(sorted, of.values())) == sorted(want)


@pytest.mark.parametrize("at", [0.8, 0.85, 0.9])
def test_stage_keeps_one_of_each_planted_pair(spark, at):
    rng = random.Random(int(at * 100))
    rows = []
    for n in range(60):
        base = prose(rng, 200)
        copy = planted(rng, base, at)
        assert alike(slow_set(" ".join(base)), slow_set(" ".join(copy)))
        rows += [(2 * n, " ".join(base), "s"), (2 * n + 1, " ".join(copy), "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 120, 2))


def test_a_text_below_four_fifths_stays(spark):
    rng = random.Random(4)
    base = prose(rng, 200)
    rows = [(1, " ".join(base)), (2, " ".join(planted(rng, base, 0.78)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 2]


def test_empty_table(spark):
    assert shingles.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_a_pair_that_shares_no_cell_is_linked(spark):
    rng, hashes = random.Random(1), Hashes()

    def found(parts):
        return shingles.shingles(hashes, " ".join(parts).encode(), 5)

    def same(tail):
        one, two = (np.frombuffer(shingles.sketch(found(parts))[3], np.int64) for parts in (base, base + tail))
        return int((one == two).sum())

    # words are changed until all least hashes' cells differ, though four fifths of the shingles are shared
    base, tail = prose(rng, 84), prose(rng, 20)
    left = same(tail)
    while left:
        other = list(tail)
        other[rng.randrange(20)] = f"w{rng.randrange(100000)}"
        if (now := same(other)) <= left:
            tail, left = other, now
    assert len(np.intersect1d(found(base), found(base + tail))) * 5 == len(found(base + tail)) * 4
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base + tail)), (3, " ".join(tail))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_without_any_cells_every_link_is_found(spark):
    rows = [r for r in rows_of(5, 30) if slow_set(r[1])]
    rows += [(200000 + n, " ".join(["same", "line"] * 20 + prose(random.Random(n), 12))) for n in range(20)]
    named = keyed(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    prints = named.mapInArrow(shingles._prints(5, ["_id", *KEY]), f"_id bigint, _k1 bigint, _k2 bigint, {shingles._PRINT}")
    alone = spark.createDataFrame([], "node bigint, label bigint")
    links = shingles.missed(prints.dropDuplicates(["node"]), alone, named, 5, (4, 5)).collect()
    node = {shingles.name_of(shingles.shingles(Hashes(), t.encode(), 5)): slow_set(t) for _, t in rows}
    got = {frozenset((node[r.a % 2**64], node[r.b % 2**64])) for r in links}
    sets = list(node.values())
    assert got == {frozenset((a, b)) for n, a in enumerate(sets) for b in sets[:n] if alike(a, b)}


@pytest.mark.parametrize("n", [1, 4, 5, 64, 65, 700])
def test_alike_sets_share_a_first_shingle_and_nearly_their_parities(n):
    rng = np.random.default_rng(n)
    for _ in range(50):
        one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        lost = rng.integers(0, len(one) // 9 + 1)
        two = np.unique(np.concatenate([one[rng.permutation(len(one))[lost:]], rng.integers(0, 2**63, lost).astype(np.uint64)]))
        common = np.sort(rng.permutation(np.concatenate([one, two]))[: rng.integers(0, n + 1)])
        first = [shingles.first_of(s, np.unique(common), (4, 5)) for s in (one, two)]
        assert len(np.intersect1d(*first))
        assert shingles.may_be_alike(shingles.parity(one), shingles.parity(two), len(one) + len(two), (4, 5))
    far = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    assert not shingles.may_be_alike(shingles.parity(one), shingles.parity(far), len(one) + len(far), (4, 5))
