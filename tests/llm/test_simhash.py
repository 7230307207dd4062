"""SimHash groups beside a brute-force version."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from seriatim.llm import simhash


def slow_print(text, words):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return 0
    k = min(words, len(parts))
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + k]).encode(), 42) for i in range(len(parts) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, most):
    left, out = set(range(len(prints))), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            a = todo.pop()
            group.append(a)
            near = {b for b in left if (prints[a] ^ prints[b]).bit_count() <= most}
            left -= near
            todo += near
        for a in group:
            out[a] = frozenset(group)
    return out


def rows_of(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÉcdeF") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    rows = []
    for n in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        rows.append((n, " ".join(text)))
        for m in range(rng.randrange(4)):
            copy = list(text)
            if copy:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + n * 10 + m, rng.choice([" ", "\n", "  \t"]).join(copy)))
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "One"), (None, "one"), (None, "null id"), (7, "two words"), (7, "two words")]


@pytest.mark.parametrize("words", [3, 5])
def test_groups_as_by_brute_force(spark, words):
    rows = rows_of(words)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fingerprint", "2 AS label")
    got = simhash.near_duplicates(docs, words=words).collect()
    prints = [slow_print(t, words) for _, t in rows]
    groups = slow_groups(prints, 3)
    least = {a: min((rows[b][0] for b in g if rows[b][0] is not None), default=None) for a, g in groups.items()}
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(((rows[a][0], prints[a], least[a]) for a in groups), key=key)
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got), key=key) == want


@pytest.mark.parametrize("limit", [4096, 3])
def test_every_link_of_crowded_fingerprints_counts(spark, limit):
    rng = random.Random(limit)
    prints = set()
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(40):
            prints.add(at)
            for _ in range(rng.randrange(1, 5)):
                at ^= 1 << rng.randrange(64)
    prints = [*prints, 0, 2**64 - 1, 7]
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    links = simhash.linked(spark.createDataFrame(signed, "fingerprint bigint"), cell_limit=limit)
    from seriatim.llm.components import components

    label = {r.node: r.label for r in components(links, "a", "b").collect()}
    groups = slow_groups(prints, 3)
    want = {frozenset(signed[b][0] for b in g) for g in groups.values()}
    found = {}
    for (p,) in signed:
        found.setdefault(label.get(p, p), set()).add(p)
    assert {frozenset(g) for g in found.values()} == want


def test_manhattan_never_exceeds_hamming():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    b[:2500] = a[:2500] ^ (np.uint64(1) << rng.integers(0, 64, 2500).astype(np.uint64))
    segments = lambda x: [[int(v >> 2 * k & 3).bit_count() for k in range(32)] for v in x.tolist()]
    want = [sum(abs(p - q) for p, q in zip(x, y)) for x, y in zip(segments(a), segments(b))]
    got = simhash.manhattan(simhash.counts_of(a), simhash.counts_of(b))
    assert got.tolist() == want
    assert (got <= np.bitwise_count(a ^ b)).all()


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
