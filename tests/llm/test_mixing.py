"""Mixing beside its SQL, and the budget tree beside a plain version."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from seriatim.llm import mixing
from seriatim.llm.queries import REGISTRY
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    ok, note = compare(spark, duck(FOLDER), FOLDER, "op2_mixing", REGISTRY.queries["op2_mixing"], REGISTRY.oracle["op2_mixing"])
    assert ok, note


def shared(budget, caps):
    """Equal shares with shortages passed on among siblings."""
    left, open_, out = budget, dict(caps), {}
    while open_:
        part = left / len(open_)
        short = {k: c for k, c in open_.items() if c <= part}
        if not short:
            return out | {k: int(part) for k in open_}
        for k, c in short.items():
            out[k] = c
            left -= c
            del open_[k]
    return out


@pytest.mark.parametrize("share, epochs", [((1, 2), 1), ((3, 1), 4), ((9, 1), 2)])
def test_budgets_and_prefixes(spark, share, epochs):
    rows, n = [], 0
    for a, families in {"x": {"p": 900, "q": 30}, "y": {"p": 80, "": 7}, None: {"r": 300}}.items():
        for b, count in families.items():
            for k in range(count):
                rows.append((n if n % 50 else None, "w " * (k % 13), a, b))
                n += 1
    rows += [(5, "same", "x", "q")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, a string, b string").selectExpr("*", "1 AS tokens", "2 AS budget")
    got = mixing.mixed(docs, {"a": "a", "b": "b"}, share=share, max_epochs=epochs, seed=1).collect()
    tokens = Counter()
    for i, t, a, b in rows:
        tokens[a or "", b] += len(t.split())
    caps = defaultdict(int)
    for (a, _), t in tokens.items():
        caps[a] += t * epochs
    top = shared(min(sum(tokens.values()) * share[0] // share[1], sum(caps.values())), caps)
    want = {}
    for a, budget in top.items():
        want |= {(a, b): x for b, x in shared(budget, {b: t * epochs for (c, b), t in tokens.items() if c == a}).items()}
    taken, least = Counter(), max(len(t.split()) for _, t, _, _ in rows)
    for r in got:
        assert abs(r.leaf_budget - want[r.a, r.b]) <= 1 and 1 <= r.epochs <= epochs
        taken[r.a, r.b] += r.n_tokens * r.epochs
    for leaf, budget in want.items():
        assert budget - least <= taken[leaf] <= budget


def test_empty_table_and_no_words(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, a string")
    assert mixing.mixed(docs, {"a": "a"}).collect() == []
    docs = spark.createDataFrame([(1, None, "x"), (2, " ", "x")], docs.schema)
    assert [r.epochs for r in mixing.mixed(docs, {"a": "a"}).collect()] == [1, 1]
