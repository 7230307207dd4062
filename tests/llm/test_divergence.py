"""Divergences beside a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from seriatim.llm import divergence


def plain(rows, least=3, top=200):
    docs = [(lang or "", source or "", Counter(re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, c in mine for t in c)
        kept = sorted(t for t, n in seen.items() if n >= least)
        groups = {s: sum((c for _, x, c in mine if x == s), Counter()) for s in {d[1] for d in mine}}
        whole = sum(groups.values(), Counter())

        def share(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        shares, all_ = {s: share(c) for s, c in groups.items()}, share(whole)
        apart = lambda p, q: (p - q) ** 2 // q
        for s, p in shares.items():
            pairs = [(x, sum(apart(p[t], q[t]) for t in kept)) for x, q in shares.items() if x != s]
            terms = [(t, apart(p[t], all_[t])) for t in kept if groups[s][t] and p[t] > all_[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, n) for n, (item, value) in enumerate(found[:most], 1)]
    return Counter(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["ÄB", "Z", "x\x00y", "漢字"]
    rows = []
    for n in range(400):
        source = None if n % 97 == 0 else f"s{min(rng.randrange(12), rng.randrange(12))}"
        text = rng.choice(["-", " ", "9"]).join(rng.choice(words[: rng.randrange(1, 65)]).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(30)))
        rows.append((text, rng.choice(["en", "en", "de", None]), source))
    rows += [("", "en", "silent"), (None, "xx", "one"), (None, "xx", "two"), ("rare", "yy", "one"), ("rare word", "zz", "a")] + [("same same", "vv", "a")] * 3
    return rows + rows[:5]


def test_same_rows_as_by_a_plain_version(spark):
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS value", "3 AS _text", "4 AS doc_id")
    assert Counter(map(tuple, divergence.divergence(docs.repartition(6)).collect())) == plain(rows)
    few = rows_of(8)[:40]
    docs = spark.createDataFrame(few, "text string, lang string, source string")
    assert Counter(map(tuple, divergence.divergence(docs, least_docs=1, top=7).collect())) == plain(few, 1, 7)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_shared_paths_give_one_correction_a_node_and_ancestor():
    rng = np.random.default_rng(2)
    paths = sorted({tuple((k, int(rng.integers(1, 3))) for k in range(6) if rng.random() < 0.6) for _ in range(60)} - {()})
    times = rng.integers(1, 9, len(paths))
    none = {k: 3 + k for k in range(6)}
    share = lambda k, n: 10 * (k + 1) + 7 * n
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for path, n in zip(paths, times.tolist()):
        for a, x in path:
            for b, y in path:
                if a != b:
                    p, q = share(a, x), share(b, y)
                    want[a, b] += n * (f(p, q) - f(p, none[b]) - f(none[a], q) + f(none[a], none[b]))
    flat = [x for path in paths for x in path]
    got = divergence.tree_corrections(
        np.array([k for k, _ in flat]), np.array([share(*x) for x in flat]), np.array([none[k] for k, _ in flat]), np.array([len(p) for p in paths]), times
    )
    assert {(a, b): v for a, b, v in zip(*(x.tolist() for x in got))} == dict(want)
