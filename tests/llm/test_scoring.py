"""Stupid-backoff scores beside a plain version."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from seriatim.llm import scoring


def plain(rows, order, least):
    texts = [(t or "").encode().lower().split() for _, t in rows]
    counts = Counter(tuple(w[i : i + k]) for w in texts for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n = sum(map(len, texts))

    def log_score(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / n)
        if counts[gram] >= least:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(0.4) + log_score(gram[1:])

    for (i, _), w in zip(rows, texts):
        s = sum(log_score(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w))) if w else None
        yield i, len(w), s, s / len(w) if w else None


@pytest.mark.parametrize("order, least, shards", [(2, 2, None), (3, 2, 5), (1, 1, 1), (4, 3, 3)])
def test_scores_as_by_plain_version(spark, order, least, shards):
    rng = random.Random(order)
    words = [*"a b c d e f g É é".split(), "The", "the"]
    rows = [(n if n % 8 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for n in range(90)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "once"), (1004, "a b c d e"), (1004, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_words")
    got = scoring.scored(docs, order=order, least=least, shards=shards).collect()
    key = lambda r: (r[0] or -1, r[1], round(r[2] or 0, 6))
    for mine, want in zip(sorted(map(tuple, got), key=key), sorted(plain(rows, order, least), key=key), strict=True):
        assert mine == pytest.approx(want)


def test_scores_look_back_two_words_unless_told(spark):
    rng = random.Random(17)
    rows = [(n, " ".join(rng.choice("abcde") for _ in range(30))) for n in range(40)]
    got = scoring.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for mine, want in zip(sorted(map(tuple, got)), sorted(plain(rows, 3, 2)), strict=True):
        assert mine == pytest.approx(want)


def test_empty_table(spark):
    assert scoring.scored(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_a_shard_takes_little_memory_beside_its_words():
    """Numpy and Python memory at the peak, in bytes a word: counts of one order at a time, no inverse, no list of all words."""
    rng = random.Random(3)
    docs = pa.table({
        "_id": pa.array(range(2000), pa.int64()),
        "_text": [" ".join(f"w{min(rng.randrange(20000), rng.randrange(20000))}" for _ in range(200)) for _ in range(2000)],
        "_shard": pa.array([0] * 2000, pa.int32()),
    })
    totals = []
    for k in (1, 2, 3):
        asked = scoring._asked(docs, totals, 1, 1)
        totals.append(scoring._numbers(asked.column("_counts")[0].as_py()))
    answers = pa.table({
        "_order": pa.array([1, 2, 3], pa.int32()), "_bucket": pa.array([0] * 3, pa.int32()), "_shard": pa.array([0] * 3, pa.int32()),
        "_totals": [scoring._planes(t) for t in totals], "_all": [400_000] * 3,
    })
    tracemalloc.start()
    got = scoring._scored_of(3, 1, 0.4)(docs, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 2000
    assert peak < 115 * 400_000


def test_words_hashed_together_as_one_by_one(monkeypatch):
    rng = random.Random(5)
    words = ["a", "B", "ab", "ba", "É", "é", "x" * 64, "x" * 65, "y" * 300, "\u3000", "\x85", "0\x00", "\x1c"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\t", "\n\r", " \x0b\x0c "]) for _ in range(rng.randrange(30))).encode() for _ in range(60)]
    texts += [b"", b" ", b"end", b"\nend"]
    monkeypatch.setattr(scoring, "AT_ONCE", 7)
    got, n = scoring.word_hashes(texts)
    want = [t.lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in want]
    flat = [w for t in want for w in t]
    assert len(set(zip(flat, got.tolist()))) == len(set(flat)) == len(set(got.tolist()))
    assert [len(x) for x in scoring.word_hashes([])] == [0, 0]
