"""Removal of repeated strings beside a brute-force version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute
import pytest

from seriatim.llm import repeats


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if times[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randrange(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = [prose(60) for _ in range(4)]
    rows = []
    for n in range(120):
        parts = [prose(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            passage = rng.choice(shared)
            a = rng.randrange(len(passage) // 2)
            parts += [passage[a : a + rng.randrange(150, 400)], prose(rng.randrange(30))]
        rows.append((n, " ".join(parts)))
    copied = prose(150)
    rows += [(200 + n, copied) for n in range(40)]
    rows += [(300 + n, copied[:n] + "x" + copied[n + 1 :]) for n in range(0, 400, 29)]
    rows += [(400, None), (401, ""), (402, "a" * 900), (403, "ab" * 300), (404, "short"), (None, prose(80)), (None, prose(5))]
    rows += [(405, prose(70)), (405, prose(70))]
    rows += [(406, shared[0] * 3)] * 2
    rows += [(407, prose(9000))]
    return rows


@pytest.mark.parametrize("limit", [2000, 7])
def test_same_bytes_go_as_by_brute_force(spark, limit):
    rows = rows_of(limit)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _id", "'x' AS n_bytes")
    got = repeats.without_repeats(docs, shard_anchors=limit)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows, 200)


def test_shorter_strings_and_kept_text(spark):
    rows = [(1, "é" * 10 + "k" * 70 + "1"), (2, "z" + "k" * 70), (3, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in repeats.without_repeats(docs, length=64, with_text=True).collect()}
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.values()) == brute(rows, 64)
    assert got[1].kept == "é" * 10 + "1" and got[3].kept == "alone"


def test_different_edges_of_one_passage_do_not_meet(spark):
    rng = random.Random(9)
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(230))
    passage = noise() + noise()
    rows = [(n, noise() + passage + noise()) for n in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    most = 100
    found = repeats.handed_over(repeats.keyed(docs, "doc_id", "text"), shard_anchors=most, route_shards=1)
    crowd = found.where("_owner <> 0").groupBy("_route").count().agg({"count": "max"}).first()[0]
    assert 2 <= crowd <= 2000 // most + 1
    got = repeats.without_repeats(docs, shard_anchors=most, route_shards=1)
    assert Counter(map(tuple, got.collect())) == brute(rows, 200)


def test_windows_that_go_one_by_one_meet_across_shards(spark):
    rows = rows_of(11)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = repeats.without_repeats(docs, shard_anchors=1, route_shards=1)
    assert Counter(map(tuple, got.collect())) == brute(rows, 200)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.without_repeats(docs).collect() == []


def test_runs_of_shards_cut_into_different_numbers_of_parts_stay_apart(monkeypatch):
    """One shard of an anchor falls into two parts, another into one: both still hold windows of their own."""
    rng = random.Random(4)
    window = bytes(rng.choice(b"abcdefgh ") for _ in range(200))
    anchor = int(repeats.anchors(*repeats.buffers(pa.array([window.decode()])), 200)[0].view("i8")[0])

    def shard(salt, fillers):
        pieces = [window, *(bytes(rng.choice(b"klmnop ") for _ in range(400)) for _ in range(fillers))]
        n = len(pieces)
        columns = {
            "_anchor": pa.array([anchor] * n, pa.int64()), "_salt": pa.array([salt] * n, pa.int32()), "_salts": pa.array([40] * n, pa.int32()),
            "_k1": pa.array(range(salt * 100, salt * 100 + n), pa.int64()), "_k2": pa.array([salt] * n, pa.int64()),
            "_from": pa.array([0] * n, pa.int64()), "_times": pa.array([1] * n, pa.int64()), "_bytes": pa.array(pieces, pa.binary()),
        }
        return pa.table(columns)

    def merged(*shards):
        handed = [b for t in shards for b in repeats._one_array(t, 200, 32)]
        table = pa.Table.from_batches(handed).filter(pa.compute.field("_owner") != 0).sort_by([("_route", "ascending"), ("_owner", "ascending")])
        return {(r["_k1"], r["_k2"]) for b in repeats._merge(table.combine_chunks(), 200) for r in b.to_pylist()}

    monkeypatch.setattr(repeats, "ARRAY", 700)
    for fillers in (0, 1, 2, 5):
        # the window's own part comes first, so that a shard's number of parts is all that differs
        assert merged(shard(1, fillers), shard(2, 0)) == {(100, 1), (200, 2)}


def test_many_rows_alike(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(1, text)] * 5000 + [(2, text[100:450] + "other"), (3, "alone " * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for limit in (2000, 50):
        spans = repeats.repeated_windows(repeats.keyed(docs, "doc_id", "text"), shard_anchors=limit)
        assert spans.count() < 100
        assert Counter(map(tuple, repeats.without_repeats(docs, shard_anchors=limit).collect())) == brute(rows, 200)
