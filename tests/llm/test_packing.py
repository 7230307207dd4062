"""Packing: an exact round trip through every piece."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriatim.llm import packing, word_ids


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def texts():
    rng = random.Random(4)
    odd = "aZé ǅ Σς ﬁ ́x ́ 12 don't 's <|endoftext|>x \x1c\x85  漢字 \U0001f600 İi ſ".split(" ")
    words = [*odd, *("".join(rng.choice("abcdefg'") for _ in range(rng.randrange(1, 9))) for _ in range(300))]
    blanks = [" ", "\n", "\t ", "  ", "\r\n", "\x0b"]
    out = ["".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.choice([3, 30, 200, 900]))) for _ in range(150)]
    return [None, "", " \n", "a b 　 c", *out, "".join(rng.choice(words) + " " for _ in range(12000))]


def test_ids_as_by_the_library():
    words = word_ids.WordIds("word_bpe_49k.json")
    for t in texts():
        assert np.frombuffer(words.ids((t or "").encode()), "<u4").tolist() == ids_of(t)[:-1]
    rng = random.Random(9)
    marks = [chr(c) for c in range(33, 256)]
    long = [" ".join("".join(rng.choice(marks if k % 3 else "aabcdeéß's") for _ in range(rng.randrange(1, 40))) for _ in range(300)) for k in range(30)]
    for t, found in zip(long, words.many([t.encode() for t in long])):
        assert np.frombuffer(found, "<u4").tolist() == ids_of(t)[:-1]


@pytest.mark.parametrize("window, parts", [(4096, 3), (64, 2)])
def test_every_id_in_one_piece(spark, window, parts):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts, "doc_id").selectExpr("*", "0 AS start")
    got = packing.packed(docs, window=window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {n for n, _ in rows}
    for n, t in rows:
        ids, at = np.asarray(ids_of(t), "<u4"), 0
        for r in sorted(by_doc[n], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and all(r.sequence_tokens == at for r in pieces)
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_least_squares_and_full_windows():
    packer = packing.Packer(8, 0)
    for n, size in enumerate([5, 5, 3]):
        packer.add(n, b"\0" * 4 * size)
    assert [r[:3] for r in packer.rows] == [(0, 0, 5), (2, 0, 3)] or [r[:3] for r in packer.rows] == [(1, 0, 5), (2, 0, 3)]
    packer = packing.Packer(8, 0)
    for n in range(packing.OPEN + 5):
        packer.add(n, b"\0" * 4 * 5)
    assert packer.open <= packing.OPEN


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "a b"), (None, None), (3, "c"), (3, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = defaultdict(int)
    for r in packing.packed(docs).collect():
        ids[r.doc_id, r.doc_tokens] += r.length
    assert ids == {(None, 1): 1, (None, 3): 3, (3, 2): 4}
    assert packing.packed(docs.limit(0)).collect() == []
