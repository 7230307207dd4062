"""Encoding beside the library's, decoding as a round trip, and the automaton itself."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriatim.llm import encoding
from seriatim.llm.lexicon import Lexicon, compiled

ODD = ["don't", "  ", "\n\n", " \t", "é", "漢字", "<|endoftext|>", "<|endof", "12345", "\x1c", "\x85", "　", "᠎", " ", "!!!", "'s", "͸", "֋", "🙂‍↔️", "ſ", "a" * 200, "\x00", "\r\n"]


def texts_of(seed, n=150):
    rng = random.Random(seed)
    words = [*ODD, *("".join(rng.choice("abcdefghij THE") for _ in range(rng.randrange(1, 12))) for _ in range(200))]
    texts = [None, "", " ", "\n ", "  a", "a  ", "x" * 5000, "<|endoftext|>" * 3, "ab" * 70, " ".join(["the cat sat"] * 500)]
    return texts + ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(rng.choice([5, 60, 1500]))) for _ in range(n)]


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("words", [100_000, 20, 0])
def test_ids_and_texts_as_by_the_library(spark, words):
    rows = [(n if n % 7 else None, t) for n, t in enumerate(texts_of(3))] + [(3, "twice")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS _text", "4 AS _c0")
    lib = library()
    want = [(i, tuple(e.ids), lib.decode(e.ids, skip_special_tokens=False)) for (i, _), e in zip(rows, lib.encode_batch([t or "" for _, t in rows], add_special_tokens=False))]
    found = encoding.decoded(encoding.encoded(docs, words=words, keep=("doc_id", "decoded", "ids")))
    assert found.columns == ["doc_id", "ids", "decoded"]
    got = [(r.doc_id, tuple(r.ids), r.decoded) for r in found.collect()]
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted(r[2] for r in got) == sorted(t or "" for _, t in rows)
    assert encoding.encoded(docs.limit(0), words=words).collect() == []


def test_merging_without_a_lexicon():
    lib, merges = library(), encoding.merges_of("byte_bpe_50k.json")
    units = list({u for t in texts_of(5, 60) if t for u in merges.units(t.encode())} | {b"z" * 300, " é".encode() * 90})
    got = [np.frombuffer(x, np.int32).tolist() for x in merges.of(units)]
    assert got == [lib.encode(u.decode(), add_special_tokens=False).ids for u in units]


def test_frequent_units_cover_all_texts(spark):
    docs = spark.createDataFrame([(n, "one two two" if n % 2 else "one\nthree") for n in range(40)], "doc_id int, text string").repartition(5)
    got = {bytes(r["unit"]): r["n"] for r in encoding.frequent_units(docs).collect()}
    assert got == {b"one": 40, b" two": 40, b"\n": 20, b"three": 20}
    assert {bytes(r["unit"]) for r in encoding.frequent_units(docs, words=3).collect()} == {b"one", b" two"}
    assert encoding.frequent_units(docs, words=1).collect() == []


def test_unknown_ids_and_nulls_decode(spark):
    rows = [(1, [15496, 11, 995]), (2, [50256, 99999, None, -1]), (3, []), (4, None), (5, [164])]
    got = dict(encoding.decoded(spark.createDataFrame(rows, "k int, ids array<int>")).select("k", "decoded").collect())
    lib = library()
    assert got == {1: lib.decode([15496, 11, 995]), 2: "<|endoftext|>", 3: "", 4: None, 5: lib.decode([164])}


def states(words):
    return int(compiled(sorted((w, ()) for w in words))[3])


def test_automaton_is_minimal_and_gives_each_word_its_ids():
    # endings are shared: walk, talk, with -s, -ed, -ing have a state for each set of what may follow
    words = [stem + end for stem in (b"walk", b"talk") for end in (b"", b"s", b"ed", b"ing")]
    right = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for x in words for p in (x[:n] for n in range(len(x) + 1))}
    assert states(words) == len(right)
    rng = random.Random(1)
    entries = {"".join(rng.choice("abc") for _ in range(rng.randrange(7))).encode(): tuple(rng.randrange(4) for _ in range(rng.randrange(4))) for _ in range(500)}
    lexicon = Lexicon(compiled(sorted(entries.items())))
    asked = [*entries, b"d", b"abcabcabca", b"aaaaaad"]
    found, ids, bounds = lexicon.of(asked)
    for n, word in enumerate(asked):
        assert found[n] == (word in entries)
        assert tuple(ids[bounds[n] : bounds[n + 1]].tolist()) == entries.get(word, ())
    for few in ([], [(b"", (5,))], [(b"", ()), (b"a", (1, 2))]):
        found, ids, bounds = Lexicon(compiled(few)).of([b"", b"a", b"b"])
        assert found.tolist() == [w in dict(few) for w in (b"", b"a", b"b")]
        assert ids.tolist() == [i for _, x in few for i in x]
    with pytest.raises(ValueError):
        compiled([(b"b", ()), (b"a", ())])


def test_a_mapped_file_is_the_same_automaton(tmp_path):
    numbers = compiled([(b"ab", (1,)), (b"abc", (1, 2)), (b"b", (3,))])
    path = tmp_path / "words.bin"
    path.write_bytes(numbers.tobytes())
    found, ids, _ = Lexicon.mapped(str(path)).of([b"abc", b"b", b"c"])
    assert found.tolist() == [True, True, False] and ids.tolist() == [1, 2, 3]
