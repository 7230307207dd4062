"""Token counts beside the library's."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from seriatim.llm import token_counts


def test_counts_as_by_the_library(spark):
    rng = random.Random(2)
    odd = ["don't", "  ", "\n\n", " \t", "é", "漢字", "<|endoftext|>", "12345", "\x1c", "\x85", "　", "!!!", "'s", "͸", "֋", "🙂‍↔️", "ſ", "a" * 200, "\x00"]
    words = [*odd, *("".join(rng.choice("abcdefghij THE") for _ in range(rng.randrange(1, 12))) for _ in range(200))]
    texts = [None, "", " ", "\n ", "  a", "a  ", "x" * 5000, "<|endoftext|>" * 3]
    texts += ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(rng.choice([5, 60, 1500]))) for _ in range(150)]
    rows = [(n if n % 7 else None, t) for n, t in enumerate(texts)] + [(3, "twice")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_tokens")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(map(tuple, token_counts.token_counts(docs).collect()), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(docs.limit(0)).collect() == []


def test_shortcut_is_proved_with_the_library():
    whole = token_counts.whole_tokens("byte_bpe_50k.json")
    assert len(whole) > 40_000 and " the" in whole and "<|endoftext|>" not in whole
