"""Quality measures beside a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter

from seriatim.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(again), failed


def test_measures_as_by_plain_version(spark):
    rng = random.Random(3)
    many = [f"w{n}" for n in range(6000)]
    texts = [None, "", " \n ", "one", "a b c d e a b c d e", "é ü x \x0b y\x1cz " * 4, "x\r\n\n x\nx\n x\n" * 3]
    texts += [" ".join(rng.choice(["a", "b", "c", "Ü", "*#", "d\n"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += [" ".join(many + many[2000:2300] + many[::-1]), " ".join(rng.choice(many) for _ in range(20000))]
    rows = [(n if n % 9 else None, t, "s") for n, t in enumerate(texts)] + [(1, "", "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string").selectExpr("*", "1 AS n_words")
    got = quality.quality(docs)
    assert got.columns[:8] == "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    assert Counter(tuple(r)[:7] for r in got.collect()) == Counter((i, *plain(t)) for i, t, _ in rows)


def test_bands_tell_prose_from_repetition_and_noise(spark):
    rng = random.Random(5)
    syllables = "ka lo mi ren tas ver un do pel gri sho nam bit".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(3000)]
    prose = {n: " ".join(rng.choice(words) for _ in range(n)) for n in (12, 40, 100, 400, 3000, 20000)}
    noise = "".join(chr(rng.randrange(33, 0x2FF)) + " " * (n % 7 == 0) for n in range(9000))
    phrase = [" ".join(words[k : k + 20]) for k in range(0, 60, 20)]
    loop = " ".join(f"{n} {rng.choice(phrase)}" for n in range(900))
    half = prose[3000] + " " + "z " * 12000
    rows = [*prose.items(), (-1, noise), (-2, loop), (-3, half)]
    # half noise, and noise at the end of a text that is no whole number of chunks
    rows += [(-4, prose[3000][:1500] + noise[:1500]), (-5, prose[3000][:2100] + noise[:900])]
    rows += [(-6, "ab" * 40 + " a b c d e f g h i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert all(kept[n] for n in prose)
    assert not any(kept[n] for n in range(-6, 0))


def test_empty_table(spark):
    assert quality.quality(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
