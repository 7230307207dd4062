"""Every stage of the pipeline, and the whole, beside plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from seriatim.llm import quality
from tests.llm.test_quality import plain as measures
from tests.llm.test_shingles import slow_groups, slow_set

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_removed int, ratio double, _id int"


def rows_of(seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("kalomirentasver") for _ in range(rng.randrange(2, 9))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = prose(60)
    rows = [(n, prose(rng.randrange(30, 120)), rng.choice(["en", "de", None]), f"src{n % 7}") for n in range(60)]
    base = prose(150)
    rows += [(100 + n, base + " " + prose(n), "en", "src0") for n in range(4)]
    rows += [(200 + n, prose(40) + " " + passage + " " + prose(40), "en", "src1") for n in range(3)]
    rows += [(300, None, "en", "src2"), (301, "", None, None), (302, "too short", "en", "src1"), (303, "again " * 60, "en", "src1"), (None, prose(50), "en", None)]
    rows += [(305, prose(50), "de", "src3")] * 2 + [(306, "".join(chr(rng.randrange(33, 700)) + " " * (n % 9 == 0) for n in range(4000)), "en", "src4")]
    return [(*r, len(r[1] or ""), "k", 5, 0.5, 6) for r in rows]


def stays(text):
    m = measures(text)
    return not m[-1] and quality.Bands().verdict((text or "").encode())[0]


def one_of_each(rows):
    sets = [slow_set(r[1]) for r in rows]
    best = [min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0)) for g in slow_groups(sets)]
    return [rows[k] for k in best]


def without_repeats(rows, length=200):
    texts = [(r[1] or "").encode() for r in rows]
    times = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if times[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        if not any(gone):
            out.append(r)
        elif kept.strip(" "):
            out.append((r[0], kept, *r[2:4], len(kept), *r[5:]))
    return out


def held(df):
    return Counter(map(tuple, df.collect()))


def test_stages_one_after_the_other(spark, tmp_path):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA)
    first = corpus_pipeline.quality_rules(spark, docs, "")
    want = [r for r in rows if stays(r[1])]
    assert first.columns == docs.columns and held(first) == Counter(want) and 60 < len(want) < len(rows)
    second = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(want, SCHEMA), "")
    want = one_of_each(want)
    assert second.columns == docs.columns and held(second) == Counter(want)
    assert {r[0] for r in want} >= {*range(60), 100, 200, 201, 202, 305, None} and not {101, 102, 103} & {r[0] for r in want}
    third = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(want, SCHEMA), "")
    want = without_repeats(want)
    assert third.columns == docs.columns and held(third) == Counter(want)
    fourth = corpus_pipeline.source_weights(spark, spark.createDataFrame(want, SCHEMA), "")
    got = held(fourth)
    assert fourth.columns == docs.columns and not got - Counter(want)
    size = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert 0.8 * size(want) < size(got.elements()) <= 0.9 * size(want)
    # a source with less than another left whole is whole itself
    by = {s: (size([r for r in got.elements() if r[3] == s]), size([r for r in want if r[3] == s])) for s in {r[3] for r in want}}
    cut = [all_ for some, all_ in by.values() if some < all_]
    assert cut and min(cut) >= max((all_ for some, all_ in by.values() if some == all_), default=0) / 4
    fifth = corpus_pipeline.packed_sequences(spark, spark.createDataFrame(sorted(got.elements(), key=str), SCHEMA), "").collect()
    by_doc = {}
    for r in fifth:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(by_doc) == {r[0] for r in got}
    for pieces in by_doc.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:n]) for n in range(len(pieces))]
        assert sum(p[1] for p in pieces) == pieces[0][2]


def test_run_applies_all_stages(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(rows_of(8), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.collect()}
    assert len({r["doc_id"] for r in got}) > 40


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_tables_and_rows_of_nulls(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").collect() == []
    nulls = spark.createDataFrame([(None,) * 9], SCHEMA)
    assert len(stage(spark, nulls, "").collect()) == (0 if name == "quality_rules" else 1)
