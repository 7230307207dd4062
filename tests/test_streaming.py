"""Streams over files landing one after the other, and batches run twice."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seriatim.streaming import batches, news, opened, patrol

SCHEMA = "entry bigint, episode bigint, seq bigint, status string, ts timestamp"

LANDED = [
    [(1, 1, 1, "saved"), (1, 2, 2, "locked"), (2, 1, 3, "locked")],
    [(1, 2, 4, "saved"), (1, 3, 5, "locked"), (2, 1, 6, "locked")],
    [(1, 3, 7, "saved"), (3, 1, 8, "locked"), (3, 1, 9, "saved")],
]


def land(spark, folder, upto):
    for n, rows in enumerate(LANDED[:upto]):
        df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
        target = folder / f"events{n}"
        if not target.exists():
            df.coalesce(1).write.parquet(str(target))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events*")


def test_patrol_over_batches(spark, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    patrol.run(land(spark, tmp_path, 2), table, checkpoint)
    assert {tuple(r) for r in patrol.watchlist(spark, table).collect()} == {(1, 3)}
    patrol.run(land(spark, tmp_path, 3), table, checkpoint)
    held = {(r["entry"], r["episode"]): (r["status"], r["visits"]) for r in patrol.catalogue(spark, table).collect()}
    assert held == {(1, 1): ("saved", 1), (1, 2): ("saved", 2), (1, 3): ("saved", 2), (2, 1): ("locked", 2), (3, 1): ("saved", 2)}
    assert {tuple(r) for r in patrol.watchlist(spark, table).collect()} == {(1, 3), (3, 1)}


def test_batch_run_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(1, "a")], "k bigint, v string")
    for _ in range(2):
        batches.write_batch(rows, path, 0)
        batches.write_batch(rows, path, 1)
    assert batches.read_batches(spark, path, rows.schema).count() == 2
    assert batches.read_batches(spark, path, rows.schema, before=1).count() == 1


@pytest.mark.parametrize("every", [2, 100])
def test_state_is_the_same_with_and_without_snapshots(spark, tmp_path, every):
    path = str(tmp_path / "state")

    def merge(df):
        return df.groupBy("k").agg(F.sum("n").cast("bigint").alias("n"))

    for batch in [*range(5), 4]:
        rows = spark.createDataFrame([(batch % 2, 1), (7, 1)], "k bigint, n bigint")
        batches.write_state(spark, rows, path, merge, batch, every)
    upto = batches.batches_written(spark, path, rows.schema)
    assert upto == 5
    got = batches.read_state(spark, path, rows.schema, merge, upto, every).collect()
    assert sorted(map(tuple, got)) == [(0, 3), (1, 2), (7, 5)]


@pytest.mark.parametrize("upto", [1, 3])
def test_opened_finds_turns_between_batches(spark, tmp_path, upto):
    path = str(tmp_path / "table")
    stream = land(spark, tmp_path, upto).withColumn("key", F.col("entry") * 100 + F.col("episode"))
    opened.run(stream, "key", "seq", "status", "locked", "saved", path, str(tmp_path / "checkpoint"))
    schema = stream.select("key", "seq", "status").schema
    got = {(r["key"], r["seq"]) for r in opened.found(spark, path, schema).collect()}
    assert got == (set() if upto == 1 else {(102, 4), (103, 7), (301, 9)})


def test_new_items_once(spark, tmp_path):
    stream = land(spark, tmp_path, 3)
    items = news.new_items(stream, ["entry", "episode"], "ts", "1 day").select("entry", "episode")
    news.write_available(items, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]


@pytest.mark.parametrize("seed", range(2))
def test_late_observations_give_what_all_at_once_gives(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3]), n, rng.choice(["locked", "saved", "exists", None])) for n in range(40)]
    rng.shuffle(rows)
    for n in range(4):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], "k bigint, n bigint, s string").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    stream = spark.readStream.schema("k bigint, n bigint, s string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    path = str(tmp_path / "table")
    opened.run(stream, "k", "n", "s", "locked", "saved", path, str(tmp_path / "checkpoint"))
    want = set()
    for key in (1, 2, 3):
        mine = sorted(r[1:] for r in rows if r[0] == key)
        want |= {(key, at, s) for (_, was), (at, s) in zip(mine, mine[1:]) if was == "locked" and s == "saved"}
    got = opened.found(spark, path, stream.schema).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_patrol_keeps_an_entry_that_locks_again(spark, tmp_path):
    table = str(tmp_path / "table")
    landed = [[(1, 1, 1, "saved"), (1, 2, 2, "saved")], [(1, 1, 3, "locked"), (1, 2, 4, "locked"), (2, 5, 5, "exists")]]
    for n, rows in enumerate(landed):
        spark.createDataFrame(rows, "entry bigint, episode bigint, seq bigint, status string").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema("entry bigint, episode bigint, seq bigint, status string").parquet(f"{tmp_path}/in*")
        patrol.run(stream, table, str(tmp_path / "checkpoint"))
    assert {tuple(r) for r in patrol.watchlist(spark, table).collect()} == {(1, 2), (2, 5)}


def test_patrol_rounds_walk_on_from_the_list_before(spark, tmp_path):
    schema = "url string, series_title string, status string, seq bigint"
    watched = spark.createDataFrame(
        [(1, "a1", "", False, True), (2, "b1", "old", False, True), (3, "q", "", True, False)],
        "pos bigint, url string, title string, search boolean, chain boolean",
    )
    edges = spark.createDataFrame([("a1", "a2"), ("a2", "a3"), ("a3", None), ("b1", "b2"), ("b2", None)], "url string, next_url string")
    landed = [[("a1", "A", "saved", 1), ("a2", "A", "locked", 2), ("b1", "B", "locked", 3)], [("a2", "A", "saved", 4), ("a3", "A", "saved", 5)]]
    want = [{(1, "a2", "A"), (2, "b1", "old"), (3, "q", "")}, {(1, "a3", "A"), (2, "b1", "old"), (3, "q", "")}]
    for n, rows in enumerate(landed):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in*")
        patrol.rounds(stream, watched, edges, str(tmp_path / "table"), str(tmp_path / "checkpoint"))
        got = patrol.rounds_list(spark, str(tmp_path / "table"), watched.schema).collect()
        assert {(r.pos, r.url, r.title) for r in got} == want[n]
