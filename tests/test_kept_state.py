"""State in buckets and lists in ranges: what a batch does not name stays as it lies."""

from __future__ import annotations

import os
from pathlib import Path

from seriatim.operators import joins, watch
from seriatim.sources import sinks
from seriatim.streaming import batches, kept_list, opened, patrol


def files(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in Path(folder).rglob("*.parquet")}


def test_buckets_hold_their_last_version_and_the_one_before(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "k long, v string"
    bucket = batches.bucket_of("k")

    def put(batch, *rows):
        batches.write_buckets(spark.createDataFrame(rows, schema).withColumn("bucket", bucket), path, batch)

    put(0, (1, "a"), (2, "b"), (None, "n"))
    put(1, (1, "c"))
    put(2, (1, "d"))
    names = spark.createDataFrame([], schema).schema

    def held(**some):
        return sorted(map(str, map(tuple, batches.read_buckets(spark, path, names, **some).collect())))

    assert held() == sorted(map(str, [(1, "d"), (2, "b"), (None, "n")]))
    assert held(before=2) == sorted(map(str, [(1, "c"), (2, "b"), (None, "n")]))
    one = batches.buckets_in(spark.createDataFrame([(1, "")], schema), bucket)
    some = batches.read_buckets(spark, path, names, one)
    assert {f"bucket={one[0]}/batch=2" in f for f in some.inputFiles()} == {True}
    # the version before the last two is gone
    assert sorted(int(f.split("batch=")[1].split("/")[0]) for f in files(path) if f"bucket={one[0]}/" in f) == [1, 2]
    assert batches.read_buckets(spark, path, names, []).collect() == []


def test_an_untouched_bucket_is_neither_read_nor_written(spark, tmp_path):
    landed = [[(k, k, "locked") for k in range(40)], [(7, 100, "saved")]]
    path = str(tmp_path / "table")
    before = None
    for n, rows in enumerate(landed):
        spark.createDataFrame(rows, "k long, n long, s string").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema("k long, n long, s string").parquet(f"{tmp_path}/in*")
        opened.run(stream, "k", "n", "s", "locked", "saved", path, str(tmp_path / "checkpoint"))
        if n == 0:
            before = files(f"{path}/last")
    after = files(f"{path}/last")
    mine = batches.buckets_in(spark.createDataFrame([(7,)], "k long"), batches.bucket_of("k"))[0]
    assert {f.split("/")[0] for f in after.keys() - before.keys()} == {f"bucket={mine}"}
    assert all(after[f] == t for f, t in before.items())
    got = opened.found(spark, path, stream.schema).collect()
    assert [tuple(r) for r in got] == [(7, 100, "saved")]


def test_an_update_rewrites_the_ranges_it_hits(spark, tmp_path):
    path = str(tmp_path / "list")
    rows = [(k, f"u{k}", f"t{k}", False, True) for k in range(1, 40)]
    watched = spark.createDataFrame(rows, "pos long, url string, title string, search boolean, chain boolean")
    kept_list.save(watched, path, 0, width=10)
    before = files(path)
    updates = spark.createDataFrame(
        [(1, "v12", "u12", "new", False), (2, "w12", "v12", "", True), (3, "x", None, "fresh", False)], "seq long, url string, replacing string, title string, search boolean"
    )
    hit = kept_list.update(spark, path, watched.schema, updates, 1, width=10)
    assert hit == [1, 4]
    after = files(path)
    assert {f.split("/")[0] for f in after.keys() - before.keys()} == {"bucket=1", "bucket=4"}
    assert all(after[f] == t for f, t in before.items())
    listed = kept_list.load(spark, path, watched.schema).collect()
    want = watch.upsert(watched.select("pos", "url", "title", "search"), updates).collect()
    assert sorted(tuple(r)[:4] for r in listed) == sorted(map(tuple, want))
    assert {r["pos"]: r["chain"] for r in listed if r["pos"] > 38} == {39: True, 40: None}
    # run again, the version gives the same
    kept_list.update(spark, path, watched.schema, updates, 1, width=10)
    assert sorted(map(tuple, kept_list.load(spark, path, watched.schema).collect())) == sorted(map(tuple, listed))


def test_only_entries_with_news_are_walked(spark, tmp_path, monkeypatch):
    schema = "url string, series_title string, status string, seq long"
    watched = spark.createDataFrame(
        [(1, "a1", "", False, True), (2, "b1", "", False, True), (3, "s", "", False, False), (4, "z", "", True, False)],
        "pos long, url string, title string, search boolean, chain boolean",
    )
    links = [("a1", "a2"), ("a2", None), ("b1", "b2"), ("b2", "c2"), ("c1", "c2"), ("c2", None)]
    edges = spark.createDataFrame(links, "url string, next_url string")
    listings = spark.createDataFrame([("s", 1, "s1"), ("s", 2, "s2")], "series_url string, pos long, episode_url string")
    landed = [
        [("a1", "A", "saved", 1), ("b1", "B", "saved", 2), ("s1", "S", "saved", 3)],
        [("c2", "C", "saved", 4)],
        [("s2", "T", "saved", 5)],
        [("nowhere", "N", "saved", 6)],
    ]
    want = {1: ("a1", "A"), 2: ("c2", "C"), 3: ("s", "T"), 4: ("z", "")}
    walked, plain = [], patrol.watch.moves

    def moves(entries, *rest):
        walked.append({r["pos"] for r in entries.select("pos").collect()})
        return plain(entries, *rest)

    monkeypatch.setattr(patrol.watch, "moves", moves)
    table = str(tmp_path / "table")
    for n, rows in enumerate(landed):
        folder = tmp_path / f"in{n}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
        for f in folder.glob("*.parquet"):
            os.utime(f, (1000 + n, 1000 + n))  # files land in this order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    patrol.rounds(stream, watched, edges, table, str(tmp_path / "checkpoint"), listings)
    assert walked == [{1, 2, 3, 4}, {2}, {3}, set()]
    got = {r["pos"]: (r["url"], r["title"]) for r in patrol.rounds_list(spark, table, watched.schema).collect()}
    assert got == want


def test_the_saved_side_is_joined_as_it_lies(spark, tmp_path):
    saved = spark.createDataFrame([(k % 50,) for k in range(300)] + [(None,)], "key long")
    table = sinks.write_saved(saved, "saved_for_test", str(tmp_path / "saved"), "key", buckets=4)
    new = spark.createDataFrame([(k, f"t{k}") for k in range(40, 60)] + [(None, "none")], "key long, title string").repartition(3)
    found = joins.not_saved_yet(new, table, "key", by_key=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("SortMergeJoin") :].splitlines()
    scan = next(n for n, line in enumerate(joined) if "Bucketed: true" in line)
    # the one exchange by key stands on the side of the new episodes
    assert sum("hashpartitioning(key" in line for line in joined) == 1
    assert not any("Exchange" in line for line in joined[scan - 3 : scan])
    assert {r["key"] for r in found.collect()} == {*range(50, 60), None}
    spark.sql("DROP TABLE saved_for_test")
