"""Bucketed tables: what is rewritten, writers at once, replays, pruning."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quantloom.sources import commits
from quantloom.sources.commits import BucketTable


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "symbol string, v long")


def union(old, new):
    return new if old is None else old.unionByName(new)


def content(table, version=None):
    return sorted((r.symbol, r.v) for r in table.read(version).collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", "symbol", 16)
    assert table.read() is None and table.versions() == []
    table.change(frame(spark, *((f"s{i}", i) for i in range(60))), union)
    first = table.manifest()
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    table.change(frame(spark, ("s7", 700)), union)
    second = table.manifest()
    moved = {b for b in first.folders if first.folders[b] != second.folders[b]}
    assert len(moved) == 1 and len(first.folders) > 8
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())  # old files as they were
    assert content(table) == sorted([*((f"s{i}", i) for i in range(60)), ("s7", 700)])
    assert content(table, 0) == sorted((f"s{i}", i) for i in range(60))  # a reader's version stays


def test_writers_at_once_lose_nothing(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", "symbol", 4)

    def write(i):
        return BucketTable(spark, f"file://{tmp_path}/t", "symbol", 4).change(frame(spark, ("a", i), (f"w{i}", i)), union)

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(write, range(8)))
    assert sorted(versions) == list(range(8)) == table.versions()
    assert content(table) == sorted([("a", i) for i in range(8)] + [(f"w{i}", i) for i in range(8)])


def test_a_writer_that_was_overtaken_starts_again(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", "symbol", 4)
    seen = []

    def slow(old, new):
        seen.append(None if old is None else old.count())
        if len(seen) == 1:
            BucketTable(spark, f"file://{tmp_path}/t", "symbol", 4).change(frame(spark, ("a", 1)), union)
        return union(old, new)

    assert table.change(frame(spark, ("a", 2)), slow) == 1 and seen == [None, 1]
    assert content(table) == [("a", 1), ("a", 2)]
    with pytest.raises(RuntimeError, match="first each time"):
        table.change(frame(spark, ("a", 3)), lambda old, new: (BucketTable(spark, f"file://{tmp_path}/t", "symbol", 4).change(frame(spark, ("a", 0)), union), union(old, new))[1], attempts=2)


def test_a_replayed_batch_adds_no_version(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", "symbol")
    assert [table.change(frame(spark, ("a", i)), union, "stream", i) for i in (0, 1, 1, 0)] == [0, 1, 1, 1]
    assert table.change(frame(spark, ("a", 9)), union, "other", 0) == 2
    assert content(table) == [("a", 0), ("a", 1), ("a", 9)] and table.manifest().batches == {"stream": 1, "other": 0}


def test_empty_changes_and_emptied_buckets(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", "symbol")
    table.change(frame(spark), union)
    assert table.read() is None
    table.change(frame(spark, ("a", 1), (None, 2)), union)
    table.change(frame(spark, ("a", 0)), lambda old, new: new.where("false"))
    assert content(table) == [(None, 2)]


def test_pruning_keeps_what_new_versions_need(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", "symbol", 8)
    for i in range(5):
        table.change(frame(spark, (f"s{i}", i)), union)
    table.prune(2)
    assert table.versions() == [3, 4] and content(table) == [(f"s{i}", i) for i in range(5)] and len(content(table, 3)) == 4
    table.change(frame(spark, ("s0", 9)), lambda old, new: new)
    table.prune(1)
    assert ("s0", 9) in content(table) and ("s0", 0) not in content(table)


def test_bars_are_fetched_and_merged_by_bucket(spark, tmp_path):
    def bars(*rows):
        return spark.createDataFrame(list(rows), "symbol string, d string, close double").select("symbol", F.to_date("d").alias("date"), "close")

    table = BucketTable(spark, f"file://{tmp_path}/t", "symbol", 32)
    asked = []
    fetch = lambda stale: asked.append(sorted(r.symbol for r in stale.collect())) or bars(("a", "2024-01-10", 1.0), ("b", "2024-01-02", 2.0)).join(stale, "symbol", "left_semi")
    wanted = spark.createDataFrame([("a",), ("b",), ("x",)], "symbol string")
    assert {r.symbol for r in commits.refresh_bars(wanted, table, fetch, "2024-01-11").collect()} == {"a", "b"}
    before = table.manifest().folders
    assert {r.symbol for r in commits.refresh_bars(wanted, table, fetch, "2024-01-11").collect()} == {"a", "b"}
    assert asked == [["a", "b", "x"], ["b", "x"]]
    after = table.manifest().folders
    assert sum(before[b] != after[b] for b in before) == 1 == len(before) - sum(before[b] == after[b] for b in before)


def test_two_streams_write_one_timeline(spark, tmp_path):
    rows = spark.createDataFrame([(m, f"2024-01-0{d} 0{h}:1{s}:00", s + 10 * d) for m in ("CN", "US") for d in (1, 2, 3) for h in (1, 2) for s in (1, 2)], "market string, t string, seq long")
    rows = rows.select("market", F.col("t").cast("timestamp").alias("timestamp"), "seq")
    table = BucketTable(spark, f"file://{tmp_path}/t", "market", 8)
    for name, part in (("first", "seq < 20"), ("second", "seq >= 20")):
        rows.where(part).write.parquet(str(tmp_path / name))
    started = []
    for name in ("first", "second"):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
        writer = stream.writeStream.foreachBatch(commits.merge_into(table, name, 30)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True)
        started.append(writer.start())
    for query in started:
        query.awaitTermination()
    found = sorted((r.market, r.timestamp.strftime("%d %H:%M"), r.seq) for r in table.read().collect())
    assert found == [(m, f"0{d} 0{h}:12", 2 + 10 * d) for m in ("CN", "US") for d in (2, 3) for h in (1, 2)]
