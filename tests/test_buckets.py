"""Bucketed upserts, replayed batches and a sink that is cut off half-way."""

import random

import pytest
from pyspark.sql import functions as F

from paperlake.sources.buckets import BucketTable, History, micro_batch_sink
from paperlake.streaming import inbox

SCHEMA = "key string, seq long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_upserts_equal_one_reduction(spark, tmp_path):
    rng = random.Random(1)
    table, latest = BucketTable(spark, str(tmp_path), "key", ["seq"], SCHEMA, buckets=8), {}
    assert table.read().count() == 0 and table.current() == {}
    seqs = iter(rng.sample(range(1000), 90))
    for number in range(4):
        rows = [(f"k{rng.randrange(30)}", next(seqs), f"{number}") for _ in range(20)]
        table.upsert(frame(spark, rows), batch=number)
        for key, seq, v in rows:
            latest[key] = max(latest.get(key, (-1, "")), (seq, v))
        assert {r["key"]: (r["seq"], r["v"]) for r in table.read().collect()} == latest


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), "key", ["seq"], SCHEMA, buckets=16)
    table.upsert(frame(spark, [(f"k{k}", 1, "a") for k in range(100)]))
    before = table.current()
    touched = table.upsert(frame(spark, [("k5", 2, "b"), ("new", 1, "c")]))
    after = table.current()
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    assert table.read().count() == 101 and table.read().where("key = 'k5'").first()["v"] == "b"
    table.upsert(frame(spark, [("k5", 1, "old")]))
    assert table.read().where("key = 'k5'").first()["v"] == "b"


def test_replays_and_empty_batches(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), "key", ["seq"], SCHEMA, buckets=4)
    assert table.upsert(frame(spark, [("a", 1, "x")]), batch=0) and table.upsert(frame(spark, [("a", 9, "replayed")]), batch=0) == []
    assert table.upsert(frame(spark, []), batch=1) == [] and table.done(1) and not table.done(2)
    assert [tuple(r) for r in table.read().collect()] == [("a", 1, "x")]
    assert sorted(r["key"] for r in table.unseen(frame(spark, [("a", 3, "y"), ("b", 1, "y"), ("b", 2, "z")])).collect()) == ["b"]


def test_a_folder_without_a_line_is_not_read(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), "key", ["seq"], SCHEMA, buckets=2)
    table.upsert(frame(spark, [("a", 1, "x")]))
    frame(spark, [("a", 5, "half")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/data/2-half")
    assert table.read().first()["v"] == "x"


def test_a_stream_that_is_cut_off_writes_nothing_twice(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    state = BucketTable(spark, f"{tmp_path}/state", "sha", ["ts"], "sha string, path string, ts long", buckets=4)
    proposals = BucketTable(spark, f"{tmp_path}/proposals", "sha", ["ts"], "sha string, name string, ts long", buckets=4)
    history = History(spark, f"{tmp_path}/history", "sha string, batch_no int")
    write = micro_batch_sink(lambda fresh: fresh.select("sha", F.concat(F.lit("doc_"), "path").alias("name"), "ts"), state, proposals, history)

    def stream():
        lines = spark.readStream.schema("sha string, path string, ts long").option("maxFilesPerTrigger", 1).json(str(files))
        inbox.run_once(lines, failing, f"{tmp_path}/checkpoint")

    broken = []

    def failing(batch, number):
        if number == 1 and not broken:
            broken.append(number)
            proposals.upsert(state.unseen(batch).select("sha", F.lit("half").alias("name"), "ts"), batch=number)
            raise RuntimeError("lost")
        write(batch, number)

    (files / "a.json").write_text('{"sha":"s1","path":"p1","ts":1}\n{"sha":"s2","path":"p2","ts":2}\n')
    stream()
    (files / "b.json").write_text('{"sha":"s2","path":"again","ts":3}\n{"sha":"s3","path":"p3","ts":4}\n')
    with pytest.raises(Exception, match="lost"):
        stream()
    stream()
    assert sorted((r["sha"], r["name"]) for r in proposals.read().collect()) == [("s1", "doc_p1"), ("s2", "doc_p2"), ("s3", "half")]
    assert sorted(r["path"] for r in state.read().collect()) == ["p1", "p2", "p3"]
    assert sorted((r["sha"], r["batch"]) for r in history.read().collect()) == [("s1", 0), ("s2", 0), ("s3", 1)]
    write(spark.createDataFrame([("s9", "p9", 9)], "sha string, path string, ts long"), 1)
    assert state.read().count() == 3
