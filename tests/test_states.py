"""Mergeable states and sums equal the full recomputation after any split."""

import random

import pytest
from pyspark.sql import functions as F

from paperlake.operators import lifecycle, stats
from paperlake.streaming import inbox


@pytest.mark.parametrize("parts", [2, 5])
def test_states_of_any_split(spark, parts):
    rng = random.Random(parts)
    rows = [(f"s{rng.randrange(25)}", rng.randrange(50), k % 3, rng.choice(["proposed", "approved", "denied"]), rng.choice("abc"), rng.choice(["bill", "rx", None])) for k in range(300)]
    events = spark.createDataFrame(rows, "sha string, ts int, seq int, kind string, name string, doc_type string").withColumn("part", (F.rand(parts) * parts).cast("int")).cache()
    split = [lifecycle.event_states(events.where(F.col("part") == p)) for p in range(parts)]
    merged = lifecycle.of_states(lifecycle.merge_states(lifecycle.merge_states(*split[1:]), split[0]))
    whole = lifecycle.reduce_events(events)
    assert sorted(map(tuple, merged.select(*whole.columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_sums_of_changes(spark):
    rng = random.Random(2)
    make = lambda: (rng.choice(["bill", "rx", None]), rng.choice(["none", "deny", "retype"]), rng.choice([None, 1]), rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, 0.1234, 0.99]))
    old = {k: make() for k in range(80)}
    new = old | {k: make() for k in rng.sample(range(120), 50)}
    frame = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], "id int, proposed_doc_type string, override_type string, approved_at int, approval_attempts int, classification_confidence double")
    changed = {k: v for k, v in new.items() if old.get(k) != v}
    merged = stats.merge_tallies(stats.tally(frame(old)), stats.tally(frame({k: old[k] for k in changed if k in old}), -1), stats.tally(frame(changed)))
    assert sorted(map(tuple, stats.of_tallies(merged).collect()), key=str) == sorted(map(tuple, stats.of_tallies(stats.tally(frame(new))).collect()), key=str)
    gone = stats.merge_tallies(stats.tally(frame(old)), stats.tally(frame(old), -1))
    assert gone.count() == 0


def test_a_queue_until_it_gives_up(spark):
    queue = spark.createDataFrame([("a", "working", "2024-01-01 10:00:00", 1), ("b", "done", "2024-01-01 09:00:00", 1)], "file string, status string, since string, attempts int")
    queue = queue.withColumns({"since": F.col("since").cast("timestamp"), "note": F.lit(None).cast("string")})
    seen = []
    for hour in range(11, 15):
        queue = inbox.requeued(queue, F.lit(f"2024-01-01 {hour}:00:00").cast("timestamp"))
        seen.append(tuple(queue.where("file = 'a'").select("status", "attempts", "note").first()))
        queue = queue.withColumn("status", F.when(F.col("status") == "queued", "working").otherwise(F.col("status")))
    assert seen == [("queued", 2, None), ("queued", 3, None), ("dead", 3, "given up after 3 attempts"), ("dead", 3, "given up after 3 attempts")]
    late = spark.createDataFrame([("a", "2023-01-01"), ("late", "2023-01-01"), ("late", "2023-01-02")], "file string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["file"], r["status"], r["attempts"]) for r in inbox.merged_arrivals(queue, late).collect()) == [("a", "dead", 3), ("b", "done", 1), ("late", "queued", 1)]
