"""State with timers: sides and expiry over restarts of a stream, late rows and known state."""

import datetime as dt

from pyspark.sql import functions as F

from paperlake.operators import pages
from paperlake.streaming import inbox

START = dt.datetime(2024, 5, 1, 8)


def runs(spark, folder, build, batches, schema):
    """What each run of the stream over one more batch emits; every run is a restart from the checkpoint."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = []
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        inbox.run_once(build(stream), lambda df, _, got=got: got.extend(df.collect()), f"{folder}/checkpoint")
        out.append(got)
    return out


def test_proposals_expire_over_restarts(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    batches = [
        [("a", "proposed", at(0)), ("b", "proposed", at(1)), ("c", "approved", at(1)), ("d", "proposed", at(2)), ("d", "denied", at(2)), (None, "proposed", at(0)), ("x", "proposed", None)],
        [("b", "approved", at(20)), ("a", "proposed", at(22)), ("e", "proposed", at(30))],
        [("z", "note", at(60))],
        [("e", "approved", at(61)), ("z", "note", at(90))],
    ]
    got = runs(spark, tmp_path, inbox.expiring, batches, "key string, kind string, ts timestamp")
    rows = sorted(((r["key"], r["proposed_at"], r["expired_at"]) for g in got for r in g), key=str)
    assert rows == sorted([(None, at(0), at(24)), ("a", at(22), at(46)), ("e", at(30), at(54))], key=str)
    assert not got[0] and {r["key"] for r in got[2]} >= {"a", "e"}


def test_sides_over_restarts(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    schema = "person string, doc_type string, day string, scan_id long, ts timestamp"
    row = lambda who, n, m: (who, "id", "d", n, at(m))
    batches = [[row("Ann", 1, 0), row("Bo", 2, 1)], [row("Ann", 3, 5), row("Ann", 4, 6)], [row("Ann", 5, 7), row("Bo", 6, 40), row(None, 7, 41)], [row("Ann", 8, 60), row("Bo", 9, 3000)], [row("Ann", 10, 3001)]]
    got = runs(spark, tmp_path, inbox.sides_stream, batches, schema)
    found = {r["scan_id"]: r["side"] for g in got for r in g}
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    assert found == {r["scan_id"]: r["side"] for r in pages.sides(every).collect()} and len(found) == 10
    assert [found[n] for n in (1, 3, 4, 8)] == ["Front", "Back", None, "Front"]


def test_sides_begin_with_what_is_known(spark, tmp_path):
    schema = "person string, doc_type string, day string, scan_id long, ts timestamp"
    clock = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    known = spark.createDataFrame([("Ann", "id", "d", clock, "Front")], "person string, doc_type string, day string, at long, last string")
    batch = [("Ann", "id", "d", 1, START + dt.timedelta(minutes=2)), ("Bo", "id", "d", 2, START)]
    got = runs(spark, tmp_path, lambda s: inbox.sides_stream(s, known=known), [batch], schema)
    assert {r["scan_id"]: r["side"] for r in got[0]} == {1: "Back", 2: "Front"}


def test_state_is_in_rocksdb(spark):
    inbox.with_rocksdb(spark.range(1))
    assert all(spark.conf.get(k) == v for k, v in inbox.ROCKSDB.items())
    assert spark.range(3).where(F.col("id") > 5).isEmpty()
