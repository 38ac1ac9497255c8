"""Folder digests do not depend on order or split, and see every change; odd rows of an index have a defined result."""

import datetime as dt

from pyspark.sql import functions as F

from paperlake.operators import dedup, indexing

DAY = dt.datetime(2024, 1, 2)
FILES = "path string, mtime timestamp, size long"


def test_digests(spark):
    rows = [("top", DAY, 1), ("a/x", DAY, 2), ("a/b/y", DAY, 3), ("a/b/y", DAY, 3), ("c//z", None, None), (None, DAY, 1)]
    files = spark.createDataFrame(rows, FILES)
    got = {r["folder"]: (r["n"], r["digest"]) for r in indexing.folder_digests(files).collect()}
    assert {f: n for f, (n, _) in got.items()} == {"": 5, "a": 3, "a/b": 2, "c": 1, "c/": 1}
    again = {r["folder"]: (r["n"], r["digest"]) for r in indexing.folder_digests(spark.createDataFrame(rows[::-1], FILES).repartition(7)).collect()}
    assert got == again
    for k, changed in enumerate([("a/b/y", DAY, 4), ("a/b/q", DAY, 3), ("a/b/y", DAY + dt.timedelta(seconds=1), 3), ("c/y", DAY, 3)]):
        other = {r["folder"]: r["digest"] for r in indexing.folder_digests(spark.createDataFrame([*rows[:3], changed, *rows[4:]], FILES)).collect()}
        assert other["a/b"] != got["a/b"][1] and other[""] != got[""][1] and (k == 3 or other["c"] == got["c"][1])
    assert indexing.folder_digests(files.where("false")).isEmpty()


def test_delta_of_changed_folders_is_the_whole_delta(spark):
    now = spark.range(3000).select(F.concat_ws("/", F.lit("d"), (F.col("id") % 17).cast("string"), F.col("id").cast("string")).alias("path"), F.lit(DAY).alias("mtime"), F.col("id").alias("size"))
    then = now.where("size % 170 <> 3").withColumn("mtime", F.when(F.col("size") == 40, F.col("mtime") - F.expr("interval 5 seconds")).otherwise(F.col("mtime")))
    then = then.unionByName(spark.createDataFrame([("d/5/old", DAY, 1), ("e/old", DAY, 1)], FILES))
    some = {tuple(r) for r in indexing.folder_delta(now, then).collect()}
    every = {tuple(r) for r in dedup.index_delta(now, then).collect()}
    assert {r for r in every if r[1] != "unchanged"} == {r for r in some if r[1] != "unchanged"}
    assert some < every and {p.split("/")[1] for p, _ in some} == {"3", "5", "6", "old"}
    assert {r["path"] for r in indexing.to_hash(now, then).collect()} == {p for p, s in every if s in ("new", "changed")}
    assert indexing.folder_delta(now, now).isEmpty()


def test_unreadable_and_bare_files(spark):
    listing = spark.createDataFrame([("new", DAY, 1), ("lost", DAY, 1), ("kept", DAY, 2)], FILES)
    index = spark.createDataFrame([("kept", "h0", 1, DAY - dt.timedelta(days=1), None, None, True, False, "p", "q", "r"), ("gone", "h1", 1, DAY, None, None, False, False, "", "", "")],
                                  "path string, sha256 string, size long, mtime timestamp, meta string, ocr_hash string, has_meta boolean, has_ocr boolean, provider string, person string, doc_type string")
    hashes = spark.createDataFrame([("new", "n")], "path string, sha256 string")
    none = spark.createDataFrame([], "path string, meta string, ocr string, has_meta boolean, has_ocr boolean")
    rows = indexing.refreshed(listing, index, hashes, none)
    got = {r["path"]: (r["state"], r["sha256"], r["size"], r["has_meta"], r["provider"]) for r in rows.collect()}
    assert got == {"new": ("new", "n", 1, False, None), "kept": ("error", "h0", 1, True, "p")}
    assert tuple(indexing.build_statistics(rows, listing).first()) == (1, 0, 2, 0)
    assert tuple(indexing.build_statistics(rows.where("false"), listing.where("false")).first()) == (0, 0, 0, 0)
