"""Counted metadata matches against the scored pairs, whatever fields are blank, hot or missing."""

import random

from pyspark.sql import functions as F

from paperlake.operators import dedup

SCHEMA = "doc_id long, path string, provider string, description string, date string, person string, doc_type string"


def files(spark, n, seed):
    pick = random.Random(seed)
    value = lambda c: pick.choice(["", None, f"{c}1", f" {c}1".upper(), f"{c}1 and more", f"{c}2"])
    return spark.createDataFrame([(k, f"{k % 37}/{k}", *[value(c) for c in "adtpk"]) for k in range(n)], SCHEMA)


def test_counts_are_those_of_the_pairs(spark):
    index = files(spark, 260, 1)
    docs = files(spark, 120, 2).unionByName(files(spark, 260, 1).where("doc_id % 3 = 0"))
    pairs = dedup.metadata_overlap(docs.withColumn("doc_id", F.monotonically_increasing_id()), index)
    want = sorted(tuple(r) for r in pairs.groupBy("doc_id").agg(F.count("*"), F.min("path")).drop("doc_id").collect())
    got = sorted((r["n"], r["first_path"]) for r in dedup.metadata_matches(docs, index).collect())
    assert got == want and len(got) > 100


def test_hot_person_and_odd_rows(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), "id").alias("path"), F.lit("Ada").alias("person"), F.lit("bill").alias("doc_type"))
    got = dedup.metadata_matches(hot, hot).collect()
    assert len(got) == 3000 and {r["n"] for r in got} == {2999}
    assert {r["first_path"] for r in got if r["doc_id"] != 0} == {"p0"} and [r["first_path"] for r in got if r["doc_id"] == 0] == ["p1"]
    assert dedup.metadata_matches(hot.where("false"), hot).isEmpty() and dedup.metadata_matches(hot, hot.where("false")).isEmpty()
    blank = spark.createDataFrame([(1, None, "", "", "", "", "")], SCHEMA)
    assert dedup.metadata_matches(blank, hot).isEmpty() and dedup.metadata_matches(hot, blank).isEmpty()
    no_path = spark.createDataFrame([(1, None, "", "", "", "ADA ", "")], SCHEMA)
    assert [tuple(r) for r in dedup.metadata_matches(no_path, hot).collect()] == [(1, 3000, "p0")]


def test_overlap_compares_metadata_not_files(spark):
    """A million pairs of one date among which none can match: rows with a provider are no candidates of another's documents."""
    names = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("n"), "id").alias("path"), (F.col("id") % 3).cast("string").alias("provider"), F.lit("today").alias("date"), F.lit("ada").alias("person"))
    index = names.withColumns({"path": F.concat(F.lit("o"), "doc_id"), "provider": F.lit("other")})
    links = dedup.metadata_overlap(names, index)
    assert links.isEmpty()
    copies = names.where("doc_id < 90")
    assert dedup.metadata_overlap(copies, copies).count() == 3 * 30 * 29


def test_links_of_every_document(spark):
    """One row a document, however many copies it meets."""
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), "id").alias("path"), F.lit("Ada").alias("person"), F.when(F.col("id") < 2999, "bill").otherwise("none").alias("doc_type"))
    got = {r["doc_id"]: r for r in dedup.metadata_links(hot, hot).collect()}
    assert len(got) == 3000 and {got[k]["n_links"] for k in range(2999)} == {2998} and (got[2999]["n_links"], got[2999]["first_path"]) == (0, None)
    assert len({r["class_id"] for r in got.values()}) == 2


def test_pairs_in_blocks(spark, monkeypatch):
    """Keys of many rows on one side or on both are dealt into blocks: the pairs are those of a join, in more tasks for more pairs."""
    monkeypatch.setattr(dedup, "BLOCK", 7)
    monkeypatch.setattr(dedup, "BLOCKS", 2)
    left = spark.range(200).select(F.when(F.col("id") < 150, "hot").when(F.col("id") < 180, "cold").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") < 90, "hot").when(F.col("id") == 90, "cold").when(F.col("id") > 290, None).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("b"))
    blocks = dedup.paired(left, right, "k")
    got = sorted(map(tuple, blocks.select("k", "a", "b").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect())) and len(got) == 150 * 90 + 30 + 20
    most = max(r["n"] for r in blocks.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    assert most < 150 * 90 / 10
    assert dedup.paired(left, right.where("k = 'none'"), "k").isEmpty()
