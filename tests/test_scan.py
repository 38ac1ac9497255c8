"""Running values and ends of groups against plain loops, with one key over most rows."""

import random

import pytest
from pyspark.sql import functions as F

from paperlake.operators import dedup, pages, scan, select, stats


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 6 + ["b", None, ""]), rng.choice([None, None, None, rng.randrange(50)])) for i in rng.sample(range(5 * n), n)]


def expected(rows):
    out, state = {}, {}
    totals = {k: sum(r[1] == k for r in rows) for _, k, _ in rows}
    for i, key, v in sorted(rows):
        first, last, n, s = state.get(key, (None, None, 0, 0))
        first, last, n, s = (v if first is None else first), (last if v is None else v), n + 1, s + (v or 0)
        state[key] = first, last, n, s
        out[i] = (first, last, n, s, totals[key])
    return out


@pytest.mark.parametrize("blocks", [1, 7, 60])
@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_running_values(spark, monkeypatch, blocks, broadcast):
    monkeypatch.setattr(scan, "BROADCAST_ROWS", broadcast)
    rows = rows_of(blocks)
    df = spark.createDataFrame(rows, "id long, key string, v int").repartition(5)
    got = scan.running(df, "key", ["id"], {"f": ("first", "v"), "l": ("last", "v"), "n": ("count", None), "s": ("sum", "v"), "t": ("total", None)}, blocks=blocks)
    assert got.columns == ["id", "key", "v", "f", "l", "n", "s", "t"]
    assert {r["id"]: tuple(r)[3:] for r in got.collect()} == expected(rows)


def test_a_hot_key_is_many_tasks(spark):
    df = spark.range(20_000).select(F.col("id"), F.lit("all").alias("key"), F.when(F.col("id") == 5, 1).alias("v"))
    got = scan.running(df, "key", ["id"], {"f": ("first", "v")}, blocks=16)
    assert got.groupBy(F.spark_partition_id()).count().count() > 1 and got.where("f = 1").count() == 20_000 - 5


def test_running_of_nothing_and_unknown_kinds(spark):
    empty = spark.createDataFrame([], "id long, key string")
    assert scan.running(empty, "key", ["id"], {"n": ("count", None)}).count() == 0
    with pytest.raises(ValueError, match="kinds"):
        scan.running(empty, "key", ["id"], {"n": ("median", "id")})


def test_ends_of_groups_are_cut_before_the_shuffle(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "id long, key string, v int").repartition(5)
    out = pages.samples(df, key="key", order="id")
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    wanted = set()
    for key in {k for _, k, _ in rows}:
        own = sorted(i for i, k, _ in rows if k == key)
        wanted |= {(key, i, k, len(own), max(len(own) - 3, 0)) for k, i in enumerate(own, 1) if len(own) <= 3 or k <= 2 or k == len(own)}
    assert {(r["key"], r["id"], r["k"], r["n"], r["more"]) for r in out.collect()} == wanted


def test_conflicts_of_one_hot_name(spark):
    plan = spark.createDataFrame([("f", "same", f"p{k:03}") for k in range(40)] + [("f", "own", "q"), ("g", "same", "r"), (None, "n", "s"), (None, "n", "t")], "folder string, name string, path string")
    got = {r["path"]: r["final_name"] for r in pages.conflict_suffixes(plan).collect()}
    assert [got[f"p{k:03}"] for k in (0, 39)] == ["same_000", "same_039"] and got["q"] == "own" and got["r"] == "same" and (got["s"], got["t"]) == ("n_000", "n_001")


def test_notification_lists(spark):
    rows = [(k, "in", f"n{k}", 0.9 if k % 2 else 0.5, "bad" if k == 7 else None, "Whose?" if k < 3 else None) for k in range(10)]
    got = stats.notification(spark.createDataFrame(rows, "doc_id long, destination string, proposed_name string, confidence double, error string, question string")).collect()
    of = lambda s: sorted((r["position"], r["document"], r["n"], r["more"]) for r in got if r["section"] == s)
    assert of("group") == [(1, 0, 9, 6), (2, 1, 9, 6), (9, 9, 9, 6)] and of("error") == [(1, 7, 1, 0)]
    assert of("ambiguous") == [(k + 1, k, 3, 0) for k in range(3)] and of("review") == [(1, 0, 5, 2), (2, 2, 5, 2), (5, 8, 5, 2)]


def test_duplicates_are_counted_without_pairs(spark):
    rng = random.Random(6)
    index = [(k, f"{rng.choice(['to', 'x'])}/{k}", rng.choice(["hot", "hot", "b", f"own{k}", None])) for k in range(150)]
    docs = index[:60] + [(900, "new/1", "hot"), (901, "to/5", "other"), (902, None, "b")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, path string, sha256 string")
    got = {r["doc_id"]: tuple(r)[1:] for r in dedup.restricted_matches(frame(docs), frame(index), "to/").collect()}
    wanted = {}
    for i, path, sha in docs:
        found = sorted(p for _, p, s in index if s is not None and s == sha and p != path)
        inside = [p for p in found if p.startswith("to/")]
        if found:
            wanted[i] = (len(found), found[0], len(inside), inside[0] if inside else None)
    assert got == wanted


def test_pages_by_key(spark):
    rows = [(k % 7, k, f"v{k}") for k in range(100)]
    df, order = spark.createDataFrame(rows, "a int, b int, v string").repartition(5), [("a", True), ("b", False)]
    wanted, got, after = sorted(rows, key=lambda r: (-r[0], r[1])), [], None
    while page := [tuple(r) for r in select.page_after(df, order, after, most=30).collect()]:
        got, after = got + page, page[-1][:2]
    assert got == wanted
    assert "TakeOrderedAndProject" in select.page_after(df, order, (3, 10))._jdf.queryExecution().executedPlan().toString()
