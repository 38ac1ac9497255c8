"""The dataset manifest against a plain tree, in one and in many rounds of blocks."""

import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from paperlake.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos long, h string, tree int, held string"
SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(hashes):
    """(top, siblings of each node as lists of (left, right))."""
    proofs, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, p in enumerate(at):
            run, k = hashes[p // 8 * 8 : p // 8 * 8 + 8], p % 8
            proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[i] = p // 8
        hashes = [H(*hashes[k : k + 8]) for k in range(0, len(hashes), 8)]
    return hashes[0], proofs


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded root and verdict of rows (doc_id, text, lang, source, n_chars)."""
    groups, subroots, found = {}, [], []
    for r in rows:
        groups.setdefault(r[2], []).append(r)

    def leaf(r, text):
        return H(*[value(v) for v in (r[0], r[3], r[2], r[4], text)])

    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in ordered:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subroots.append(climb([leaf(r, r[1]) for r in groups[g]]))
    root, above = climb([s for s, _ in subroots])
    for g, (subroot, proofs), up in zip(ordered, subroots, above, strict=True):
        for r, proof in zip(groups[g], proofs, strict=True):
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            now = leaf(r, text if struck else r[1])
            for left, right in proof + up:
                now = H(left, now, right)
            found.append((r[0], leaf(r, r[1]), subroot, root, H(*[a + b for a, b in proof + up]), now, now == root))
    return found


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(None, "a", "en", None, 1), (None, "A", "en", None, 1), (None, None, None, None, None), (7, "x", None, "s", 1), (7, "x", None, "s", 1)]
    for lang, n in sizes.items():
        for _ in range(n):
            i = rng.randrange(10_000)
            rows.append((i, rng.choice([None, "", "É%sb" % i, "Lower Me", "same"]), lang, rng.choice(["s1", None]), rng.choice([0, 5, None])))
    rows += [(9, "b" * 100_000, "it", "s", 4), rows[8], rows[8]]
    return rows


def run(spark, rows, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(*r, 1, "h", 2, "held") for r in rows], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    got = manifest.op11_merkle_manifest(spark, path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_against_a_plain_tree(spark, tmp_path, monkeypatch, digits):
    monkeypatch.setattr(manifest, "BLOCK_DIGITS", digits)
    rows = rows_of({"en": 150, "de": 9, "fr": 8, "es": 1, "": 3, **{f"l{k}": 2 for k in range(9)}})
    got = run(spark, rows, tmp_path)
    assert got == sorted(plain(rows), key=str)
    assert {v for *_, v in got} == {True, False}


def test_large_tables_of_partitions_are_joined_by_sorting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "BROADCAST_ROWS", 0)
    rows = rows_of({"en": 30, "de": 9}, seed=2)
    assert run(spark, rows, tmp_path) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, "one", "en", "s", 3)], [(3, "A", None, None, None), (4, "B", "", None, None)]])
def test_small_tables(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == sorted(plain(rows) if rows else [], key=str)


def test_proofs_of_other_columns_and_ids(spark):
    rows = [(f"id{k % 37}", k) for k in range(70)]
    leaves = spark.createDataFrame(rows, "name string, size long").select(
        F.lit("all").alias("tree"), F.col("name").alias("key"), manifest.leaf_of([F.col("name"), F.col("size")]).alias("leaf"), F.col("size").alias("held"))
    got = manifest.manifest(leaves).withColumn("up", manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted(r["held"] for r in got) == list(range(70)) and all(r["up"] == r["root"] == r["subroot"] for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = manifest.op11_merkle_manifest(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(manifest.OP11_SQL).fetchall())
