"""Ids that are texts: the same classes, removed bytes and kept documents as with the numbers that they stand for."""

import random
import warnings

from pyspark.sql import functions as F

import corpus_pipeline
from paperlake.llm import ngram_join, repeats

from .test_small_cases import prose

NUMBERS, TEXTS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id string, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(9)
    out = [(k, prose(rng, 90)) for k in range(30)]
    out += [(100 + k, out[3][1] + f" end{k}") for k in range(12)] + [(200 + k, out[4][1]) for k in range(9)]
    return [*out, (300, None), (301, ""), (None, out[5][1]), (200, out[4][1])]


def name(k):
    return None if k is None else f"doc-{k:05d}"


def both(spark):
    full = [(k, t, "en", f"s{(k or 0) % 3}", len(t or "")) for k, t in rows()]
    return spark.createDataFrame(full, NUMBERS).repartition(3), spark.createDataFrame([(name(k), *rest) for k, *rest in full], TEXTS).repartition(3)


def test_join(spark):
    numbers, texts = both(spark)
    want = sorted(((name(r["doc_id"]), name(r["class_id"]), r["n_links"], name(r["same_as"])) for r in ngram_join.join_classes(numbers).collect()), key=str)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["same_as"]) for r in ngram_join.join_classes(texts).collect()), key=str)
    assert got == want and max(r[2] for r in got) >= 9
    kept = sorted(str(r["doc_id"]) for r in ngram_join.keep_one(texts).collect())
    assert kept == sorted(str(name(r["doc_id"])) for r in ngram_join.keep_one(numbers).collect()) and len(kept) < len(rows())


def test_repeats(spark):
    def result(docs, told):
        return sorted(((told(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect()), key=str)

    numbers, texts = both(spark)
    assert result(texts, str) == result(numbers, lambda k: str(name(k)))


def test_pipeline(spark, tmp_path):
    docs = both(spark)[1]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.where("doc_id is not null").select("doc_id", (F.crc32("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct().write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i1", " ".join(rows()[7][1].split()[10:30]))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in out.collect()}
    assert dict(out.dtypes)["doc_id"] == "string" and ids <= {name(k) for k, _ in rows()}
    assert name(7) not in ids and not ids & {name(k) for k in range(201, 209)}
