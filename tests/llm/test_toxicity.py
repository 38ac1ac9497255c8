"""The toxicity classifier against plain Python, on odd rows and on held-out labels."""

import math
import os
import random
import zlib

import numpy as np
import pytest

from paperlake.llm import toxicity, tokens

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double, toxic string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, "x") for i, t in rows], DOCS).repartition(3)


def plain_features(text):
    """N-grams of a text, one string at a time, as buckets."""
    found = set()
    words = "".join(c if c.isalpha() or c in "́" else " " for c in (text or "").lower()).split()
    for word in words:
        word = f" {word} "
        for n in toxicity.SIZES:
            for k in range(len(word) - n + 1):
                h = 0
                for c in word[k : k + n]:
                    h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
                found.add(int(tokens.mix(np.array([(h + n) % 2**64], np.uint64))[0]) >> (64 - toxicity.BITS))
    return found


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        words = [f"{rng.choice(['ka', 'lo', 'mi', 'nu'])}{rng.choice(['ra', 'te', 'so'])}{rng.choice(['ling', 'ber', 'ton'])}" for _ in range(rng.randrange(5, 60))]
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["Vilescum", "gräßlich", "foulmouth"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_features_are_the_ngrams_of_each_text():
    texts = ["", None, "a", "Idiot, über-klug 12idioten3", "ｗｉｄｅ été", "x" * 30, "12 34"] * 3
    got = []
    for n, rows, found in toxicity.features(texts):
        rows, found = toxicity.once(rows, found)
        got += [set(f.tolist()) for f in np.split(found, np.searchsorted(rows, np.arange(1, n)))]
    assert got == [plain_features(t) for t in texts]


def test_slices_do_not_change_features(monkeypatch):
    texts = ["one long enough text of words", "", "another sentence entirely", "12", "yet another"] * 5
    whole = [x for n, rows, found in toxicity.features(texts) for x in zip(rows.tolist(), found.tolist(), strict=True)]
    monkeypatch.setattr(toxicity, "SLICE", 20)
    at, parts = 0, []
    for n, rows, found in toxicity.features(texts):
        parts += [(r + at, f) for r, f in zip(rows.tolist(), found.tolist(), strict=True)]
        at += n
    assert at == len(texts) and sorted(parts) == sorted(whole)


def test_scores_are_the_models(spark, corpus):
    rows, labels = corpus
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "42 !"), (None, rows[0][1]), (None, None), (5, rows[5][1]), (1004, "kara " * 50_000 + "vilescum")]
    docs, marks = frame(spark, rows + odd), spark.createDataFrame(labels + [(None, 1), (4, None), (99999, 1), (8, 1), (8, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    wanted = []
    for i, t in rows + odd:
        z = model["bias"] + sum(float(model["weights"][f]) for f in plain_features(t))
        wanted.append((-1 if i is None else i, round(1 / (1 + math.exp(-z)), 6)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 6)) for r in got) == sorted(wanted)
    by = {r["doc_id"]: r["score"] for r in got}
    assert all(by[i] == by[1000] < 0.5 for i in (1001, 1002, 1003)) and by[1004] > 0.7
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((by[i] >= 0.7) == bool(y) for i, y in held) >= 0.95 * len(held)
    again = toxicity.learn(docs.repartition(5), marks.repartition(2))
    assert np.allclose(again["weights"], model["weights"]) and math.isclose(again["bias"], model["bias"])


def test_held_out_labels_are_not_learned(spark, corpus):
    rows, labels = corpus
    docs = frame(spark, rows)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (toxicity.learn(docs, spark.createDataFrame(m, "doc_id long, toxic int")) for m in (labels, turned))
    assert np.array_equal(a["weights"], b["weights"]) and a["bias"] == b["bias"]


def test_few_labels_and_empty_tables(spark, corpus):
    rows, labels = corpus
    docs = frame(spark, rows)
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none == {"prior": 0.5} and {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    clean = toxicity.learn(docs, spark.createDataFrame([(i, 0) for i, _ in labels[:9]], "doc_id long, toxic int"))
    assert 0 < clean["prior"] < 0.5
    two = [next((i, y) for i, y in labels if y == want and zlib.crc32(str(i).encode()) % 3 != 1) for want in (0, 1)]
    model = toxicity.learn(docs, spark.createDataFrame(two, "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(frame(spark, []), model).count() == 0
    assert toxicity.learn(frame(spark, []), spark.createDataFrame(labels, "doc_id long, toxic int")) == {"prior": 0.5}


def test_ids_of_any_type(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in rows], "doc_id string, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(f"d{i}", y) for i, y in labels], "doc_id string, toxic int"))
    assert dict(toxicity.score(docs, model).dtypes)["doc_id"] == "string"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_labels_of_the_table(spark):
    got = {r["doc_id"]: r for r in toxicity.op13_toxicity(spark, SF).collect()}
    held = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    toxic = [got[r["doc_id"]]["predicted"] for r in held if r["toxic"]]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(got[r["doc_id"]]["predicted"] for r in held if not r["toxic"]) <= 2
