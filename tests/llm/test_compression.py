"""Scores and languages recomputed on the driver, one text at a time, from the same dictionaries."""

import math
import random

import zstandard

from paperlake.llm import compression

DOCS = "doc_id long, text string, lang string, source string, score double, held_out string"


def make(rng, lexicon, n):
    return " ".join(rng.choice(lexicon) for _ in range(n))


def corpus(spark):
    rng = random.Random(8)
    lexicon = {g: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 9))) for _ in range(150)] for g, a in (("xx", "abcdeilmnort"), ("yy", "abdefghkoszä"))}
    rows = [(i, make(rng, lexicon[("xx", "yy")[i % 2]], 40 + i % 30) + (" | #" * (i % 5) if i % 2 else ""), ("xx", "yy")[i % 2], "s", 1.0, "x") for i in range(160)]
    rows += [(500, None, "xx", "s", 1.0, "x"), (501, "", None, "s", 1.0, "x"), (None, rows[0][1], "xx", "s", 1.0, "x"), (502, make(rng, lexicon["yy"], 30_000), None, "s", 1.0, "x"), (3, rows[3][1], "yy", "s", 1.0, "x")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


def size(dictionaries, data):
    """Behind the best of a class's dictionaries."""
    return min(behind(raw, data) for raw in dictionaries)


def behind(raw, data):
    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=compression.LEVEL)
    return len(zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data))


def test_quality_is_a_function_of_the_dictionary_difference(spark):
    rows, docs = corpus(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)] + [(None, 1, 0), (7, None, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = compression.learn_quality(docs, labels)
    good, bad = model["dictionaries"]
    got = {(r["doc_id"]): r["score"] for r in compression.score_quality(docs, model).collect()}
    for i, t, *_ in rows:
        data = (t or "").encode()
        if len(data) > 20_000:
            continue
        pieces = [data[k : k + compression.PIECE] for k in range(0, len(data), compression.PIECE)]
        difference = (sum(size(bad, p) for p in pieces) - sum(size(good, p) for p in pieces)) / (len(data) + 16)
        w = model["weights"]
        assert len(w) == 2 and abs(got[i] - 1 / (1 + math.exp(-(w[0] + 20 * w[1] * difference)))) < 1e-9
    assert sum((got[i] >= 0.5) == i % 2 for i in range(160)) >= 155


def test_language_is_the_smallest_size(spark):
    rows, docs = corpus(spark)
    model = compression.learn_languages(docs)
    got = {r["doc_id"]: r for r in compression.identify(docs, model).collect()}
    for i, t, *_ in rows:
        if not t:
            assert got[i]["lang_pred"] == "und"
            continue
        data = compression.letters_of(t)
        sizes = [sum(size(d, data[k : k + compression.LANGUAGE_PIECE]) for k in range(0, len(data), compression.LANGUAGE_PIECE)) for d in model["dictionaries"]]
        assert got[i]["lang_pred"] == model["langs"][sizes.index(min(sizes))]
    assert compression.letters_of("Ha ha, HA! 1 Ä") == "ha ha ha ä".encode()


def test_long_texts_train_too(spark):
    """A class of long texts only is learned, from whole texts, in as many dictionaries as they fill."""
    rng = random.Random(2)
    words = {k: ["".join(rng.choice(a) for _ in range(6)) for _ in range(150)] for k, a in enumerate(("abcdefgh", "klmnopqr"))}
    rows = [(i, make(rng, words[i % 2], 12_000 if i % 2 else 400), "lo" if i % 2 else "sh", "s", 1.0, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert compression.learn_quality(docs, labels)["dictionaries"] is not None
    got = {r["doc_id"]: r["lang_pred"] for r in compression.identify(docs, compression.learn_languages(docs)).collect()}
    assert sum(got[i] == ("lo" if i % 2 else "sh") for i in range(40)) >= 38
    texts = [random.Random(k).randbytes(n).replace(b"\n", b" ") for k, n in enumerate((10, 300_000, 200_000, 0, 1_000_000, 5))]
    cut = compression.dictionaries_of(texts)
    assert max(map(len, cut)) <= compression.DICTIONARY_BYTES + 1 and b"".join(cut).replace(b"\n", b"") == b"".join(texts)
    assert texts[1] in cut[0] and texts[2] in cut[1] and compression.dictionaries_of([b""]) == [b"\n" * 8]


def test_rows_without_id_and_empty_tables(spark):
    _, docs = corpus(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = {r["doc_id"]: r["score"] for r in compression.score_quality(docs, compression.learn_quality(docs, labels)).collect()}
    assert set(none.values()) == {0.5} and None in none
    empty = docs.limit(0)
    assert compression.score_quality(empty, compression.learn_quality(empty, labels)).count() == 0
    assert compression.identify(empty, compression.learn_languages(empty)).count() == 0
