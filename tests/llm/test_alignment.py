"""The alignment of two tokenizers against a plain merge of their ends and plain counts."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from paperlake.llm import alignment

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n_a long, block long, places string, count int"
ODD = [None, "", " ", "\n\n", "a", "Plain words.", "tok<|endoftext|>en <s> </s> <unk>", "▁ under", "nul\x00é😀 <0x41>", "汉字" * 50, "  many   spaces  \t x", "don't we'll", "ñandú Łódź straße", "x" * 5000, "same text", "same text", "same text",
       "long " * 60_000]
pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.FOLDER), reason="no vocabularies")


def plain(rows):
    """Contract rows of (doc_id, text), text by text, with the slower library and sets of ends."""
    import sentencepiece
    import tokenizers

    a_model = tokenizers.Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")
    letters = alignment.byte_letters()
    a_bytes = {i: bytes(letters.get(c, 63) for c in w) for w, i in a_model.get_vocab().items()}

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    found, links = [], Counter()
    for i, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        if not text or b"".join(map(a_bytes.get, a)) != (" " + text).encode() or b"".join(map(b_bytes, b)) != (" " + text).encode():
            found.append((i, 0, 0, "", []))
            continue
        ends = [dict(zip(np.cumsum([len(size(k)) for k in ids]).tolist(), range(1, len(ids) + 1), strict=True)) for size, ids in ((a_bytes.get, a), (b_bytes, b))]
        at = [(0, 0)] + [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
        groups = [(a[p:x], b[q:y]) for (p, q), (x, y) in zip(at[:-1], at[1:], strict=True)]
        own = [(x[-1], y[-1]) for x, y in groups]
        links.update(own)
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((i, len(a), len(b), hashlib.sha256(spelled.encode()).hexdigest(), own))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return [(i, n_a, n_b, len(own), len(own), sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), sha) for i, n_a, n_b, sha, own in found]


def rows_of(seed):
    rng = random.Random(seed)
    words = ["token", "alignment", " ", "the", "Über", "größe", "naïve", "x1y2", "...", "\n", "e-mail@x.org", "ing", "un", "able", "　", "’s", "99.5%"]
    rows = list(enumerate(ODD)) + [(None, "no id"), (None, None), (3, "an id again")]
    return rows + [(100 + k, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 200)))) for k in range(60)]


def contract(df):
    return sorted(((*r,) for r in df.collect()), key=str)


def test_cuts_are_the_common_ends():
    rng = np.random.default_rng(4)
    for _ in range(300):
        sizes = [rng.integers(1, 40, rng.integers(1, 6)) for _ in range(rng.integers(1, 9))]
        ends_a, ends_b, first_a, first_b, base = [], [], [0], [0], 0
        for s in sizes:
            total = int(s.sum())
            for ends, first in ((ends_a, first_a), (ends_b, first_b)):
                own = np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, 2 * len(s) + 8)), total))
                ends.append(own + base)
                first.append(first[-1] + len(own))
            base += total
        a, b = np.concatenate(ends_a), np.concatenate(ends_b)
        _, at_a, at_b = np.intersect1d(a, b, return_indices=True)
        got = alignment.cuts(a, b, np.array(first_a), np.array(first_b))
        assert np.array_equal(got[0], at_a) and np.array_equal(got[1], at_b)
    none = np.zeros(0, np.int64)
    assert [len(x) for x in alignment.cuts(none, none, np.zeros(1, np.int64), np.zeros(1, np.int64))] == [0, 0]


def test_an_interval_without_cuts_takes_few_rounds(monkeypatch):
    a, b = np.arange(2, 200_000, 2), np.append(np.arange(1, 199_997, 2), 199_998)
    calls, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *args: calls.append(1) or search(*args))
    got = alignment.cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert got[0].tolist() == [len(a) - 1] and got[1].tolist() == [len(b) - 1] and len(calls) < 25


@pytest.mark.parametrize(("slice_", "block"), [(1 << 20, 16 << 20), (300, 1000), (1, 1)])
def test_against_plain_python(spark, monkeypatch, slice_, block):
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rows = rows_of(slice_)
    docs = spark.createDataFrame([(i, t, "en", 1, 2, "x", 3) for i, t in rows], DOCS).repartition(3)
    assert contract(alignment.linked(docs)) == sorted(plain(rows), key=str)


def test_groups_spell_the_text(spark):
    rows = [(i, t) for i, t in rows_of(9) if i is not None and i != 3]
    got = {r["doc_id"]: r["groups"] for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    counts = {r[0]: r for r in plain(rows)}
    for i, text in rows:
        groups = got[i]
        assert len(groups) == counts[i][3] and sum(len(g["a"]) for g in groups) == counts[i][1] and sum(len(g["b"]) for g in groups) == counts[i][2]
        edges = [0, *(g["end"] for g in groups)]
        assert [g["start"] for g in groups] == edges[:-1] and (not groups or edges[-1] == len((" " + text).encode()))


def test_very_long_runs_of_spaces():
    tokens_ = alignment.ByteTokens(alignment.sources(alignment.FOLDER, alignment.A_FILE, alignment.B_FILE)[0])
    ids = tokens_.encode(" \n" * 700_000 + "x")
    assert b"".join(tokens_.bytes[i] for i in ids.tolist()) == b" \n" * 700_000 + b"x"


def test_empty_tables_and_other_ids(spark):
    assert alignment.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = alignment.linked(spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["n_groups"] for r in got}["b"] == 0 and len(got) == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert contract(alignment.op12_tokenizer_alignment(spark, SF)) == sorted(plain(rows), key=str)
