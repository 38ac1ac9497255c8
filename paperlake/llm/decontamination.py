"""Benchmark decontamination by a positional inverted index of the training documents.

build_index() stores postings: for each block of documents (about a MB of text) its terms with their ascending word positions,
one row a block, so that searching needs no shuffle. A search sends some phrases to every block: it starts from the positions
of the phrase's rarest term, by its count over all documents, and intersects the other terms' positions, shifted by their place
in the phrase, from rare to common. With slop 0 that finds exact phrases, with slop k phrases of which every word stands within
k words of its place.

The phrases are a stated query set. Items are cut to pieces of PIECE_WORDS words that overlap by a window, and pieces are taken
in blocks of about QUERY_WORDS words, so that what is broadcast is bounded whatever the benchmark and its longest item. Terms
are 64-bit hashes of words.

Defined results: null and empty texts have no words; an item of fewer words than a window is one window, one of none is
none; items without an id are left out; ids of documents and items may have any type (items are told apart and returned as
strings); rows without a doc_id are looked at like others; repeated documents are looked at one by one; repeated items count
once by id; empty tables give no rows, or no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD_SPLIT, ascii_lower, store, table
from .tokens import hash_texts, hash_words, slices

WINDOW = 10
QUERY_WORDS = 200_000
#: Words of an item that are taken as one piece.
PIECE_WORDS = 10_000
#: Bytes of text in a block of the index, about; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Empty positions between documents of a block, so that no match crosses documents.
GAP = 32
CANDIDATES = 1 << 19



def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text): a row for each block with its terms, how often each occurs, all their positions
    in the order of the terms, and its documents with their first position and number of words."""
    type_ = docs.schema["doc_id"].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for first, last, data, offsets in slices(b.column("text"), BLOCK_BYTES):
                h, at = hash_words(data, offsets)
                gaps = np.arange(len(at) - 1) * GAP
                place = np.arange(len(h)) + np.repeat(gaps, np.diff(at))
                terms, code, counts = np.unique(h, return_inverse=True, return_counts=True)
                place = place[np.argsort(code, kind="stable")].astype(np.int32)
                rows = b.slice(first, last - first)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), one(terms.view(np.int64)), one(counts.astype(np.int32)), one(place), one((at[:-1] + gaps).astype(np.int32)), one(np.diff(at).astype(np.int32)), one(rows.column("doc_id")), one(rows.column("text_hash"))],
                    ["block", "terms", "counts", "positions", "starts", "n_words", "doc_ids", "text_hashes"])
                block += 1

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"block long, terms array<long>, counts array<int>, positions array<int>, starts array<int>, n_words array<int>, doc_ids array<{type_}>, text_hashes array<long>"
    return store(texts.mapInArrow(post, schema), "postings")


def query_blocks(items: DataFrame, most: int = QUERY_WORDS, *, size: int = WINDOW, piece: int = PIECE_WORDS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Pieces of items as (item_id, word hashes), some at a time: each block holds about `most` words, and comes to the driver alone."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), WORD_SPLIT), "")
    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words.alias("w")).where("size(w) > 0").distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)), F.lit(piece))
    rows = store(rows.select("item_id", F.explode(F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("w", s + 1, F.lit(piece + size - 1)).alias("w")))).alias("p")).select("item_id", "p.at", "p.w"), "item-pieces")
    total = rows.agg(F.sum(F.size("w"))).first()[0] or 0
    n = -(-total // most) if total else 0
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "at", "w"), F.lit(n)) == k).orderBy("item_id", "at", "w").collect()
        yield list(zip([r["item_id"] for r in got], hash_texts([" ".join(r["w"]) for r in got]), strict=True))


def windows(items: list[tuple[str, np.ndarray]], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, length and padded word hashes of every window of the items."""
    ids, sizes, rows = [], [], []
    for item, h in items:
        n = min(size, len(h))
        for i in range(len(h) - n + 1 if n else 0):
            ids.append(str(item)), sizes.append(n)
            rows.append(np.pad(h[i : i + n], (0, size - n)))
    return np.array(ids, object), np.array(sizes, np.int64), np.array(rows, np.uint64).reshape(-1, size)


def search(index: DataFrame, items: list[tuple[str, np.ndarray]], *, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """For every indexed document: its words hit (positions in the document) and the items whose windows occur in it."""
    if slop >= GAP // 2:
        raise ValueError(f"slop must be under {GAP // 2}")
    spark = index.sparkSession
    ids, sizes, rows = windows(items, size)
    used = np.arange(size) < sizes[:, None]
    terms = np.unique(rows[used])
    # counts over all documents, of the terms of one query block only
    count = np.zeros(len(terms), np.int64)
    if len(terms):
        wanted = spark.sparkContext.broadcast(terms)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(wanted.value), np.int64)
            for b in batches:
                own = b.column("terms").flatten().to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(wanted.value, own), len(n) - 1)
                known = wanted.value[at] == own
                np.add.at(n, at[known], b.column("counts").flatten().to_numpy()[known])
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(wanted.value[some].view(np.int64)), pa.array(n[some])], ["term", "n"])

        for r in index.select("terms", "counts").mapInArrow(tally, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            count[np.searchsorted(terms, np.uint64(r["term"] % (1 << 64)))] = r["n"]
    code = np.where(used, np.searchsorted(terms, rows), -1) if len(terms) else np.zeros((0, size), np.int64)
    rarity = np.where(used, count[code], np.iinfo(np.int64).max) if len(terms) else np.zeros((0, size), np.int64)
    order = np.argsort(rarity, axis=1, kind="stable")
    anchor = code[np.arange(len(code)), order[:, 0]] if len(code) else np.zeros(0, np.int64)
    by_anchor = np.argsort(anchor, kind="stable")
    query = spark.sparkContext.broadcast((terms, ids[by_anchor], sizes[by_anchor], code[by_anchor], order[by_anchor], anchor[by_anchor]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield from block({c: b.column(c)[i] for c in b.schema.names}, *query.value)

    def block(rows: dict, terms, ids, sizes, code, order, anchor) -> Iterator[pa.RecordBatch]:
        number = rows["block"].as_py()
        starts, n_words, values, term, n_each = (rows[c].values.to_numpy() for c in ("starts", "n_words", "positions", "terms", "counts"))
        starts, n_words, term, at = starts.astype(np.int64), n_words.astype(np.int64), term.view(np.uint64), np.concatenate([[0], np.cumsum(n_each, dtype=np.int64)])
        own = np.searchsorted(terms, term)
        own[(own >= len(terms)) | (terms[np.minimum(own, len(terms) - 1)] != term) if len(terms) else slice(None)] = -1
        end = int(starts[-1] + n_words[-1]) if len(starts) else 0
        here = np.full(end + 2 * GAP + size, -1, np.int64)  # the term at each position, shifted by GAP
        here[values[at[0] : at[-1]] + GAP] = np.repeat(own, np.diff(at))
        hits, found = [], []
        for t, lo, hi in zip(own[own >= 0], at[:-1][own >= 0], at[1:][own >= 0], strict=True):
            first, last = np.searchsorted(anchor, [t, t + 1])
            step = max(1, CANDIDATES // max(1, last - first))
            for p in range(lo, hi if last > first else lo, step):
                positions = values[p : min(p + step, hi)]
                w = np.repeat(np.arange(first, last), len(positions))
                s = np.tile(positions, last - first).astype(np.int64) - order[w, 0]
                for k in range(1, size):  # from the rarest term to the most common one
                    place = order[w, k]
                    ok = place >= sizes[w]
                    for shift in range(-slop, slop + 1):
                        ok |= here[np.clip(s + place + shift + GAP, 0, len(here) - 1)] == code[w, place]
                    w, s = w[ok], s[ok]
                hits.append(s), found.append(w)
        s, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hits, found))
        doc = np.searchsorted(starts, s + order[w, 0], "right") - 1 if len(w) else np.zeros(0, np.int64)
        words, items = [[] for _ in starts], [[] for _ in starts]
        for d in np.unique(doc):
            of = doc == d
            marks = np.zeros(n_words[d] + 1, np.int64)
            np.add.at(marks, np.clip(s[of] - starts[d], 0, n_words[d]), 1)
            np.add.at(marks, np.clip(s[of] - starts[d] + sizes[w[of]], 0, n_words[d]), -1)
            words[d] = np.flatnonzero(np.cumsum(marks[:-1])).tolist()
            items[d] = sorted(set(ids[w[of]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number] * len(starts), pa.int64()), pa.array(np.arange(len(starts))), rows["doc_ids"].values, rows["text_hashes"].values, pa.array(n_words), pa.array(words, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
            ["block", "place", "doc_id", "text_hash", "n_words", "hit_words", "items"])

    type_ = index.schema["doc_ids"].dataType.elementType.simpleString()
    return index.mapInArrow(look, f"block long, place long, doc_id {type_}, text_hash long, n_words long, hit_words array<int>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, *, size: int = WINDOW, slop: int = 0, query_words: int = QUERY_WORDS) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, items (sorted ids as strings), contaminated."""
    index, found = build_index(docs), None
    for block in query_blocks(items, query_words, size=size):
        part = search(index, block, size=size, slop=slop)
        # documents without a hit are told once, by the first block
        part = part if found is None else part.where("size(items) > 0")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = search(index, [], size=size)
    else:
        found = store(found, "phrase-matches")
    found = found.groupBy("block", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.select("doc_id", "text_hash", "n_words", F.size("hit_words").cast("long").alias("n_hit"), "items", (F.size("hit_words") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of an item."""
    bad = contamination(docs, items, **options).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = store(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, w, least(len(w), 10) as n from (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark) where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from b)),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from bw))),
hits as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(words.n_hit, 0) as bigint) as n_hit, cast(coalesce(items.n_items, 0) as bigint) as n_items,
       sha256(coalesce(items.ids, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
