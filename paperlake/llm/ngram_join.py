"""Jaccard self-join of word 5-gram sets by the chosen-path method, and the classes of near copies that it links.

Documents with the same set of shingles are one node; they are never paired. A node carries T minhash values, its sampled
tokens. In every run a node walks down a tree: at each tree node one or two (1 / threshold on average) of the T places
are drawn, and it goes to the child named by its token there, so that only nodes that share sampled tokens stay together.
Buckets of at most LIMIT nodes are compared by brute force; larger ones split again, and what is still large after DEPTH
levels is compared in tiles. Runs repeat until a pair at the threshold is met with probability `recall`.

Bucket members are compared on their minhash values with a wide margin; what is alike becomes a star of edges (never all
pairs), and the components of those edges are verified exactly on the whole texts' shingle sets, again in tiles. Per
document only the number of links and one edge leave a tile.

Defined results: texts without a word (null, empty) link to nothing; texts of under five words have one shingle, the whole;
rows without a doc_id are left out of the join (no class, no links); repeated rows count as copies of each other. Ids may be of
any type that has an order; of equal documents, and of a class, the least id stands for all. Long texts are shingled whole, in
slices; an empty table gives no rows; columns other than doc_id and text are not read and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import free_name, store, table
from .tokens import groups, hash_words, mix, slices

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
T, DEPTH, LIMIT = 64, 3, 500
#: Sets that more than one row in so many has are told to all tasks; there are fewer of them than this.
HOT_SETS = 10_000
#: Minhash agreement from which a pair is verified: over four deviations under the threshold.
MARGIN = 0.24


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold, split `depth` times, has met with this probability."""
    more = 1 / threshold - 1
    level = (1 - more) * threshold + more * (1 - (1 - threshold) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - level**depth))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one shingle, one of none has none."""
    h, at = hash_words(data, offsets)
    with np.errstate(over="ignore"):
        run = h.copy()
        for k in range(1, min(words, len(h))):
            run[: len(h) - k] = mix(run[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                one = h[a : a + 1]
                for k in range(a + 1, b):
                    one = mix(one * np.uint64(0x9E3779B97F4A7C15) + h[k : k + 1])
            out.append(one ^ np.uint64(b - a))
        else:
            out.append(h[:0])
    return out


def fingerprints(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, size (distinct shingles), set_id (hash of the set) and the T minhash values, one row per row."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        a = rng.integers(1, 1 << 63, T, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        b = rng.integers(1, 1 << 63, T, dtype=np.uint64)[:, None]
        for batch in batches:
            sizes, ids, signs = [], [], []
            for _, _, data, offsets in slices(batch.column("text")):
                for s in shingles(data, offsets, words):
                    sizes.append(len(s))
                    least = np.full(T, np.iinfo(np.uint64).max)
                    with np.errstate(over="ignore"):
                        for part in range(0, len(s), 4096):
                            least = np.minimum(least, ((s[part : part + 4096] ^ b) * a).min(axis=1))
                        ids.append(mix(np.array([s.sum() ^ mix(mix(s) + np.uint64(len(s))).sum()]))[0])
                    signs.append((least >> np.uint64(32)).astype(np.uint32).view(np.int32))
            flat = pa.array(np.concatenate(signs) if signs else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(signs) + 1, dtype=np.int32) * T), flat)],
                ["doc_id", "text_hash", "size", "set_id", "sign"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    type_ = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(prints, f"doc_id {type_}, text_hash long, size int, set_id long, sign array<int>")


def buckets(nodes: DataFrame, *, threshold: float, recall: float, limit: int) -> DataFrame:
    """(bucket, n, set_id): the leaves of all runs with two members or more, each set of members once."""
    rng = np.random.default_rng(11)
    more = 1 / threshold - 1
    first = []
    for run in range(runs_for(recall, threshold)):
        first += [(run, int(i)) for i in rng.choice(T, 2 if rng.random() < more else 1, replace=False)]
    step = [F.xxhash64(F.lit(run), F.lit(i), F.get("sign", F.lit(i))) for run, i in first]
    walks = nodes.select("set_id", F.explode(F.array(*step)).alias("path"))
    leaves = None
    for depth in range(1, DEPTH + 1):
        walks = store(walks, "walks")
        # the number of members, and a hash of who they are
        known = walks.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(20,0)")).alias("who")).where("n > 1")
        known = store(known, "paths")
        small = known if depth == DEPTH else known.where(F.col("n") <= limit)
        once = small.groupBy("n", "who").agg(F.min("path").alias("path"))
        part = walks.join(once, "path").select(F.col("path").alias("bucket"), "n", "set_id")
        leaves = part if leaves is None else leaves.unionByName(part)
        if depth == DEPTH:
            break
        large = known.where(F.col("n") > limit).select("path")
        if large.isEmpty():
            break
        # the next one or two places of a large bucket, drawn by its path
        place = lambda k: F.pmod(F.xxhash64("path", F.lit(k)), F.lit(T)).cast("int")
        two = F.pmod(F.xxhash64("path", F.lit("two")), F.lit(1000)) < int(1000 * more)
        down = lambda k: F.xxhash64(F.col("path"), place(k), F.get("sign", place(k)))
        walks = walks.join(large, "path").join(nodes.select("set_id", "sign"), "set_id").select(
            "set_id", F.explode(F.when(two, F.array(down(0), down(1))).otherwise(F.array(down(0)))).alias("path")).distinct()
    return leaves


def tiles(rows: DataFrame, group: str, n: str, limit: int, node: str = "set_id") -> DataFrame:
    """rows with a key for each pair of tiles of their group, and their own tile: groups of at most limit have one tile."""
    k = F.ceil(F.col(n) / limit)
    own = F.pmod(F.xxhash64(node, F.lit("tile")), k)
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda v: F.struct(F.least(v, own).alias("i"), F.greatest(v, own).alias("j")))
    rows = rows.withColumns({"_own": own, "_pair": F.explode(pairs)})
    return rows.withColumns({"key": F.xxhash64(group, "_pair.i", "_pair.j"), "tile": F.col("_own").cast("int"), "crossed": F.col("_pair.i") != F.col("_pair.j")}).drop("_own", "_pair")


def least_linked(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row of its connected component."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def spanning(linked: np.ndarray, tile: np.ndarray, crossed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect what is linked: a star per component within a tile, and between two tiles one pair for
    each two of their components that touch (the stars within are found where each tile is looked at alone)."""
    if not crossed:
        first = least_linked(linked)
        other = np.flatnonzero(first != np.arange(len(linked)))
        return other, first[other]
    same = tile[:, None] == tile[None, :]
    label = least_linked(linked & same)
    i, j = np.nonzero(np.triu(linked & ~same))
    pairs = np.unique(np.stack([label[i], label[j]]), axis=1)
    return pairs[0], pairs[1]


def alike(members: DataFrame, *, threshold: float) -> DataFrame:
    """Edges (a, b) that span what seems alike within each tile pair. Nodes come in order, so that stars of different runs
    have the same centres and fall together."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "key"):
            key, node, tile, crossed = (rows.column(c).to_numpy() for c in ("key", "set_id", "tile", "crossed"))
            sign = rows.column("sign").combine_chunks().flatten().to_numpy().reshape(-1, T)
            cuts = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
            a, b = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = sign[lo:hi]
                near = np.empty((hi - lo, hi - lo), bool)
                for i in range(0, hi - lo, 64):
                    near[i : i + 64] = (own[i : i + 64, None, :] == own[None, :, :]).mean(axis=2) >= threshold - MARGIN
                i, j = spanning(near, tile[lo:hi], bool(crossed[lo]))
                a.append(node[lo:hi][i]), b.append(node[lo:hi][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    rows = members.select("key", "set_id", "tile", "crossed", "sign").repartition("key").sortWithinPartitions("key", "set_id")
    return rows.mapInArrow(compare, "a long, b long")


def verified(texts: DataFrame, *, threshold: float, words: int) -> DataFrame:
    """set_id and links (documents linked, this tile pair's share), one row per member; and rows with an edge (set_id, other)
    that together span the classes."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "key"):
            key, node = rows.column("key").to_numpy(), rows.column("set_id").to_numpy()
            tile, crossed, copies = (rows.column(c).to_numpy() for c in ("tile", "crossed", "copies"))
            sets = []
            for _, _, data, offsets in slices(rows.column("text").combine_chunks()):
                sets += shingles(data, offsets, words)
            cuts = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
            out = ([], [], [])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                _, once = np.unique(node[lo:hi], return_index=True)  # repeated rows bring a text twice
                at = lo + np.sort(once)
                shared = intersections([sets[k] for k in at])
                sizes = np.array([len(sets[k]) for k in at])
                linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
                np.fill_diagonal(linked, False)
                i, j = spanning(linked, tile[at], bool(crossed[lo]))
                if crossed[lo]:
                    linked &= tile[at][:, None] != tile[at][None, :]
                out[0].extend((node[at], node[at][i])), out[1].extend((linked @ copies[at], np.zeros(len(i)))), out[2].extend((np.full(len(at), -1), at[j]))
            other = np.concatenate(out[2]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in out[:2]] + [pa.array(node[np.maximum(other, 0)], mask=other < 0)], ["set_id", "links", "other"])

    return texts.repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(exact, "set_id long, links long, other long")


def intersections(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all pairwise intersections, from the tokens that two or more sets have."""
    n = len(sets)
    owner, token = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    new = np.diff(token, prepend=~token[:1]) != 0 if len(token) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    many = np.bincount(number)[number] > 1 if len(token) else np.zeros(0, bool)
    owner, number = owner[many], number[many]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    out = np.zeros((n, n))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        a, b = np.searchsorted(number, [lo, lo + columns])
        has = np.zeros((n, columns), np.float32)
        has[owner[a:b], number[a:b] - lo] = 1
        out += has @ has.T
    return out


def join_classes(docs: DataFrame, *, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, class_id (least doc_id of its class), n_links (other documents at or over
    the threshold) and same_as (least doc_id with the same shingles)."""
    prints = store(fingerprints(docs, words=words), "fingerprints")
    held = prints.where("size > 0 and doc_id is not null")
    nodes = store(held.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"), F.first("sign").alias("sign")
    ).select("set_id", "first.doc_id", "first.text_hash", "copies", "sign"), "nodes")
    leaves = buckets(nodes, threshold=threshold, recall=recall, limit=limit)
    near = alike(tiles(leaves.join(nodes.select("set_id", "sign"), "set_id"), "bucket", "n", limit), threshold=threshold)
    groups_ = components(near)
    sizes = groups_.groupBy("component").agg(F.count("*").alias("n"))
    members = store(groups_.join(sizes, "component").join(nodes.drop("sign"), groups_["node"] == nodes["set_id"]).select("set_id", "component", "n", "copies", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "members")
    texts = docs.select("doc_id", "text")
    # sort-merge at every size: members grow with the corpus
    texts = texts.join(members.hint("merge"), (texts["doc_id"] == members["_id"]) & (F.xxhash64(texts["text"]) == members["_hash"]))
    found = store(verified(tiles(texts.select("set_id", "component", "n", "copies", "text"), "component", "n", limit), threshold=threshold, words=words), "links")
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    classes = components(found.where("other is not null").select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    least = classes.join(nodes, classes["node"] == nodes["set_id"]).groupBy("component").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(least, "component").select(F.col("node").alias("set_id"), "class_id")
    known = nodes.select("set_id", F.col("doc_id").alias("same_as"), "copies").join(links, "set_id", "left").join(classes, "set_id", "left")
    known = store(known.select("set_id", "same_as", F.coalesce("class_id", "same_as").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"), "classes")
    rows = prints.select("doc_id", "text_hash", F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    # the rows of a set of many copies stay where they are
    hot = store(known.where(F.col("copies") > prints.count() / HOT_SETS), "hot-sets")
    cold = rows.where("set_id is not null").join(F.broadcast(hot.select("set_id")), "set_id", "left_anti").join(known.hint("merge"), "set_id")
    linked = rows.join(F.broadcast(hot), "set_id").unionByName(cold)
    alone = rows.where("set_id is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("same_as"))
    return linked.select("doc_id", "text_hash", "class_id", "n_links", "same_as").unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, with one document of each class: that of the least doc_id, one row of it."""
    found = join_classes(docs, **options)
    best = found.where("doc_id is not null").groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    best = store(best.select(F.col("best.doc_id").alias("_id"), F.col("best.text_hash").alias("_hash")), "kept")
    hash_ = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    kept = docs.join(best, (docs["doc_id"] == best["_id"]) & (hash_ == F.coalesce(best["_hash"], F.lit(0))), "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # repeated rows: one of them
        name = free_name(docs, "_hash")
        kept = kept.withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name]).drop(name)
    return kept.unionByName(docs.where("doc_id is null"))


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "same_as")
