"""Alignment of two tokenizers' tokens over the same texts, and corpus-wide counts of the token pairs that end together.

A cut is a byte offset where a token of A and a token of B both end. The tokens of a text are aligned by divide and conquer:
from the middle of A's tokens outwards, in steps that double, ends are looked up in B's by bisection; the nearest common one
cuts the interval in two, and both halves are treated alike; an interval without a cut within it is a group. All intervals of
a slice of texts are cut in one numpy pass a round, so a round serves thousands of texts, and a text of n tokens takes about
log n rounds.

Counts are brought back without a row for every link: tokens are encoded once, and each block of about BLOCK_BYTES of text
keeps its distinct pairs; per text only their places in the block's list and their numbers are stored. The pairs of all
blocks are summed up and joined with their own counts, one row a pair and block, and meet the block's texts again by its
number. A pair that every text has is one row a block, at every size of the corpus.

Vocabulary files are read once by the driver and broadcast; their size is that of the vocabularies, whatever the data.

Defined results: null and empty texts, and those whose tokens do not spell out a space and the text, have no tokens, no
groups and zero counts; strings of special tokens within a text are plain text; repeated rows and rows without an id are
texts of their own, all counted; of several pairs with the highest count of their B token all are best; long texts are a
slice or a block alone; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, table

#: Where the vocabularies lie, and the files of A (byte-level BPE) and B (pieces with byte fallback).
FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once, and of a block of texts that shares a list of pairs; a longer text is alone.
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20
#: How byte-level vocabularies split texts before merging (a fixed value of the format).
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible, else the next from U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokens:
    """Tokenizer A from its JSON file's text: ids of space and text, and the bytes of each id."""

    def __init__(self, source: str):
        held, letters = json.loads(source), byte_letters()
        vocabulary, special = held["model"]["vocab"], {x["content"] for x in held["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *(x["id"] for x in held["added_tokens"])]))
        for word, i in vocabulary.items():
            self.bytes[i] = word.encode() if word in special else bytes(letters[c] for c in word)
        self.source, self.plain, self.fast = source, None, None
        words, merges = held.get("pre_tokenizer") or {}, [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        usual = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and not held.get("normalizer")
        order = [vocabulary["".join(m)] for m in merges]
        if usual and order == list(range(256, 256 + len(order))) and not held["model"].get("ignore_merges"):
            import tiktoken  # the same merges in the order of ids: the same tokens, sooner

            ranks = {self.bytes[i]: i for word, i in vocabulary.items() if word not in special}
            self.fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
            except ValueError:  # its regular expressions give up on a million spaces in a row; the other library does not
                pass
        if self.plain is None:  # held only where it is needed
            import tokenizers

            self.plain = tokenizers.Tokenizer.from_str(self.source)
            self.plain.encode_special_tokens = True
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """Tokenizer B from its model file's bytes."""

    def __init__(self, source: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=source)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


def cuts(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ends_a and in ends_b of all common ends, in order.

    ends_a, ends_b: rising offsets of token ends of all texts, one after another. a, b: first token of each text in either,
    and one more entry at the end; every text's last ends are common.
    """
    low_a, high_a, low_b, high_b = a[:-1], a[1:], b[:-1], b[1:]  # high: one behind the last token
    reach = np.zeros(len(low_a), np.int64)  # how far from the middle has been looked
    found_a, found_b = [], []
    while len(low_a):
        middle = (low_a + high_a - 2) // 2  # of the ends before the last one
        far = np.maximum(middle - low_a, high_a - 2 - middle) + 1
        closed = (high_a - low_a < 2) | (high_b - low_b < 2) | (reach >= far)
        found_a.append(high_a[closed] - 1)
        found_b.append(high_b[closed] - 1)
        low_a, high_a, low_b, high_b, reach, middle = (x[~closed] for x in (low_a, high_a, low_b, high_b, reach, middle))
        if not len(low_a):
            break
        upto = np.where(reach == 0, 1, 2 * reach)
        left = np.clip(middle - low_a - reach + 1, 0, upto - reach)
        right = np.where(reach == 0, 0, np.clip(high_a - 2 - middle - reach + 1, 0, upto - reach))
        many = left + right
        own = np.repeat(np.arange(len(low_a)), many)
        k = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        away = reach[own] + np.where(k < left[own], k, k - left[own])
        tried = middle[own] + np.where(k < left[own], -away, away)
        place = np.searchsorted(ends_b, ends_a[tried])
        hit = np.flatnonzero(ends_b[place] == ends_a[tried])  # a text's last end is in both, so place is within
        hit = hit[np.argsort(away[hit], kind="stable")]
        cut, first = np.unique(own[hit], return_index=True)
        at_a, at_b = tried[hit[first]] + 1, place[hit[first]] + 1
        still = np.ones(len(low_a), bool)
        still[cut] = False
        low_a, high_a = np.concatenate([low_a[still], low_a[cut], at_a]), np.concatenate([high_a[still], at_a, high_a[cut]])
        low_b, high_b = np.concatenate([low_b[still], low_b[cut], at_b]), np.concatenate([high_b[still], at_b, high_b[cut]])
        reach = np.concatenate([upto[still], np.zeros(2 * len(cut), np.int64)])
    return np.sort(np.concatenate(found_a or [a[:0]])), np.sort(np.concatenate(found_b or [b[:0]]))


class Aligner:
    """Both tokenizers and their tables, in one task."""

    def __init__(self, a_source: str, b_source: bytes):
        self.a, self.b = ByteTokens(a_source), PieceTokens(b_source)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.names = {}
        for side, t, last in (("a", self.a, "|"), ("b", self.b, ";")):
            self.names[side] = [f"{i}{mark}" for i in range(len(t.bytes)) for mark in (",", last)]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text in A and in B; none where there are none to align."""
        none = np.zeros(0, np.int64)
        ids_a, ids_b = [none] * len(texts), [none] * len(texts)
        known = [i for i, t in enumerate(texts) if t]
        for i, b in zip(known, self.b.encode([texts[i] for i in known]), strict=True):
            a, whole = self.a.encode(" " + texts[i]), b" " + texts[i].encode()
            if all(b"".join(map(t.bytes.__getitem__, ids.tolist())) == whole for t, ids in ((self.a, a), (self.b, b))):
                ids_a[i], ids_b[i] = a, b
        return ids_a, ids_b

    def align(self, texts: list[str | None]) -> dict:
        """Tokens of all texts one after another, the first token of each text, the last token of each group."""
        ids_a, ids_b = self.encode(texts)
        out = {"a": np.concatenate(ids_a), "b": np.concatenate(ids_b), "first_a": np.cumsum([0, *map(len, ids_a)]), "first_b": np.cumsum([0, *map(len, ids_b)])}
        out["ends_a"], out["ends_b"] = np.cumsum(self.size_a[out["a"]]), np.cumsum(self.size_b[out["b"]])
        some = np.flatnonzero(np.diff(out["first_a"]))
        out["last_a"], out["last_b"] = cuts(out["ends_a"], out["ends_b"], *(out[f][np.append(some, len(texts))] for f in ("first_a", "first_b")))
        out["text"] = np.searchsorted(out["first_a"], out["last_a"], "right") - 1  # of each group
        return out

    def spelled(self, found: dict) -> list[str]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        n_a, n_b = len(found["a"]), len(found["b"])
        end_a, end_b = found["last_a"] + 1, found["last_b"] + 1
        group_a, group_b = np.repeat(np.arange(len(end_a)), np.diff(end_a, prepend=0)), np.repeat(np.arange(len(end_b)), np.diff(end_b, prepend=0))
        names = np.empty(n_a + n_b, object)
        for side, at in (("a", np.arange(n_a) + (end_b - np.diff(end_b, prepend=0))[group_a]), ("b", np.arange(n_b) + end_a[group_b])):
            last = np.zeros(len(at), np.int64)
            last[found[f"last_{side}"]] = 1
            table_ = self.names[side]
            names[at] = [table_[k] for k in (2 * found[side] + last).tolist()]
        names, first = names.tolist(), (found["first_a"] + found["first_b"]).tolist()
        return ["".join(names[x:y])[:-1] for x, y in zip(first[:-1], first[1:], strict=True)]


def sources(folder: str, a_file: str, b_file: str) -> tuple[str, bytes]:
    return Path(folder, a_file).read_text(encoding="utf-8"), Path(folder, b_file).read_bytes()


def slices_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Runs of rows of about SLICE_BYTES of text."""
    texts, at, size = batch.column("text").to_pylist(), 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > SLICE_BYTES:
            yield batch.slice(at, i - at), texts[at:i]
            at, size = i, 0
        size += len(t or "")
    if len(texts) > at:
        yield batch.slice(at), texts[at:]


def align(docs: DataFrame, *, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, groups) of every row of docs (doc_id, text). groups: array of (start, end: bytes of space and text; a, b: ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(sources(folder, a_file, b_file))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups array<struct<start: bigint, end: bigint, a: array<int>, b: array<int>>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        for batch in batches:
            for rows, texts in slices_of(batch):
                f = aligner.align(texts)
                groups = [[] for _ in texts]
                from_a = from_b = from_end = 0
                for text, a, b in zip(f["text"].tolist(), (f["last_a"] + 1).tolist(), (f["last_b"] + 1).tolist(), strict=True):
                    own = groups[text]
                    base = from_end - own[-1]["end"] if own else from_end
                    end = int(f["ends_a"][a - 1])
                    own.append({"start": from_end - base, "end": end - base, "a": f["a"][from_a:a].tolist(), "b": f["b"][from_b:b].tolist()})
                    from_a, from_b, from_end = a, b, end
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(groups, kind)], ["doc_id", "groups"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encoded(docs: DataFrame, files: tuple[str, bytes]) -> tuple[DataFrame, DataFrame]:
    """Stored (block, doc_id, n_a, n_b, n_groups, groups_sha256, places, times) of every row, and (block, pairs, totals) of
    every block. A pair is A's id times 2^32 plus B's; places point into the block's pairs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(files)
    type_ = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, block long, doc_id {type_}, n_a long, n_b long, n_groups long, groups_sha256 string, places array<int>, times array<int>, pairs array<long>, totals array<long>"
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def lists(values: np.ndarray, sizes: np.ndarray, item) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, sizes)), pa.int32()), pa.array(values, item))

    def block_of(held: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        """held: (ids, n_a, n_b, n_groups, digests, text of each link, its pair) of each slice."""
        pairs, place = np.unique(np.concatenate([h[6] for h in held]), return_inverse=True)
        at = 0
        for ids, n_a, n_b, n_groups, digests, text, links in held:
            both, times = np.unique(text * max(1, len(pairs)) + place[at : at + len(links)], return_counts=True)
            at += len(links)
            own, n = np.divmod(both, max(1, len(pairs))), len(ids)
            sizes = np.bincount(own[0], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), pa.array([number] * n, pa.int64()), ids, *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digests, pa.string()),
                 lists(own[1].astype(np.int32), sizes, pa.int32()), lists(times.astype(np.int32), sizes, pa.int32()), pa.nulls(n, longs), pa.nulls(n, longs)], names)
        one = [pa.array([1], pa.int32()), pa.array([number], pa.int64()), pa.nulls(1, held[0][0].type), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.string()),
               pa.nulls(1, ints), pa.nulls(1, ints), pa.array([pairs], longs), pa.array([np.bincount(place, minlength=len(pairs))], longs)]
        yield pa.RecordBatch.from_arrays(one, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, held, size = None, TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for rows, texts in slices_of(batch):
                aligner = aligner or Aligner(*shared.value)
                f = aligner.align(texts)
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in aligner.spelled(f)]
                links = (f["a"][f["last_a"]] << 32) | f["b"][f["last_b"]]
                held.append((rows.column("doc_id"), np.diff(f["first_a"]), np.diff(f["first_b"]), np.bincount(f["text"], minlength=len(texts)), digests, f["text"], links))
                size += sum(len(t or "") for t in texts)
                if size >= BLOCK_BYTES:
                    yield from block_of(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield from block_of(held, number)

    names = [c.split(" ")[0] for c in schema.split(", ")]
    path = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    # the number of a block is that of its task, so both kinds of rows come from one pass that is written out
    docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    texts, blocks = (spark.read.schema(schema).parquet(path).where(f"kind = {k}") for k in (0, 1))
    return texts.drop("kind", "pairs", "totals"), blocks.select("block", "pairs", "totals")


def linked(docs: DataFrame, *, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs (doc_id, text).

    A link is a pair of tokens that end together; its count is how many links of all texts hold the pair. n_best: links
    whose count is the highest of their B token.
    """
    texts, blocks = encoded(docs, sources(folder, a_file, b_file))
    own = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("place", "pair")).select("block", "place", "pair.pairs", "pair.totals")
    counts = own.groupBy("pairs").agg(F.sum("totals").alias("count")).withColumn("b", F.col("pairs").bitwiseAND(0xFFFFFFFF))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each of B's ids at most: a proven bound
    counts = counts.join(F.broadcast(most), "b").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    back = own.select("block", "place", "pairs").join(counts.hint("merge"), "pairs").select("block", "place", "count", "best")
    type_ = docs.schema["doc_id"].dataType.simpleString()

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
        left = left.combine_chunks()
        places, times = left.column("places").combine_chunks(), left.column("times").combine_chunks()
        at, times = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(left)), places.value_lengths().to_numpy(zero_copy_only=False))
        n_best, count_sum = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        np.add.at(n_best, row, times * best[at])
        np.add.at(count_sum, row, times * count[at])
        return pa.table([*(left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")), pa.array(n_best), pa.array(count_sum), left.column("groups_sha256")],
                        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = f"doc_id {type_}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(tally, schema)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linked(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
