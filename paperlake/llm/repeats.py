"""Removal of repeated byte strings by prefix-free parsing.

Parsing: the start of the smallest rolling hash among the first REACH starts of a 200-byte string is that string's trigger.
It depends on the string's bytes alone, so equal strings have equal triggers at equal places, and as the trigger moves on
monotonically, all strings with one trigger start in one phrase. A phrase with the strings that start in it (at most
REACH + 199 bytes) is one entry of the parse.

Dictionary: entries with equal bytes are one dictionary phrase with a count. Only phrases whose trigger context (the
CONTEXT bytes from the trigger, which every string of the phrase holds) occurs again stay; in highly repetitive text the
dictionary is much smaller than the text. A phrase that occurs twice repeats as a whole.

Corpus order: a string is what its phrase has before the trigger, followed by the parse from the trigger on. The dictionary's
suffix array orders phrases by their bytes before the trigger, read from it, so that one order serves the suffixes of every
length; the parse's suffix array orders what follows the trigger; both keep the longest common prefix of neighbours. A
string's place in the corpus is the rank of its phrase suffix, then the rank of its parse suffix, and strings that share both
ranks over 200 bytes are equal. This takes place within trigger contexts (equal strings have equal ones), so the first bytes
of the order deal it out over tasks. A context of many phrases is dealt out in parts of PART; each part has its own arrays,
and the distinct strings of the parts, ranked in each, are merged by their bytes' hash over all tasks.

Text leaves its document only where a phrase is unique but its trigger context is not. Equality of phrases, of contexts and
of strings of several parts is judged by 64-bit polynomial hashes, mixed; within a part bytes are compared.

Defined results: null and empty texts have no bytes; texts under 200 bytes keep all; exact copies of a text of 200 bytes or
more lose all of it, each copy; repeated rows are copies; a null id is an id, and ids may be of any type that has an order;
long texts are parsed whole, in slices; of equal phrases the one with the least id, text and place is cut out, which one does not
show in the result; empty tables give no rows; other columns are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import store, table
from .tokens import groups, mix, slices

LENGTH = 200
REACH, GRAM = 100, 12
CONTEXT = LENGTH - REACH
BASE = np.uint64(0x9E3779B97F4A7C55)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Phrases of one part of a trigger context, about; phrases whose suffixes a task sorts at once, about.
PART, AT_ONCE = 1000, 2000


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any substrings of data from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.back = powers(INVERSE, len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start])


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the phrases of all texts: text, first start in the text, trigger less first start, number of starts, trigger
    context's hash and phrase's hash."""
    none = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    if not len(data) or lengths.max() < LENGTH:
        return none, none, none, none, none, none
    roll = Rolling(data)
    n = len(data)
    grams = np.full(-(-(n + REACH) // REACH) * REACH, np.iinfo(np.uint64).max)
    bits = np.uint64(max(1, int(n).bit_length()))
    place = np.arange(max(0, n - GRAM + 1), dtype=np.uint64)
    # the hash above, the place below: the least is the smallest hash, and the last of equal ones
    h = roll.of(place.astype(np.int64), place.astype(np.int64) + GRAM)
    grams[: len(h)] = ((h >> bits) << bits) | ((np.uint64(1) << bits) - np.uint64(1) - place)
    blocks = grams.reshape(-1, REACH)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    # starts of strings that end within their text
    some = lengths >= LENGTH
    firsts, counts = offsets[:-1][some], lengths[some] - LENGTH + 1
    s = np.arange(counts.sum()) + np.repeat(firsts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    least = np.minimum(after[s], before[s + REACH - 1])
    trigger = ((np.uint64(1) << bits) - np.uint64(1) - (least & ((np.uint64(1) << bits) - np.uint64(1)))).astype(np.int64)
    text = np.repeat(np.flatnonzero(some), counts)
    new = np.flatnonzero(np.diff(trigger, prepend=-1) | np.diff(text, prepend=-1))
    lo, hi, p, text = s[new], s[np.append(new[1:], len(s)) - 1], trigger[new], text[new]
    context = roll.of(p, p + CONTEXT)
    with np.errstate(over="ignore"):
        phrase = mix(roll.of(lo, hi + LENGTH) + (p - lo).astype(np.uint64) * np.uint64(1009) + (hi - lo).astype(np.uint64))
    return text, lo - offsets[text], p - lo, hi - lo + 1, context.view(np.int64), phrase.view(np.int64)


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def phrases(docs: DataFrame) -> DataFrame:
    """The parse: one row for each phrase of each row of docs (doc_id, text_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in slices(b.column("text")):
                text, lo, off, span, context, phrase = parse(data, offsets)
                own = b.slice(first, last - first)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(context), pa.array(phrase), own.column("doc_id").take(at), own.column("text_id").take(at), pa.array(lo.astype(np.int32)), pa.array(off.astype(np.int16)), pa.array(span.astype(np.int16))],
                    ["context", "phrase", "doc_id", "text_id", "lo", "off", "span"])

    return docs.mapInArrow(rows, f"context long, phrase long, doc_id {id_type(docs)}, text_id long, lo int, off short, span short")


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of one occurrence of each wanted phrase, with its context, phrase, off, span and the context's parts."""
    by = wanted.groupBy(F.col("at.doc_id").alias("_doc"), F.col("at.text_id").alias("_text")).agg(
        F.collect_list("context").alias("context"), F.collect_list("phrase").alias("phrase"), F.collect_list("at.lo").alias("lo"),
        F.collect_list("at.off").alias("off"), F.collect_list("at.span").alias("span"), F.collect_list("parts").alias("parts"))
    held = docs.join(by.hint("merge"), docs["doc_id"].eqNullSafe(by["_doc"]) & (docs["text_id"] == by["_text"])).drop("_doc", "_text", "doc_id", "text_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                data = b.column("text")[i].as_py().encode()
                c = {k: b.column(k)[i].values for k in ("context", "phrase", "lo", "off", "span", "parts")}
                bytes_ = [data[lo : lo + span + LENGTH - 1] for lo, span in zip(c["lo"].to_pylist(), c["span"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c["context"], c["phrase"], c["off"], c["span"], c["parts"], pa.array(bytes_, pa.binary())], ["context", "phrase", "off", "span", "parts", "bytes"])

    return held.mapInArrow(cut, "context long, phrase long, off short, span short, parts long, bytes binary")


def suffix_classes(group: np.ndarray, suffixes: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """From the suffix array of rows of bytes: for each row and depth a number that rows of one group share exactly if their
    first `depth` bytes are equal."""
    head = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    keys = np.ascontiguousarray(np.concatenate([head, suffixes], axis=1))
    order = np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")
    differ = keys[order[1:]] != keys[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1]) - 4  # with the neighbour before
    new = np.concatenate([np.ones((1, len(depths)), bool), common[:, None] < depths[None, :]])
    out = np.empty(new.shape, np.int64)
    out[order] = np.cumsum(new, axis=0)
    return out


def corpus_order(group: np.ndarray, off: np.ndarray, span: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all strings that start in these phrases: the row, the start in it, and the place of the string in corpus order,
    which equal strings of one group share. at: where the phrases' bytes begin in data."""
    reach, own = np.arange(REACH - 1), off.astype(np.int64)
    trigger = at[:-1] + own
    before = np.where(reach < own[:, None], data[np.maximum(trigger[:, None] - 1 - reach, 0)], 0).astype(np.uint8)
    length = at[1:] - trigger
    reach = np.arange(LENGTH)
    after = np.where(reach < length[:, None], data[np.minimum(trigger[:, None] + reach, len(data) - 1)], 0).astype(np.uint8)
    far = np.arange(REACH)  # from a string's start to its trigger
    phrase_rank = suffix_classes(group, before, far)
    parse_rank = suffix_classes(group, after, LENGTH - far)
    row = np.repeat(np.arange(len(span)), span)
    j = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
    d = own[row] - j
    n = len(span) + 1
    return row, j, (d * n + phrase_rank[row, d]) * n + parse_rank[row, d]


def runs_of(mask: np.ndarray, row: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last start of each run of marked starts."""
    row, j = row[mask], j[mask]
    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(j, prepend=-5) != 1))
    return row[new], j[new], j[np.append(new[1:], len(j)) - 1] if len(j) else j


def repeated_strings(cuts: DataFrame) -> DataFrame:
    """(context, phrase, j0, j1): the starts in a phrase whose strings start in another phrase too."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_ in groups(batches, "part"):
            key = table_.column("part").to_numpy()
            edges = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
            lo = 0
            while lo < len(edges) - 1:  # whole parts, some at a time
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + AT_ONCE, "right")) - 1)
                rows = table_.slice(edges[lo], edges[hi] - edges[lo])
                group = np.repeat(np.arange(hi - lo), np.diff(edges[lo : hi + 1]))
                lo = hi
                bytes_ = rows.column("bytes").combine_chunks()
                at = np.frombuffer(bytes_.buffers()[1], np.int32)[bytes_.offset : bytes_.offset + len(bytes_) + 1].astype(np.int64)
                data, at = np.frombuffer(bytes_.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
                off, span, parts = (rows.column(c).to_numpy().astype(np.int64) for c in ("off", "span", "parts"))
                row, j, place = corpus_order(group, off, span, data, at)
                order = np.argsort(place, kind="stable")
                same = np.concatenate([[False], place[order][1:] == place[order][:-1], [False]])
                mask = np.zeros(len(place), bool)
                mask[order] = same[1:] | same[:-1]
                some = parts[row] > 1  # strings of one part only are settled here; the others meet those of the other parts
                once = np.zeros(len(place), bool)
                once[order[~same[:-1]]] = True  # the first of each run of equal strings stands for it
                r, j0, j1 = runs_of(mask & ~some, row, j)
                k = np.flatnonzero(some)
                with np.errstate(over="ignore"):
                    h = mix(Rolling(data).of(at[row[k]] + j[k], at[row[k]] + j[k] + LENGTH) + rows.column("context").to_numpy().view(np.uint64)[row[k]] * np.uint64(31)) if len(k) else np.zeros(0, np.uint64)
                take = pa.array(np.concatenate([r, row[k]]))
                none = np.zeros(len(r), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("context").take(take).combine_chunks(), rows.column("phrase").take(take).combine_chunks(), pa.array(np.concatenate([j0, j[k]]).astype(np.int32)), pa.array(np.concatenate([j1, j[k]]).astype(np.int32)),
                     pa.array(np.concatenate([none, h.view(np.int64)]), mask=np.concatenate([none == 0, np.zeros(len(k), bool)])), pa.array(np.concatenate([none > 0, once[k]])), pa.array(np.concatenate([none == 0, mask[k]]))],
                    ["context", "phrase", "j0", "j1", "string", "once", "twice"])

    dealt = cuts.withColumn("part", F.xxhash64("context", F.pmod("phrase", "parts"))).repartition("part").sortWithinPartitions("part", "phrase")
    every = store(dealt.mapInArrow(resolve, "context long, phrase long, j0 int, j1 int, string long, once boolean, twice boolean"), "strings")
    settled = every.where("twice").select("context", "phrase", "j0", "j1")
    # one row for each distinct string of a part: strings that two parts have
    shared = store(every.where("once and string is not null").groupBy("string").count().where("count > 1").select("string"), "shared-strings")
    open_ = every.where("not twice").join(shared.hint("merge"), "string").select("context", "phrase", "j0", "j1")
    return settled.unionByName(open_)


def repeated_spans(docs: DataFrame, *, part: int = PART) -> DataFrame:
    """(text_id, spans): for each text that holds repeated strings the byte ranges (start, end) that they cover; they overlap."""
    parsed = store(phrases(docs), "parse")
    again = store(parsed.groupBy("context").agg(F.count("*").alias("c")).where("c > 1").select("context"), "contexts")
    parsed = store(parsed.join(again.hint("shuffle_hash"), "context"), "repeated-contexts")
    dictionary = parsed.groupBy("context", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_id", "lo", "off", "span")).alias("at"))
    dictionary = store(dictionary, "dictionary")
    whole = dictionary.where("n > 1").select("context", "phrase", F.lit(0).alias("j0"), (F.col("at.span") - 1).cast("int").alias("j1"))
    sizes = dictionary.groupBy("context").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    sizes = store(sizes.select("context", F.ceil(F.col("m") / part).alias("parts")), "sizes")
    found = store(whole.unionByName(repeated_strings(cut_out(docs, dictionary.join(sizes, "context")))), "found")
    hits = parsed.select("context", "phrase", "text_id", "lo").distinct().join(found, ["context", "phrase"])
    return hits.groupBy("text_id").agg(F.collect_list(F.struct((F.col("lo") + F.col("j0")).alias("start"), (F.col("lo") + F.col("j1") + LENGTH).alias("end"))).alias("spans"))


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that remain)."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("text_id"), "text")
    spans = store(repeated_spans(texts, **options), "spans")
    joined = texts.join(spans.withColumnRenamed("text_id", "_id").hint("merge"), F.col("text_id") == F.col("_id"), "left").select("doc_id", "text", "spans.start", "spans.end")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i in range(len(b)):
                data = b.column("text")[i].as_py().encode()
                start, end = b.column("start")[i], b.column("end")[i]
                parts, at, spans, removed = [], 0, 0, 0
                if start.is_valid:
                    s, e = start.values.to_numpy(), end.values.to_numpy()
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                    for a, z in zip(s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist(), strict=True):
                        parts.append(data[at:a])
                        at, spans, removed = z, spans + 1, removed + z - a
                kept = b"".join([*parts, data[at:]])
                for k, v in enumerate((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                    out[k].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, t) for v, t in zip(out, types, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, f"doc_id {id_type(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP10_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
p as (select doc_id, unnest(generate_series(0, len(hx) // 2 - 200)) as i from d where len(hx) >= 400),
w as (select p.doc_id, p.i, md5_number(substr(d.hx, 2 * p.i + 1, 400)) as h from p join d using (doc_id)),
hit as (select w.doc_id, w.i from w join (select h from w group by h having count(*) > 1) as m using (h)),
g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as new from hit),
r as (select doc_id, i, sum(new) over (partition by doc_id order by i rows unbounded preceding) as run from g),
spans as (select doc_id, min(i) as a, max(i) + 200 as z from r group by doc_id, run),
parts as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as b from spans),
k as (select d.doc_id, any_value(d.hx) as hx, count(parts.a) as n_spans, coalesce(sum(parts.z - parts.a), 0) as n_removed, coalesce(max(parts.z), 0) as last_z,
             coalesce(string_agg(substr(d.hx, 2 * parts.b + 1, 2 * (parts.a - parts.b)), '' order by parts.a), '') as head from d left join parts using (doc_id) group by d.doc_id)
select doc_id, cast(len(hx) // 2 as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, cast(n_spans as bigint) as n_spans, sha256(unhex(head || substr(hx, 2 * last_z + 1))) as kept_sha256 from k
"""
