"""Classification by compression with zstandard dictionaries: quality (good or bad) and language.

A dictionary is raw training text; text compresses better behind a dictionary that resembles it. A class has as many
dictionaries as its sample fills, whole texts all of them, and the smallest size behind one of them counts. Dictionaries are
built on the driver from a bounded number of labelled texts (MAX_* below), as are the calibrations; scoring runs over Arrow
batches on the executors, over whole texts, one text at a time.

A text is compressed in pieces, each behind every dictionary, so that a long text does not become its own dictionary; the
sizes of all pieces are summed up. Quality: the score is a logistic function of one number, the difference of the sizes
behind bad and good text over the text's length. Language: the smallest size wins.

Defined results: null and empty texts score as a text of no bytes (difference 0), and have language `und`; without labels of
both kinds every text scores the share of good ones; without labelled languages every text is `und`; rows with a null id are
scored, are not held out and never train; repeated rows are scored one by one, and an id with several labels trains once,
with its least label; of repeated rows of one id one text trains; empty tables give no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, table

#: Labelled texts that reach the driver, at most: of each kind of quality, and of all languages together.
MAX_TEXTS, MAX_LANGUAGE_TEXTS = 600, 800
#: Bytes of one dictionary; what is over them begins the next one.
DICTIONARY_BYTES = 400 * 1024
LEVEL = 3
#: Bytes that are compressed at once for quality and for language.
PIECE, LANGUAGE_PIECE = 96, 2048


def sample_of(docs: DataFrame, keys: DataFrame, label: str, limit: int) -> list[tuple]:
    """(label, text) of at most limit documents for each label (see bounded_sample), whole texts."""
    rows = bounded_sample(docs, keys.groupBy("doc_id").agg(F.min(label).alias(label)), label, limit).collect()
    return [(r[label], r["text"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def dictionaries_of(texts: list[bytes]) -> list[bytes]:
    """Raw content of all texts, in dictionaries of DICTIONARY_BYTES at most; a text that does not fit goes on in the next one."""
    out = [b""]
    for text in texts:
        at = 0
        while at < len(text):
            room = DICTIONARY_BYTES - len(out[-1])
            if room <= 0 or (len(text) - at > room and len(text) <= DICTIONARY_BYTES and at == 0):
                out.append(b"")
                continue
            out[-1] += text[at : at + room]
            at += room
        out[-1] += b"\n"
    return [x for x in out if x.strip()] or [b"\n" * 8]


def unshared(documents: dict) -> dict:
    """Documents as lists of lines, by class, without the lines that more than one class has."""
    seen: dict[bytes, set] = {}
    for label, own in documents.items():
        for lines in own:
            for line in lines:
                seen.setdefault(line, set()).add(label)
    return {label: [kept for lines in own if (kept := [x for x in lines if len(seen[x]) == 1])] for label, own in documents.items()}


class Sizer:
    """Compressed sizes of a text behind the dictionaries of each class."""

    def __init__(self, dictionaries: list[list[bytes]], level: int = LEVEL):
        self.by = [[self._behind(raw, level) for raw in own] for own in dictionaries]

    @staticmethod
    def _behind(raw: bytes, level: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False, write_dict_id=False, dict_data=held)

    def sizes(self, data: bytes, piece: int) -> np.ndarray:
        """For each class the sizes of all pieces of data, each behind the best of its dictionaries, summed up."""
        pieces = [data[at : at + piece] for at in range(0, len(data), piece)]
        return np.array([sum(min(len(c.compress(p)) for c in own) for p in pieces) for own in self.by], float)


def quality_features(sizer: Sizer, text: str) -> list[float]:
    """1, and the difference bad - good of the compressed sizes of all pieces over the length of the whole text."""
    data = text.encode()
    good, bad = sizer.sizes(data, PIECE)
    return [1.0, 20 * (bad - good) / (len(data) + 16)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Newton's steps for logistic regression over the bounded sample."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    return w


def learn_quality(docs: DataFrame, labels: DataFrame) -> dict:
    """Dictionaries of good and bad text from one half of the sample, the calibration from the other half."""
    keys = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    keys = keys.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = sample_of(docs, keys, "quality", MAX_TEXTS)
    texts = {q: [t for label, t in rows if (label > 0) == q] for q in (True, False)}
    if not texts[True] or not texts[False]:
        return {"dictionaries": None, "prior": (len(texts[True]) + 1) / (len(rows) + 2)}
    dictionaries = [dictionaries_of([b"\n".join(d) for d in own]) for own in unshared({q: [t.encode().split(b"\n") for t in texts[q][::2]] for q in (True, False)}).values()]
    sizer = Sizer(dictionaries)
    held = [(q, t) for q in (True, False) for t in texts[q][1::2] or texts[q]]
    x = np.array([quality_features(sizer, t) for _, t in held])
    w = fit_logistic(x, np.array([float(q) for q, _ in held]))
    return {"dictionaries": dictionaries, "weights": w.tolist()}


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row; null texts score as empty ones."""
    type_ = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model["dictionaries"]) if model["dictionaries"] else None
        w = np.array(model.get("weights", ()))
        for b in batches:
            if sizer is None:
                out = [model["prior"]] * len(b)
            else:
                out = [float(1 / (1 + np.exp(-np.clip(np.dot(quality_features(sizer, t or ""), w), -30, 30)))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {type_}, score double")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


#: ASCII other than letters becomes a space before languages are told apart.
NOT_LETTER = bytes.maketrans(bytes(i for i in range(128) if not chr(i).isalpha()), b" " * sum(not chr(i).isalpha() for i in range(128)))


def letters_of(text: str) -> bytes:
    """The whole text as lower-case words with single spaces; ASCII marks and digits are left out."""
    return b" ".join(text.lower().encode().translate(NOT_LETTER).split())


def language_dictionaries(rows: list[tuple], langs: list[str]) -> list[list[bytes]]:
    """The dictionaries of each language, without lines that languages share or that the other half gives to another one.

    Documents quote passages of other languages; such a line would claim every text that quotes it too.
    """
    own = unshared({g: [[letters_of(x) for x in t.split("\n")] for label, t in rows if label == g] for g in langs})
    first = [Sizer([dictionaries_of([b"\n".join(d) for d in own[g][half::2]]) for g in langs]) for half in (0, 1)]
    lines: dict[str, list[bytes]] = {g: [] for g in langs}
    for k, g in enumerate(langs):
        for i, document in enumerate(own[g]):
            lines[g] += [x for x in document if x and (len(x) < 20 or int(np.argmin(first[1 - i % 2].sizes(x, LANGUAGE_PIECE))) == k)]
    return [dictionaries_of(list(dict.fromkeys(lines[g]))) for g in langs]


def learn_languages(docs: DataFrame, *, limit: int = MAX_LANGUAGE_TEXTS) -> dict:
    """Raw-content dictionaries of each learned language, from limit texts of all languages together (one each at least)."""
    known = docs.where(F.col("lang").isNotNull() & (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1))
    keys = known.select("doc_id", "lang")
    rows = sample_of(docs, keys, "lang", max(1, limit // max(1, keys.select("lang").distinct().count())))
    langs = sorted({label for label, _ in rows})
    return {"langs": langs, "dictionaries": language_dictionaries(rows, langs)}


def identify(docs: DataFrame, model: dict, *, margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row.

    The smallest compressed size wins, ties by the language's name. score: the winner's share of a softmax over sizes.
    rejected: the runner-up is within margin of the winner. `und` for null texts and texts without a letter.
    """
    type_ = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer, langs = Sizer(model["dictionaries"]), model["langs"]
        for b in batches:
            pred, score, reject = [], [], []
            for t in b.column("text").to_pylist():
                if not t or not langs or not any(map(str.isalpha, t)):
                    pred.append("und"), score.append(0.0), reject.append(True)
                    continue
                sizes = sizer.sizes(letters_of(t), LANGUAGE_PIECE)
                order = np.argsort(sizes, kind="stable")
                p = np.exp(-(sizes - sizes[order[0]]) / (2 + 0.02 * sizes[order[0]]))
                pred.append(langs[order[0]])
                score.append(float(1 / p.sum()))
                reject.append(len(langs) > 1 and sizes[order[1]] - sizes[order[0]] <= margin * sizes[order[0]])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([bool(x) for x in reject], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(predict, f"doc_id {type_}, lang_pred string, score double, rejected boolean")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_languages(docs)).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
