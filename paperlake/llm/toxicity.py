"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is read as words (runs of letters, in lower case) with a space before and after each; its n-grams are those of SIZES
that lie within one word and its two spaces, so beginnings and ends of words are features of their own. A feature counts
once a text, however often it stands there, and is a bucket of 2^BITS hashes.

The ratio of a feature is log((p + s) / (P + 2 s)) - log((q + s) / (Q + 2 s)), where p and q of the P toxic and Q other
sample texts have it. Features with a ratio above LEAST_RATIO in LEAST_TEXTS texts or more get a weight by logistic
regression on ratio-scaled features; a text's margin is the sum over the features that it has. Margins of texts that a fit
has not seen (FOLDS parts in turn) calibrate the score, which is a logistic function of the margin.

What is fitted is a sample of at most MAX_TEXTS labelled texts a class. The driver receives their features, at most 2^BITS
numbers a text, never texts. Scoring covers whole texts, on the executors, with a table of 2^BITS weights.

Defined results: null texts, empty ones and texts without a letter have no feature and get the score of the bias alone;
repeated rows are scored one by one; an id with several labels trains once, with the least one, and of repeated rows of one
id the least text trains; rows with a null id are scored, are not held out and never train; labels that are null or belong
to no document are left out; without labels of both kinds every text gets the smoothed share of toxic ones; the order of rows
and ties have no influence; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, table
from .tokens import mix

#: Labelled texts of each class that are fitted, at most.
MAX_TEXTS = 4000
SIZES = (5, 7, 9)
BITS = 20
LEAST_RATIO, LEAST_TEXTS, SMOOTHING = 0.5, 3, 0.5
#: Ridge of the weights, weight of a toxic text against another one, and parts of the sample for the calibration.
RIDGE, TOXIC_WEIGHT, FOLDS = 1.0, 5.0, 4
#: Characters of text that are hashed at once; a longer text is taken alone.
SLICE = 1 << 20
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str | None) -> str:
    """Words in lower case with single spaces between, before and after them; a single space if there is none."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else " "


def slices_of(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in map(letters, texts):
        if held and size + len(t) > SLICE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def features(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the texts: their number, and (text within the slice, feature) of every n-gram, repeats included."""
    for own in slices_of(texts):
        x = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).astype(np.uint64)
        spaces = np.concatenate([[0], np.cumsum(x == 32)])
        text = np.repeat(np.arange(len(own)), [len(t) for t in own])
        rows, found, h = [], [], np.zeros(len(x), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, max(SIZES) + 1):
                h = (h[:-1] if n > 1 else h) * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(1)
                if not len(h):
                    break
                if n in SIZES:
                    inner = spaces[n - 1 : n - 1 + len(h)] - spaces[1 : 1 + len(h)]
                    at = np.flatnonzero(inner == 0)
                    rows.append(text[at + 1])
                    found.append((mix(h[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        yield len(own), np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])


def once(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once."""
    both = np.unique((rows << BITS) | found)
    return both >> BITS, both & ((1 << BITS) - 1)


def minimise(f, w: np.ndarray, *, steps: int = 60, kept: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking; f gives value and gradient."""
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    value, slope = f(w)
    for _ in range(steps):
        step, used = slope.copy(), []
        for s, y in reversed(moves):
            used.append((s @ step) / (y @ s))
            step -= used[-1] * y
        step *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(moves, reversed(used), strict=True):
            step += s * (a - (y @ step) / (y @ s))
        size = 1.0
        while True:
            new_value, new_slope = f(w - size * step)
            if new_value <= value - 1e-4 * size * (slope @ step) or size < 1e-6:
                break
            size /= 2
        move, change = -size * step, new_slope - slope
        if move @ change > 1e-12:
            moves = [*moves, (move, change)][-kept:]
        done = abs(value - new_value) < 1e-5 * max(1.0, abs(value))
        w, value, slope = w + move, new_value, new_slope
        if done:
            break
    return w


def fit(having: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each feature, ratio included; bias) from the features of each text and its label."""
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for own, bad in zip(having, toxic, strict=True):
        (p if bad else q)[own] += 1
    ratio = np.log((p + SMOOTHING) / (toxic.sum() + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / ((~toxic).sum() + 2 * SMOOTHING))
    ratio[(p + q < LEAST_TEXTS) | (ratio <= LEAST_RATIO)] = 0
    own = [f[ratio[f] != 0] for f in having]
    row = np.repeat(np.arange(len(own)), [len(f) for f in own])
    used, place = np.unique(np.concatenate(own), return_inverse=True)
    scaled, y, cost = ratio[used][place], toxic.astype(float), np.where(toxic, TOXIC_WEIGHT, 1.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, scaled * w[:-1][place], len(own)) + w[-1]
        away = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
        value = float(np.sum((np.logaddexp(0, z) - y * z) * cost) + RIDGE / 2 * np.sum(w[:-1] ** 2))
        return value, np.append(np.bincount(place, scaled * away[row], len(used)) + RIDGE * w[:-1], away.sum())

    w = minimise(loss, np.zeros(len(used) + 1))
    weights = np.zeros(1 << BITS)
    weights[used] = w[:-1] * ratio[used]
    return weights, float(w[-1])


def calibrate(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(slope, bias) of the logistic function from margins to the share of toxic texts; the slope is no less than 0.05."""
    x, y, w = np.stack([margins, np.ones(len(margins))], 1), toxic.astype(float), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * (w - [1.0, 0.0]))
    return max(float(w[0]), 0.05), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, *, limit: int = MAX_TEXTS) -> dict:
    """Weights and calibration, from ids whose crc32 modulo 3 is not 1."""
    keys = labels.select("doc_id", (F.col("toxic") > 0).alias("toxic")).dropna().groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    keys = keys.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for n, rows, found in features(b.column("text").to_pylist()):
                rows, found = once(rows, found)
                own = [f.astype(np.int32).tobytes() for f in np.split(found, np.searchsorted(rows, np.arange(1, n)))]
                yield pa.RecordBatch.from_arrays([b.column("order").slice(at, n), b.column("toxic").slice(at, n), pa.array(own, pa.binary())], ["order", "toxic", "features"])
                at += n

    sample = bounded_sample(docs, keys, "toxic", limit).select(F.xxhash64("doc_id").alias("order"), "toxic", "text")
    rows = sorted(sample.mapInArrow(read, "order long, toxic boolean, features binary").collect(), key=lambda r: (r["order"], bytes(r["features"])))
    toxic = np.array([r["toxic"] for r in rows], bool)
    having = [np.frombuffer(r["features"], np.int32) for r in rows]
    if toxic.all() or not toxic.any():  # also when there is no row
        return {"prior": (float(toxic.sum()) + 1) / (len(rows) + 2)}
    part, margins = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    seen = [k for k in range(FOLDS) if 0 < toxic[part != k].sum() < (part != k).sum()]
    for k in seen:
        others = np.flatnonzero(part != k)
        weights, bias = fit([having[i] for i in others], toxic[others])
        for i in np.flatnonzero(part == k):
            margins[i] = weights[having[i]].sum() + bias
    held = np.isin(part, seen)
    slope, shift = calibrate(margins[held], toxic[held]) if held.any() else (1.0, 0.0)
    weights, bias = fit(having, toxic)
    return {"weights": (slope * weights).astype(np.float32), "bias": slope * bias + shift}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row."""
    type_ = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers whatever the data

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            if "prior" in model:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model["prior"]] * len(b), pa.float64())], ["doc_id", "score"])
                continue
            at = 0
            for n, rows, found in features(b.column("text").to_pylist()):
                known = model["weights"][found] != 0
                rows, found = once(rows[known], found[known])
                z = np.bincount(rows, model["weights"][found], n) + model["bias"]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, n), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"])
                at += n

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(judge, f"doc_id {type_}, score double")


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(docs, learn(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))
