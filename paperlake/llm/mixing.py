"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

weights() raises the sources' token shares to an exponent and normalises them. The exponent is bisected: the largest (nearest
to the natural shares) whose weights reach the target entropy, raised where a source would be repeated more often than
allowed. mix() deals each source's documents into blocks of about BLOCK_TOKENS tokens and the blocks into SHELVES shelves. Every
epoch permutes the shelves anew by a keyed hash, and the blocks of a shelf, and takes blocks until the source's token budget is
met: whole epochs first, then the first shelves of one more permutation, of the shelf at the border its first blocks, and of the
block at the border its first documents in permuted order.

Only one row per source reaches the driver (MAX_SOURCES at most, else an error). Running sums are over a source's shelves, over
the blocks of the one shelf at the border, and over the documents of the one block there, so that none grows with a source
faster than its tokens over BLOCK_TOKENS x SHELVES.

Defined results: a null source is a source; sources without tokens get weight 0 and no rows; null texts have no tokens;
repeated rows are documents of their own; rows without an id are documents; a budget is never exceeded and missed by less than
one document of the source; equal documents fall into one block, in the order of their ids; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import store, table

BLOCK_TOKENS, SHELVES, MAX_SOURCES = 20_000, 1024, 100_000
ENTROPY_SHARE, MAX_REPEATS, SEED = 0.97, 4.0, 17
SPACES = r"[\x20\x09-\x0D]+"


def at_exponent(tokens: list[int], a: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** a if t else 0.0 for t in tokens]
    return [r / sum(raised) for r in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect(good_low: bool, test, steps: int = 60) -> float:
    """The border in [0, 1] of a condition that holds on one side: its last good point."""
    lo, hi = 0.0, 1.0
    if test(hi if good_low else lo):
        return hi if good_low else lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        if test(mid) == good_low:
            lo = mid
        else:
            hi = mid
    return lo if good_low else hi


def weights(tokens: list[int], budget: int, *, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS) -> tuple[float, list[float]]:
    """(exponent, weights). target_entropy in nats; None: ENTROPY_SHARE of the most that the sources allow."""
    if not sum(tokens):
        return 1.0, [0.0] * len(tokens)
    some = sum(t > 0 for t in tokens)
    target = ENTROPY_SHARE * math.log(some) if target_entropy is None else target_entropy
    flat = bisect(True, lambda a: entropy(at_exponent(tokens, a)) >= target - 1e-12)
    repeats = lambda a: max(w * budget / t for w, t in zip(at_exponent(tokens, a), tokens, strict=True) if t)
    least = bisect(False, lambda a: repeats(a) <= max_repeats + 1e-12)
    a = max(flat if entropy(at_exponent(tokens, 0.0)) >= target else 0.0, least)
    return a, at_exponent(tokens, a)


def budgets(w: list[float], budget: int) -> list[int]:
    """Whole tokens by largest remainder; ties by place."""
    exact = [x * budget for x in w]
    out = [int(x) for x in exact]
    order = sorted(range(len(w)), key=lambda i: (out[i] - exact[i], i))
    for i in order[: max(0, round(sum(exact)) - sum(out))]:
        out[i] += 1
    return out


def mix(docs: DataFrame, *, budget: int | None = None, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS,
        block_tokens: int = BLOCK_TOKENS, shelves: int = SHELVES, seed: int = SEED) -> DataFrame:
    """One row per document and epoch in which it is taken: doc_id, source, n_tokens, weight, epoch, block and position
    (0 to 1: sorting all rows by it interleaves the sources). budget: tokens in all, the corpus's own by default."""
    spark = docs.sparkSession
    n_tokens = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES), ""))
    rows = store(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_tokens.cast("long").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("h")), "tokens")
    own = rows.groupBy("source").agg(F.sum("n_tokens").alias("t")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(own) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    tokens = [r["t"] for r in own]
    total = sum(tokens) if budget is None else budget
    _, w = weights(tokens, total, target_entropy=target_entropy, max_repeats=max_repeats)
    plan = [(r["source"], t, float(x), b, max(1, -(-t // block_tokens))) for r, t, x, b in zip(own, tokens, w, budgets(w, total), strict=True) if t and b]
    plan_ = F.broadcast(spark.createDataFrame(plan, "p_source string, t long, weight double, b long, blocks long"))  # MAX_SOURCES rows at most
    dealt = rows.join(plan_, F.col("source").eqNullSafe(F.col("p_source")))
    dealt = dealt.select("doc_id", "source", "n_tokens", "h", "weight", "t", "b", F.pmod(F.xxhash64("h", F.lit(seed)), F.col("blocks")).alias("block")).withColumn("shelf", F.col("block") % shelves)
    turn = lambda what: F.pmod(F.xxhash64(what, "epoch", F.lit(seed)), F.lit(1 << 30))  # noqa: E731  a place in the epoch's permutation
    upto = lambda keys, what: F.sum("n").over(Window.partitionBy(*keys).orderBy(turn(what), what).rowsBetween(Window.unboundedPreceding, 0))

    # shelves: those before the border are taken whole, and at most one for each source holds it
    held = dealt.groupBy("source", "shelf").agg(F.sum("n_tokens").alias("n"), F.first("t").alias("t"), F.first("b").alias("b"))
    held = held.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("b") / F.col("t")))).alias("epoch"))
    held = held.select("*", F.least(F.col("t"), F.col("b") - F.col("epoch") * F.col("t")).alias("left"), (upto(["source", "epoch"], "shelf") - F.col("n")).alias("before"))
    held = store(held.where("left > 0 and before < left").select(F.col("source").alias("of"), F.col("shelf").alias("at"), "epoch", "before", "n", "left", (F.col("before") + F.col("n") > F.col("left")).alias("border")), "shelves")
    on_shelf = F.col("source").eqNullSafe(F.col("of")) & (F.col("shelf") == F.col("at"))
    cols = ["doc_id", "source", "n_tokens", "h", "weight", "t", "b", "block", "epoch", "before", F.col("n").alias("share")]
    whole = dealt.join(held.where("not border"), on_shelf).select(*cols)

    # blocks of the shelves at the border
    bordering = dealt.join(held.where("border").drop("n"), on_shelf)
    blocks = bordering.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left"), F.first("before").alias("first"))
    blocks = blocks.select("*", (F.col("first") + upto(["source", "epoch"], "block") - F.col("n")).alias("before")).where("before < left")
    blocks = store(blocks.select(F.col("source").alias("of"), F.col("block").alias("at"), "epoch", "before", F.least("n", F.col("left") - F.col("before")).alias("n"), (F.col("before") + F.col("n") > F.col("left")).alias("border")), "blocks")
    parts = dealt.join(blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    within = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64("h", "epoch", F.lit(seed)), "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = parts.where("border").withColumn("upto", F.sum("n_tokens").over(within)).where("upto <= n").select(*cols)
    parts = parts.where("not border").select(*cols).unionByName(last)

    # documents of a block stand together; on a whole shelf its blocks stand in the epoch's order
    jitter = F.pmod(F.xxhash64("h", "epoch", F.lit(seed + 1)), F.lit(1 << 20)) / (1 << 20)
    on_whole = (turn("block") + jitter) / (1 << 30)
    place = lambda within: F.least(F.lit(1.0), (F.col("epoch") * F.col("t") + F.col("before") + within * F.col("share")) / F.col("b"))
    out = whole.withColumn("position", place(on_whole)).unionByName(parts.withColumn("position", place(jitter)))
    return out.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "position")


def op2_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
