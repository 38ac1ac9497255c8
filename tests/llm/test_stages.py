"""The pipeline stage by stage, and the mixing's permutations, against plain Python on the smallest tables."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperlake.llm import decontamination, mixing, pii, quality_rules
from paperlake.llm.shared import store

from .test_small_cases import DOCS, shingle_set, words
from .test_surrogates import FIND

SF = "/root/testdata/sf0.001"


def statistics(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for d in range(3)}
    n, chars = len(w), sum(map(len, w))
    over = lambda a, b: a / b if b else 0.0
    return n, len(covered), {
        "mean_word": over(chars, n), "symbols_per_word": over(len(re.findall(r"[#*$%&|<>]", text or "")), n), "dup_line_share": over(len(lines) - len(set(lines)), len(lines)), "repeat_share": over(len(covered), n),
        "upper_share": over(sum(c.isupper() for c in text or ""), chars), "distinct_share": over(len(set(w)), n), "n_words": float(n)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_against_plain_python(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    rules = quality_rules.learn(docs, labels)
    assert rules

    def good(text):
        n, covered, s = statistics(text)
        caught = any(all((s[c.name] > c.threshold) == c.above for c in rule) for rule in rules)
        return n >= 50 and 100 * covered <= 50 * n and not caught

    rows = docs.collect()
    kept = store(stages["quality rules"](spark, docs, SF), "one")
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if good(r["text"]))

    rows = kept.collect()
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    label = {i: i for i in sets}
    links = {i: [j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    for _ in sets:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in sets}
        if new == label:
            break
        label = new
    single = store(stages["n-gram jaccard join"](spark, kept, SF), "two")
    assert {r["doc_id"] for r in single.collect()} == set(label.values()) and single.count() == len(set(label.values()))

    windows = [w[k : k + 10] for r in items.collect() for w in [words(r["text"])] for k in range(max(1, len(w) - 9)) if w]
    held = {tuple(w) for w in windows}
    sizes = {len(w) for w in held}
    clean = store(stages["benchmark decontamination"](spark, single, SF), "three")
    want = [r["doc_id"] for r in single.collect() for w in [words(r["text"])] if not any(tuple(w[k : k + n]) in held for n in sizes for k in range(len(w) - n + 1))]
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(want)

    private = store(stages["pii surrogates"](spark, clean, SF), "four")
    old, map_ = {r["doc_id"]: r["text"] for r in clean.collect()}, {}
    assert private.count() == len(old) and private.columns == docs.columns
    for r in private.collect():
        found = [m[0] for m in FIND.finditer(old[r["doc_id"]])]
        if not found:
            assert r["text"] == old[r["doc_id"]]
        for m in found:
            if not re.match(pii.TITLE.replace(r"\p{L}", "\\w"), m) and len(m) > 6:
                assert m not in r["text"]

    out = stages["temperature mixing"](spark, private, SF).collect()
    n = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in private.collect()}
    share = Counter()
    for s, k in n.values():
        share[s] += k
    names = sorted(share)
    total = sum(share.values())
    target = dict(zip(names, mixing.budgets(mixing.weights([share[s] for s in names], total)[1], total), strict=True))
    taken = Counter()
    for r in out:
        taken[r["source"]] += n[r["doc_id"]][1]
    largest = {s: max(k for x, k in n.values() if x == s) for s in names}
    assert all(target[s] - largest[s] <= taken[s] <= target[s] for s in names)


def test_replay_of_the_permutations(spark):
    """Shelves, blocks and documents in the order of their hashes, taken one by one until the budget is met."""
    rows = [(i, "t " * (1 + i % 13), "x", f"s{i % 3 and 1}", 0, 0, "x") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    size, shelves, seed, budget = 60, 4, mixing.SEED, 1500
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.mix(docs, budget=budget, block_tokens=size, shelves=shelves).collect())
    share = Counter()
    for _, t, _, s, *_ in rows:
        share[s] += len(t.split())
    names = sorted(share)
    target = dict(zip(names, mixing.budgets(mixing.weights([share[s] for s in names], budget)[1], budget), strict=True))
    blocks = {s: -(-share[s] // size) for s in names}
    turn = lambda what: F.pmod(F.xxhash64(what, "epoch", F.lit(seed)), F.lit(1 << 30))
    every = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<bigint>")).alias("epoch"), F.size(F.split(F.trim("text"), " ")).alias("n"))
    every = every.withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed)), F.when(F.col("source") == names[0], blocks[names[0]]).otherwise(blocks[names[1]]).cast("bigint"))).withColumn("shelf", F.col("block") % shelves)
    every = every.select("*", turn("shelf").alias("a"), turn("block").alias("b"), F.xxhash64("h", "epoch", F.lit(seed)).alias("c")).collect()
    want = Counter()
    for s in names:
        left = target[s]
        for epoch in range(10):
            own = [r for r in every if r["source"] == s and r["epoch"] == epoch]
            order = sorted(own, key=lambda r: (r["a"], r["shelf"], r["b"], r["block"], r["c"], r["h"], r["doc_id"]))
            room = min(left, share[s])
            for r in order:
                if r["n"] > room:
                    break
                want[r["doc_id"], epoch] += 1
                room -= r["n"]
            left -= share[s]
            if left <= 0:
                break
    assert got == want
