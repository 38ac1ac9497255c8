"""Quality rules as a learned decision list (native DataFrame operators only).

Sequential covering: rules for bad documents are grown one condition at a time by information gain over the labelled
documents, pruned on a part held back, and emitted as one ordered CASE expression over per-document statistics. The only
things that reach the driver are counts per (statistic, threshold bin, label), whose number does not depend on the data.

Defined results: a null or empty text has no words (all statistics 0) and so fails the base rule; without labels, or with
labels of one class, there are no learned rules; repeated rows are judged one by one; label rows with nulls are ignored; of
contradicting labels of one document the worse counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, store

SPACES = r"[\x20\x09-\x0D]+"
#: Labelled documents that the list is learned from, at most (the bound of its sample).
MAX_LABELLED = 20_000
#: Statistics that conditions can test.
STATISTICS = ("mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "n_words")


def with_statistics(docs: DataFrame, text: str = "text", into: str = "statistics") -> DataFrame:
    """docs with one struct column of counts over the whole text. One projection, no shuffle.

    Word triples are compared by 64-bit hashes within their document. All repeated triples' words are counted, the first
    occurrence included: positions of repeated triples are sorted, and each covers three words less the overlap.
    """
    keep = list(docs.columns)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = {n: free_name(docs, f"_{into}_{n}") for n in ("t", "w", "l", "h", "s", "p")}
    c = {n: F.col(v) for n, v in names.items()}
    step = docs.withColumns({names["t"]: t})
    step = step.withColumns({
        names["w"]: F.array_remove(F.split(c["t"], SPACES), ""),
        names["l"]: F.filter(F.split(c["t"], "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    n = F.size(c["w"])
    triple = lambda w, i: F.xxhash64(w, F.get(c["w"], i + 1), F.get(c["w"], i + 2))
    step = step.withColumn(names["h"], F.when(n >= 3, F.slice(F.transform(c["w"], triple), F.lit(1), n - 2)))
    pairs = F.sort_array(F.transform(c["h"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn(names["s"], F.when(F.size(F.array_distinct(c["h"])) < F.size(c["h"]), pairs))
    twin = lambda e, i: F.coalesce(F.get(c["s"], i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(c["s"], i + 1)["h"] == e["h"], F.lit(False))
    step = step.withColumn(names["p"], F.sort_array(F.transform(F.filter(c["s"], twin), lambda e: e["i"])))
    covered = F.aggregate(
        F.transform(c["p"], lambda x, i: F.least(F.lit(3), F.coalesce(F.get(c["p"], i + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x,
    )
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(c["w"], "")),
        "n_symbols": F.regexp_count(c["t"], F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(c["l"]) - F.size(F.array_distinct(c["l"])),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size(c["l"]),
        "n_upper": F.regexp_count(c["t"], F.lit(r"\p{Lu}")),
        "n_distinct": F.size(F.array_distinct(c["w"])),
    }
    return step.select(*keep, F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]).alias(into))


def statistic(name: str, counts: str) -> Column:
    """A named statistic as a number; 0 where its base is empty."""
    s = F.col(counts)
    over = lambda a, b: F.coalesce(s[a] / F.nullif(s[b], F.lit(0)), F.lit(0.0))
    return {
        "mean_word": over("word_chars", "n_words"),
        "symbols_per_word": over("n_symbols", "n_words"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "upper_share": over("n_upper", "word_chars"),
        "distinct_share": over("n_distinct", "n_words"),
        "n_words": s["n_words"].cast("double"),
    }[name]


@dataclass(frozen=True)
class Condition:
    """statistic > threshold, or <= threshold; bin is the threshold's place among those of its statistic."""

    name: str
    above: bool
    threshold: float
    bin: int

    def on_bins(self) -> Column:
        at = F.get(F.col("bins"), F.lit(STATISTICS.index(self.name)))
        return at > self.bin if self.above else at <= self.bin

    def on_counts(self, counts: str) -> Column:
        value = statistic(self.name, counts)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


def all_of(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def base_failed(counts: str) -> Column:
    s = F.col(counts)
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def learn(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_rules: int = 8, max_conditions: int = 3,
          bins: int = 32, min_precision: float = 0.9, min_support: int = 5) -> list[list[Condition]]:
    """Rules for bad documents (label quality = 0), in the order in which they were found.

    Two thirds of the labelled documents, by a hash of their id, grow the rules and one third prunes them. A grown
    condition maximises FOIL's gain; pruning keeps the prefix with the best (p - n) / (p + n). A rule is kept if at least
    min_precision of the documents that it catches are bad and it catches min_support of them.
    """
    chosen = (
        labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # at most max_labelled ids: a proven bound for the broadcast
    seen = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    seen = with_statistics(seen).select("doc_id", "quality", *[statistic(n, "statistics").alias(n) for n in STATISTICS])
    seen = store(seen, "labelled-statistics")
    shares = [i / (bins + 1) for i in range(1, bins + 1)]
    cuts = seen.agg(*[F.percentile_approx(n, F.lit(shares).cast("array<double>"), 10_000).alias(n) for n in STATISTICS]).first()
    cuts = {n: sorted(set(cuts[n] or [])) for n in STATISTICS}
    place = lambda n: sum((F.when(F.col(n) > v, 1).otherwise(0) for v in cuts[n]), F.lit(0)) - 1
    rows = store(seen.select(
        (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("prune")), F.lit(3)) == 0).alias("prune"),
        F.array(*[place(n) for n in STATISTICS]).alias("bins")), "labelled-bins")
    rules: list[list[Condition]] = []
    left = F.lit(True)
    for _ in range(max_rules):
        rule = grow(rows.where(left & ~F.col("prune")), cuts, max_conditions)
        if not rule:
            break
        rule, bad, good = prune(rows.where(left), rule)
        if bad < min_support or bad < min_precision * (bad + good):
            break
        rules.append(rule)
        left = left & ~all_of([c.on_bins() for c in rule])
    return rules


def grow(rows: DataFrame, cuts: dict[str, list[float]], max_conditions: int) -> list[Condition]:
    """Add the condition of the highest FOIL gain until only bad documents are left or nothing gains."""
    rule: list[Condition] = []
    while len(rule) < max_conditions:
        held = rows.where(all_of([c.on_bins() for c in rule]))
        counts = held.select("bad", F.posexplode("bins").alias("k", "b")).groupBy("k", "b").agg(
            F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        per = [{r["b"]: (r["bad"], r["good"]) for r in counts if r["k"] == k} for k in range(len(STATISTICS))]
        bad, good = (sum(v[i] for v in per[0].values()) for i in (0, 1))
        if not bad or not good:
            break
        best = (1e-9, None)
        for k, name in enumerate(STATISTICS):
            below = [0, 0]
            for b in range(-1, len(cuts[name]) - 1):
                p, q = per[k].get(b, (0, 0))
                below = [below[0] + p, below[1] + q]
                threshold, at = cuts[name][b + 1], b
                for above, (p1, n1) in ((True, (bad - below[0], good - below[1])), (False, tuple(below))):
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(bad / (bad + good))) if p1 else 0
                    if gain > best[0]:
                        best = (gain, Condition(name, above, threshold, at))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def prune(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
    """The prefix of rule that is best on the rows held back, and what it catches among all rows."""
    cols = []
    for k in range(1, len(rule) + 1):
        hit = all_of([c.on_bins() for c in rule[:k]])
        for name, more in (("prune", F.col("prune")), ("all", F.lit(True))):
            cols += [F.count_if(hit & more & F.col("bad")).alias(f"bad_{name}_{k}"), F.count_if(hit & more & ~F.col("bad")).alias(f"good_{name}_{k}")]
    got = rows.agg(*cols).first()
    worth = lambda k: (got[f"bad_prune_{k}"] - got[f"good_prune_{k}"]) / max(1, got[f"bad_prune_{k}"] + got[f"good_prune_{k}"])
    k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
    return rule[:k], got[f"bad_all_{k}"], got[f"good_all_{k}"]


def decision(rules: list[list[Condition]], counts: str = "statistics") -> Column:
    """The number of the first rule that catches the document, from 1; 0 if none does."""
    if not rules:
        return F.lit(0)
    out = None
    for k, rule in enumerate(rules, 1):
        hit = all_of([c.on_counts(counts) for c in rule])
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Statistics, base verdict, first learned rule and kept, one row per row of docs."""
    base = with_statistics(docs.select("doc_id", "text"))
    failed = base_failed("statistics")
    rule = decision(rules)
    return base.select("doc_id", "statistics.n_words", "statistics.word_chars", "statistics.n_symbols", "statistics.n_dup_lines",
                       "statistics.n_repeat_words", failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that neither the base rule nor a learned rule rejects."""
    rules = learn(docs, labels, **options)
    counts = free_name(docs, "_statistics")
    tag = free_name(docs, "_tag")
    # the tag keeps Spark from moving the filter below the statistics, where every word would split its text anew
    scored = with_statistics(docs, into=counts).withColumn(tag, F.monotonically_increasing_id())
    return scored.where((F.col(tag) >= 0) & ~base_failed(counts) & (decision(rules, counts) == 0)).select(*docs.columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs, learn(docs, labels))
