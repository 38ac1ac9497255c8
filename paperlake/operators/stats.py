"""Accuracy, coverage and confidence statistics over lifecycle rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import CONFIDENCE_BANDS, band, percent_text
from .scan import ends, first_rows

APPROVED = "approved_at is not null"


def totals(life: DataFrame, *, as_of=None, days: int | None = None) -> DataFrame:
    """All, approved as proposed and overridden documents, with accuracy and the mean number of attempts."""
    if days is not None:
        life = life.where(F.col("first_seen_at") >= as_of - F.expr(f"interval {days} days"))
    over = F.col("override_type").isin("retype", "rename", "redirect")
    n = F.count("*")
    return life.agg(
        n.alias("total"), F.count_if(F.col("override_type") == "none").alias("as_proposed"), F.count_if(over).alias("overridden"),
        F.coalesce(F.round(1 - F.count_if(over) / F.nullif(n, F.lit(0)), 2), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.round(F.avg(F.when(F.expr(APPROVED), F.col("approval_attempts"))), 2), F.lit(0.0)).alias("mean_attempts"))


def approval_state():
    return (
        F.when(F.col("override_type") == "deny", "denied").when(F.col("override_type") == "expired", "expired").when(F.expr(APPROVED) & (F.col("override_type") != "none"), "overridden")
        .when(F.expr(APPROVED), "auto_approved").otherwise("pending"))


def breakdown(life: DataFrame, column) -> DataFrame:
    return life.groupBy(column.alias("value")).agg(F.count("*").alias("n"))


def worst_types(life: DataFrame, most: int = 10) -> DataFrame:
    """Types by accuracy, the worst first; ties by name."""
    over = F.sum(F.when(F.col("override_type").isin("retype", "rename", "redirect"), 1).otherwise(0))
    out = life.groupBy("proposed_doc_type").agg(F.count("*").alias("total"), over.alias("overridden"), F.round(1 - over / F.count("*"), 2).alias("accuracy"))
    return out.orderBy("accuracy", F.desc("total"), "proposed_doc_type").limit(most)


def confusion(life: DataFrame, most: int = 20) -> DataFrame:
    out = life.where(F.col("override_type").isin("retype", "rename")).groupBy("proposed_doc_type", "final_doc_type").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "proposed_doc_type", "final_doc_type").limit(most)


def mean_confidence(rows: DataFrame, key: str, value: str, most: int | None = None) -> DataFrame:
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean_confidence"))
    return out.orderBy("mean_confidence", key).limit(most) if most else out


def confidence_bands(life: DataFrame) -> DataFrame:
    return life.groupBy(band(F.col("classification_confidence"), CONFIDENCE_BANDS, "low").alias("band")).agg(F.count("*").alias("n"))


def correction_rate(life: DataFrame) -> DataFrame:
    c, t = F.count_if(F.col("override_type").isin("retype", "rename", "redirect")), F.count("*")
    share = F.coalesce(c / F.nullif(t, F.lit(0)), F.lit(0.0))
    return life.agg(F.concat(c.cast("string"), F.lit("/"), t.cast("string"), F.lit(" ("), percent_text(share), F.lit(")")).alias("rate"))


def dead_rules(life: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (id) that no document matched; the organisation is the second part of rule_match_id."""
    used = life.select(F.element_at(F.split("rule_match_id", ":"), 2).alias("id")).distinct()
    return rules.join(used, "id", "left_anti")


def suggestions(feedback: DataFrame, least: int = 2) -> DataFrame:
    """Repeated redirections: (type, rule, from, to) seen at least `least` times."""
    return feedback.groupBy("type", "rule_match_id", "from_dest", "to_dest").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def metric_summary(metrics: DataFrame, as_of, *, prefix: str = "ocr_", days: int = 1) -> DataFrame:
    held = metrics.where(F.col("metric_name").startswith(prefix) & (F.col("ts") >= as_of - F.expr(f"interval {days} days")))
    return held.groupBy("metric_name").agg(F.count("*").alias("n"), F.round(F.avg("metric_value"), 1).alias("mean"), F.min("metric_value").alias("least"), F.max("metric_value").alias("most"))


def sidecar_coverage(files: DataFrame) -> DataFrame:
    """files (has_ocr, has_meta): how many have both, one or neither, and the share of both in percent."""
    a, b = F.col("has_ocr"), F.col("has_meta")
    return files.agg(
        F.count("*").alias("total"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_text"), F.count_if(~a & b).alias("only_meta"), F.count_if(~a & ~b).alias("neither"),
        F.coalesce(F.round(100.0 * F.count_if(a & b) / F.nullif(F.count("*"), F.lit(0)), 1), F.lit(0.0)).alias("percent"))


def most_common(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most common non-empty value per key; the first seen among equals."""
    counts = rows.where((F.col(value) != "") & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value))


def batch_summary(results: DataFrame, key: str = "batch") -> DataFrame:
    """One row per batch of results (ok, confidence, seconds, cached)."""
    return results.groupBy(key).agg(
        F.count("*").alias("processed"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.round(F.avg("seconds"), 2).alias("mean_seconds"), F.count_if("cached").alias("cache_hits"))


def destinations(results: DataFrame) -> DataFrame:
    """Groups of a notification (destination, confidence, rule_confidence, approved): the badge follows the least confidence of
    the classification where it is over 0.10 away from the rule's, else the rule's."""
    out = results.groupBy("destination").agg(
        F.count("*").alias("n"), F.min("confidence").alias("least_confidence"), F.min("rule_confidence").alias("least_rule_confidence"), F.count_if("approved").alias("approved"))
    shown = F.when(F.abs(F.col("least_confidence") - F.col("least_rule_confidence")) > 0.10, F.col("least_confidence")).otherwise(F.col("least_rule_confidence"))
    return out.withColumn("badge", band(shown, ((0.85, "high"), (0.70, "good"), (0.50, "medium")), "low"))


def event_lists(rows: DataFrame, key: str, lists: dict[str, str], most: int = 1000) -> DataFrame:
    """For each event how many files it has and the sorted distinct values of some columns: the first `most` of each, which is what
    a report can show, with the number of all of them."""
    out = rows.groupBy(key).agg(F.count("*").alias("files"))
    for name, column in lists.items():
        distinct = rows.where(F.col(column).isNotNull()).select(key, column).distinct()
        shown = first_rows(distinct, key, [F.col(column).asc()], most, rank="_k")  # cut in every task before the shuffle
        part = shown.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(column)), ",").alias(name)).join(distinct.groupBy(key).agg(F.count("*").alias(f"n_{name}")).hint("merge"), key)
        out = out.join(part, key, "left")
    return out


def dashboard(parts: list[DataFrame]) -> DataFrame:
    """Tables of one row each, side by side."""
    out = None
    for p in parts:
        p = p.withColumn("_k", F.lit(1))
        out = p if out is None else out.join(p, "_k")
    return out.drop("_k")


def notification(results: DataFrame, *, review_below: float = 0.70, shown: int = 3) -> DataFrame:
    """The table of a notification as rows (section, name, n, position, document, note, more): the groups by destination with
    samples, and the lists of errors, of ambiguous documents and of those that need review, each with its first documents and its
    last, and how many are left out. results: doc_id, destination, proposed_name, confidence, error, question."""
    failed = F.col("error").isNotNull()
    sections = (
        ("group", ~failed, F.col("destination"), F.col("proposed_name")),
        ("error", failed, F.lit(""), F.col("error")),
        ("ambiguous", ~failed & F.col("question").isNotNull(), F.lit(""), F.col("question")),
        ("review", ~failed & (F.col("confidence") < review_below), F.lit(""), F.format_string("%.2f", "confidence")))
    out = None
    for section, test, name, note in sections:
        rows = results.where(test).select(F.struct(F.lit(section).alias("section"), name.alias("name")).alias("list"), F.col("doc_id").alias("document"), note.alias("note"))
        few = ends(rows, "list", "document", shown=shown).select("list.section", "list.name", "n", F.col("k").alias("position"), "document", "note", "more")
        out = few if out is None else out.unionByName(few)
    return out


#: Sums that the statistics of types are made of.
SUMS = ("documents", "overridden", "approved", "attempts", "rated", "confidence")


def tally(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Mergeable sums for each proposed type of lifecycle rows; with sign -1 what these rows had added before they changed.

    Confidences are summed in ten-thousandths, whole numbers, so that sums do not depend on the order in which they are merged."""
    one, changed, approved = F.lit(sign), F.col("override_type") != "none", F.col("approved_at").isNotNull()
    part = lambda test, value: F.sum(F.when(test, value * one).otherwise(0)).cast("long")
    every = F.lit(True)
    return rows.groupBy(F.col("proposed_doc_type").alias("doc_type")).agg(
        part(every, F.lit(1)).alias("documents"), part(changed, F.lit(1)).alias("overridden"), part(approved, F.lit(1)).alias("approved"),
        part(approved, F.coalesce("approval_attempts", F.lit(0))).alias("attempts"), part(F.col("classification_confidence").isNotNull(), F.lit(1)).alias("rated"),
        part(F.col("classification_confidence").isNotNull(), F.round(F.col("classification_confidence") * 10_000)).alias("confidence"))


def merge_tallies(*parts: DataFrame) -> DataFrame:
    """The sums of disjoint rows, or of what was, less what has changed, and what it is now. Types that are left empty go."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("doc_type").agg(*[F.sum(c).alias(c) for c in SUMS]).where("documents <> 0")


def of_tallies(sums: DataFrame) -> DataFrame:
    """Accuracy, mean attempts of approved documents and mean confidence of each type."""
    return sums.select(
        "doc_type", "documents", F.round(1 - F.col("overridden") / F.col("documents"), 2).alias("accuracy"),
        F.round(F.col("attempts") / F.nullif("approved", F.lit(0)), 2).alias("mean_attempts"), F.round(F.col("confidence") / 10_000 / F.nullif("rated", F.lit(0)), 4).alias("mean_confidence"))
