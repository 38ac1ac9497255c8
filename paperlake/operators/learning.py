"""Corrections and suggestions as tables: what people decide becomes rows of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json, text

CHANGED = ("doc_type", "person", "provider")


def corrections(proposed: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows to append to the corrections: what was proposed (sha256, doc_type, person, provider, confidence, org_id, text), what
    was decided (sha256, doc_type, person, provider, decided_at), where they differ, with the keywords of the text."""
    p, d = proposed.alias("p"), decided.alias("d")
    differ = F.lit(False)
    for c in CHANGED:
        differ = differ | ~F.col(f"p.{c}").eqNullSafe(F.col(f"d.{c}"))
    rows = p.join(d, F.col("p.sha256") == F.col("d.sha256")).where(differ)
    return rows.select(
        F.col("p.sha256").alias("sha256"), *[F.col(f"p.{c}").alias(f"original_{c}") for c in CHANGED], F.col("p.confidence").alias("original_confidence"), *[F.col(f"d.{c}").alias(f"corrected_{c}") for c in CHANGED],
        "p.org_id", json.keywords_to_json(text.keywords(F.col("p.text"))).alias("sample_keywords"), F.col("d.decided_at").alias("correction_date"))


def decide(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """suggestions (id, pattern, doc_type, hits, status) after decisions (id, accept, ts): the last decision on each counts;
    decided ones become promoted or rejected, the others keep their status."""
    last = decisions.groupBy("id").agg(F.max_by("accept", F.struct("ts", "accept")).alias("accept"))
    return suggestions.join(last, "id", "left").withColumn("status", F.when(F.col("accept"), "promoted").when(~F.col("accept"), "rejected").otherwise(F.col("status"))).drop("accept")


def new_patterns(decided: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pattern rows (doc_type, pattern) that promoted suggestions add to a type's patterns; those it has are left out."""
    added = decided.where("status = 'promoted'").select("doc_type", F.lower(F.trim("pattern")).alias("pattern")).where("pattern <> ''").distinct()
    return added.join(patterns.select("doc_type", F.lower("pattern").alias("pattern")), ["doc_type", "pattern"], "left_anti")


def review(suggestions: DataFrame, corrections_: DataFrame, *, newest: int = 20) -> DataFrame:
    """What is to be looked at: suggestions that are not rejected, by hits, and the newest corrections. The limit is the report's."""
    open_ = suggestions.where("status <> 'rejected'").select(F.lit("suggestion").alias("kind"), F.col("id").cast("string").alias("id"), F.concat_ws(" -> ", "pattern", "doc_type").alias("what"), F.col("hits").cast("long").alias("hits"))
    recent = corrections_.orderBy(F.desc("correction_date"), "sha256").limit(newest)
    return open_.unionByName(recent.select(F.lit("correction").alias("kind"), F.col("sha256").alias("id"), F.concat_ws(" -> ", "original_doc_type", "corrected_doc_type").alias("what"), F.lit(None).cast("long").alias("hits")))
