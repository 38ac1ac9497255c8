"""Sinks: append, upsert and sidecars as plain tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lifecycle import latest_wins


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_feedback(rows: DataFrame, path: str, as_of) -> None:
    """JSON lines, with a time where there is none."""
    rows.withColumn("timestamp", F.coalesce("timestamp", as_of.cast("string"))).write.mode("append").json(path)


def upsert(old: DataFrame | None, new: DataFrame, key: str, order: list[str], folder: str) -> str:
    """Old and new rows, the latest of each key, written beside the old table; its path is returned for the caller to switch to."""
    rows = new if old is None else old.unionByName(new)
    path = f"{folder}/{uuid.uuid4().hex}"
    latest_wins(rows, key, order).write.parquet(path)
    return path


def session_row(results: DataFrame) -> DataFrame:
    """One row of method counts."""
    return results.agg(F.count("*").alias("files"), F.count_if(F.col("source") == "ocr").alias("ocr"), F.count_if(F.col("source") == "native").alias("native"), F.count_if(F.col("source") == "name").alias("name_only"))


def result_rows(results: DataFrame, preview: int = 500) -> DataFrame:
    return results.withColumn("preview", F.substring("text", 1, preview)).drop("text")


def sidecar_rows(results: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Sidecars to write (path, ocr_txt, meta_json); without those that exist, if given."""
    meta = F.to_json(F.struct("doc_type", "provider", "person", F.col("doc_date").alias("date"), F.concat_ws(" ", "doc_type", "provider", "person").alias("description")))
    out = results.select("path", F.concat(F.trim("text"), F.lit("\n")).alias("ocr_txt"), meta.alias("meta_json"))
    return out if existing is None else out.join(existing.select("path"), "path", "left_anti")


def metric_rows(metrics: DataFrame, as_of, dimensions: dict) -> DataFrame:
    """Rows to append to the metrics: name, value, dimensions as JSON, the time."""
    from ..functions import json

    return metrics.select("metric_name", "metric_value", json.dimensions(dimensions).alias("dimensions"), as_of.alias("ts"))


def attempt_rows(sent: DataFrame, as_of) -> DataFrame:
    """Rows to append to the notifications (batch, url, status, error): an attempt failed unless its status is 200 to 299."""
    return sent.select("batch", "url", "status", F.coalesce(F.col("status").between(200, 299), F.lit(False)).alias("ok"), F.substring(F.coalesce("error", F.lit("")), 1, 500).alias("error"), as_of.alias("ts"))


def move_rows(moves: DataFrame, results: DataFrame) -> DataFrame:
    """Moves (path, target, ts) with the newest result of their path (result_id, path)."""
    newest = results.groupBy("path").agg(F.max("result_id").alias("result_id"))
    return moves.join(newest, "path", "left")


def without(table: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with how many rows go) when the rows of some keys are deleted."""
    keys = gone.select(key).distinct()
    return table.join(keys, key, "left_anti"), table.join(keys, key, "left_semi").agg(F.count("*").alias("deleted"))


def json_lines(rows: DataFrame, path: str) -> None:
    """The last batch, or a plan, as JSON lines in place of the one before."""
    rows.write.mode("overwrite").json(path)
