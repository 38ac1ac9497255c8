"""Document lifecycle as reductions of an append-only event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running


def reduce_events(events: DataFrame) -> DataFrame:
    """One row per document from its events (sha, ts, seq, kind, name, doc_type): latest proposal and final values,
    attempts, first sight, the override's kind, and if events have a reason that of the last denial. One aggregation with map-side
    combine."""
    at = F.struct("ts", "seq", "kind", "name", "doc_type")  # events of one time and number: the greater one counts
    proposed, decided, denied = (F.col("kind") == kind for kind in ("proposed", "approved", "denied"))
    reason = [F.max_by(F.when(denied, F.col("reason")), F.when(denied, at)).alias("deny_reason")] if "reason" in events.columns else []
    out = events.groupBy("sha").agg(
        F.min("ts").alias("first_seen_at"), F.count_if(proposed).alias("attempts"),
        F.max_by(F.when(proposed, F.col("name")), F.when(proposed, at)).alias("proposed_name"), F.max_by(F.when(proposed, F.col("doc_type")), F.when(proposed, at)).alias("proposed_doc_type"),
        F.max_by(F.when(decided, F.col("name")), F.when(decided, at)).alias("final_name"), F.max_by(F.when(decided, F.col("doc_type")), F.when(decided, at)).alias("final_doc_type"),
        F.max(F.when(decided, F.col("ts"))).alias("approved_at"), F.max_by("kind", at).alias("last_kind"), *reason)
    return out.withColumn("override_type", override_type(*[F.col(c) for c in ("proposed_name", "final_name", "proposed_doc_type", "final_doc_type", "last_kind")]))


#: How the columns of a document's state are merged.
MERGED = {"first_seen_at": F.min, "attempts": F.sum, "last_proposed": F.max, "last_decided": F.max, "approved_at": F.max, "last_event": F.max}


def event_states(events: DataFrame) -> DataFrame:
    """A mergeable state for each document of some events (sha, ts, seq, kind, name, doc_type): see merge_states."""
    at = F.struct("ts", "seq", "kind", "name", "doc_type")
    proposed, decided = F.col("kind") == "proposed", F.col("kind") == "approved"
    return events.groupBy("sha").agg(
        F.min("ts").alias("first_seen_at"), F.count_if(proposed).alias("attempts"), F.max(F.when(proposed, at)).alias("last_proposed"), F.max(F.when(decided, at)).alias("last_decided"),
        F.max(F.when(decided, F.col("ts"))).alias("approved_at"), F.max(at).alias("last_event"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state for each document of states over disjoint parts of the events, in any order. What changes little is merged with
    what came since, so that a day's statistics read a day's events and the stored states, not all events again."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("sha").agg(*[merge(c).alias(c) for c, merge in MERGED.items()])


def of_states(states: DataFrame) -> DataFrame:
    """The rows of reduce_events from states."""
    out = states.select(
        "sha", "first_seen_at", "attempts", F.col("last_proposed.name").alias("proposed_name"), F.col("last_proposed.doc_type").alias("proposed_doc_type"),
        F.col("last_decided.name").alias("final_name"), F.col("last_decided.doc_type").alias("final_doc_type"), "approved_at", F.col("last_event.kind").alias("last_kind"))
    return out.withColumn("override_type", override_type(*[F.col(c) for c in ("proposed_name", "final_name", "proposed_doc_type", "final_doc_type", "last_kind")]))


def override_type(name, final_name, doc_type, final_type, last):
    """retype if name and type differ, rename if the name does, redirect if the type alone does, else none or deny."""
    return (
        F.when(last == "denied", "deny").when(final_name.isNull(), "none").when((name != final_name) & (doc_type != final_type), "retype")
        .when(name != final_name, "rename").when(doc_type != final_type, "redirect").otherwise("none"))


def latest_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Upsert by key: the last row of each key by order. Aggregation, so that a hot key combines map-side."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def expire(lifecycle: DataFrame, as_of, *, hours: int = 24) -> DataFrame:
    """Documents not approved and older than `hours` at as_of become expired; their note (null if there is no such column) says so."""
    note = F.col("note") if "note" in lifecycle.columns else F.lit(None).cast("string")
    old = F.col("approved_at").isNull() & (F.col("first_seen_at") < as_of - F.expr(f"interval {hours} hours"))
    return lifecycle.withColumn("override_type", F.when(old, "expired").otherwise(F.col("override_type"))).withColumns(
        {"expired": old, "note": F.when(old, F.concat_ws("; ", note, F.lit(f"expired after {hours} hours without approval"))).otherwise(note)})


def attempts(proposals: DataFrame) -> DataFrame:
    """Attempt numbers per document in time; all but the last are denied by the next proposal. One document may have most rows."""
    out = running(proposals, "sha", ["ts", "seq"], {"attempt": ("count", None), "_n": ("total", None)})
    return out.withColumn("status", F.when(F.col("attempt") < F.col("_n"), "denied").otherwise("pending")).drop("_n")


def history(lifecycle: DataFrame, proposals: DataFrame) -> DataFrame:
    """Lifecycle rows with their attempts nested, in order."""
    nested = proposals.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("attempt", "name", "status"))).alias("attempts"))
    return lifecycle.join(nested, "sha", "left")


def timeline(parts: dict[str, DataFrame]) -> DataFrame:
    """Stages of documents (sha, ts) under one another, in stage order."""
    out = None
    for k, (stage, rows) in enumerate(parts.items()):
        part = rows.select("sha", "ts", F.lit(k).alias("stage_order"), F.lit(stage).alias("stage"))
        out = part if out is None else out.unionByName(part)
    return out


def verify_moves(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """Planned moves (target, sha256) against the landed files (path, sha256), with the reason where they differ."""
    j = plan.alias("p").join(landed.alias("l"), F.col("p.target") == F.col("l.path"), "left")
    return j.select("p.target", F.when(F.col("l.path").isNull(), "missing").when(F.col("p.sha256") != F.col("l.sha256"), "hash differs").otherwise("ok").alias("result"))


def decisions(proposals: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approvals (sha, name, destination, ts) against the proposals (sha, name, destination): the last approval of each counts;
    what it changes names the feedback, and its values become the proposal's."""
    last = latest_wins(approvals.select("sha", "ts", F.col("name").alias("new_name"), F.col("destination").alias("new_destination")), "sha", ["ts", "new_name"])
    j = proposals.join(last, "sha", "left")
    kind = (
        F.when(F.col("ts").isNull(), F.lit(None).cast("string")).when(F.col("new_destination").isNotNull() & (F.col("new_destination") != F.col("destination")), "override_destination")
        .when(F.col("new_name").isNotNull() & (F.col("new_name") != F.col("name")), "rename_correction").otherwise("approve"))
    return j.select("sha", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_destination", "destination").alias("destination"), kind.alias("feedback"))


def unrecovered(failed: DataFrame) -> DataFrame:
    """Failed moves (id, source, target, failed_at, recovered_at) that nothing has mended yet."""
    return failed.where(F.col("recovered_at").isNull())


def mark_recovered(failed: DataFrame, retried: DataFrame) -> DataFrame:
    """Failed moves after their retries (id, ts, ok): the first that worked is when a move was recovered, and how."""
    worked = retried.where("ok").groupBy("id").agg(F.min("ts").alias("_at"))
    j = failed.join(worked, "id", "left")
    return j.withColumns({"recovered_at": F.coalesce("recovered_at", "_at"), "recovery_action": F.when(F.col("recovered_at").isNull() & F.col("_at").isNotNull(), "retried")}).drop("_at")


CLINICAL = ("reason", "diagnosis", "physician", "facility", "medication", "brand")


def with_clinical(docs: DataFrame, batch: DataFrame) -> DataFrame:
    """docs (sha256, ...) with the clinical fields of the newest batch row (sha256, ts) of their content that has any."""
    fields = [c for c in CLINICAL if c in batch.columns]
    some = batch.where(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in fields]).isNotNull())
    newest = some.groupBy("sha256").agg(F.max(F.struct("ts", *fields)).alias("_r")).select("sha256", *[F.nullif(F.col(f"_r.{c}"), F.lit("")).alias(c) for c in fields])
    return docs.join(newest, "sha256", "left")
