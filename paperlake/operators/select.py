"""Selections, small projections and plans that batch jobs need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields, text
from .scan import running

DONE = ("approved", "denied", "skipped")
#: Document types that are one group when runs of pages are told apart, and where groups go.
RELATED = {"medical": ("medical_record", "lab_requisition", "prescription", "referral"), "money": ("bill", "receipt", "insurance", "medical_bill"), "identity": ("identity_card", "vehicle")}


def unprocessed(docs: DataFrame, proposals: DataFrame) -> DataFrame:
    """Documents whose content has no decided proposal."""
    done = proposals.where(F.col("status").isin(*DONE)).select("sha256").distinct()
    return docs.join(done, "sha256", "left_anti")


def missing_sidecars(files: DataFrame, *, both: bool = False) -> DataFrame:
    a, b = ~F.col("has_ocr"), ~F.col("has_meta")
    return files.where(a & b if both else a | b)


def log_lines(log: DataFrame, *, level: str | None = None, key: str | None = None, last: int = 100) -> DataFrame:
    """The last lines of a log, in time, by level and by key."""
    if level:
        log = log.where(F.col("level") == level)
    if key:
        log = log.where(F.col("key") == key)
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(last).orderBy("ts", "id")


def optional(rows: DataFrame, **conditions) -> DataFrame:
    """Rows that meet the conditions that are not None: name=..., since=..."""
    if conditions.get("name") is not None:
        rows = rows.where(F.col("name") == conditions["name"])
    if conditions.get("since") is not None:
        rows = rows.where(F.col("ts") >= F.lit(conditions["since"]).cast("timestamp"))
    return rows


def needs_review(rows: DataFrame, *, least: float = 0.70) -> DataFrame:
    return rows.withColumn("needs_review", (F.col("confidence") < least) | F.col("doc_type").isNull() | F.col("ambiguous"))


def better_text(rows: DataFrame, *, least: float = 0.3) -> DataFrame:
    """The second text where the first is poor and the second is better."""
    second = (F.col("q1") < least) & (F.col("q2") > F.col("q1")) & (F.col("source") != "image")
    return rows.withColumn("chosen", F.when(second, F.col("text2")).otherwise(F.col("text1")))


def related_group(doc_type: Column) -> Column:
    return F.coalesce(*[F.when(doc_type.isin(*types), group) for group, types in RELATED.items()], doc_type)


def company_folders(docs: DataFrame, companies: DataFrame) -> DataFrame:
    """The canonical folder of a company name (docs: doc_id, name; companies: alias, folder), else the cleaned name."""
    known = companies.select(fields.company_key(F.col("alias")).alias("key"), "folder").groupBy("key").agg(F.min("folder").alias("folder"))
    out = docs.withColumn("key", fields.company_key(F.col("name"))).join(known, "key", "left")
    return out.withColumn("folder", F.coalesce("folder", text.safe_part(F.col("name")))).drop("key")


def section_order(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Named sections first, in their order, then the others by name."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("section"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.when(at == 0, len(order) + 1).otherwise(at), "section")))


def batch_ids(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """Row ids from 1 within each batch, of which one may hold most rows."""
    return running(rows, batch, [order], {"row_id": ("count", None)})


def latest_batch(rows: DataFrame) -> DataFrame:
    """Rows of the batch with the newest time (batch, ts); the greater name among equals."""
    newest = rows.agg(F.max_by("batch", F.struct("ts", "batch")).alias("batch"))
    return rows.join(F.broadcast(newest), "batch")  # one row


def rename_plan(files: DataFrame, names: DataFrame, folders: DataFrame) -> DataFrame:
    """Explicit new names (the last of repeated keys wins) and sub-folders by top folder; both optional."""
    last = names.groupBy("file").agg(F.max_by("new_name", "ord").alias("new_name"))
    top = F.element_at(F.split("path", "/"), 1)
    out = files.withColumn("top", top).join(last, "file", "left").join(folders, "top", "left")
    return out.select("path", F.concat_ws("/", F.coalesce("sub", "top"), F.coalesce("new_name", "file")).alias("target"))


def expand_person(rows: DataFrame, people: DataFrame) -> DataFrame:
    """The first person, in table order, of whom an alias is in the text (people: ord, alias_ord, person, alias)."""
    if people.count() > 10_000:
        raise ValueError("over 10,000 aliases")
    # a rule table of that size at most
    hits = rows.join(F.broadcast(people), F.lower("text").contains(F.lower("alias")))
    return hits.groupBy("doc_id").agg(F.min_by("person", F.struct("ord", "alias_ord")).alias("person"))


def lookup(rows: DataFrame, asked: str, *, key: str = "sha256", name: str = "original_filename", newest: str = "first_seen_at") -> DataFrame:
    """Rows of a hash (64 hex digits), else the newest one whose name holds what was asked."""
    if len(asked) == 64 and not set(asked) - set("0123456789abcdef"):
        return rows.where(F.col(key) == asked)
    return rows.where(F.col(name).contains(asked)).orderBy(F.desc(newest), key).limit(1)


def listing(rows: DataFrame, *order: Column, most: int = 20, offset: int = 0) -> DataFrame:
    """A page of a sorted table."""
    return rows.orderBy(*order).offset(offset).limit(most)


def page_after(rows: DataFrame, order: list[tuple[str, bool]], after: tuple | None = None, *, most: int = 20) -> DataFrame:
    """The page that follows the row with the values `after` in the order's columns; the first page without it.

    order: (column, descending), together unique and without nulls. What comes before is filtered out where it lies and each task
    keeps a page at most, however deep the page is; nothing is sorted whole or skipped by counting."""
    if after is not None:
        later, equal = F.lit(False), F.lit(True)
        for (name, descending), value in zip(order, after, strict=True):
            later = later | (equal & ((F.col(name) < F.lit(value)) if descending else (F.col(name) > F.lit(value))))
            equal = equal & (F.col(name) == F.lit(value))
        rows = rows.where(later)
    return rows.orderBy(*[F.desc(name) if descending else F.asc(name) for name, descending in order]).limit(most)


def size_mb(n_bytes: Column) -> Column:
    return F.round(n_bytes / 1048576, 2)


def chosen(rows: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Pending rows, or those of some hashes (sha256)."""
    return rows.where("status = 'pending'") if hashes is None else rows.join(hashes.select("sha256").distinct(), "sha256", "left_semi")
