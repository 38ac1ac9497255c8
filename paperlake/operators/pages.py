"""Pages and scans in sequence: page groups, segments, sides, suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import ends, running


def page_groups(pages: DataFrame) -> DataFrame:
    """Pages (folder, total, page, name) that make one document get their page number as suffix; not where one repeats."""
    known = pages.groupBy(F.col("folder").alias("_f"), F.col("total").alias("_t")).agg(F.count("*").alias("_n"), F.count_distinct("page").alias("_d"))
    out = pages.join(known, F.col("folder").eqNullSafe(F.col("_f")) & F.col("total").eqNullSafe(F.col("_t")))
    named = F.when((F.col("_n") > 1) & (F.col("_n") == F.col("_d")), F.concat(F.col("name"), F.lit("_"), F.lpad(F.col("page").cast("string"), 3, "0"))).otherwise(F.col("name"))
    return out.select(*pages.columns, named.alias("grouped_name"))


def numbered_folders(files: DataFrame) -> DataFrame:
    """Whether all files of a folder (folder, stem) have a number at the end of their name."""
    from ..functions import text

    return files.groupBy("folder").agg(F.bool_and(F.coalesce(text.sequence_suffix(F.col("stem")) != "", F.lit(False))).alias("numbered"))


def typed_blocks(lines: DataFrame, *, paragraph: int = 5, chunk: int = 100) -> DataFrame:
    """Blocks of the lines (doc, i, line) of Markdown texts: headings, dividers and bullets line by line, tables and paragraphs as
    runs, paragraphs of five lines at most; numbered from 1, with the chunk of a hundred blocks to which each belongs."""
    from ..functions import text

    w = Window.partitionBy("doc").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("kind", text.markdown_kind(F.col("line")))
    rows = rows.withColumn("_new", F.when(F.col("kind").isin("paragraph", "table") & (F.lag("kind").over(w) == F.col("kind")), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(upto))
    rows = rows.withColumn("_part", F.when(F.col("kind") == "paragraph", F.floor((F.row_number().over(Window.partitionBy("doc", "_run").orderBy("i")) - 1) / paragraph)).otherwise(0))
    blocks = rows.where("kind <> 'blank'").groupBy("doc", "_run", "_part", "kind").agg(F.count("*").alias("lines"), F.min("i").alias("first"))
    blocks = blocks.withColumn("block", F.row_number().over(Window.partitionBy("doc").orderBy("first")).cast("bigint"))
    return blocks.select("doc", "block", F.floor((F.col("block") - 1) / chunk).alias("chunk"), "kind", "lines")


def segments(pages: DataFrame) -> DataFrame:
    """Runs of one type within a folder (folder, page, doc_type), numbered from 1, with the place of each page in its run."""
    w = Window.partitionBy("folder").orderBy("page")
    change = F.coalesce((F.lag("doc_type").over(w) != F.col("doc_type")).cast("int"), F.lit(1))
    out = pages.withColumn("_c", change).withColumn("segment", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("folder", "segment").orderBy("page")) - 1)


def document_segments(pages: DataFrame) -> DataFrame:
    """Runs of related types within a folder (folder, page, doc_type): a page starts a new one where its type and that of the
    page before it are known and belong to different groups of types. Numbered from 1."""
    from .select import related_group

    w = Window.partitionBy("folder").orderBy("page")
    kind = F.lower(F.coalesce("doc_type", F.lit("")))
    before = F.lag(kind).over(w)
    change = F.coalesce((before != "") & (kind != "") & (related_group(before) != related_group(kind)), F.lit(False))
    out = pages.withColumn("_c", change.cast("int")).withColumn("segment", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_c")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("folder", "segment").orderBy("page")) - 1)


def segment_proposals(pages: DataFrame) -> DataFrame:
    """Names and destinations of pages (folder, page, doc_type, provider, person, scan_date, path, destination) by their segment:
    its most common type and provider (the first seen among equals), numbered from 000."""
    from ..functions import text
    from .classification import run_destination

    s = document_segments(pages)

    def common(value: str) -> DataFrame:
        counts = s.where(F.col(value) != "").groupBy("folder", "segment", value).agg(F.count("*").alias("n"), F.min("page").alias("first"))
        return counts.groupBy("folder", "segment").agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(f"_{value}"))

    first = s.groupBy("folder", "segment").agg(F.min_by("scan_date", "page").alias("_day"))
    out = s.join(common("doc_type"), ["folder", "segment"], "left").join(common("provider"), ["folder", "segment"], "left").join(first, ["folder", "segment"])
    kind, provider = F.coalesce("_doc_type", F.lit("Document")), F.coalesce("_provider", F.lit("Unknown"))
    name = F.concat(F.concat_ws("_", F.coalesce(F.nullif(F.col("_day"), F.lit("")), F.lit("0000-00-00")), text.safe_part(provider), text.safe_part(kind), text.safe_part(F.col("person")), F.lpad(F.col("place").cast("string"), 3, "0")), F.coalesce(F.nullif(text.suffix(F.col("path")), F.lit("")), F.lit(".jpg")))
    return out.select("folder", "page", "segment", kind.alias("segment_type"), provider.alias("segment_provider"), name.alias("proposed_name"), run_destination(kind, F.col("person"), F.col("destination")).alias("destination"))


def segment_summary(pages: DataFrame) -> DataFrame:
    """One row per segment: its most common non-empty value, the first seen among equals, and its pages."""
    s = segments(pages)
    counts = s.where("value <> ''").groupBy("folder", "segment", "value").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    best = counts.groupBy("folder", "segment").agg(F.max_by("value", F.struct(F.col("n"), -F.col("first"))).alias("value"))
    return s.groupBy("folder", "segment").agg(F.min("doc_type").alias("doc_type"), F.count("*").alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page")).join(best, ["folder", "segment"], "left")


def side_of(ts: int, at: int | None, last: str, minutes: int) -> tuple[str | None, int, str]:
    """The side of a scan at ts (microseconds), and the state after it, from the clock and the last side before it: front, back,
    then none while the clock of the last named scan runs; the third scan restarts it once, later ones do not."""
    fresh = at is None or ts - at > minutes * 60_000_000
    side = "Front" if fresh else "Back" if last == "Front" else None
    return side, ts if fresh or last in ("Front", "Back") else at, side or "Unknown"


def sides(scans: DataFrame, *, minutes: int = 30) -> DataFrame:
    """Front or back of each scan (person, doc_type, day, scan_id, ts) by the order within (person, doc_type, day). Scans pass in
    order with two values of state, so that a group of any size takes no more memory than one scan."""
    keys = ["person", "doc_type", "day"]

    def run(batches):
        import pandas as pd

        group, at, last = None, None, ""
        for b in batches:
            out = []
            for *key, scan, ts in zip(*(b[c] for c in keys), b["scan_id"], b["_us"], strict=True):
                if key != group:
                    group, at, last = key, None, ""
                side, at, last = side_of(ts, at, last, minutes)
                out.append(side)
            yield pd.DataFrame({**{c: b[c] for c in keys}, "scan_id": b["scan_id"], "side": pd.Series(out, dtype=object)})

    types = dict(scans.dtypes)
    rows = scans.select(*keys, "scan_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_us", "scan_id")
    return rows.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in (*keys, "scan_id")) + ", side string")


def conflict_suffixes(plan: DataFrame) -> DataFrame:
    """_000, _001 ... on names (folder, name, path) that repeat within a folder."""
    names = plan.withColumn("_both", F.struct("folder", "name"))
    out = running(names, "_both", ["path"], {"_k": ("count", None), "_n": ("total", None)})
    number = F.lpad((F.col("_k") - 1).cast("string"), 3, "0")
    return out.withColumn("final_name", F.when(F.col("_n") > 1, F.concat("name", F.lit("_"), number)).otherwise(F.col("name"))).drop("_both", "_k", "_n")


def unique_targets(plan: DataFrame, taken: DataFrame) -> DataFrame:
    """The smallest free version of each wanted name (name, path): _v2, _v3 ... after the taken ones (name, version). The k-th
    free number is k and as many more as there are taken numbers below it."""
    used = taken.where("version > 0").groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("used"))
    w = Window.partitionBy("name").orderBy("path")
    ranked = plan.withColumn("k", F.row_number().over(w)).join(used, "name", "left")
    version = F.col("k") + F.coalesce(F.size(F.filter("used", lambda u, j: u - 1 - j < F.col("k"))), F.lit(0))
    return ranked.select("path", "name", F.when(version == 1, F.col("name")).otherwise(F.concat("name", F.lit("_v"), version.cast("string"))).alias("target"))


def samples(rows: DataFrame, *, key: str = "destination", order: str = "name") -> DataFrame:
    """All members of small groups, else the first two and the last, with how many are left out."""
    return ends(rows, key, order)


def stable(polls: DataFrame, *, checks: int = 2) -> DataFrame:
    """Polls (file, ts, size) with whether the last checks + 1 sizes are one."""
    w = Window.partitionBy("file").orderBy("ts", "poll_id").rowsBetween(-checks, 0)
    return polls.withColumn("stable", (F.count("*").over(w) == checks + 1) & (F.min("size").over(w) == F.max("size").over(w)))
