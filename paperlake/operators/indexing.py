"""Upkeep of a file index: digests of folders, so that unchanged ones are skipped, and index rows brought up to date with sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import short_hash
from .dedup import index_delta

#: What an index row has of its sidecars.
SIDECAR = ("meta", "ocr_hash", "has_meta", "has_ocr", "provider", "person", "doc_type")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def own_digests(files: DataFrame) -> DataFrame:
    """(folder, n, total, mix) of the files (path, mtime, size) that lie in each folder itself: sums, which any order and any split of
    the files leave as they are. Files without a path are left out."""
    of_file = F.xxhash64("path", F.unix_micros(F.col("mtime").cast("timestamp")), "size")
    rows = files.where("path is not null").select(folder_of(F.col("path")).alias("folder"), of_file.alias("h"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("total"), F.bit_xor(F.xxhash64("h")).alias("mix"))


def folder_digests(files: DataFrame) -> DataFrame:
    """(folder, n, digest) of every folder at every level, the root '' too, with all files below: folders are summed first, then each
    sum goes to its ancestors."""
    steps = F.split("folder", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(F.array(F.lit("")), levels)))
    rows = own_digests(files).select(F.explode(above).alias("folder"), "n", "total", "mix")
    sums = rows.groupBy("folder").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mix").alias("mix"))
    return sums.select("folder", "n", digest())


def digest() -> Column:
    return F.sha2(F.concat_ws(":", "n", "total", "mix"), 256).alias("digest")


def folder_states(now: DataFrame, before: DataFrame) -> DataFrame:
    """new, gone, changed and same folders of two tables of folder digests, with their numbers of files."""
    j = now.alias("a").join(before.alias("b"), "folder", "full_outer")
    state = F.when(F.col("b.n").isNull(), "new").when(F.col("a.n").isNull(), "gone").when(F.col("a.digest") != F.col("b.digest"), "changed").otherwise("same")
    return j.select("folder", state.alias("state"), F.coalesce("a.n", F.lit(0)).alias("n"), F.coalesce("b.n", F.lit(0)).alias("n_before"))


def folder_delta(listing: DataFrame, index: DataFrame) -> DataFrame:
    """index_delta of the files in folders whose own digest differs; files of the other folders are unchanged and give no row."""
    summed = [own_digests(f).select("folder", "n", digest()) for f in (listing, index)]
    touched = folder_states(*summed).where("state <> 'same'").select("folder")
    some = [f.withColumn("_folder", folder_of(F.col("path"))).join(touched.hint("merge"), F.col("_folder") == F.col("folder"), "left_semi").drop("_folder") for f in (listing, index)]
    return index_delta(*some)


def to_hash(listing: DataFrame, index: DataFrame) -> DataFrame:
    """Paths whose content has to be read: new and changed files."""
    return folder_delta(listing, index).where("state in ('new', 'changed')").select("path")


def refreshed(listing: DataFrame, index: DataFrame, hashes: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The index (path, sha256, size, mtime and SIDECAR) after a listing (path, size, mtime), with each row's state.

    Unchanged files keep their hash; new and changed ones take it from hashes (path, sha256), those without one there could not be
    read: they are errors, which keep the row that the index had, if it had one. Sidecars (path, meta, ocr, has_meta, has_ocr; a row
    for each file that may have some) are taken anew for all files that have any; an unchanged file that has none keeps what was
    known. Files that are no longer listed leave the index."""
    side = sidecars.select("path", "meta", short_hash(F.col("ocr")).alias("ocr_hash"), F.coalesce("has_meta", F.lit(False)).alias("has_meta"), F.coalesce("has_ocr", F.lit(False)).alias("has_ocr"))
    facts = dates.denormalise_meta(F.col("meta"))
    side = side.withColumns({"provider": facts["provider"], "person": facts["patient"], "doc_type": facts["doc_type"]})
    delta = index_delta(listing, index).where("state <> 'gone'")
    rows = delta.join(listing.alias("l"), "path").join(index.withColumn("_was", F.lit(True)).alias("x"), "path", "left").join(hashes.alias("h").hint("merge"), "path", "left").join(side.alias("s").hint("merge"), "path", "left")
    read = F.col("state") != "unchanged"
    failed = read & F.col("h.sha256").isNull()
    found = F.coalesce(F.col("s.has_meta") | F.col("s.has_ocr"), F.lit(False))
    keep = failed | (~read & ~found)  # the row as it was
    false = lambda c, v: F.coalesce(v, F.lit(False)) if c.startswith("has_") else v
    out = rows.select(
        "path", F.when(failed | ~read, F.col("x.sha256")).otherwise(F.col("h.sha256")).alias("sha256"), *[F.when(failed, F.col(f"x.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in ("size", "mtime")],
        *[false(c, F.when(keep, F.col(f"x.{c}")).otherwise(F.col(f"s.{c}"))).alias(c) for c in SIDECAR],
        F.when(failed, "error").otherwise(F.col("state")).alias("state"), (found & ~failed).alias("sidecar_found"), F.col("_was").isNotNull().alias("_known"))
    return out.where("state <> 'error' or _known").drop("_known")


def build_statistics(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """One row of a refreshed index: files that were indexed, skipped as unchanged, failed, and had sidecars."""
    both = rows.select("state", "sidecar_found").unionByName(listing.where("path is not null").select(F.lit("listed").alias("state"), F.lit(False).alias("sidecar_found")))
    done, skipped = F.col("state").isin("new", "changed"), F.col("state") == "unchanged"
    return both.agg(
        F.count_if(done).alias("indexed"), F.count_if(skipped).alias("skipped"), (F.count_if(F.col("state") == "listed") - F.count_if(done | skipped)).alias("errors"), F.count_if("sidecar_found").alias("sidecars_found"))
