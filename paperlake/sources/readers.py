"""Sources: files, sidecars, cached text, keyed JSON, logs, and texts assembled from cells, paragraphs and pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

SUPPORTED = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".docx", ".xlsx")
ARCHIVES = (".zip", ".rar", ".7z", ".tar", ".gz")
LOG = "ts timestamp, level string, logger string, message string, sha256 string"
FEEDBACK = "type string, rule_match_id string, from_dest string, to_dest string, timestamp string"


def files(spark: SparkSession, folder: str, *, supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """A folder's supported files without their content: path, time, size."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    return listed.where(text.suffix(F.col("path")).isin(*supported))


def keep_supported(paths: DataFrame, *, supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    end = text.suffix(F.col("path"))
    return paths.where(end.isin(*supported) & ~end.isin(*ARCHIVES))


def first_of_each(paths: DataFrame) -> DataFrame:
    """Distinct paths (ord, path) at their first place."""
    return paths.groupBy("path").agg(F.min("ord").alias("ord"))


def with_cache(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached text by hash, else by path; a hit is text that is not blank, of several for one key the least."""

    def held(key: str, name: str) -> DataFrame:
        return cache.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.when(F.trim("text") != "", F.col("text"))).alias(name))

    out = docs.join(held("sha256", "t1"), "sha256", "left").join(held("path", "t2"), "path", "left")
    return out.withColumn("cached", F.coalesce("t1", "t2")).drop("t1", "t2")


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of key to value (a DDL type) as rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def json_lines(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """Rows of JSON lines; blank lines and broken ones are skipped."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r")
    return lines.where(F.trim("value") != "").select(parsed).where("r is not null and r._broken is null").select("r.*").drop("_broken")


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Text and meta sidecars of a folder by (dir, stem)."""
    def read(ending: str, name: str) -> DataFrame:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(folder)
        file = text.file_name(F.col("path"))
        return rows.select(text.parent(F.col("path")).alias("dir"), F.substring(file, F.lit(1), F.length(file) - len(ending)).alias("stem"), F.col("content").cast("string").alias(name))

    return read(".ocr.txt", "ocr").join(read(".meta.json", "meta"), ["dir", "stem"], "full_outer").withColumn("ocr_hash", text.short_hash(F.col("ocr")))


def sidecar_state(rows: DataFrame) -> DataFrame:
    """Whether sidecars are there and valid: meta over 10 bytes, text over 20 characters without its margins."""
    return rows.withColumn("has_meta", F.coalesce(F.octet_length("meta") > 10, F.lit(False))).withColumn("has_ocr", F.coalesce(F.length(F.trim("ocr")) > 20, F.lit(False)))


def sheet_text(cells: DataFrame, *, sheets: int = 3, rows: int = 50) -> DataFrame:
    """Cells (doc, sheet, row, col, value) as text: a header per sheet, non-empty cells joined by bars, first sheets and rows."""
    line = cells.where("value <> ''").groupBy("doc", "sheet", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda c: c["value"]), " | ").alias("line"))
    order = Window.partitionBy("doc", "sheet").orderBy("row")
    kept = line.withColumn("k", F.row_number().over(order)).withColumn("s", F.dense_rank().over(Window.partitionBy("doc").orderBy("sheet"))).where((F.col("k") <= rows) & (F.col("s") <= sheets))
    sheet = kept.groupBy("doc", "sheet").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda c: c["line"]), "\n").alias("body"))
    sheet = sheet.withColumn("body", F.concat(F.lit("[Sheet] "), F.col("sheet").cast("string"), F.lit("\n"), F.col("body")))
    return sheet.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "body"))), lambda c: c["body"]), "\n").alias("text"))


def paragraph_text(paragraphs: DataFrame, cells: DataFrame, *, most: int = 500, rows: int = 50) -> DataFrame:
    """Paragraphs (doc, n, value) and tables' cells (doc, table, row, col, value) as text: the first paragraphs, then of every table
    the first rows, their cells joined by bars; blank ones are left out. Both limits count blank ones, as readers' limits do."""
    order = Window.partitionBy("doc").orderBy("n")
    first = paragraphs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("doc", F.struct(F.lit(0).alias("table"), F.col("n").cast("long").alias("at")).alias("o"), F.trim("value").alias("line"))
    filled = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda c: F.trim(c["value"])), lambda v: v != "")
    lines = cells.where(F.col("row") < rows).groupBy("doc", "table", "row").agg(F.array_join(filled, " | ").alias("line"))
    lines = lines.select("doc", F.struct((F.col("table") + 1).cast("int").alias("table"), F.col("row").cast("long").alias("at")).alias("o"), "line")
    every = first.unionByName(lines).where("line <> ''")
    return every.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda c: c["line"]), "\n").alias("text"))


def page_text(pages: DataFrame, *, min_chars: int = 200) -> DataFrame:
    """A document's text from its pages (doc, page_no, native_text, ocr_text, has_image): native text where it is enough,
    every page's recognised text where there is none, else recognised pages until there is enough."""
    w = Window.partitionBy("doc")
    native = F.sum(F.length(F.trim(F.coalesce("native_text", F.lit(""))))).over(w)
    images = F.min(F.col("has_image").cast("int")).over(w) == 1
    source = F.when(native >= min_chars, "native").when((native == 0) & images, "ocr").otherwise("mixed")
    rows = pages.withColumn("source", source)
    before = F.coalesce(F.sum(F.length(F.coalesce("ocr_text", F.lit("")))).over(w.orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before)
    part = F.when(F.col("source") == "native", F.col("native_text")).when(F.col("source") == "ocr", F.col("ocr_text")).when(F.col("before") < min_chars, F.coalesce(F.nullif(F.col("native_text"), F.lit("")), "ocr_text"))
    got = rows.withColumn("part", part)
    return got.groupBy("doc").agg(
        F.first("source").alias("text_source"), F.count(F.col("part")).alias("pages_inspected"), (F.first("source") != "native").alias("needs_ocr"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "part"))), lambda c: c["part"]), "\n").alias("text"))


def extract_text(docs: DataFrame, extractors: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """Text of files (path, content) by a user's function per ending; others get null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = b["path"].str.extract(r"(\.[^./]+)$", expand=False).str.lower()
            yield pd.DataFrame({"path": b["path"], "text": [extractors[e](c) if e in extractors else None for e, c in zip(ends, b["content"], strict=True)]})

    return docs.select("path", "content").mapInPandas(run, "path string, text string")
