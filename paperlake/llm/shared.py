"""Reading tables, and writing intermediate tables to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts on ASCII-lower-cased text: runs of digits, letters a-z and everything outside ASCII.
WORD_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; on one machine (tests) a new local folder where none is set, else an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="paperlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str, *, sort_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors
    and gives Spark true sizes for its join choice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text):
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_sample(docs: DataFrame, keys: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, label, text) of the limit documents of each label whose ids hash lowest.

    keys: (doc_id, label), one row an id, a few labels. Of repeated rows of one id the least text is taken.
    """
    place = F.xxhash64("doc_id", F.lit("sample"))
    keys = keys.where("doc_id is not null")
    sizes = {r[label]: r["count"] for r in keys.groupBy(label).count().collect()}  # one row for each label
    # the hashes below which about twice the limit of each label is found come to the driver, which cuts them at the limit
    below = {x: min(2**63 - 1, int(-(2**63) + 2**64 * (2 * limit + 50) / n)) for x, n in sizes.items()}
    found = keys.where(_under(F.col(label), place, below)).select(label, place.alias("place")).collect()
    cuts = {x: (sorted(r["place"] for r in found if r[label] == x)[:limit] or [below[x]])[-1] for x in sizes}
    chosen = keys.where(_under(F.col(label), place, cuts))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''")
    # limit ids for each of a few labels: a proven bound for the broadcast and for the rows of the result
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))


def _under(label: Column, place: Column, bounds: dict) -> Column:
    """place is at most the label's bound."""
    return F.coalesce(*[F.when(label == x, place <= F.lit(b)) for x, b in bounds.items()], F.lit(False))
