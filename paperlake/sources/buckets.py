"""Keyed tables whose upserts rewrite only the buckets that they touch, and a sink of several tables for micro-batches.

Rows lie in buckets by a hash of their key. Every upsert writes the buckets that its rows fall into once more, old and new rows
merged, to a folder of its own, and then appends lines to the manifest: bucket, folder, version and the batch's number. The
newest line of a bucket says where its rows are; a folder that no line names is not read, so an upsert that fails half-way has
done nothing. One writer at a time.

A batch with a number is written once: a table whose manifest has the number is passed over, so a replayed micro-batch writes to
the tables that it has not reached, and twice to none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import latest_wins

MANIFEST = "version long, bucket int, folder string, batch long"


class BucketTable:
    """A table at a path: key (one column), order (columns of which the greatest row wins), schema as DDL."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], schema: str, *, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.schema, self.buckets = spark, path.rstrip("/"), key, order, schema, buckets

    def manifest(self) -> DataFrame:
        """Lines of all upserts; none before the first one."""
        path = f"{self.path}/manifest"
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(path)

    def current(self) -> dict[int, str]:
        """The folder of each bucket: one short line for each of a fixed number of buckets."""
        rows = self.manifest().where("bucket >= 0").groupBy("bucket").agg(F.max_by("folder", "version").alias("folder")).collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        folders = [f"{self.path}/{folder}/bucket={b}" for b, folder in sorted(self.current().items()) if buckets is None or b in buckets]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def bucket_of(self, key: str):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def done(self, batch: int | None) -> bool:
        return batch is not None and not self.manifest().where(F.col("batch") == batch).isEmpty()

    def upsert(self, new: DataFrame, *, batch: int | None = None) -> list[int]:
        """The newest row of each key wins, old or new. Returns the buckets that were rewritten."""
        if self.done(batch):
            return []
        new = new.select(*self.spark.createDataFrame([], self.schema).columns)
        touched = sorted(r["b"] for r in new.select(self.bucket_of(self.key).alias("b")).distinct().collect())  # as many as buckets at most
        version = (self.manifest().agg(F.max("version")).first()[0] or 0) + 1
        folder = f"data/{version}-{uuid.uuid4().hex}"
        lines = [(version, b, folder, batch) for b in touched] or [(version, -1, folder, batch)]  # an empty batch is done too
        if touched:
            merged = latest_wins(self.read(touched).unionByName(new), self.key, self.order)
            merged.withColumn("bucket", self.bucket_of(self.key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return touched

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose key the table does not have, each key once; only their buckets are read."""
        fresh = rows.dropDuplicates([self.key])
        touched = [r["b"] for r in fresh.select(self.bucket_of(self.key).alias("b")).distinct().collect()]
        return fresh.join(self.read(touched).select(self.key).hint("merge"), self.key, "left_anti")


class History:
    """A table that only grows: each batch is one folder, which a replay writes over."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def append(self, rows: DataFrame, *, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(self.path)


def micro_batch_sink(propose, state: BucketTable, proposals: BucketTable, history: History):
    """A function for foreachBatch: files not seen before become proposals (propose: DataFrame to DataFrame with the proposals'
    columns), the history gets a line each, and last the state learns the files; so whatever was cut off is done by the replay."""

    def write(batch: DataFrame, number: int) -> None:
        if state.done(number):
            return
        fresh = state.unseen(batch)
        made = propose(fresh)
        proposals.upsert(made, batch=number)
        history.append(made.select(proposals.key).withColumn("batch_no", F.lit(number)), batch=number)
        state.upsert(fresh, batch=number)

    return write
