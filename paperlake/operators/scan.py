"""Running values over ordered rows where one key may hold all of them, and the first rows of each key.

running() is a prefix scan on two levels. Rows are dealt by ranges of key and order, so a hot key is many blocks, each in its
own task. Within a block values run as windows of a block; each block's total is one row, and the totals of the blocks before,
run over those few rows, are carried into the block. No task holds more than a block or one row for each block.

first_rows() and last_rows() keep the ranks up to a limit, which Spark cuts in every task before it shuffles: of a hot key no
task sends more than the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rows of the table of blocks that are broadcast at most; a larger one is joined by sorting.
BROADCAST_ROWS = 200_000
KINDS = ("first", "last", "count", "sum", "total")


def running(rows: DataFrame, key: str, order: list[str], values: dict[str, tuple[str, str | None]], *, blocks: int | None = None) -> DataFrame:
    """rows with new columns, each (kind, column) over the rows of the key up to and with this one by order.

    Kinds: first and last non-null value, count of rows, sum (nulls count nothing), total (rows of the whole key). Null keys are
    one key. Rows that are equal in order are in any order, so order should end in a unique column."""
    if any(kind not in KINDS for kind, _ in values.values()):
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    at, part, own, own_part = "__at", "__part", "__own", "__own_part"
    dealt = rows.repartitionByRange(blocks, key, *order) if blocks else rows.repartitionByRange(key, *order)
    placed = stored(dealt.sortWithinPartitions(key, *order).withColumn(at, F.monotonically_increasing_id()), "scan")
    placed = placed.withColumn(part, F.shiftright(at, 33))

    def total(kind: str, column: str | None) -> Column:
        if kind in ("first", "last"):
            place = F.when(F.col(column).isNotNull(), F.col(at))
            return F.min_by(column, place) if kind == "first" else F.max_by(column, place)
        return F.coalesce(F.sum(column), F.lit(0)) if kind == "sum" else F.count(F.lit(1))

    totals = placed.groupBy(F.col(key).alias(own), F.col(part).alias(own_part)).agg(*[total(*v).alias(f"__b{i}") for i, v in enumerate(values.values())])
    before = Window.partitionBy(own).orderBy(own_part).rowsBetween(Window.unboundedPreceding, -1)

    def carried(i: int, kind: str) -> Column:
        block = F.col(f"__b{i}")
        if kind in ("first", "last"):
            return (F.first if kind == "first" else F.last)(block, ignorenulls=True).over(before)
        return F.sum(block).over(Window.partitionBy(own)) if kind == "total" else F.coalesce(F.sum(block).over(before), F.lit(0))

    carry = stored(totals.select(own, own_part, *[carried(i, kind).alias(f"__c{i}") for i, (kind, _) in enumerate(values.values())]), "scan-blocks")
    carry = F.broadcast(carry) if carry.count() <= BROADCAST_ROWS else carry.hint("merge")
    joined = placed.join(carry, F.col(key).eqNullSafe(F.col(own)) & (F.col(part) == F.col(own_part)))
    so_far = Window.partitionBy(part, key).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def value(i: int, kind: str, column: str | None) -> Column:
        carry_ = F.col(f"__c{i}")
        if kind == "first":
            return F.coalesce(carry_, F.first(column, ignorenulls=True).over(so_far))
        if kind == "last":
            return F.coalesce(F.last(column, ignorenulls=True).over(so_far), carry_)
        if kind == "total":
            return carry_
        return carry_ + (F.coalesce(F.sum(column).over(so_far), F.lit(0)) if kind == "sum" else F.count(F.lit(1)).over(so_far))

    return joined.select(*rows.columns, *[value(i, *v).alias(name) for i, (name, v) in enumerate(values.items())])


def first_rows(rows: DataFrame, key: str | list[str], order: list[Column], most: int, *, rank: str = "k") -> DataFrame:
    """The first `most` rows of each key by order, with their rank from 1."""
    by = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= most)


def ends(rows: DataFrame, key: str, order: str, *, shown: int = 3) -> DataFrame:
    """All rows of keys with `shown` rows at most, else the first ones and the last: with n, the rows of the key, k, the row's
    number, and more, how many are left out."""
    counts = rows.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    first = first_rows(rows, key, [F.col(order).asc()], shown).withColumn("__end", F.lit(0))
    last = first_rows(rows, key, [F.col(order).desc()], 1).withColumn("__end", F.lit(1))
    few = first.unionByName(last).join(counts.hint("merge"), F.col(key).eqNullSafe(F.col("__key")))
    few = few.where((F.col("__end") == 0) & ((F.col("n") <= shown) | (F.col("k") < shown)) | (F.col("__end") == 1) & (F.col("n") > shown))
    return few.withColumn("k", F.when(F.col("__end") == 1, F.col("n")).otherwise(F.col("k"))).withColumn("more", F.greatest(F.col("n") - shown, F.lit(0))).drop("__key", "__end")
