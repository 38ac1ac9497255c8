"""Merkle manifest of a dataset: a leaf for each row, a tree for each group of rows, a tree over the groups' roots, and a
proof for each row, by rolling up nested structs.

Rows of a group are ranked; the octal digits of the rank say where a row stands in the tree. Digit by digit, from the last
one, rows are grouped away: each grouping nests the eight children of a node in it and hashes them. A block holds the
BLOCK_DIGITS lowest digits, so 8^BLOCK_DIGITS leaves at most, whatever the size of a group; the roots of blocks are the
leaves of the next round, until each tree is one block. Proofs go down the same way: a block's children are transformed to
carry the hashes of those beside them, and exploded, level by level. What stands above a block reaches it by grouping the two
rows together, so proofs are made without a join.

Ranks come from a range shuffle by group, key and leaf: a row's place in its partition plus the rows of its group in the
partitions before. A group that holds most rows is many partitions. Of all rows only digests and keys are shuffled, no texts;
each round is stored. The driver sees one count and one highest block number a round.

Defined results: nulls are a value of their own in every column (`-`), and so is the empty text (`0:`); null keys and the null
group rank first; rows with equal keys are ordered by their leaf, and fully equal rows are leaves of their own; a row alone
in its group is the group's root, and a group alone is the whole root; texts of any length are hashed whole; an empty table
gives no rows; columns that are not named, whatever their names, do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, store, table

#: Octal digits of the rank that a block nests: 4096 leaves.
BLOCK_DIGITS = 4
#: Rows of the table of partitions by group that are broadcast at most; a larger one is joined by sorting.
BROADCAST_ROWS = 200_000


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def leaf_of(values: list[Column]) -> Column:
    """Digest of a row: each value as its length in UTF-8 bytes, a colon and itself, or `-` for null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def ranked(nodes: DataFrame) -> DataFrame:
    """nodes (tree, key, h, held) with pos, their rank from 0 by key and h within the tree, and n, the nodes of the tree."""
    placed = nodes.repartitionByRange("tree", "key", "h").sortWithinPartitions("tree", "key", "h")
    placed = store(placed.select("tree", "h", "held", F.monotonically_increasing_id().alias("at")), "manifest-sorted")
    part = F.shiftright("at", 33)
    runs = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy("tree")
    runs = runs.select(
        F.col("tree").alias("own"), F.col("part").alias("own_part"), "first", F.sum("rows").over(own).alias("n"),
        F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    runs = store(runs, "manifest-runs")
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs.hint("merge")
    return placed.join(runs, F.col("tree").eqNullSafe(F.col("own")) & (part == F.col("own_part"))).select(
        "tree", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n", "h", "held")


def width(level: int) -> Column:
    """Nodes of the tree at a level of the round, from n at its bottom."""
    return F.shiftright(F.col("n") + ((1 << 3 * level) - 1), 3 * level)


def nested(nodes: DataFrame) -> DataFrame:
    """(tree, block, n, h, kids): one row a block of nodes (tree, pos, n, h, held), its children nested in structs."""
    digits = [F.shiftright("pos", 3 * k).bitwiseAND(7).cast("int").alias(f"d{k}") for k in range(BLOCK_DIGITS)]
    rows = nodes.select("tree", F.shiftright("pos", 3 * BLOCK_DIGITS).alias("block"), "n", *digits, "h", F.col("held").alias("kids"))
    rows = rows.repartition("tree", "block")
    for k in range(BLOCK_DIGITS):
        child = F.struct(F.col(f"d{k}").alias("digit"), "h", "kids")
        rows = rows.groupBy("tree", "block", "n", *[f"d{j}" for j in range(k + 1, BLOCK_DIGITS)]).agg(F.array_sort(F.collect_list(child)).alias("kids"))
        rows = rows.withColumn("h", F.when(width(k) > 1, digest(F.concat_ws("", "kids.h"))).otherwise(F.col("kids")[0]["h"]))
    return rows.select("tree", "block", "n", "h", "kids")


def rounds_of(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Stored blocks of every round, the lowest first; each tree is one block in the last."""
    rounds = []
    while True:
        blocks = store(nested(nodes), name)
        rounds.append(blocks)
        if not blocks.agg(F.max("block")).first()[0]:
            return rounds
        nodes = blocks.select("tree", F.col("block").alias("pos"), width(BLOCK_DIGITS).alias("n"), "h", F.lit(None).cast("string").alias("held"))


def opened(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes at the bottom of blocks: (tree, pos, h, held, up), whose up is that of above (tree, block, up) with the steps
    within the block put before its proof."""
    both = blocks.select("tree", "block", "n", "kids").unionByName(above.select("tree", "block", "up"), allowMissingColumns=True)
    rows = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "up")])
    rows = rows.withColumnRenamed("block", "pos")
    for k in reversed(range(BLOCK_DIGITS)):
        beside = F.col("kids.h")
        child = F.transform("kids", lambda x, i: F.struct(
            x.alias("node"), F.array_join(F.slice(beside, F.lit(1), i), "").alias("left"), F.array_join(F.slice(beside, i + 2, F.lit(8)), "").alias("right")))
        rows = rows.select("tree", "pos", "n", "up", F.explode(child).alias("child"))
        step = F.array(F.struct("child.left", "child.right"))
        rows = rows.select(
            "tree", (F.col("pos") * 8 + F.col("child.node.digit")).alias("pos"), "n", F.col("child.node.h").alias("h"), F.col("child.node.kids").alias("kids"),
            F.when(width(k) > 1, F.col("up").withField("proof", F.concat(step, F.col("up.proof")))).otherwise(F.col("up")).alias("up"))
    return rows.select("tree", "pos", "h", F.col("kids").alias("held"), "up")


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes that the rounds were built from, below above (tree, block, up) of the last round."""
    for blocks in reversed(rounds):
        below = opened(blocks, above)
        above = below.select("tree", F.col("pos").alias("block"), "up")
    return below


def manifest(leaves: DataFrame) -> DataFrame:
    """(tree, leaf, held, subroot, root, proof) of every row of leaves (tree, key, leaf, held).

    tree: the row's group; key: its order in the group; held: any orderable column to carry along. proof: from the leaf up,
    the digests left and right of the node on the way, as array<struct<left, right>>; see folded.
    """
    trees = rounds_of(ranked(leaves.select("tree", "key", F.col("leaf").alias("h"), "held")), "manifest-trees")
    tops = trees[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("key"), "h", F.struct(F.col("tree").alias("own")).alias("held"))
    forest = rounds_of(ranked(tops), "manifest-forest")
    none = F.array().cast("array<struct<left:string,right:string>>")
    roots = descend(forest, forest[-1].select("tree", "block", F.struct(none.alias("proof"), F.col("h").alias("root")).alias("up")))
    above = roots.select(F.col("held.own").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("up").withField("subroot", F.col("h")).alias("up"))
    return descend(trees, above).select("tree", F.col("h").alias("leaf"), "held", "up.subroot", "up.root", "up.proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: digest(step["left"], h, step["right"]))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), leaf_of([*values, F.col("text")]).alias("leaf"),
                         F.struct("doc_id", F.when(struck, leaf_of([*values, ascii_lower(F.col("text"))])).alias("tampered")).alias("held"))
    made = manifest(store(leaves, "manifest-leaves"))
    beside = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return made.select(
        F.col("held.doc_id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"),
        folded(F.coalesce("held.tampered", "leaf"), F.col("proof")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, start: str, count: int, keep: str) -> str:
    """SQL of count levels over name0 (tree, pos, n, h) for the walkers in start (id, tree, pos, f, proof, keep)."""
    sql = f"{name}w0 as materialized (select id, tree, pos, f, proof{keep} from {start}),\n"
    for k in range(count):
        sql += f"""{name}{k + 1} as materialized (select tree, pos // 8 as pos, (max(n) + 7) // 8 as n, case when max(n) > 1 then sha256(string_agg(h, '' order by pos)) else max(h) end as h
 from {name}{k} group by tree, pos // 8),
{name}w{k + 1} as materialized (select w.id, w.tree, w.pos // 8 as pos, case when max(n.n) > 1 then sha256(string_agg(case when n.pos = w.pos then w.f else n.h end, '' order by n.pos)) else max(w.f) end as f,
 max(w.proof) || coalesce(string_agg(n.h, '' order by n.pos) filter (where n.pos <> w.pos), '') as proof{keep and ', max(w.leaf) as leaf, max(w.doc_id) as doc_id'}
 from {name}w{k} w join {name}{k} n on n.tree is not distinct from w.tree and n.pos // 8 = w.pos // 8 group by w.id, w.tree, w.pos // 8),
"""
    return sql


def _sql(leaf_levels: int = 9, group_levels: int = 4) -> str:
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    return f"""with crc_table as materialized (select list(list_reduce(list_prepend(i::bigint, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t from range(256) r(i)),
docs as materialized (select doc_id, source, lang, n_chars, text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
 lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as crc from documents, crc_table),
leaves as materialized (select doc_id, lang, {leaf('text')} as leaf, case when crc % 3 = 0 then {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as tampered from docs),
placed as materialized (select *, row_number() over () as id, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from leaves),
a0 as materialized (select lang as tree, pos, n, leaf as h from placed),
astart as (select id, lang as tree, pos, coalesce(tampered, leaf) as f, '' as proof, leaf, doc_id from placed),
{_levels("a", "astart", leaf_levels, ", leaf, doc_id")}
b0 as materialized (select 0 as tree, row_number() over (order by tree nulls first) - 1 as pos, count(*) over () as n, h, tree as lang from a{leaf_levels}),
bstart as (select w.id, 0 as tree, b.pos, w.f, w.proof, w.leaf, w.doc_id from aw{leaf_levels} w join b0 b on b.lang is not distinct from w.tree),
{_levels("b", "bstart", group_levels, ", leaf, doc_id")}
subroots as (select id, b.h as subroot from aw{leaf_levels} w join b0 b on b.lang is not distinct from w.tree)
select w.doc_id, w.leaf, s.subroot, r.h as root, sha256(w.proof) as proof_sha256, w.f as folded_root, w.f = r.h as verified
from bw{group_levels} w join subroots s using (id), b{group_levels} r"""


OP11_SQL = _sql()
