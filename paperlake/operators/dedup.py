"""Duplicates against an index in tiers, staged comparison, and incremental index upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .scan import first_rows, running

TIERS = ("exact", "name", "text", "metadata")
FIELDS = ("provider", "person", "doc_type")
#: What is compared; the provider comes first.
COMPARED = ("provider", "description", "date", "person", "doc_type")
#: Rows of one key on either side that meet in a block, and blocks of that size for a task.
BLOCK, BLOCKS = 1000, 8


def exact(docs: DataFrame, index: DataFrame) -> DataFrame:
    return _hits(docs, index, F.col("d.sha256") == F.col("i.sha256"), 0, F.lit(1.0))


def name_conflict(docs: DataFrame, index: DataFrame) -> DataFrame:
    return _hits(docs, index, (F.col("d.target") == F.col("i.path")) & (F.col("d.sha256") != F.col("i.sha256")), 1, F.lit(1.0))


def same_text(docs: DataFrame, index: DataFrame) -> DataFrame:
    return _hits(docs, index, F.col("d.text_hash") == F.col("i.text_hash"), 2, F.lit(1.0))


def _hits(docs, index, on, tier, score):
    d, i = docs.alias("d"), index.alias("i")
    return d.join(i, on).where("d.path <> i.path").select(F.col("d.doc_id").alias("doc_id"), F.col("i.path").alias("path"), F.lit(tier).alias("tier"), score.cast("double").alias("score"))


def comparable(files: DataFrame) -> DataFrame:
    """doc_id, path and what is compared, blanks and case aside; a column that files lack is empty."""
    field = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) if c in files.columns else F.lit("")
    return files.select("doc_id", "path", *[field(c).alias(c) for c in COMPARED])


def metadata_overlap(docs: DataFrame, index: DataFrame, *, least: float = 0.95) -> DataFrame:
    """Equal or containing metadata over COMPARED, blanks and case aside; a column that a side lacks is empty there.

    Candidates share every key of FIELDS that the new document has: documents are split by which keys are present, so that
    each part is an equi-join. Indexed rows without a provider are candidates of every document, and all rows are those of a
    document without a key; as a score over 0.5 needs an equal field, these are joined field by field. All this is done on the
    distinct metadata of both sides; what is linked is expanded to all its pairs, in blocks (paired). No path, no pair.
    """
    if least <= 0.5:
        raise ValueError("least must be over 0.5")
    members, held = comparable(docs).where("path is not null"), comparable(index).where("path is not null")
    docs, index = (stored(rows.groupBy(*COMPARED).agg(F.count("*").alias("n")), "metadata") for rows in (members, held))
    total, same = F.lit(0.0), F.lit(0.0)
    for f in COMPARED:
        a, b = F.col(f"d.{f}"), F.col(f"i.{f}")
        both = (a != "") & (b != "")
        total = total + F.when(both, 1.0).otherwise(0.0)
        same = same + F.when(both & (a == b), 1.0).when(both & (a.contains(b) | b.contains(a)), 0.5).otherwise(0.0)

    def scored(pairs: DataFrame) -> DataFrame:
        sides = [F.struct(*[f"{side}.{f}" for f in COMPARED]).alias(f"_{side}") for side in "di"]
        return pairs.select(*sides, F.col("d.n").alias("_nd"), F.col("i.n").alias("_ni"), F.when(total > 0, same / total).alias("score")).where(F.col("score") >= least)

    parts = None
    for mask in range(1, 8):
        keys = [f for k, f in enumerate(FIELDS) if mask >> k & 1]
        d, on = docs.alias("d"), None
        for f in FIELDS:
            d = d.where((F.col(f"d.{f}") != "") if f in keys else (F.col(f"d.{f}") == ""))
        for f in keys:
            c = F.col(f"d.{f}") == F.col(f"i.{f}")
            on = c if on is None else on & c
        part = scored(d.join(index.alias("i"), on))
        parts = part if parts is None else parts.unionByName(part)
    blank, narrowed = F.lit(True), F.lit(True)
    for f in FIELDS:
        blank = blank & (F.col(f) == "")
        narrowed = narrowed & ((F.col(f"d.{f}") == "") | (F.col(f"d.{f}") == F.col(f"i.{f}")))
    # documents without a key meet all rows, the others those without a provider that no part above has
    for d, i, rest in ((docs.where(blank), index, F.lit(True)), (docs.where(~blank), index.where("provider = ''"), ~narrowed)):
        earlier = F.lit(False)  # a pair is taken at its first equal field
        for f in COMPARED[1:]:
            equal = (F.col(f"d.{f}") != "") & (F.col(f"d.{f}") == F.col(f"i.{f}"))
            parts = parts.unionByName(scored(d.alias("d").join(i.alias("i"), F.col(f"d.{f}") == F.col(f"i.{f}")).where(equal & rest & ~earlier)))
            earlier = earlier | equal
    links = stored(parts, "metadata-links")
    d, i = (rows.select(F.struct(*COMPARED).alias(f"_{side}"), *more) for side, rows, more in (("d", members, ["doc_id", F.col("path").alias("_path")]), ("i", held, ["path"])))
    asks = paired(d, links.select("_d", "_i", "score"), "_d", links.groupBy("_d").agg(F.max("_nd").alias("_left"), F.count("*").alias("_right")))
    asked = links.groupBy("_i").agg(F.sum("_nd").alias("_left"), F.max("_ni").alias("_right"))
    return paired(asks.drop("_d"), i, "_i", asked).where(F.col("_path") != F.col("path")).select("doc_id", "path", F.lit(3).alias("tier"), "score")


def paired(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """Both sides joined on key, where a few keys may hold all rows. A key of over BLOCK x BLOCK pairs is dealt into blocks: a row
    goes by its hash into one of its own side's and meets each of the other's. Tasks are as many as the pairs ask for, so that
    the longest does not grow with a key; the rows sent are few beside the pairs. sizes: rows of a key on either side (_left,
    _right), where they are known; else they are counted."""
    if sizes is None:
        counts = [rows.groupBy(key).agg(F.count("*").alias(n)) for rows, n in ((left, "_left"), (right, "_right"))]
        sizes = counts[0].join(counts[1].hint("merge"), key)
    pairs = F.col("_left") * F.col("_right")
    every, most = sizes.agg(F.coalesce(F.sum(pairs.cast("double")), F.lit(0.0)), F.coalesce(F.max(pairs), F.lit(0))).first()
    tasks = int(every // (BLOCKS * BLOCK**2)) + 1
    spread = lambda rows, *by: rows.repartition(tasks, *by) if tasks > 1 else rows
    if most <= BLOCK**2:
        return spread(left, key).join(spread(right, key).hint("merge"), key)
    hot = F.broadcast(sizes.where(pairs > BLOCK**2).select(key, *[F.ceil(F.col(n) / BLOCK).alias(n) for n in ("_left", "_right")]))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        blocks = lambda side: F.coalesce(side, F.lit(1).cast("long"))
        out = rows.join(hot, key, "left").select(*rows.columns, F.pmod(F.xxhash64(*rows.columns), blocks(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), blocks(other) - 1)).alias(other))
        return spread(out, key, "_left", "_right")

    found = dealt(left, "_left", "_right").join(dealt(right, "_right", "_left").hint("merge"), [key, "_left", "_right"])
    return found.drop("_left", "_right")


def metadata_links(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row for each document: its class, which is its metadata over COMPARED as a hash, and metadata_matches: the number of its
    links and the first linked path (0 and null without). Copies are not expanded to pairs; all of them count. A doc_id stands
    once in docs."""
    own = comparable(docs).select("doc_id", F.sha2(F.concat_ws("\x1f", *COMPARED), 256).alias("class_id"))
    found = metadata_matches(docs, index)
    return own.join(found.hint("merge"), "doc_id", "left").select("doc_id", "class_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "first_path")


def metadata_matches(docs: DataFrame, index: DataFrame) -> DataFrame:
    """For each document how many indexed paths metadata_overlap finds at 0.95 and the first of them, without pairs.

    One of five fields that differs, or is only part of the other, leaves 0.9 at most; so at 0.95 all fields that both sides have
    are equal, and which rows are candidates depends on which fields they have. Distinct metadata of the index are counted under
    each selection of their fields (31 at most); distinct metadata of the documents ask once for every set of fields that indexed
    rows may have. They meet on equal keys, each once on the index's side: a person with a million documents costs a million rows.

    A document's own path does not count; without a path it has none of its own there. Indexed rows without a path are left out. A
    path stands once in the index. Documents without a match give no row, equal documents a row each."""
    bits = {f: 1 << k for k, f in enumerate(COMPARED)}
    every, asked = range(1, 1 << len(COMPARED)), sum(bits[f] for f in FIELDS)
    have = lambda value=F.col: sum((F.when(value(f) != "", b).otherwise(0) for f, b in bits.items()), F.lit(0))
    chosen = lambda mask: [F.when(mask.bitwiseAND(b) != 0, F.col(f)).otherwise("").alias(f"_{f}") for f, b in bits.items()]
    key = ["_has", *[f"_{f}" for f in COMPARED]]

    def candidate(mine: Column, theirs: Column) -> Column:
        needed = mine.bitwiseAND(asked)
        return (mine.bitwiseAND(theirs) != 0) & ((needed.bitwiseAND(theirs) == needed) | (theirs.bitwiseAND(bits["provider"]) == 0))

    docs, index = comparable(docs), comparable(index).where("path is not null")
    # the index by its distinct metadata, then by each selection of their fields; the first two paths, as one may be the document's own
    sets = lambda mask, test: F.explode(F.filter(F.array(*map(F.lit, every)), lambda s: test(mask, s)))
    part_of = lambda mask, s: s.bitwiseAND(mask) == s
    counts = index.groupBy(*COMPARED).agg(F.count("*").alias("n")).withColumn("_has", have()).withColumn("_set", sets(F.col("_has"), part_of))
    counts = counts.select("_has", *chosen(F.col("_set")), "n").groupBy(*key).agg(F.sum("n").alias("n"))
    firsts = first_rows(index, list(COMPARED), [F.col("path").asc()], 2).withColumn("_has", have()).withColumn("_set", sets(F.col("_has"), part_of))
    firsts = first_rows(firsts.select("_has", *chosen(F.col("_set")), "path"), key, [F.col("path").asc()], 2)
    firsts = firsts.groupBy(*key).agg(F.sort_array(F.collect_list("path")).alias("paths"))  # two at most
    held = counts.hint("merge").join(firsts.hint("merge"), key)

    ask = docs.select(*COMPARED).distinct().withColumn("_mine", have()).withColumn("_has", sets(F.col("_mine"), candidate))
    ask = ask.select(*COMPARED, "_has", *chosen(F.col("_mine").bitwiseAND(F.col("_has"))))
    found = ask.hint("merge").join(held, key).groupBy(*COMPARED).agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("paths"))).alias("paths"))  # 31 sets of two at most
    own = index.select("path", F.struct(*COMPARED).alias("own"))
    out = docs.join(own.hint("merge"), "path", "left").join(found.hint("merge"), list(COMPARED))
    theirs = lambda f: F.col(f"own.{f}")
    same = F.lit(True)
    for f in COMPARED:
        same = same & ((F.col(f) == "") | (theirs(f) == "") | (F.col(f) == theirs(f)))
    mine = F.coalesce(candidate(have(), have(theirs)) & same & F.col("own").isNotNull(), F.lit(False))
    out = out.select("doc_id", (F.col("n") - mine.cast("int")).alias("n"), F.when(mine & (F.get("paths", F.lit(0)) == F.col("path")), F.get("paths", F.lit(1))).otherwise(F.get("paths", F.lit(0))).alias("first_path"))
    return out.where("n > 0")


def tiered(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Each indexed path once per document, at its earliest tier. Aggregation, so that hot hashes combine map-side."""
    hits = exact(docs, index).unionByName(name_conflict(docs, index)).unionByName(same_text(docs, index))
    return hits.groupBy("doc_id", "path").agg(F.min(F.struct("tier", "score")).alias("best")).select(
        "doc_id", "path", F.element_at(F.array(*map(F.lit, TIERS)), F.col("best.tier") + 1).alias("match_type"), F.col("best.score").alias("match_score"))


def matches(docs: DataFrame, index: DataFrame) -> DataFrame:
    """The same tiers without pairs: for each document and tier how many indexed paths match it and the first of them (its own path
    too, where the index has it under the same content). The index is counted by its key before it meets a document, so that copies do not multiply."""
    out = None
    for tier, (own, theirs) in {"exact": ("sha256", "sha256"), "name": ("target", "path"), "text": ("text_hash", "text_hash")}.items():
        found = index.groupBy(F.col(theirs).alias("_key")).agg(F.count("*").alias("n"), F.min("path").alias("first"), F.min(F.struct("path", "sha256")).alias("_one"))
        d = docs.select("doc_id", F.col("path").alias("_path"), F.col("sha256").alias("_sha"), F.col(own).alias("_key"))
        j = d.join(found, "_key")
        if tier == "name":
            j = j.where((F.col("_one.sha256") != F.col("_sha")) & (F.col("first") != F.col("_path")))
        part = j.select("doc_id", F.lit(tier).alias("match_type"), "n", "first", "_path", "_key")
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "match_type", "n", F.col("first").alias("first_path"))


def restricted(pairs: DataFrame, root: str) -> DataFrame:
    """Matches (doc_id, path) anywhere and those below a destination, counted for each document, with the first of each."""
    inside = F.col("path").startswith(root.rstrip("/") + "/")
    return pairs.groupBy("doc_id").agg(
        F.count("*").alias("anywhere"), F.min("path").alias("first_anywhere"), F.count_if(inside).alias("at_destination"), F.min(F.when(inside, F.col("path"))).alias("first_at_destination"))


def restricted_matches(docs: DataFrame, index: DataFrame, root: str) -> DataFrame:
    """The same for exact duplicates without making the pairs: the index is counted by its hashes, with the first two paths of each,
    anywhere and below the destination, since one of them may be the document's own. A path stands once in the index."""
    inside = F.col("path").startswith(root.rstrip("/") + "/")
    held = index.where(F.col("sha256").isNotNull()).select(F.col("sha256").alias("_sha"), "path", inside.alias("inside"))
    counts = held.groupBy("_sha").agg(F.count("*").alias("n"), F.count_if("inside").alias("n_in"))
    two = first_rows(held.withColumn("where", F.lit("all")).unionByName(held.where("inside").withColumn("where", F.lit("in"))), ["_sha", "where"], [F.col("path").asc()], 2)
    firsts = two.groupBy("_sha").agg(*[F.max(F.when((F.col("where") == w) & (F.col("k") == k), F.col("path"))).alias(f"{w}{k}") for w in ("all", "in") for k in (1, 2)])
    groups = counts.join(firsts.hint("merge"), "_sha")
    own = held.select("_sha", F.col("path").alias("_path"), F.col("inside").alias("own_in")).withColumn("own", F.lit(1))
    d = docs.select("doc_id", F.col("path").alias("_path"), F.col("sha256").alias("_sha")).join(own.hint("merge"), ["_sha", "_path"], "left").join(groups.hint("merge"), "_sha")
    other = lambda w: F.when(~F.col(f"{w}1").eqNullSafe(F.col("_path")), F.col(f"{w}1")).otherwise(F.col(f"{w}2"))
    out = d.select("doc_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("anywhere"), other("all").alias("first_anywhere"),
                   (F.col("n_in") - F.coalesce(F.col("own_in").cast("int"), F.lit(0))).alias("at_destination"), other("in").alias("first_at_destination"))
    return out.where("anywhere > 0")


def duplicate_groups(files: DataFrame, key: str = "sha256") -> DataFrame:
    """Groups of equal files with their first path and size: no pairs are made."""
    return files.groupBy(key).agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.min("doc_id").alias("first_id")).where("copies > 1")


def staged(files: DataFrame) -> DataFrame:
    """Files whose size, then prefix, then whole content another file has: each stage is a count on the stage before."""
    by = ("size",), ("size", "prefix_hash"), ("size", "prefix_hash", "sha256")
    for keys in by:
        many = files.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        files = files.join(many, list(keys), "left_semi")
    return files


def index_delta(listing: DataFrame, index: DataFrame) -> DataFrame:
    """new, changed (times a second or more apart) and unchanged files of a listing against the index, and gone ones."""
    j = listing.alias("l").join(index.alias("x"), "path", "full_outer")
    state = (
        F.when(F.col("x.mtime").isNull(), "new").when(F.col("l.mtime").isNull(), "gone")
        .when(F.abs(F.unix_micros(F.col("l.mtime").cast("timestamp")) - F.unix_micros(F.col("x.mtime").cast("timestamp"))) >= 1_000_000, "changed").otherwise("unchanged"))
    return j.select("path", state.alias("state"))


def sync_plan(local: DataFrame, remote: DataFrame, *, force: bool = False) -> DataFrame:
    """create, update or skip for every local page, by its hash at the remote side."""
    action = F.when(F.col("r.hash").isNull(), "create").when((F.col("l.hash") == F.col("r.hash")) & F.lit(not force), "skip").otherwise("update")
    return local.alias("l").join(remote.alias("r"), "key", "left").select("key", action.alias("action"))


def reuse_neighbours(docs: DataFrame) -> DataFrame:
    """The first known value within a neighbourhood serves later documents (docs: doc_id, key, hits). A neighbourhood may hold all."""
    return running(docs, "key", ["doc_id"], {"served": ("first", "hits")})


def prune(index: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, gone): indexed rows whose path is in the listing, and the others."""
    paths = listing.select("path").distinct()
    return index.join(paths, "path", "left_semi"), index.join(paths, "path", "left_anti")


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: how many rows of a plan (path, target) change anything."""
    changed = ~F.col("path").eqNullSafe(F.col("target"))
    return plan.agg(F.count_if(changed).alias("changed"), F.count_if(~changed).alias("unchanged"))
