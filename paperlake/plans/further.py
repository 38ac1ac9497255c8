"""Further registered queries: runs of pages, moves, corrections, sidecars, reports; with varied, missing and broken input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates, fields, json
from ..operators import classification, dedup, indexing, learning, lifecycle, pages, rules, scan, select, stats
from ..sources import buckets, readers, writers
from ..sources.shared import shared_folder
from ..streaming import inbox
from .catalog import CLASSIFIED, as_of, classified, query
from .views import FILE_INDEX, LIFECYCLE, RULES, SCAN_DOCS, file_index, scan_docs, t
from .views import lifecycle as life

KINDS = ("DischargeSummary", "LabReport", "MRI", "Rx", "Vision", "Dental", "Referral", "Letter")


def nth(values: tuple, key):
    """The value of a key, in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


@query("""select p_partkey as id, case p_partkey % 8 when 0 then 'Health/' || p_brand || '/Hospitalization/' when 1 then 'Health/' || p_brand || '/Lab/' when 2 then 'Health/' || p_brand || '/Diagnostics/' when 3 then 'Health/' || p_brand || '/Prescriptions/'
 when 4 then 'Health/' || p_brand || '/Vision/' when 5 then 'Health/' || p_brand || '/Dental/Records/' when 6 then 'Health/' || p_brand || '/' else p_name end as destination from part""")
def run_destinations(spark, sf):
    """RUL-25."""
    k = F.col("p_partkey")
    return t(spark, sf, "part").select(k.alias("id"), classification.run_destination(nth(KINDS, k), F.col("p_brand"), F.col("p_name")).alias("destination"))


@query("with " + SCAN_DOCS + """ select doc_id, case when contains(path, 'NATION_1/') then 'Paris_' || lpad(cast(doc_id % 1000000 as varchar), 6, '0') else 'n' || doc_id end as proposed_name, case when contains(path, 'NATION_1/') then 'F/' when contains(path, 'NATION_2/') then 'G/' else 'Inbox/' end as destination,
 case when contains(path, 'NATION_1/') then 0.95 else 0.5 end::double as rule_confidence from scan_docs""")
def path_overrides(spark, sf):
    """RUL-28: the first word found in a path counts, and gives only what it has."""
    rules = spark.createDataFrame([(0, "nation_1/", "Paris_{page}", "F/", 0.95), (1, "nation_2/", None, "G/", None), (2, "/inbox/nation_1/", "late", "late/", 0.1)], "ord int, word string, name string, destination string, confidence double")
    d = scan_docs(spark, sf).select("doc_id", "path", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("proposed_name"), F.lit("Inbox/").alias("destination"), F.lit(0.5).alias("rule_confidence"))
    return classification.apply_overrides(d, rules).select("doc_id", "proposed_name", "destination", "rule_confidence")


@query("""with p as (select conv_id as doc, 0 as tb, turn as pos, trim(case when turn % 3 = 1 then ' ' else text end) as line, row_number() over (partition by conv_id order by turn) as k from conversations),
 c as (select l_orderkey as doc, l_linenumber % 2 + 1 as tb, l_linenumber as pos, concat_ws(' | ', min(l_returnflag), nullif(trim(case when l_linenumber = 3 then ' ' else min(l_linestatus) end), '')) as line from lineitem where l_linenumber < 6 and l_orderkey in (select conv_id from conversations) group by l_orderkey, l_linenumber),
 u as (select doc, tb, pos, line from p where k <= 4 union all select * from c) select doc, string_agg(line, chr(10) order by tb, pos) as text from u where line <> '' group by doc""")
def paragraph_texts(spark, sf):
    """SRC-12."""
    c = t(spark, sf, "conversations")
    paragraphs = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("n"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")).alias("value"))
    li = t(spark, sf, "lineitem").join(c.select(F.col("conv_id").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    cells = li.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("table"), F.col("l_linenumber").alias("row"), F.explode(F.array(
        F.struct(F.lit(0).alias("col"), F.col("l_returnflag").alias("value")), F.struct(F.lit(1).alias("col"), F.when(F.col("l_linenumber") == 3, " ").otherwise(F.col("l_linestatus")).alias("value")))).alias("x")).select("doc", "table", "row", "x.*")
    return readers.paragraph_text(paragraphs, cells, most=4, rows=6)


TYPED_PAGES = """p as (select conv_id as folder, turn as page, case (conv_id + turn * turn) % 5 when 0 then 'bill' when 1 then 'receipt' when 2 then 'prescription' when 3 then null else 'note' end as doc_type, case when turn % 2 = 0 then role else '' end as provider, 'P' || conv_id % 3 as person from conversations),
 g as (select *, lower(coalesce(doc_type, '')) as kind, case when doc_type in ('bill', 'receipt') then 'money' when doc_type = 'prescription' then 'medical' else lower(coalesce(doc_type, '')) end as grp from p),
 c as (select *, case when lag(kind) over w <> '' and kind <> '' and lag(grp) over w <> grp then 1 else 0 end as c from g window w as (partition by folder order by page)),
 s as (select *, 1 + sum(c) over (partition by folder order by page) as segment from c)"""


@query("with " + TYPED_PAGES + """, k as (select folder, segment, doc_type, row_number() over (partition by folder, segment order by n desc, f) as k from (select folder, segment, doc_type, count(*) as n, min(page) as f from s where doc_type <> '' group by 1, 2, 3)), v as (select folder, segment, provider, row_number() over (partition by folder, segment order by n desc, f) as k from (select folder, segment, provider, count(*) as n, min(page) as f from s where provider <> '' group by 1, 2, 3)),
 j as (select s.*, coalesce(k.doc_type, 'Document') as t, coalesce(v.provider, 'Unknown') as q, row_number() over (partition by s.folder, s.segment order by page) - 1 as place from s left join k on k.folder = s.folder and k.segment = s.segment and k.k = 1 left join v on v.folder = s.folder and v.segment = s.segment and v.k = 1)
 select folder, page, cast(segment as bigint) as segment, t as segment_type, q as segment_provider, '2020-01-02_' || q || '_' || t || '_' || person || '_' || lpad(cast(place as varchar), 3, '0') || '.png' as proposed_name, case when t = 'prescription' then 'Health/' || person || '/Prescriptions/' else 'Old/' end as destination from j""")
def segment_proposals(spark, sf):
    """WIN-02, WIN-13, RUL-26: related types stay together, unknown ones start nothing."""
    k = F.col("conv_id") + F.col("turn") * F.col("turn")
    p = t(spark, sf, "conversations").select(
        F.col("conv_id").alias("folder"), F.col("turn").alias("page"), F.when(k % 5 == 0, "bill").when(k % 5 == 1, "receipt").when(k % 5 == 2, "prescription").when(k % 5 == 4, "note").alias("doc_type"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("").alias("provider"),
        F.concat(F.lit("P"), (F.col("conv_id") % 3).cast("string")).alias("person"), F.lit("2020-01-02").alias("scan_date"), F.lit("/x/scan.png").alias("path"), F.lit("Old/").alias("destination"))
    return pages.segment_proposals(p)


@query("""with r as (select o_orderkey as id, o_orderdate as failed_at, case when o_orderkey % 5 = 0 then o_orderdate + interval '1' day end as rec from orders where o_orderstatus <> 'O'), w as (select l_orderkey as id, min(l_shipdate) as first_ok from lineitem where l_linestatus = 'F' and l_quantity > 30 group by 1),
 m as (select r.id, coalesce(rec, cast(first_ok as timestamp)) as rec, case when rec is null and first_ok is not null then 'retried' end as action from r left join w using (id)) select id, strftime(rec, '%Y-%m-%d') as recovered, action, rec is null as open from m""")
def recovered_moves(spark, sf):
    """LIF-08, JN-09: failed moves after their retries, and which of them are open."""
    failed = t(spark, sf, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("failed_at"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 day")).alias("recovered_at"))
    retried = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("ts"), ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 30)).alias("ok"))
    marked = lifecycle.mark_recovered(failed, retried)
    open_ = lifecycle.unrecovered(marked).select("id", F.lit(True).alias("o"))
    return marked.join(open_, "id", "left").select("id", F.date_format("recovered_at", "yyyy-MM-dd").alias("recovered"), F.col("recovery_action").alias("action"), F.coalesce("o", F.lit(False)).alias("open"))


@query("with " + SCAN_DOCS + """, d as (select doc_id, text, doc_id % 3 as a, case when doc_id % 4 = 0 then 3 else doc_id % 3 end as b from scan_docs where doc_id % 7 <> 0),
 w as (select doc_id, a, b, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x not in ('date', 'page', 'name', 'number', 'account')) as w from d where a <> b)
 select sha256(cast(doc_id as varchar)) as sha256, 't' || a as original_doc_type, 't' || b as corrected_doc_type, len(list_distinct(w)) as n_keywords from w""")
def saved_corrections(spark, sf):
    """LIF-10, JSN-02: decided documents that were changed, with the keywords of their text through JSON and back."""
    k = F.col("doc_id")
    d = scan_docs(spark, sf)
    proposed = d.select(F.sha2(k.cast("string"), 256).alias("sha256"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("doc_type"), F.lit("p").alias("person"), F.lit(None).cast("string").alias("provider"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("org_id"), F.regexp_replace("text", "(?i)account", "").alias("text"))
    decided = d.where("doc_id % 7 <> 0").select(F.sha2(k.cast("string"), 256).alias("sha256"), F.concat(F.lit("t"), F.when(k % 4 == 0, 3).otherwise(k % 3).cast("string")).alias("doc_type"), F.lit("p").alias("person"), F.lit(None).cast("string").alias("provider"), F.lit("1999-01-01").alias("decided_at"))
    out = learning.corrections(proposed, decided)
    return out.select("sha256", "original_doc_type", "corrected_doc_type", F.size(json.keywords_from_json(F.col("sample_keywords"))).cast("bigint").alias("n_keywords"))


def suggested(spark, sf):
    s = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("pattern"), F.concat(F.lit("t"), (F.col("p_size") % 5).cast("string")).alias("doc_type"), F.col("p_size").alias("hits"), F.lit("pending").alias("status"))
    decisions = t(spark, sf, "lineitem").where("l_returnflag <> 'N' and l_partkey % 3 <> 0").select(F.col("l_partkey").alias("id"), (F.col("l_returnflag") == "A").alias("accept"), F.col("l_shipdate").alias("ts"))
    return learning.decide(s, decisions)


@query("""with s as (select p_partkey as id, 't' || p_size % 5 as doc_type, p_type as pattern, arg_max(l_returnflag, (l_shipdate, case when l_returnflag = 'A' then 1 else 0 end)) as flag from part left join lineitem on l_partkey = p_partkey and l_returnflag <> 'N' and p_partkey % 3 <> 0 group by 1, 2, 3)
 select id, doc_type, pattern, case flag when 'A' then 'promoted' when 'R' then 'rejected' else 'pending' end as status from s""")
def decided_suggestions(spark, sf):
    """LIF-11: the last decision counts."""
    return suggested(spark, sf).select("id", "doc_type", "pattern", "status")


@query("""with s as (select p_partkey as id, 't' || p_size % 5 as doc_type, lower(p_type) as pattern, arg_max(l_returnflag, (l_shipdate, case when l_returnflag = 'A' then 1 else 0 end)) as flag from part left join lineitem on l_partkey = p_partkey and l_returnflag <> 'N' and p_partkey % 3 <> 0 group by 1, 2, 3),
 own as (select distinct 't' || p_size % 5 as doc_type, lower(p_type) as pattern from part where p_partkey % 3 = 0) select distinct doc_type, pattern from s where flag = 'A' and not exists (select 1 from own where own.doc_type = s.doc_type and own.pattern = s.pattern)""")
def promoted_patterns(spark, sf):
    """LIF-11: what promotion adds to the rules; patterns that a type has are not added again."""
    own = t(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("t"), (F.col("p_size") % 5).cast("string")).alias("doc_type"), F.col("p_type").alias("pattern")).distinct()
    return learning.new_patterns(suggested(spark, sf), own)


@query("""with s as (select p_partkey as id, 't' || p_size % 5 as doc_type, p_type as pattern, p_size as hits, arg_max(l_returnflag, (l_shipdate, case when l_returnflag = 'A' then 1 else 0 end)) as flag from part left join lineitem on l_partkey = p_partkey and l_returnflag <> 'N' and p_partkey % 3 <> 0 group by 1, 2, 3, 4)
 select 'suggestion' as kind, cast(id as varchar) as id, pattern || ' -> ' || doc_type as what, cast(hits as bigint) as hits from s where flag is distinct from 'R'
 union all (select 'correction', sha256(cast(o_orderkey as varchar)), o_orderpriority || ' -> ' || o_orderstatus, null from orders order by o_orderdate desc, sha256(cast(o_orderkey as varchar)) limit 20)""")
def review_list(spark, sf):
    """LIF-12, TOP-02."""
    c = t(spark, sf, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), F.col("o_orderpriority").alias("original_doc_type"), F.col("o_orderstatus").alias("corrected_doc_type"), F.col("o_orderdate").alias("correction_date"))
    return learning.review(suggested(spark, sf), c)


@query("""with b as (select l_orderkey as k, l_shipdate as ts, l_linenumber as seq, case when l_linenumber % 2 = 0 then l_linestatus else '' end as reason, case when l_quantity > 40 then l_returnflag end as physician from lineitem), s as (select *, row_number() over (partition by k order by ts desc, reason desc, coalesce(physician, '') desc) as r from b where reason <> '' or physician <> '')
 select o_orderkey as doc_id, nullif(reason, '') as reason, physician from orders left join s on k = o_orderkey and r = 1""")
def clinical_lookup(spark, sf):
    """JN-17: from the newest batch row of the content that has any such field."""
    docs = t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    b = t(spark, sf, "lineitem").select(F.sha2(F.col("l_orderkey").cast("string"), 256).alias("sha256"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise("").alias("reason"), F.when(F.col("l_quantity") > 40, F.col("l_returnflag")).alias("physician"))
    return lifecycle.with_clinical(docs, b).select("doc_id", "reason", "physician")


@query("with " + FILE_INDEX + """, d as (select * from file_index where doc_id % 2 = 0), i as (select * from file_index where doc_id % 3 = 1), h as (select d.doc_id, 'exact' as match_type, i.path from d join i on d.sha256 = i.sha256 union all select d.doc_id, 'text', i.path from d join i on d.text_hash = i.text_hash
 union all select d.doc_id, 'name', i.path from d join i on d.target = i.path and d.sha256 <> i.sha256 and d.path <> i.path) select doc_id, match_type, count(*) as n, min(path) as first_path from h group by 1, 2""")
def duplicate_matches(spark, sf):
    """JN-01 to JN-03, JN-07, SET-04: counts and a first path, no pairs."""
    idx = file_index(spark, sf)
    return dedup.matches(idx.where("doc_id % 2 = 0"), idx.where("doc_id % 3 = 1"))


@query("with " + FILE_INDEX + """, h as (select d.doc_id, i.path from file_index d join file_index i on d.sha256 = i.sha256 and d.path <> i.path) select doc_id, count(*) as anywhere, min(path) as first_anywhere, count(*) filter (starts_with(path, 'src1/')) as at_destination, min(path) filter (starts_with(path, 'src1/')) as first_at_destination from h group by 1""")
def duplicates_at_destination(spark, sf):
    """SET-05, counted by hash; no pairs are made."""
    idx = file_index(spark, sf)
    return dedup.restricted_matches(idx, idx, "src1/")


@query("""select event_id, '{"type":"' || event_type || '"' || case when user_id % 2 = 0 then ',"user":"' || user_id || '"' else '' end || '}' as dimensions, '{"level":"INFO","message":"' || event_type || '"' || case when user_id % 2 = 0 then ',"user":' || user_id else '' end || '}' as line from events""")
def json_rows(spark, sf):
    """JSN-04, JSN-05, SNK-07: dimensions of metrics and log entries, without what is null."""
    e = t(spark, sf, "events")
    user = F.when(F.col("user_id") % 2 == 0, F.col("user_id"))
    line = json.log_line(F.lit(None).cast("timestamp"), F.lit("INFO"), F.col("event_type"), {"user": user})
    rows = writers.metric_rows(e.select("event_id", "event_type", "user_id", F.col("event_id").alias("metric_name"), F.col("value").alias("metric_value")), as_of(), {"type": F.col("event_type"), "user": user})
    return rows.select(F.col("metric_name").alias("event_id"), "dimensions").join(e.select("event_id", line.alias("line")), "event_id")


@query("""with l as (select l_orderkey as sha, case when l_linenumber = 2 then 'n' || l_suppkey end as new_name, case when l_linenumber = 3 then l_linestatus end as new_destination,
 row_number() over (partition by l_orderkey order by l_shipdate desc, case when l_linenumber = 2 then 'n' || l_suppkey end desc nulls last, case when l_linenumber = 3 then l_linestatus end desc nulls last) as k from lineitem where l_linenumber <= 3 and l_orderkey % 4 <> 0)
 select o_orderkey as sha, coalesce(new_name, 'old') as name, coalesce(new_destination, 'AIR') as destination, case when l.sha is null then null when new_destination <> 'AIR' then 'override_destination' when new_name <> 'old' then 'rename_correction' else 'approve' end as feedback from orders left join l on l.sha = o_orderkey and k = 1""")
def approved_with_changes(spark, sf):
    """LIF-03: the last approval of each document, what it changes and what kind of feedback that is."""
    p = t(spark, sf, "orders").select(F.col("o_orderkey").alias("sha"), F.lit("old").alias("name"), F.lit("AIR").alias("destination"))
    n = F.col("l_linenumber")
    a = t(spark, sf, "lineitem").where("l_linenumber <= 3 and l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("sha"), F.col("l_shipdate").alias("ts"), F.when(n == 2, F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))).alias("name"), F.when(n == 3, F.col("l_linestatus")).alias("destination"))
    return lifecycle.decisions(p, a)


@query("""select c_custkey as path, max(o_orderkey) as result_id from customer left join orders on o_custkey = c_custkey group by 1""")
def move_records(spark, sf):
    """SNK-09, JN-08: moves of files that were scanned, and of those that never were."""
    m = t(spark, sf, "customer").select(F.col("c_custkey").alias("path"))
    return writers.move_rows(m, t(spark, sf, "orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("path")))


@query("""select event_id as batch, case when user_id % 4 = 3 then null else 199 + user_id % 4 * 50 end as status, user_id % 4 in (1, 2) as ok, case when user_id % 4 = 3 then 'no answer' else '' end as error from events""")
def notification_attempts(spark, sf):
    """SNK-08."""
    u = F.col("user_id") % 4
    sent = t(spark, sf, "events").select(F.col("event_id").alias("batch"), F.lit("http://x").alias("url"), F.when(u != 3, 199 + u * 50).alias("status"), F.when(u == 3, "no answer").alias("error"))
    return writers.attempt_rows(sent, as_of()).select("batch", "status", "ok", "error")


@query("with " + FILE_INDEX + ", g as (select distinct sha256 from file_index where doc_id % 4 = 0) select count(*) as rows, count(*) filter (sha256 not in (select sha256 from g)) as kept, count(*) filter (sha256 in (select sha256 from g)) as deleted from file_index")
def cache_deletes(spark, sf):
    """SNK-03: the rows that stay, and how many go."""
    idx = file_index(spark, sf)
    kept, gone = writers.without(idx, idx.where("doc_id % 4 = 0"), "sha256")
    return stats.dashboard([idx.agg(F.count("*").alias("rows")), kept.agg(F.count("*").alias("kept")), gone])


@query("(select 'pending' as part, o_orderkey as id from orders where o_orderstatus = 'P' order by o_custkey desc, o_orderkey limit 15 offset 3) union all (select 'oldest', o_orderkey from orders order by o_orderdate, o_orderkey limit 10) union all (select 'sizes', cast(round(sum(n_chars) / 1048576.0, 2) * 100 as bigint) from documents)")
def listings(spark, sf):
    """TOP-01 to TOP-03, TOP-05, PRJ-03: pages of sorted tables, and megabytes."""
    o = t(spark, sf, "orders")
    pending = select.chosen(o.withColumn("status", F.when(F.col("o_orderstatus") == "P", "pending")))
    size = t(spark, sf, "documents").agg(F.sum("n_chars").alias("b")).select(F.lit("sizes").alias("part"), F.round(select.size_mb(F.col("b")) * 100).cast("bigint").alias("id"))
    return select.listing(pending, F.desc("o_custkey"), F.col("o_orderkey"), most=15, offset=3).select(F.lit("pending").alias("part"), F.col("o_orderkey").alias("id")).unionAll(
        select.listing(o, F.col("o_orderdate"), F.col("o_orderkey"), most=10).select(F.lit("oldest"), "o_orderkey")).unionAll(size)


@query("with " + LIFECYCLE + ", x as (select sha256 from lifecycle where original_filename like '%scan_12%' order by first_seen_at desc, sha256 limit 1) select sha256(cast(7 as varchar)) as sha256, 'hash' as asked where exists (select 1 from lifecycle where sha256 = sha256('7')) union all select sha256, 'name' from x")
def lookups(spark, sf):
    """FLT-09."""
    rows = life(spark, sf)
    seven = "7902699be42c8a8e46fbbb4501726517e86b22c56a189f7625a6da49081b2451"
    return select.lookup(rows, seven).select("sha256", F.lit("hash").alias("asked")).unionAll(select.lookup(rows, "scan_12").select("sha256", F.lit("name")))


@query("select l_shipdate as batch, count(*) as processed, count(*) filter (l_returnflag <> 'R') as successes, count(*) filter (l_returnflag = 'R') as failures, round(avg(l_discount), 4) as mean_confidence, round(avg(l_quantity), 2) as mean_seconds, count(*) filter (l_linenumber % 2 = 0) as cache_hits from lineitem group by 1")
def batch_means(spark, sf):
    """AGG-16, AGG-17."""
    rows = t(spark, sf, "lineitem").select(F.col("l_shipdate").alias("batch"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_discount").cast("double").alias("confidence"), F.col("l_quantity").cast("double").alias("seconds"), (F.col("l_linenumber") % 2 == 0).alias("cached"))
    return stats.batch_summary(rows)


@query("""with g as (select l_suppkey as destination, count(*) as n, cast(min(1 - l_discount * 5) as double) as a, cast(min(1 - l_tax * 5) as double) as b, count(*) filter (l_returnflag = 'A') as approved from lineitem group by 1), x as (select *, case when abs(a - b) > 0.10 then a else b end as s from g)
 select destination, n, approved, case when s >= 0.85 then 'high' when s >= 0.70 then 'good' when s >= 0.50 then 'medium' else 'low' end as badge from x""")
def destination_badges(spark, sf):
    """AGG-19, RPT-01."""
    rows = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("destination"), (1 - F.col("l_discount") * 5).cast("double").alias("confidence"), (1 - F.col("l_tax") * 5).cast("double").alias("rule_confidence"), (F.col("l_returnflag") == "A").alias("approved"))
    return stats.destinations(rows).select("destination", "n", "approved", "badge")


@query("""select c_nationkey as event, count(*) as files, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as diagnoses, count(distinct c_mktsegment) as n_diagnoses, string_agg(distinct case when c_custkey % 4 > 0 then 'd' || c_custkey % 7 end, ',' order by case when c_custkey % 4 > 0 then 'd' || c_custkey % 7 end) as physicians, count(distinct case when c_custkey % 4 > 0 then 'd' || c_custkey % 7 end) as n_physicians from customer group by 1""")
def event_lists(spark, sf):
    """AGG-23, RPT-03."""
    c = t(spark, sf, "customer").withColumn("physician", F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("d"), (F.col("c_custkey") % 7).cast("string"))))
    out = stats.event_lists(c.withColumnRenamed("c_nationkey", "event"), "event", {"diagnoses": "c_mktsegment", "physicians": "physician"})
    return out.withColumn("n_physicians", F.coalesce("n_physicians", F.lit(0)))


@query("select count(*) filter (p_type <> p_name) as changed, count(*) filter (p_type = p_name) + (select count(*) from part where p_partkey % 3 = 0) as unchanged from part where p_partkey % 3 <> 0")
def plan_changes(spark, sf):
    """AGG-20."""
    p = t(spark, sf, "part")
    return dedup.plan_counts(p.select(F.col("p_type").alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("target")))


@query("with " + SCAN_DOCS + " select doc_id, split_part(path, '/', 3) as section, split_part(path, '/', 4) as child, split_part(path, '/', 5) as name from scan_docs")
def folder_rows(spark, sf):
    """RPT-04 with a row for each file: no folder is one value."""
    p = F.split("path", "/")
    return scan_docs(spark, sf).select("doc_id", F.get(p, F.lit(2)).alias("section"), F.get(p, F.lit(3)).alias("child"), F.get(p, F.lit(4)).alias("name"))


@query("with " + FILE_INDEX + ", l as (select * from file_index where doc_id % 3 <> 0) select path, path in (select path from l) as kept from file_index")
def index_prune(spark, sf):
    """JN-12."""
    idx = file_index(spark, sf)
    kept, gone = dedup.prune(idx, idx.where("doc_id % 3 <> 0"))
    return kept.select("path", F.lit(True).alias("kept")).unionAll(gone.select("path", F.lit(False)))


FIELD_CASES = """with o as (select o_orderkey as k, o_orderdate as d from orders), x as (select k, k % 7 as c, strftime(d, '%m/%d/%Y') as long, strftime(d, '%m/%d/%y') as short, strftime(d, '%Y-%m-%d') as iso, cast(strftime(d, '%Y') as int) as y, d from o)"""


@query(FIELD_CASES + """ select k as doc_id, case c when 0 then iso when 1 then iso when 2 then iso when 3 then iso when 4 then '1990-01-01' when 5 then null else null end as stated,
 case c when 0 then iso when 1 then null when 2 then iso when 3 then iso when 4 then null when 5 then iso else null end as due,
 case c when 0 then 'XK' || lpad(cast(k as varchar), 8, '0') when 3 then 'ABCDE' end as tag, case c when 1 then 'VIN' || lpad(cast(k as varchar), 9, '0') end as vin,
 case c when 0 then 'Recognition' when 1 then 'Evaluation' when 2 then 'Employment' when 3 then 'Recognition' when 4 then 'Employment' else 'Employment' end as employment, case c when 0 then 'Front' when 1 then 'Back' when 2 then 'Back' end as side from x""")
def field_cases(spark, sf):
    """EXT-04, EXT-05, EXT-07, DAT-02 to DAT-04: seven texts with hits, misses, nulls and several hits."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    long, short = F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "MM/dd/yy")
    of = lambda *v: F.element_at(F.array(*v), (k % 7 + 1).cast("int"))
    c = F.lit
    stated = of(F.concat(c("Statement Period 1/1/90 - "), long), F.concat(c("as of 02/03/1991; closing date: "), long), F.concat(c("As of "), short), F.concat(c("Notice date "), F.date_format(d, "MMMM d, yyyy")), c("statement period 12/01/1989 - 01/01/1990 closing date 05/05/1995"), c("Closing date soon"), c(None).cast("string"))
    due = of(F.concat(c("Due date: "), long), F.concat(c("Paid on "), long), F.concat(c("Please pay by Friday, "), short), F.concat(c("amount overdue since "), long), c("Nothing is due here but thanks"), F.concat(c("payment due by mail "), short, c(" due date later")), c(None).cast("string"))
    tag = of(F.concat(c("TAG/DECAL/VESS#: XK"), F.lpad(k.cast("string"), 8, "0")), F.concat(c("vin/hin VIN"), F.lpad(k.cast("string"), 9, "0")), c("TAG/DECAL/VESS# A1"), c("tag\\decal\\vess ABCDE VIN/HIN SHORT"), c("VIN: ABCDEFGHIJK"), c(""), c(None).cast("string"))
    job = of(c("nominated by staff, performance review, award for merit"), c("performance evaluation; meets expectations"), c("award for one, performance review"), c("nominated by peers"), c("contract"), c(""), c(None).cast("string"))
    stem = of(c("19950101_PassFront_x"), c("pass_back"), c("card-reverse"), c("frontier"), c("backup"), c(""), c(None).cast("string"))
    return t(spark, sf, "orders").select(k.alias("doc_id"), dates.statement_date(stated).alias("stated"), dates.due_date(due).alias("due"), fields.vehicle(tag)["tag"].alias("tag"), fields.vehicle(tag)["vin"].alias("vin"), fields.employment_kind(job).alias("employment"), fields.side_in_name(stem).alias("side"))


@query("""select s_suppkey as doc_id, case s_suppkey % 6 when 0 then 'Acme' when 1 then 'Acme' when 2 then 'BoltNut' when 3 then 'BoltNut' when 4 then 'Plain_Name_' || s_suppkey when 5 then 'Unknown' end as folder from supplier""")
def company_folder_cases(spark, sf):
    """EXT-02: forms of one name, legal endings, an unknown one and a missing one."""
    k = F.col("s_suppkey")
    name = F.element_at(F.array(F.lit("ACME, Inc."), F.lit("acme corporation"), F.lit("Bolt & Nut LLC"), F.lit("bolt and nut"), F.concat(F.lit("Plain/Name "), k.cast("string")), F.lit(None).cast("string")), (k % 6 + 1).cast("int"))
    companies = spark.createDataFrame([("Acme Corp", "Acme"), ("BOLT AND NUT", "BoltNut")], "alias string, folder string")
    return select.company_folders(t(spark, sf, "supplier").select(k.alias("doc_id"), name.alias("name")), companies).select("doc_id", "folder")


@query("""with x as (select o_orderkey as k, o_orderkey % 4 as c, o_orderkey % 3 as b from orders) select k as doc_id, case c when 0 then 1.0 when 1 then 0.8 when 2 then 0.875 else 1.0 end::double as score from x where b = 0""")
def metadata_scores(spark, sf):
    """JN-04: five compared fields: equal, one different, one containing the other among four, a blank on one side."""
    k = F.col("o_orderkey")
    base = {"provider": F.concat(F.lit("prov"), k.cast("string")), "description": F.lit("Blood test"), "date": F.lit("2020-01-01"), "person": F.lit("Ada"), "doc_type": F.lit("bill")}
    o = t(spark, sf, "orders").where("o_orderkey % 3 = 0")
    new = o.select(k.alias("doc_id"), F.concat(F.lit("n"), k.cast("string")).alias("path"), *[v.alias(c) for c, v in base.items()])
    old = base | {
        "date": F.when(k % 4 == 1, "2020-02-02").when(k % 4 == 2, "").otherwise(base["date"]), "description": F.when(k % 4 == 2, "blood TEST of May ").when(k % 4 == 3, "").otherwise(base["description"])}
    index = o.select(k.alias("doc_id"), F.concat(F.lit("o"), k.cast("string")).alias("path"), *[v.alias(c) for c, v in old.items()])
    return dedup.metadata_overlap(new, index, least=0.6).select("doc_id", "score")


@query("""with l as (select page_id as doc, string_split(regexp_replace(html, '<(p|li|h1|br)>', chr(10) || case when page_id % 2 = 0 then '' else '- ' end, 'g'), chr(10)) as lines from pages), p as (select doc, unnest(generate_series(1, len(lines))) as i, lines from l), k as (select doc, i, trim(lines[i]) as t from p),
 c as (select doc, i, case when t = '' then 'blank' when starts_with(t, '### ') then 'heading_3' when starts_with(t, '## ') then 'heading_2' when starts_with(t, '# ') then 'heading_1' when regexp_matches(t, '^-{3,}$') then 'divider' when regexp_matches(t, '^[-*] ') then 'bullet' when starts_with(t, '|') then 'table' else 'paragraph' end as kind from k),
 r as (select *, case when kind in ('paragraph', 'table') and kind = lag(kind) over (partition by doc order by i) then 0 else 1 end as new from c), g as (select *, sum(new) over (partition by doc order by i) as run from r),
 q as (select *, case when kind = 'paragraph' then (row_number() over (partition by doc, run order by i) - 1) // 5 else 0 end as part from g), b as (select doc, run, part, kind, count(*) as lines, min(i) as f from q where kind <> 'blank' group by 1, 2, 3, 4), n as (select *, row_number() over (partition by doc order by f) as block from b)
 select doc, block, (block - 1) // 100 as chunk, kind, lines from n""")
def page_blocks(spark, sf):
    """TXT-19, TXT-20: all blocks, paragraphs of five lines at most, chunks of a hundred."""
    marks = F.when(F.col("page_id") % 2 == 0, "\n").otherwise("\n- ")
    text_ = F.regexp_replace(F.col("html"), F.lit("<(p|li|h1|br)>"), marks)
    return pages.typed_blocks(t(spark, sf, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.split(text_, "\n")).alias("i", "line")))


@query("select c_nationkey as folder, bool_and(c_custkey % 9 > 0 or c_nationkey > 12) as numbered from customer group by 1")
def numbered_folders(spark, sf):
    """TXT-16."""
    k = F.col("c_custkey")
    stem = F.when((k % 9 == 0) & (F.col("c_nationkey") <= 12), F.when(k % 2 == 0, "scan_1a")).otherwise(F.concat(F.lit("scan_"), k.cast("string")))
    return pages.numbered_folders(t(spark, sf, "customer").select(F.col("c_nationkey").alias("folder"), stem.alias("stem")))


@query(CLASSIFIED + """select reason, count(*) as n from (select case when length(text) < 20 or doc_id % 11 = 0 then 'weak text' when confidence < 0.6 then 'low confidence' when doc_type = 'business' then 'never' when coalesce(doc_type, '') not in ('prescription', 'lab_requisition', 'bill') then 'not safe'
 when doc_id % 7 = 1 then 'duplicate' when doc_id % 13 = 2 then 'ambiguous' when doc_id % 17 = 3 then 'side open' when person not in ('Ada', 'Bo', 'Cy') then 'unknown person' else 'ok' end as reason from scored) group by reason""")
def approval_reasons(spark, sf):
    """RUL-23 with all of its questions."""
    k = F.col("doc_id")
    d = classified(spark, sf).withColumns({"quality": F.when(k % 11 == 0, 0.1).otherwise(F.lit(None)), "duplicates": F.when(k % 7 == 1, 2), "ambiguous": k % 13 == 2, "needs_side": k % 17 == 3})
    return rules.auto_approve(d, threshold=0.6, people=("Ada", "Bo", "Cy")).groupBy("reason").agg(F.count("*").alias("n"))


@query(CLASSIFIED + """, w as (select doc_id, len(list_intersect(list_distinct(list_filter(regexp_extract_all(low, '[a-z]{3,}'), lambda x: x not in ('date', 'page', 'name', 'number'))), ['patient', 'prescription', 'label', 'total'])) as overlap from scored)
 select s.doc_id, case when overlap >= 3 then 'rx' else doc_type end as doc_type, round(least(1.0, confidence + case when overlap >= 3 then least(0.10, 0.05 + 0.05 * overlap / 4) else 0 end), 4) as confidence, overlap >= 3 as corrected from scored s join w using (doc_id)""")
def corrected_confidence(spark, sf):
    """RUL-21 with RUL-22: the boost of a learned correction, and its type."""
    held = spark.createDataFrame([(1, None, ["patient", "prescription", "label", "total"], "rx", "1998-01-01")], "id long, org_id string, keywords array<string>, corrected_doc_type string, correction_date string")
    return rules.with_corrections(classified(spark, sf), held).select("doc_id", "doc_type", "confidence", "corrected")


@query(CLASSIFIED + """, c(id, kw, corrected, who, spot) as (values (1, ['patient', 'prescription', 'label', 'total'], 'prescription', 'Dee', 'Unknown'), (2, ['account', 'statement', 'credit', 'limit'], 'BILL', 'Unknown', 'Bank'), (3, ['lab', 'requisition', 'fasting'], 'no such type', 'Eve', null)),
 w as (select *, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x not in ('date', 'page', 'name', 'number'))) as words from scored),
 j as (select doc_id, id, corrected, who, spot, len(list_intersect(words, kw)) as overlap, len(kw) as n from w join c on true), b as (select *, row_number() over (partition by doc_id order by overlap desc, id desc) as k from j where overlap >= 3)
 select s.doc_id, case lower(b.corrected) when 'prescription' then 'prescription' when 'bill' then 'bill' else doc_type end as doc_type, coalesce(nullif(b.who, 'Unknown'), person) as person, coalesce(nullif(b.spot, 'Unknown'), provider) as provider,
 case when lower(b.corrected) = 'prescription' and coalesce(doc_type, '') <> 'prescription' then 'Rx' when lower(b.corrected) = 'bill' and coalesce(doc_type, '') <> 'bill' then 'Bill' else label end as label,
 round(least(1.0, confidence + case when b.id is null then 0.0 else least(0.10, 0.05 + 0.05 * overlap / n) end), 4) as confidence, b.id is not null as corrected from scored s left join b on s.doc_id = b.doc_id and b.k = 1""")
def corrected_documents(spark, sf):
    """RUL-22: type with its label, person and provider of the best learned correction; what is unknown corrects nothing."""
    held = spark.createDataFrame(
        [(1, None, ["patient", "prescription", "label", "total"], "prescription", "Dee", "Unknown", "1998-01-01"), (2, None, ["account", "statement", "credit", "limit"], "BILL", "Unknown", "Bank", "1998-01-02"),
         (3, None, ["lab", "requisition", "fasting"], "no such type", "Eve", None, "1998-01-03")],
        "id long, org_id string, keywords array<string>, corrected_doc_type string, corrected_person string, corrected_provider string, correction_date string")
    return rules.with_corrections(classified(spark, sf), held, RULES).select("doc_id", "doc_type", "person", "provider", "label", "confidence", "corrected")


@query("with " + FILE_INDEX + """, x as (select doc_id, path, case when doc_id % 13 = 0 then '' else doc_type end as doc_type, case when doc_id % 4 = 3 then '' else 'day ' || cast(doc_id % 4 as varchar) end as date, person, case when doc_id % 11 = 0 then '' else provider end as p from file_index)
 select d.doc_id, count(*) as n, min(i.path) as first_path from x d join x i on d.path <> i.path and (d.date = '' or i.date = '' or d.date = i.date) and d.person = i.person and (d.doc_type = '' or d.doc_type = i.doc_type or (i.doc_type = '' and i.p = '')) and (d.p = '' or i.p = '' or d.p = i.p)
 where d.person <> '' or d.p <> '' group by 1""")
def metadata_matches(spark, sf):
    """JN-04, JN-05 for every document against the whole index, with blanks in each field, counted without pairs."""
    k = F.col("doc_id")
    idx = file_index(spark, sf).withColumns({
        "doc_type": F.when(k % 13 == 0, "").otherwise(F.col("doc_type")), "date": F.when(k % 4 == 3, "").otherwise(F.concat(F.lit("day "), (k % 4).cast("string"))), "provider": F.when(k % 11 == 0, "").otherwise(F.col("provider"))})
    return dedup.metadata_matches(idx, idx)


# ---- running values, notification, bucketed tables ------------------------------------------------------------------


@query("select doc_id, first_value(hits ignore nulls) over (order by doc_id rows between unbounded preceding and current row) as served from (select doc_id, case when doc_id % 997 = 4 then doc_id end as hits from documents)")
def served_by_one_neighbourhood(spark, sf):
    """WIN-10 where one neighbourhood holds every document."""
    d = t(spark, sf, "documents").select("doc_id", F.lit("all").alias("key"), F.when(F.col("doc_id") % 997 == 4, F.col("doc_id")).alias("hits"))
    return dedup.reuse_neighbours(d).select("doc_id", "served")


@query("""select l_orderkey, l_linenumber, count(*) over w as n, cast(sum(l_quantity) over w as double) as quantity, last_value(case when l_returnflag = 'R' then l_orderkey end ignore nulls) over w as returned
 from lineitem window w as (partition by l_linestatus order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag rows between unbounded preceding and current row)""")
def running_lines(spark, sf):
    """Running count, sum and last known value over two keys that hold all rows (WIN-04, WIN-09)."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    lines = t(spark, sf, "lineitem").select(*order, "l_linestatus", F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("back"))
    out = scan.running(lines, "l_linestatus", order, {"n": ("count", None), "quantity": ("sum", "l_quantity"), "returned": ("last", "back")})
    return out.select("l_orderkey", "l_linenumber", "n", "quantity", "returned")


@query("""with r as (select o_orderkey as doc_id, o_orderpriority as destination, concat('scan_', o_orderkey) as proposed_name, (o_orderkey % 100) / 100.0 as confidence, case when o_orderkey % 11 = 0 then concat('broken ', o_orderkey) end as error, case when o_orderkey % 13 = 0 then 'Whose?' end as question from orders),
 s as (select 'group' as section, destination as name, doc_id as document, proposed_name as note from r where error is null union all select 'error', '', doc_id, error from r where error is not null
  union all select 'ambiguous', '', doc_id, question from r where error is null and question is not null union all select 'review', '', doc_id, printf('%.2f', cast(confidence as double)) from r where error is null and confidence < 0.7),
 k as (select *, count(*) over (partition by section, name) as n, row_number() over (partition by section, name order by document) as position from s)
 select section, name, n, position, document, note, greatest(n - 3, 0) as more from k where n <= 3 or position <= 2 or position = n""")
def notification_table(spark, sf):
    """RPT-01: groups with samples, errors, ambiguous documents and those that need review."""
    key = F.col("o_orderkey")
    return stats.notification(t(spark, sf, "orders").select(
        key.alias("doc_id"), F.col("o_orderpriority").alias("destination"), F.concat(F.lit("scan_"), key.cast("string")).alias("proposed_name"), ((key % 100) / 100).alias("confidence"),
        F.when(key % 11 == 0, F.concat(F.lit("broken "), key.cast("string"))).alias("error"), F.when(key % 13 == 0, F.lit("Whose?")).alias("question")))


@query("""with o as (select o_custkey as key, o_orderkey as seq, o_totalprice as price from orders) select key, max(seq) as seq, arg_max(price, seq) as price from o group by key""")
def bucketed_upserts(spark, sf):
    """SNK-02 to SNK-04: orders upserted by customer in three batches, of which the last comes twice."""
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    store = buckets.BucketTable(spark, f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}", "key", ["seq"], "key long, seq long, price double", buckets=16)
    for number in (0, 1, 2, 2):
        store.upsert(orders.where(F.col("seq") % 3 == number), batch=number)
    return store.read()


@query("""select cast(o_orderkey as varchar) as sha, case when o_orderkey % 5 = 0 then concat('no, ', o_orderpriority) end as deny_reason, case when o_orderkey % 5 = 0 then 'deny' else 'none' end as override_type from orders""")
def deny_reasons(spark, sf):
    """LIF-04: the reason of the last denial; documents that were never denied have none."""
    key = F.col("o_orderkey")
    orders = t(spark, sf, "orders").select(key.alias("k"), key.cast("string").alias("sha"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("n").alias("name"), F.lit("bill").alias("doc_type"), "o_orderpriority")
    event = lambda kind, seq, reason: orders.select("sha", "ts", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), "name", "doc_type", reason.alias("reason"), "k")
    events = event("proposed", 0, F.lit("not a denial's")).unionByName(event("denied", 1, F.lit("first thoughts")).where("k % 10 = 0")).unionByName(event("denied", 2, F.concat(F.lit("no, "), "o_orderpriority")).where("k % 5 = 0"))
    return lifecycle.reduce_events(events).select("sha", "deny_reason", "override_type")


@query("""select sha256(cast(o_orderkey as varchar)) as sha256, o_orderkey % 10 in (3, 4, 9) and o_orderdate < timestamp '1998-08-01 00:00:00' as expired,
 case when o_orderkey % 10 in (3, 4, 9) and o_orderdate < timestamp '1998-08-01 00:00:00' then concat(case when o_orderkey % 2 = 0 then 'seen; ' else '' end, 'expired after 24 hours without approval') when o_orderkey % 2 = 0 then 'seen' end as note from orders join customer on o_custkey = c_custkey""")
def expiry_notes(spark, sf):
    """LIF-06: what has expired says so in its note, behind what the note said before."""
    seen = life(spark, sf).withColumn("note", F.when(F.regexp_extract("original_filename", r"(\d+)", 1).cast("long") % 2 == 0, "seen"))
    return lifecycle.expire(seen, as_of()).select("sha256", "expired", "note")


@query("""select doc_id, case when doc_id % 4 < 2 then concat('text ', source) when doc_id % 4 = 2 then 'by path' end as cached from documents""")
def repeated_cache_keys(spark, sf):
    """SRC-04: each document once, however often the cache has its hash or path; blank texts are no hits."""
    docs = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("sha256"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), "source")
    entry = lambda test, sha, path, words: docs.where(test).select(sha.alias("sha256"), path.alias("path"), words.alias("text"))
    no, text_ = F.lit(None).cast("string"), F.concat(F.lit("text "), "source")
    cache = entry("doc_id % 4 < 2", F.col("sha256"), no, text_).unionByName(entry("doc_id % 4 < 3", F.col("sha256"), no, F.lit("  "))).unionByName(entry("doc_id % 4 = 0", F.col("sha256"), no, text_))
    cache = cache.unionByName(entry("doc_id % 4 < 3", no, F.col("path"), F.lit("by path"))).unionByName(entry("doc_id % 4 = 2", no, F.col("path"), F.lit("by path too")))
    return readers.with_cache(docs.select("doc_id", "sha256", "path"), cache).select("doc_id", "cached")


@query("select o_orderkey, o_custkey, cast(o_totalprice as double) as price from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def third_page(spark, sf):
    """TOP-01, TOP-03: the third page of the dearest orders, each page after the last key of the one before."""
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"))
    order, after = [("price", True), ("o_orderkey", False)], None
    for _ in range(2):
        last = select.page_after(orders, order, after, most=50).collect()[-1]  # a page
        after = (last["price"], last["o_orderkey"])
    return select.page_after(orders, order, after, most=50)


@query("with " + LIFECYCLE + """ select proposed_doc_type as doc_type, count(*) as documents, round(1 - count(*) filter (override_type <> 'none') / count(*), 2) as accuracy,
 round(sum(approval_attempts) filter (approved_at is not null) / count(approved_at), 2) as mean_attempts, round(sum(cast(round(classification_confidence * 10000) as bigint)) / 10000 / count(classification_confidence), 4) as mean_confidence from lifecycle group by 1""")
def merged_statistics(spark, sf):
    """AGG-03 to AGG-08 from sums of three parts, of which one was first counted with other values and then changed."""
    rows = life(spark, sf).withColumn("part", F.crc32("sha256") % 3)
    was = rows.where("part = 2").withColumns({"proposed_doc_type": F.lit("5-LOW"), "override_type": F.lit("deny")})
    stored = stats.merge_tallies(stats.tally(rows.where("part = 0")), stats.tally(rows.where("part = 1")), stats.tally(was))
    return stats.of_tallies(stats.merge_tallies(stored, stats.tally(was, -1), stats.tally(rows.where("part = 2"))))


@query("""with q as (select cast(event_id as varchar) as file, case event_id % 4 when 0 then 'queued' when 1 then 'done' else 'working' end as status, ts as since, cast(event_id % 3 + 1 as int) as attempts, ts < (select max(ts) from events) - interval 30 minute as old from events where event_id % 5 <> 0)
 select file, case when status = 'working' and old then case when attempts >= 3 then 'dead' else 'queued' end else status end as status, case when status = 'working' and old and attempts < 3 then attempts + 1 else attempts end as attempts,
 case when status = 'working' and old and attempts >= 3 then 'given up after 3 attempts' end as note from q union all select cast(event_id as varchar), 'queued', 1, null from events where event_id % 5 = 0""")
def retry_queue(spark, sf):
    """STR-06: stuck files go back to the queue or are given up; late files join it."""
    events = t(spark, sf, "events").withColumn("file", F.col("event_id").cast("string"))
    kind = F.when(F.col("event_id") % 4 == 0, "queued").when(F.col("event_id") % 4 == 1, "done").otherwise("working")
    queue = events.where("event_id % 5 <> 0").select("file", kind.alias("status"), F.col("ts").alias("since"), (F.col("event_id") % 3 + 1).cast("int").alias("attempts"), F.lit(None).cast("string").alias("note"))
    newest = events.agg(F.max("ts")).first()[0]
    arrivals = events.select("file", "ts")  # files that the queue knows come again too
    return inbox.merged_arrivals(inbox.requeued(queue, F.lit(newest)), arrivals).select("file", "status", "attempts", "note")


# ---- index upkeep ---------------------------------------------------------------------------------------------------

LINES = """with n as (select l_returnflag || '/' || l_linestatus || '/' || cast(l_suppkey % 10 as varchar) as dir, cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as file, l_suppkey % 10 as s, l_returnflag as r from lineitem group by all),
 f as (select *, not (r = 'R' and s = 7) as now, not (r = 'N' and s = 5) as was, s = 3 and r = 'A' as moved from n)"""


def line_files(spark, sf):
    """(listing, index): lines as files of folders, of which some are new, gone or changed."""
    k, r = F.col("l_suppkey") % 10, F.col("l_returnflag")
    path = F.concat_ws("/", r, "l_linestatus", k.cast("string"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    f = t(spark, sf, "lineitem").groupBy(path.alias("path"), k.alias("s"), r.alias("r")).agg(F.min("l_shipdate").alias("mtime"), F.max("l_quantity").cast("long").alias("size"))
    moved = F.when((F.col("s") == 3) & (F.col("r") == "A"), F.col("mtime") - F.expr("interval 1 day")).otherwise(F.col("mtime"))
    listing = f.where("not (r = 'R' and s = 7)").select("path", "mtime", "size")
    return listing, f.where("not (r = 'N' and s = 5)").select("path", moved.alias("mtime"), "size")


@query(LINES + """, a as (select unnest(['', split_part(dir, '/', 1), split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2), dir]) as folder, now, was, moved from f)
 select folder, case when count(*) filter (was) = 0 then 'new' when count(*) filter (now) = 0 then 'gone' when count(*) filter (now <> was or moved) > 0 then 'changed' else 'same' end as state, count(*) filter (now) as n, count(*) filter (was) as n_before from a group by 1""")
def folder_states(spark, sf):
    """JN-13: which folders, at every level, have changed, by their digests."""
    return indexing.folder_states(*map(indexing.folder_digests, line_files(spark, sf)))


@query(LINES + """, c as (select dir from f group by 1 having count(*) filter (now <> was or moved) > 0)
 select dir || '/' || file as path, case when not was then 'new' when not now then 'gone' when moved then 'changed' else 'unchanged' end as state from f join c using (dir)""")
def folder_delta(spark, sf):
    """JN-13: files of folders that have changed; the others are skipped."""
    return indexing.folder_delta(*line_files(spark, sf))


INDEX_BUILD = "with " + FILE_INDEX + """, r as (select *, doc_id % 5 <> 0 as listed, doc_id % 7 <> 0 as known, doc_id % 4 = 1 as touched, doc_id % 11 <> 0 as readable, doc_id % 3 = 0 as sided from file_index),
 b as (select *, case when known and not touched then 'unchanged' when not readable then 'error' when known then 'changed' else 'new' end as state from r where listed)"""


def index_parts(spark, sf):
    """(listing, index, hashes, sidecars) of documents as files."""
    k, day = F.col("doc_id"), F.lit("2024-01-02").cast("timestamp")
    f = file_index(spark, sf).withColumn("mtime", day)
    old = f.where("doc_id % 7 <> 0").select(
        "path", F.concat(F.lit("old "), "sha256").alias("sha256"), "size", F.when(k % 4 == 1, day - F.expr("interval 1 hour")).otherwise(day).alias("mtime"), F.lit("{}").alias("meta"), F.lit("old").alias("ocr_hash"),
        F.lit(True).alias("has_meta"), F.lit(False).alias("has_ocr"), F.lit("old provider").alias("provider"), F.lit("").alias("person"), F.lit("").alias("doc_type"))
    meta = F.to_json(F.struct(F.concat(F.lit(" "), F.upper("provider")).alias("provider"), F.col("person").alias("patient"), "doc_type"))
    side = f.where("doc_id % 3 = 0").select("path", meta.alias("meta"), F.lit(None).cast("string").alias("ocr"), F.lit(True).alias("has_meta"), F.lit(False).alias("has_ocr"))
    return f.where("doc_id % 5 <> 0").select("path", "size", "mtime"), old, f.where("doc_id % 11 <> 0").select("path", "sha256"), side


@query(INDEX_BUILD + """ select path, state, case when state in ('unchanged', 'error') then 'old ' || sha256 else sha256 end as sha256, case when state <> 'error' and sided then lower(provider) when state in ('unchanged', 'error') then 'old provider' end as provider,
 state in ('unchanged', 'error') or sided as has_meta, state <> 'error' and sided as sidecar_found from b where state <> 'error' or known""")
def refreshed_index(spark, sf):
    """JN-13: new and changed files are hashed, unchanged ones keep their hash, sidecars are taken anew; unreadable files keep their row."""
    return indexing.refreshed(*index_parts(spark, sf)).select("path", "state", "sha256", "provider", "has_meta", "sidecar_found")


@query(INDEX_BUILD + " select count(*) filter (state in ('new', 'changed')) as indexed, count(*) filter (state = 'unchanged') as skipped, count(*) filter (state = 'error') as errors, count(*) filter (state <> 'error' and sided) as sidecars_found from b")
def index_statistics(spark, sf):
    """JN-13: what a run over the listing has done."""
    parts = index_parts(spark, sf)
    return indexing.build_statistics(indexing.refreshed(*parts), parts[0])
