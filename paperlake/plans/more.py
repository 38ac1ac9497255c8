"""Further registered queries: selections, reports, plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import proposals, select
from .catalog import CLASSIFIED, as_of, classified, query
from .views import AS_OF, FILE_INDEX, LIFECYCLE, SCAN_DOCS, file_index, scan_docs, t
from .views import lifecycle as life


@query("with " + FILE_INDEX + ", p as (select sha256 from file_index where doc_id % 4 in (0, 1)) select doc_id from file_index where sha256 not in (select sha256 from p)")
def unprocessed_documents(spark, sf):
    status = F.when(F.col("doc_id") % 4 == 0, "approved").when(F.col("doc_id") % 4 == 1, "denied").otherwise("pending")
    idx = file_index(spark, sf)
    return select.unprocessed(idx, idx.select("sha256", status.alias("status"))).select("doc_id")


@query("select doc_id from documents where doc_id % 3 = 0 or doc_id % 4 = 0")
def files_without_sidecars(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3 != 0).alias("has_ocr"), (F.col("doc_id") % 4 != 0).alias("has_meta"))
    return select.missing_sidecars(d).select("doc_id")


@query("select event_id as id, event_type as level, ts from events where event_type = 'click' order by ts desc, event_id desc limit 50")
def last_log_lines(spark, sf):
    log = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("level"), "ts")
    return select.log_lines(log, level="click", last=50)


@query("select event_id, event_type as name, ts from events where event_type = 'view' and ts >= timestamp '2024-01-15 00:00:00'")
def optional_predicates(spark, sf):
    rows = t(spark, sf, "events").select("event_id", F.col("event_type").alias("name"), "ts")
    return select.optional(rows, name="view", since="2024-01-15 00:00:00")


@query(CLASSIFIED + "select needs_review, count(*) as n from (select confidence < 0.7 or doc_type is null or doc_id % 17 = 0 as needs_review from scored) group by 1")
def review_split(spark, sf):
    return select.needs_review(classified(spark, sf).withColumn("ambiguous", F.col("doc_id") % 17 == 0)).groupBy("needs_review").agg(F.count("*").alias("n"))


@query("""with q as (select doc_id, n_chars % 10 / 10.0 as q1, doc_id % 10 / 10.0 as q2, case when doc_id % 6 = 0 then 'image' else 'native' end as source from documents) select doc_id, case when q1 < 0.3 and q2 > q1 and source <> 'image' then 'second' else 'first' end as chosen from q""")
def better_texts(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 10 / F.lit(10.0)).alias("q1"), (F.col("doc_id") % 10 / F.lit(10.0)).alias("q2"), F.when(F.col("doc_id") % 6 == 0, "image").otherwise("native").alias("source"), F.lit("first").alias("text1"), F.lit("second").alias("text2"))
    return select.better_text(d).select("doc_id", "chosen")


@query("""select s_suppkey as doc_id, case s_suppkey % 3 when 0 then 'Acme' when 1 then 'BoltNut' else 'Plain_Name_' || s_suppkey end as folder from supplier""")
def company_folders(spark, sf):
    k = F.col("s_suppkey")
    d = t(spark, sf, "supplier").select(k.alias("doc_id"), F.when(k % 3 == 0, "ACME, Inc.").when(k % 3 == 1, "Bolt & Nut LLC").otherwise(F.concat(F.lit("Plain Name "), k.cast("string"))).alias("name"))
    companies = spark.createDataFrame([("Acme Corp", "Acme"), ("BOLT AND NUT", "BoltNut")], "alias string, folder string")
    return select.company_folders(d, companies).select("doc_id", "folder")


@query("""with s as (select distinct c_mktsegment as section from customer) select section, row_number() over (order by case section when 'MACHINERY' then 1 when 'BUILDING' then 2 else 3 end, section) as place from s""")
def section_order(spark, sf):
    return select.section_order(t(spark, sf, "customer").select(F.col("c_mktsegment").alias("section")).distinct(), ("MACHINERY", "BUILDING"))


@query("select o_custkey as batch, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as row_id from orders")
def batch_row_ids(spark, sf):
    return select.batch_ids(t(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), "o_orderkey"), "batch", "o_orderkey").withColumn("row_id", F.col("row_id").cast("bigint"))


@query("with b as (select arg_max(user_id, (ts, user_id)) as batch from events) select user_id as batch, event_id from events where user_id = (select batch from b)")
def latest_batch(spark, sf):
    return select.latest_batch(t(spark, sf, "events").select(F.col("user_id").alias("batch"), "ts", "event_id")).select("batch", "event_id")


@query("""with f as (select doc_id, source || '/' || doc_id || '.txt' as path, doc_id || '.txt' as file, source as top from documents) select path, case top when 'src1' then 'one/sub' when 'src2' then 'two' else top end || '/' || case when doc_id % 10 = 3 then 'new' || doc_id else file end as target from f""")
def rename_plan(spark, sf):
    d = t(spark, sf, "documents")
    files = d.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"))
    own = d.where("doc_id % 10 = 3").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), "doc_id")
    names = own.select("file", F.lit("old").alias("new_name"), F.lit(0).alias("ord")).unionByName(own.select("file", F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("new_name"), F.lit(1).alias("ord")))
    return select.rename_plan(files, names, spark.createDataFrame([("src1", "one/sub"), ("src2", "two")], "top string, sub string"))


@query("with " + SCAN_DOCS + " select doc_id, case when contains(lower(text), '0000007') then 'Ada' when contains(lower(text), 'household') or contains(lower(text), '12 ') then 'Bo' else 'Cy' end as person from scan_docs where contains(lower(text), '0000007') or contains(lower(text), 'household') or contains(lower(text), '12 ') or contains(lower(text), 'building')")
def people_in_text(spark, sf):
    people = spark.createDataFrame([(0, 0, "Ada", "0000007"), (1, 0, "Bo", "HOUSEHOLD"), (1, 1, "Bo", "12 "), (2, 0, "Cy", "Building")], "ord int, alias_ord int, person string, alias string")
    return select.expand_person(scan_docs(spark, sf), people)


@query("select role, case when role in ('user', 'assistant') then 'talk' else role end as g, count(*) as n from conversations group by 1, 2")
def related_types(spark, sf):
    role = F.col("role")
    as_type = F.when(role == "user", "bill").when(role == "assistant", "receipt").otherwise(role)
    return t(spark, sf, "conversations").groupBy("role", F.regexp_replace(select.related_group(as_type), "^money$", "talk").alias("g")).agg(F.count("*").alias("n"))


@query("with " + LIFECYCLE + """, a as (select count(*) as documents, count(*) filter (approved_at is null) as pending, cast(date_diff('second', min(first_seen_at), timestamp '""" + AS_OF + """') // 86400 as bigint) as oldest_days from lifecycle),
 b as (select count(*) as indexed, count(*) filter (doc_id % 3 <> 0) as with_text from documents), c as (select count(*) filter (value < 10) as failed from events) select * from a, b, c""")
def status_dashboard(spark, sf):
    """One row of small aggregates."""
    a = life(spark, sf).agg(F.count("*").alias("documents"), F.count_if(F.col("approved_at").isNull()).alias("pending"), F.floor((F.unix_seconds(as_of()) - F.unix_seconds(F.min("first_seen_at").cast("timestamp"))) / 86400).alias("oldest_days"))
    b = t(spark, sf, "documents").agg(F.count("*").alias("indexed"), F.count_if(F.col("doc_id") % 3 != 0).alias("with_text"))
    c = t(spark, sf, "events").agg(F.count_if(F.col("value") < 10).alias("failed"))
    one = F.lit(1).alias("_k")
    return a.select("*", one).join(b.select("*", one), "_k").join(c.select("*", one), "_k").drop("_k")


@query("""select l_shipmode as source, n from (select case l_linenumber % 3 when 0 then 'ocr' when 1 then 'native' else 'name' end as l_shipmode, count(*) as n from lineitem group by 1)""")
def method_counts(spark, sf):
    k = F.col("l_linenumber") % 3
    return t(spark, sf, "lineitem").groupBy(F.when(k == 0, "ocr").when(k == 1, "native").otherwise("name").alias("source")).agg(F.count("*").alias("n"))


@query("select o_custkey as batch, count(*) as processed, count(*) filter (o_orderstatus <> 'P') as successes, count(*) filter (o_orderstatus = 'P') as failures, round(avg(o_totalprice), 2) as mean_duration, count(*) filter (o_orderkey % 2 = 0) as cache_hits from orders group by 1")
def batch_summary(spark, sf):
    return t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(
        F.count("*").alias("processed"), F.count_if(F.col("o_orderstatus") != "P").alias("successes"), F.count_if(F.col("o_orderstatus") == "P").alias("failures"), F.round(F.avg("o_totalprice"), 2).alias("mean_duration"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("cache_hits"))


@query("select case when value >= 70 then 'high' when value >= 50 then 'medium' else 'low' end as tier, count(*) as n, round(sum(value), 2) as total, round(avg(value), 2) as mean from events group by 1")
def scan_tiers(spark, sf):
    tier = dates.band(F.col("value"), ((70.0, "high"), (50.0, "medium")), "low")
    return t(spark, sf, "events").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 2).alias("mean"))


@query("select n_name as folder, count(*) as files, min(o_orderdate) as oldest from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def oldest_per_folder(spark, sf):
    d = scan_docs(spark, sf)
    return d.groupBy(F.element_at(F.split("path", "/"), 3).alias("folder")).agg(F.count("*").alias("files"), F.min("mtime").alias("oldest"))


@query("with " + SCAN_DOCS + " select split_part(path, '/', 3) as section, split_part(path, '/', 4) as child, count(*) as files, string_agg(split_part(path, '/', 5), ',' order by path) as names from scan_docs group by 1, 2")
def folder_index(spark, sf):
    parts = F.split("path", "/")
    d = scan_docs(spark, sf).select(F.get(parts, F.lit(2)).alias("section"), F.get(parts, F.lit(3)).alias("child"), F.get(parts, F.lit(4)).alias("name"))
    return d.groupBy("section", "child").agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@query("select c_nationkey as event, count(*) as files, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as diagnoses from customer group by 1")
def event_index(spark, sf):
    return t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("event")).agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("diagnoses"))


@query("with " + LIFECYCLE + " select sha256, case when approved_at is null then null when override_type = 'none' then 'approve' when override_type = 'redirect' then 'override_destination' when override_type in ('rename', 'retype') then 'rename_correction' end as feedback from lifecycle")
def decision_feedback(spark, sf):
    kind = F.when(F.col("approved_at").isNull(), None).when(F.col("override_type") == "none", "approve").when(F.col("override_type") == "redirect", "override_destination").when(F.col("override_type").isin("rename", "retype"), "rename_correction")
    return life(spark, sf).select("sha256", kind.alias("feedback"))


@query("select sha256(cast(o_orderkey as varchar)) as sha256, len(list(l_linenumber)) as attempts, string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber) as numbers from orders left join lineitem on o_orderkey = l_orderkey where o_orderkey % 3 = 0 group by o_orderkey")
def nested_history(spark, sf):
    from ..operators.lifecycle import history

    o = t(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("sha"))
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("attempt"), F.lit("n").alias("name"), F.lit("s").alias("status"))
    out = history(o, li)
    numbers = F.nullif(F.array_join(F.transform("attempts", lambda a: a["attempt"].cast("string")), ","), F.lit(""))
    return out.select(F.sha2(F.col("sha").cast("string"), 256).alias("sha256"), F.coalesce(F.nullif(F.size("attempts"), F.lit(-1)), F.lit(1)).cast("bigint").alias("attempts"), numbers.alias("numbers"))


@query("select sha256(cast(o_orderkey as varchar)) as sha256, len(list(l_linenumber)) as attempts, string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber) as numbers from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def nested_history_of_all(spark, sf):
    from ..operators.lifecycle import history

    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("sha"))
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("attempt"), F.lit("n").alias("name"), F.lit("s").alias("status"))
    out = history(o, li)
    numbers = F.nullif(F.array_join(F.transform("attempts", lambda a: a["attempt"].cast("string")), ","), F.lit(""))
    return out.select(F.sha2(F.col("sha").cast("string"), 256).alias("sha256"), F.coalesce(F.nullif(F.size("attempts"), F.lit(-1)), F.lit(1)).cast("bigint").alias("attempts"), numbers.alias("numbers"))


@query("select o_custkey as path, max(o_orderkey) as result_id from orders group by 1")
def newest_result_per_path(spark, sf):
    return t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.max("o_orderkey").alias("result_id"))


@query("select o_orderkey as id, case when row_number() over (partition by o_custkey order by o_orderkey desc) = 1 and o_orderstatus = 'P' then 'done' else o_orderstatus end as status from orders")
def update_newest_pending(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    o = t(spark, sf, "orders").withColumn("_k", F.row_number().over(w))
    return o.select(F.col("o_orderkey").alias("id"), F.when((F.col("_k") == 1) & (F.col("o_orderstatus") == "P"), "done").otherwise(F.col("o_orderstatus")).alias("status"))


@query("""select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title, substr(sha256(html), 1, 16) as hash, len(regexp_extract_all(html, '<p>')) as paragraphs, length(html) / 1048576.0 >= 0.01 as large from pages""")
def note_pages(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), text.short_hash(F.col("html")).alias("hash"), F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"), (F.length("html") / 1048576 >= 0.01).alias("large"))


@query("with k as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) as w from documents) select a.doc_id, len(list_intersect(a.w, b.w)) as shared from k a join k b on b.doc_id = a.doc_id + 1")
def shared_keywords(spark, sf):
    """Keyword overlap of each document with the next one."""
    k = t(spark, sf, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    nxt = k.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return k.join(nxt, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).cast("bigint").alias("shared"))


@query("with " + SCAN_DOCS + """ select doc_id, case when contains(lower(text), 'credit limit') then 'BusinessCreditCard' when doc_id % 4 = 1 then 'Tax' end as kind, case when doc_id % 3 = 0 and doc_id % 2 = 1 then 'personal?' end as question,
 case when contains(lower(text), 'invoice') then case when contains(lower(text), '000001') then 'One' else 'Zero' end else 'Me' end as person from scan_docs""")
def proposal_branches(spark, sf):
    """Business kind, open question and patient of every scanned document."""
    d = scan_docs(spark, sf).withColumn("low", F.concat(F.lower("text"), F.when(F.col("doc_id") % 4 == 1, " internal revenue service").otherwise("")))
    seen = proposals.patient(F.col("low"), (("One", ("000001",)), ("Zero", ("customer#",))))
    # "customer#" stands before its number, so the nearest alias is Zero; a text with 000001 is asked for it alone
    one = proposals.patient(F.col("low"), (("One", ("000001",)),))
    kind = F.when(F.col("low").contains("invoice"), "bill").otherwise("other")
    return d.select("doc_id", proposals.business_kind(F.col("low"), F.lit(True)).alias("kind"), proposals.ambiguity(F.col("doc_id") % 3 == 0, F.lit("personal?"), F.when(F.col("doc_id") % 2 == 0, "Acme")).alias("question"),
                    proposals.prefer_patient(kind, F.coalesce(one, seen), F.lit("Me")).alias("person"))
