"""Views over the given tables that stand for scanned documents, their lifecycle and their index, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import OrgRule, Rules, TypeRule

AS_OF = "1998-08-02 00:00:00"


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scan_docs(spark: SparkSession, sf: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    body = (
        F.when(key % 5 == 0, "Invoice amount due $").when(key % 5 == 1, "Prescription label total $").when(key % 5 == 2, "Lab requisition fasting $")
        .when(key % 5 == 3, "Account number 12 statement period closing date credit limit $").otherwise("Note $"))
    joined = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        key.alias("doc_id"),
        F.concat(F.lit("/inbox/"), "n_name", F.lit("/"), F.year("o_orderdate").cast("string"), F.lit("/Scan"), day, F.lit("_"), F.lpad((key % 1000000).cast("string"), 6, "0"), F.lit(".pdf")).alias("path"),
        F.concat(F.lit("Patient: "), "c_name", F.lit(" DOB: 01/02/1980 "), body, F.floor("o_totalprice").cast("bigint").cast("string"), F.lit(".00 date "), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" page "), (key % 4 + 1).cast("string"), F.lit(" of 4 "), "c_mktsegment").alias("text"),
        F.col("o_orderdate").alias("mtime"))


SCAN_DOCS = """scan_docs as (
select o_orderkey as doc_id,
       concat('/inbox/', n_name, '/', cast(year(o_orderdate) as varchar), '/Scan', strftime(o_orderdate, '%Y-%m-%d'), '_', lpad(cast(o_orderkey % 1000000 as varchar), 6, '0'), '.pdf') as path,
       concat('Patient: ', c_name, ' DOB: 01/02/1980 ',
              case o_orderkey % 5 when 0 then 'Invoice amount due $' when 1 then 'Prescription label total $' when 2 then 'Lab requisition fasting $'
                   when 3 then 'Account number 12 statement period closing date credit limit $' else 'Note $' end,
              cast(cast(floor(o_totalprice) as bigint) as varchar), '.00 date ', strftime(o_orderdate, '%m/%d/%Y'), ' page ', cast(o_orderkey % 4 + 1 as varchar), ' of 4 ', c_mktsegment) as text,
       o_orderdate as mtime
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.when(key % 10 == 0, "retype").when(key % 10 == 1, "rename").when(key % 10 == 2, "redirect").when(key % 10 == 3, "deny").when(key % 10 == 4, "expired").otherwise("none")
    return t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.sha2(key.cast("string"), 256).alias("sha256"), F.concat(F.lit("scan_"), key.cast("string"), F.lit(".pdf")).alias("original_filename"), F.col("o_orderdate").alias("first_seen_at"),
        F.col("o_orderpriority").alias("proposed_doc_type"), F.when(key % 7 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("final_doc_type"), kind.alias("override_type"),
        F.when(~(key % 10).isin(3, 4, 9), F.col("o_orderdate") + F.expr("interval 1 day")).alias("approved_at"), (key % 4 + 1).cast("int").alias("approval_attempts"),
        ((key % 100).cast("double") / 100).alias("classification_confidence"), F.concat(F.lower("o_orderpriority"), F.lit(":"), F.lower("c_mktsegment")).alias("rule_match_id"))


LIFECYCLE = """lifecycle as (
select sha256(cast(o_orderkey as varchar)) as sha256, concat('scan_', cast(o_orderkey as varchar), '.pdf') as original_filename, o_orderdate as first_seen_at, o_orderpriority as proposed_doc_type,
       case when o_orderkey % 7 = 0 then '1-URGENT' else o_orderpriority end as final_doc_type,
       case o_orderkey % 10 when 0 then 'retype' when 1 then 'rename' when 2 then 'redirect' when 3 then 'deny' when 4 then 'expired' else 'none' end as override_type,
       case when o_orderkey % 10 in (3, 4, 9) then null else o_orderdate + interval '1' day end as approved_at, cast(o_orderkey % 4 + 1 as int) as approval_attempts,
       cast(o_orderkey % 100 as double) / 100 as classification_confidence, concat(lower(o_orderpriority), ':', lower(c_mktsegment)) as rule_match_id
from orders join customer on o_custkey = c_custkey)"""


def file_index(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"),
        F.sha2(F.substring("text", 1, 64), 256).alias("prefix_hash"), F.substring(F.sha2(F.lower(F.trim("text")), 256), 1, 16).alias("text_hash"),
        F.col("source").alias("provider"), F.col("lang").alias("person"), F.concat(F.lit("type"), (F.col("doc_id") % 3).cast("string")).alias("doc_type"),
        F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit("/"), (F.col("doc_id") + 1).cast("string"), F.lit(".txt")).alias("target"))


FILE_INDEX = """file_index as (
select doc_id, concat(source, '/', cast(doc_id as varchar), '.txt') as path, sha256(text) as sha256, n_chars as size, sha256(substr(text, 1, 64)) as prefix_hash, substr(sha256(lower(trim(text))), 1, 16) as text_hash,
       source as provider, lang as person, concat('type', cast(doc_id % 3 as varchar)) as doc_type, concat('src', cast(doc_id % 20 as varchar), '/', cast(doc_id + 1 as varchar), '.txt') as target
from documents)"""

#: Made-up rules: documents are matched against the tables' own words.
RULES = Rules(
    types=(
        TypeRule("bill", ("invoice", "amount due"), "Bill", {"default": "Bill", "Insurance": "InsuranceBill"}),
        TypeRule("prescription", ("prescription", "rx"), "Medical", {"default": "Rx"}),
        TypeRule("lab_requisition", (r"lab\s+requisition",), "Lab", {"default": "LabReq"}),
        TypeRule("insurance", ("credit limit",), "Insurance", {"default": "Policy"}),
        TypeRule("business", ("account number",), "Business", {"default": "Statement"}),
    ),
    orgs=(
        OrgRule("autohaus", ("automobile",), "Insurance", folder_alias="Auto Haus"),
        OrgRule("buildco", ("building",), "Business", destination="Companies/Build/"),
        OrgRule("furnish", ("furniture",), "Medical"),
        OrgRule("homecare", ("household",), "Medical", folder_alias="Home-Care"),
        OrgRule("patients", ("patient",), "Lab"),
    ),
    people=(("Ada", ("customer#000000001", "customer#000000007")), ("Bo", ("customer#00000000",)), ("Cy", ("customer#0000000",))),
    routes={"Bill": "Finance/{provider}/{year}/", "Medical": "Health/{person}/{month}/{clinic}/", "Lab": "Health/{person}/Lab/", "Business": "Companies/{provider}//{year}"},
    archives={"Bill": "Archive/{year}/Finance/{provider}/"},
    current_year=1996,
)
