"""Classification from a rules document, with nulls and blanks; corrections, moves, JSON."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperlake.functions import dates, fields, json, text
from paperlake.operators import classification, learning, lifecycle, proposals, rules
from paperlake.plans.cases import CASES
from paperlake.plans.cases import RULES as CASE_RULES

DOCUMENT = {
    "current_year": 2024,
    "document_types": [{"id": "bill", "patterns": ["invoice"], "labels": {"default": "Bill"}}, {"id": "vehicle", "patterns": [r"\btag\b"]}],
    "organizations": [{"id": "a", "names": ["Acme"], "category": "Business", "folder_alias": "ACME"}],
    "people": [{"name": "Ann", "aliases": ["ann smith"]}],
    "routing": {"category_routing": {"Bill": {"template": "Finance/{year}/"}}, "folders": [{"pattern": "/cars/", "doc_type": "Vehicle"}], "path_people": [{"pattern": "/bo/", "person": "Bo"}], "business_companies": [{"folder": "Acme", "match": ["ACME INC"]}]},
}


def one(spark, text_, path="/x/y.pdf", mtime=dt.datetime(2020, 1, 2), document=None):
    docs = spark.createDataFrame([(1, path, text_, mtime)], "doc_id long, path string, text string, mtime timestamp")
    return classification.classify(docs, rules.rules_of(document or DOCUMENT)).first()


def test_rules_document(spark):
    r = one(spark, "Invoice of Acme for Ann Smith 03/04/2021", "/bo/y.pdf")
    # the path's person comes before the text's, as folder facts do
    assert (r["doc_type"], r["org"], r["person"], r["doc_date"], r["destination"]) == ("bill", "a", "Bo", "2021-03-04", "Finance/2021/")
    r = one(spark, "tag only", "/cars/z.pdf")
    assert (r["doc_type"], r["rule_confidence"], r["rule_match_id"]) == ("vehicle", 0.72, "vehicle:no-org")


@pytest.mark.parametrize("value", [None, "", "  \n\t "])
def test_no_text(spark, value):
    r = one(spark, value)
    assert (r["doc_type"], r["label"], r["rule_match_id"], r["proposed_name"], r["confidence"]) == (None, "Unknown", "fallback-folder", "2020-01-02_Unknown_Shared.pdf", 0.10)
    assert one(spark, value, "/x/invoice.pdf")["doc_type"] == "bill"


def test_empty_rules(spark):
    r = one(spark, "anything at all", document={"routing": {}})
    assert r["doc_type"] is None and r["destination"] == "Inbox/Unsorted/"


def test_every_case_is_reached():
    assert len({(c.text, c.path) for c in CASES}) == len(CASES) and {c.doc_type for c in CASES} >= {r.id for r in CASE_RULES.types} - {"medical_record"}


def values(spark, f, *rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_first_date_that_is_no_birth(spark):
    got = values(spark, dates.document_date, "DOB: 01/02/1980 seen 03/04/2019 or so", "DOB: 01/02/1980, and much later than that 05/06/2019 came", "born : 2001-02-03 1/2/99 04/05/20", "date of birth:\n02/03/1999", "99/99/99 2020-01-02", None, "", "12/13/2014-15",
                 "birthday: 01/01/01 02/02/2002")
    # a second date within thirty characters of the mark is one of birth too; a line's end cuts the mark off
    assert got == [None, "2019-05-06", None, "1999-02-03", "2020-01-02", None, None, "2014-12-13", None]


def test_walk(spark):
    walk = lambda p: values(spark, lambda c: fields.folder_walk(c, CASE_RULES), p)[0]
    r = walk("/in/Garden Shop/2001 old/20190304 Scan Trip/x.pdf")
    assert (r["date"], r["year"], r["event"], r["company"]) == ("2019-03-04", "2019", "Trip", "garden shop")
    r = walk("/in/credit card/2019-2020/2020-05-06/x.pdf")
    assert (r["date"], r["year"], r["date_range"], r["subcategory"], r["event"]) == ("2020-05-06", "2019", "2019-2020", "CreditCard", "credit_card")
    assert walk("x.pdf")["date"] is None and walk("")["event"] is None


def test_papers_and_kinds(spark):
    assert values(spark, proposals.company_paper, "cp 575 form 2553", "accepted: s corporation", "s corporation election", "tracking number document number", "tracking number", "ein 12", "", None) == ["EINConfirmation", "SCorporationElection", "SCorporationElection", "GovernmentFiling", None, "EINConfirmation", None, None]
    kind = lambda c: proposals.business_kind(c, F.lit(True))
    assert values(spark, kind, "minimum payment due and new balance", "minimum payment due", "the irs wrote", "first", "checking account credit limit") == ["BusinessCreditCard", None, "Tax", None, "BusinessChecking"]
    people = (("Ann", ("ann",)), ("Bo", ("bo",)))
    assert values(spark, lambda c: proposals.patient(c, people), "for ann, patient: bo 12", "patient ... bo then ann", "ann", None) == ["Bo", "Bo", None, None]
    assert values(spark, fields.plate, "Plate number: AB12", "tag#: 9", "") == ["AB12", None, None]
    drugs = lambda c: fields.medication(c, (("acme pill", "Acmeol"),))["generic"]
    assert values(spark, drugs, "MEDICATION ACMEX 5 MG GENERIC INGREDIENT: Other", "GENERIC INGREDIENT: acme pill Tablets", None) == ["Acmex", "Acmeol", None]


def test_json(spark):
    back = lambda c: json.keywords_from_json(c)
    assert values(spark, back, '["a","b"]', "{broken", None, "[]") == [["a", "b"], [], [], []]
    assert values(spark, lambda c: json.keywords_to_json(F.split(c, " ")), "a b", None) == ['["a","b"]', "[]"]
    assert values(spark, lambda c: json.dimensions({"x": c, "n": F.lit(1)}), "v", None) == ['{"x":"v","n":"1"}', '{"n":"1"}']
    assert values(spark, lambda c: json.log_line(F.lit(None), F.lit("INFO"), c, {"sha": F.lit(None).cast("string")}), "hi") == ['{"level":"INFO","message":"hi"}']


def test_corrections_and_moves(spark):
    p = spark.createDataFrame([("a", "bill", "Ann", None, 0.5, None, "invoice invoice the garden"), ("b", "bill", "Ann", "x", 0.5, "o", None), ("c", "bill", "Ann", None, 0.5, None, "")], "sha256 string, doc_type string, person string, provider string, confidence double, org_id string, text string")
    d = spark.createDataFrame([("a", "receipt", "Ann", None, "2020"), ("b", "bill", "Ann", "x", "2020"), ("c", "bill", "Bo", None, "2020")], "sha256 string, doc_type string, person string, provider string, decided_at string")
    got = {r["sha256"]: (r["corrected_doc_type"], r["corrected_person"], r["sample_keywords"]) for r in learning.corrections(p, d).collect()}
    assert got == {"a": ("receipt", "Ann", '["invoice","garden"]'), "c": ("bill", "Bo", "[]")}
    failed = spark.createDataFrame([(1, None), (2, None), (3, "2019-01-01")], "id int, recovered_at string")
    retried = spark.createDataFrame([(1, "2020-01-02", False), (1, "2020-01-03", True), (2, "2020-01-02", False), (3, "2020-01-01", True)], "id int, ts string, ok boolean")
    marked = lifecycle.mark_recovered(failed, retried)
    assert {(r["id"], r["recovered_at"], r["recovery_action"]) for r in marked.collect()} == {(1, "2020-01-03", "retried"), (2, None, None), (3, "2019-01-01", None)}
    assert [r["id"] for r in lifecycle.unrecovered(marked).collect()] == [2]


def test_quality_of_odd_texts(spark):
    got = values(spark, text.quality, None, "", "short", "|||||||| ||||||||\n--------", "The patient has an invoice and the total amount due.\n" * 3)
    assert got[:3] == [0.0, 0.0, 0.0] and got[3] == 0.1 and got[4] > 0.9


def test_work_on_a_few_files_is_dealt_to_all_tasks(spark):
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.lit("/x/y.pdf").alias("path"), F.lit("Invoice of Acme").alias("text"), F.lit(dt.datetime(2020, 1, 2)).alias("mtime"))
    out = classification.classify(docs, rules.rules_of(DOCUMENT))
    assert out.groupBy(F.spark_partition_id()).count().count() > 4 and out.where("doc_type = 'bill'").count() == 40


def test_corrections_read_their_documents_once(spark):
    """Neither a join with the documents nor a shuffle by them."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "patient label total").otherwise("no such words").alias("text"), F.lit(None).cast("string").alias("org"), F.lit("x").alias("doc_type"), F.lit(0.5).alias("confidence"))
    held = spark.createDataFrame([(1, None, ["patient", "label", "total"], "rx", "1998-01-01"), (2, None, ["patient", "label", "total"], "bill", "1998-01-02"), (3, "a", None, "none", "1998-01-03")], "id long, org_id string, keywords array<string>, corrected_doc_type string, correction_date string")
    out = rules.with_corrections(docs, held)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {(r["doc_id"] % 2, r["doc_type"], r["confidence"], r["corrected"]) for r in out.collect()} == {(0, "bill", 0.6, True), (1, "x", 0.5, False)}
    assert rules.with_corrections(docs, held.where("false")).where("corrected").isEmpty()
