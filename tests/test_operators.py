"""Edge cases of the library's own operators on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperlake.functions import dates, fields, text
from paperlake.operators import classification, dedup, lifecycle, pages, proposals, rules, stats
from paperlake.plans.views import RULES
from paperlake.sources import readers, writers
from paperlake.streaming import inbox


def values(spark, expression, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in rows.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]


def test_dates(spark):
    assert values(spark, dates.document_date, "DOB: 01/02/1980 and then, much later, 03/04/2021", "on 2020-05-06 or 01/01/2019", "12/31/49", "12/31/50", "Date of birth: 01/02/1980, 03/04/1999", "x", None) == ["2021-03-04", "2020-05-06", "2049-12-31", "1950-12-31", None, None, None]
    assert values(spark, dates.amount, "pay $1,234.50 now", "$ 99", "$144449.00", "none") == ["1234.50", "99", "144", None]
    assert values(spark, dates.statement_date, "Statement period 1/2/20 - 2/3/20", "closing date: 12/01/1999", "as of 03/04/21", "Notice date May 7, 2019", "") == ["2020-02-03", "1999-12-01", "2021-03-04", "2019-05-07", None]
    assert values(spark, dates.due_date, "Due date 01/02/2024", "amounts due on 03/04/24", "nothing", "pay by 05/06/2025") == ["2024-01-02", "2024-03-04", None, "2025-05-06"]
    assert values(spark, dates.expiry_date, "Exp 01/02/30", "see 03/04/2031", "see 03/04/2001") == ["2030-01-02", "2031-03-04", None]
    assert values(spark, dates.date_in_name, "20210304_x", "Scan") == ["2021-03-04", None]
    assert values(spark, lambda c: dates.denormalise_meta(c)["provider"], '{"provider": " Acme "}', "{broken", None, "{}") == ["acme", "", "", ""]


def test_text(spark):
    assert values(spark, text.normalise_spaces, " a  b\n", "") == ["a b", ""]
    assert values(spark, text.safe_part, " Öl & Co. ", "___", "a b") == ["l_Co", "Unknown", "a_b"]
    assert values(spark, text.clean_name, "(a b)_.", "x") == ["(a_b)".strip("()"), "x"]
    assert values(spark, lambda c: text.fill_template(c, {"a": F.lit("1"), "b": F.lit(None).cast("string")}), "{a}/{b}/{c}") == ["1/Unknown/Unknown"]
    assert values(spark, text.tidy_path, "a//b/_/Unknown/c/None") == ["a/b/c/"]
    assert values(spark, lambda c: F.length(text.guard_length(c)), "x/" + "y" * 300 + ".pdf", "short.pdf") == [240, 9]
    assert values(spark, lambda c: F.concat_ws(",", text.keywords(c)), "The invoice and INVOICE total a bc", None) == ["invoice,total", ""]
    assert values(spark, text.page_indicator, "Page 3 of 16, 4 of 16", "09/29 of 30", "2 of 60", "5 of 4", None)[0] == (3, 16)
    assert values(spark, text.page_indicator, "2 of 60", "5 of 4", "none") == [None, None, None]
    assert values(spark, text.title_case, "o'neil-smith 2nd") == ["O'Neil-Smith 2Nd"]
    quality = values(spark, text.quality, "", "123456789", "1234567890 123", "the patient and the doctor with a date", "@@@@ #### $$$$ %%%%\nreadable words from the doctor")
    assert quality[:3] == [0.0, 0.0, 0.1] and quality[3] == 1.0 and 0 < quality[4] <= 1
    assert values(spark, lambda c: text.front_matter(c, "title"), "---\ntitle: Hi\n---\nx", "no") == ["Hi", None]


def test_fields(spark):
    assert values(spark, fields.business_name, "x\nACME PARTS LLC\n1234 5678 9012\n", "CP 575 G N&D TOOLS LLC", "nothing") == ["ACME PARTS LLC", "N&D TOOLS LLC", None]
    assert values(spark, fields.company_key, "N&D Tools, LLC", "ND Tools Inc.") == ["NANDD TOOLS", "ND TOOLS"]
    assert values(spark, lambda c: fields.medication(c)["generic"], "MEDICATION Amoxicillin 500mg TABLET", "GENERIC INGREDIENT: Ibuprofen Tablets", "x") == ["Amoxicillin", "Ibuprofen", None]
    assert values(spark, fields.side_in_name, "PassportFront_x", "id_back", "licence-verso", "page") == ["Front", "Back", "Back", None]
    assert values(spark, fields.scanner_default, "Scan2020-01-02_123456", "Doc 12", "2020-01-02_Acme_Bill") == [True, True, False]
    assert values(spark, fields.employment_kind, "nominated by; employee recognition", "performance review", "performance review nominated by", "") == ["Recognition", "Evaluation", "Employment", "Employment"]
    assert values(spark, lambda c: fields.clinical(c)["diagnosis"], "Final Diagnosis: flu\nx", "") == ["flu", None]
    assert values(spark, fields.name_convention, "2020-01-02_Acme_Lab_Result_Ann_003") == [("2020-01-02", "Acme", "Lab Result", "Ann", "003")]
    assert values(spark, fields.folder_facts, "/a/Acme/2019-05-06 Visit/x.pdf")[0]["event"] == "Visit"


def test_rules(spark):
    assert rules.pattern_of("rx") == r"\brx\b" and rules.pattern_of("a.b c") == r"a\.b\ c" and rules.pattern_of(r"lab\s+x") == r"lab\s+x"
    docs = spark.createDataFrame([(1, "/i/x.pdf", "Invoice amount due $12.00 AUTOMOBILE building", dt.datetime(1995, 1, 2)), (2, "/i/rx.pdf", None, dt.datetime(1999, 1, 2)), (3, "/i/y.pdf", "", dt.datetime(1999, 1, 2))], "doc_id long, path string, text string, mtime timestamp")
    got = {r["doc_id"]: r for r in classification.classify(docs, RULES).collect()}
    assert (got[1]["doc_type"], got[1]["org"], got[1]["label"], got[1]["destination"]) == ("bill", "autohaus", "InsuranceBill", "Finance/Auto Haus/1995/")
    assert got[1]["proposed_name"] == "1995-01-02_Auto Haus_InsuranceBill_Shared_12.00.pdf" and (got[1]["rule_confidence"], got[1]["confidence"]) == (0.88, 0.63)
    assert got[2]["doc_type"] == "prescription" and got[3]["doc_type"] is None and got[3]["destination"] == "Inbox/Unsorted/"
    assert {k: v.count() for k, v in RULES.tables(spark).items()} == {"rules_type": 5, "rules_org": 5, "rules_person": 4, "rules_folder": 0, "rules_route": 4}


def test_duplicates(spark):
    rows = [(i, f"p{i}", h, th, target, "acme", "ann", "bill") for i, h, th, target in ((1, "a", "x", "p9"), (2, "a", "x", "p1"), (3, "b", "x", "p2"), (4, "c", None, "p2"))]
    idx = spark.createDataFrame(rows, "doc_id long, path string, sha256 string, text_hash string, target string, provider string, person string, doc_type string")
    got = {(r["doc_id"], r["path"]): r["match_type"] for r in dedup.tiered(idx, idx).collect()}
    assert got == {(1, "p2"): "exact", (2, "p1"): "exact", (3, "p1"): "text", (3, "p2"): "name", (1, "p3"): "text", (2, "p3"): "text", (4, "p2"): "name"}
    assert dedup.metadata_overlap(idx.where("doc_id = 1"), idx).count() == 3
    assert dedup.duplicate_groups(idx).collect()[0]["copies"] == 2


def test_sides(spark):
    rng = random.Random(2)
    scans = [("p", "t", "d", i, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=m)) for i, m in enumerate(sorted(rng.randrange(600) for _ in range(80)))]
    want, at, last = {}, None, ""
    for *_, i, ts in scans:
        fresh = at is None or ts - at > dt.timedelta(minutes=30)
        side = "Front" if fresh else "Back" if last == "Front" else None
        if fresh or last in ("Front", "Back"):
            at = ts
        last = side or "Unknown"
        want[i] = side
    frame = spark.createDataFrame(scans, "person string, doc_type string, day string, scan_id long, ts timestamp")
    assert {r["scan_id"]: r["side"] for r in pages.sides(frame).collect()} == want


def test_lifecycle(spark):
    day = lambda n: dt.datetime(2020, 1, n)
    events = [("a", day(1), 0, "proposed", "n1", "t1"), ("a", day(2), 1, "proposed", "n2", "t1"), ("a", day(3), 2, "approved", "n3", "t2"), ("b", day(1), 0, "proposed", "n", "t"), ("b", day(2), 1, "denied", None, None)]
    got = {r["sha"]: r for r in lifecycle.reduce_events(spark.createDataFrame(events, "sha string, ts timestamp, seq int, kind string, name string, doc_type string")).collect()}
    assert (got["a"]["attempts"], got["a"]["proposed_name"], got["a"]["override_type"], got["a"]["first_seen_at"]) == (2, "n2", "retype", day(1))
    assert got["b"]["override_type"] == "deny" and got["b"]["approved_at"] is None
    old = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("l", 1, "y")], "key string, ts int, v string")
    assert {tuple(r) for r in lifecycle.latest_wins(old, "key", ["ts"]).collect()} == {("k", 3, "z"), ("l", 1, "y")}
    empty = spark.createDataFrame([], "override_type string, approved_at timestamp, approval_attempts int, first_seen_at timestamp")
    assert tuple(stats.totals(empty).first()) == (0, 0, 0, 0.0, 0.0)


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(b"PDF text")
    (tmp_path / "a/x.meta.json").write_text('{"provider": "Acme"}')
    (tmp_path / "a/x.ocr.txt").write_text("recognised text of the page, long enough")
    (tmp_path / "a/y.zip").write_bytes(b"z")
    (tmp_path / "log.json").write_text('{"ts": "2020-01-01T00:00:00Z", "level": "INFO"}\nbroken\n{"level": "ERROR"}\n')
    (tmp_path / "map.json").write_text('{"k1": {"a": 1}, "k2": {"a": 2}}')
    assert [r["path"].rsplit("/", 1)[1] for r in readers.files(spark, str(tmp_path)).collect()] == ["x.pdf"]
    side = readers.sidecar_state(readers.sidecars(spark, str(tmp_path / "a"))).first()
    assert side["stem"] == "x" and side["has_meta"] and side["has_ocr"]
    assert readers.json_lines(spark, str(tmp_path / "log.json")).count() == 2
    assert {(r["key"], r["value"]["a"]) for r in readers.keyed_json(spark, str(tmp_path / "map.json"), "struct<a:int>").collect()} == {("k1", 1), ("k2", 2)}
    binary = spark.read.format("binaryFile").load(str(tmp_path / "a"))
    got = {r["path"].rsplit(".", 1)[1]: r["text"] for r in readers.extract_text(binary, {".pdf": lambda b: b.decode()}).collect()}
    assert got["pdf"] == "PDF text" and got["zip"] is None
    rows = spark.createDataFrame([("k", 1, "a")], "key string, ts int, v string")
    first = writers.upsert(None, rows, "key", ["ts"], str(tmp_path / "store"))
    second = writers.upsert(spark.read.parquet(first), rows.withColumn("ts", F.lit(2)).withColumn("v", F.lit("b")), "key", ["ts"], str(tmp_path / "store"))
    assert [tuple(r) for r in spark.read.parquet(second).collect()] == [("k", 2, "b")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.pdf").write_bytes(b"x" * (i + 1))
    seen = []
    inbox.run_once(inbox.arrivals(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r["length"] for r in df.collect()), str(tmp_path / "ck"))
    (tmp_path / "in/3.pdf").write_bytes(b"xxxx")
    inbox.run_once(inbox.arrivals(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r["length"] for r in df.collect()), str(tmp_path / "ck"))
    assert sorted(seen) == [1, 2, 3, 4]
    scans = [("p", "t", "d", i, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=m)) for i, m in enumerate((0, 5, 9, 100, 101))]
    frame = spark.createDataFrame(scans, "person string, doc_type string, day string, scan_id long, ts timestamp")
    frame.coalesce(1).write.parquet(str(tmp_path / "scans"))
    out = []
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "scans"))
    inbox.run_once(inbox.sides_stream(stream), lambda df, _: out.extend((r["scan_id"], r["side"]) for r in df.collect()), str(tmp_path / "ck2"))
    assert dict(out) == {r["scan_id"]: r["side"] for r in pages.sides(frame).collect()}


@pytest.mark.parametrize("gap", ["5 seconds", "1 hour"])
def test_debounce(spark, gap):
    events = spark.createDataFrame([("k", dt.datetime(2020, 1, 1, 0, 0, s)) for s in (0, 3, 7, 20)], "key string, ts timestamp")
    assert sorted(r["arrivals"] for r in inbox.debounced(events, gap=gap).collect()) == ([1, 3] if gap == "5 seconds" else [4])


def test_identity(spark):
    at = lambda m: dt.datetime(2020, 1, 1, 0, m)
    rows = [(1, "Ann", "passport no", "Scan1", "2015-01-01", "2020-01-01", at(0)), (2, "Ann", "passport no", "Scan2", "2015-01-01", "2020-01-01", at(1)), (3, "Ann", "passport no", "Scan3", "2015-01-01", "2020-01-01", at(2)),
            (4, "Ann", "", "ssn_back", "1980-01-01", "2020-01-01", at(0)), (5, "Bo", "", "x", None, "2020-01-01", at(0))]
    scans = spark.createDataFrame(rows, "scan_id long, person string, low string, stem string, doc_date string, scan_date string, ts timestamp")
    got = {r["scan_id"]: (r["label"], r["day"], r["needs_side"]) for r in proposals.identity_labels(scans).collect()}
    assert got == {1: ("PassportFront", "2015-01-01", False), 2: ("PassportBack", "2015-01-01", False), 3: ("Passport", "2015-01-01", True), 4: ("SSNBack", "2020-01-01", False), 5: ("IDCardFront", "2020-01-01", False)}


def test_metadata_of_five_fields(spark):
    from paperlake.operators import dedup

    schema = "doc_id long, path string, provider string, person string, doc_type string, date string, description string"
    docs = spark.createDataFrame([(1, "n1", "Acme", "Ann", "bill", "2024-01-01", "x"), (2, "n2", "", "", "", "2024-02-02", "scan"), (3, "n3", "acme ", "Ann", "bill", None, "")], schema)
    index = spark.createDataFrame([(10, "same", "Acme", "Ann", "bill", "2024-01-01", "x"), (11, "other day", "Acme", "Ann", "bill", "2024-03-03", "x"), (12, "blank", "", "", "bill", "2024-01-01", "X"), (13, "dated", "Beta", "Bo", "note", "2024-02-02", "scan"), (14, "empty", "", None, "", "", "")], schema)
    got = sorted((r["doc_id"], r["path"], r["score"]) for r in dedup.metadata_overlap(docs, index).collect())
    assert got == [(1, "blank", 1.0), (1, "same", 1.0), (2, "dated", 1.0), (3, "blank", 1.0), (3, "other day", 1.0), (3, "same", 1.0)]


def test_nine_places_of_a_company(spark):
    texts = (
        "Name  Employer identification number\nACME PARTS LLC 12-3456789", "Notice\nCP 575 A\nACME PARTS LLC\nx", "ACME PARTS INC Notice date January 5, 2024", "Wells Fargo statement\nACME PARTS CORP.\nx", "Business Advantage\nACME PARTS CO\nx",
        "x\nACME PARTS LTD\n4444 5555 6666 7777\n", "x\nN&D TOOLS LLC\nAccount number 1234 5678\n", "Member FDIC.\nACME PARTS LLP\nx", "x\nACME PARTS COMPANY\n12 OAK GROVE RD\n", "x\nACME PARTS LLC\nP.O. Box 12", "x\nACME PARTS LLC\nnothing", "Acme Parts LLC\n12 Oak St", "", None)
    assert values(spark, fields.business_name, *texts) == [
        "ACME PARTS LLC", "ACME PARTS LLC", "ACME PARTS INC", "ACME PARTS CORP.", "ACME PARTS CO", "ACME PARTS LTD", "N&D TOOLS LLC", "ACME PARTS LLP", "ACME PARTS COMPANY", "ACME PARTS LLC", None, None, None, None]


def test_marks_of_vehicles_and_scanners(spark):
    assert [tuple(x) for x in values(spark, fields.vehicle, r"TAG\DECAL/VESS#: AB12345 VIN/HIN: 1HGCM82633A004352", "vin/hin 123", None)] == [("AB12345", "1HGCM82633A004352"), (None, None), (None, None)]
    names = ("Scan", "scan 12", "IMG0001", "20240102_030405_678", "DocFile (12)", "SKMBT_C3524", "HPX_C1abc", "20240102 letter", "2024-01-02", "Scan of x", "letter_c1x", "20240102", None)
    assert values(spark, fields.scanner_default, *names) == [True, True, True, True, True, True, True, True, False, False, True, False, None]
    assert values(spark, lambda c: fields.medication(c), "MEDICATION AMOXICILLIN CLAV 500 mg BRAND NAMES: Augmentin, x")[0] == ("Amoxicillin Clav", "Augmentin")
    assert values(spark, dates.statement_date, "Statement period 01/02/2024 - 02/01/2024", "closing date: 3/4/24", "as of 12/31/1999", "notice date March 5, 2021", "the atlas of 1/2/2024") == ["2024-02-01", "2024-03-04", "1999-12-31", "2021-03-05", None]
