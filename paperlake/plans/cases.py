"""Documents of all branches of the classification, and what each must become, stated by hand from the rules' wording.

One case for every order, by its key: the case's text and path with the order's dates and number. The SQL joins the orders to
the answers below; it knows no rule.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import FolderRule, OrgRule, Rules, TypeRule
from .views import t

RULES = Rules(
    types=(
        TypeRule("identity_card", ("passport", "driver license", "ssn")), TypeRule("vehicle", ("registration", "title transfer")), TypeRule("employment", ("employee",), labels={"default": "Employment", "Evaluation": "Review"}),
        TypeRule("medical_record", ("surgery",)), TypeRule("prescription", ("prescription", "rx")), TypeRule("lab_requisition", ("requisition",)), TypeRule("bill", ("invoice", "amount due")), TypeRule("insurance", ("policy",)),
        TypeRule("business", ("account number", "form 2553", "cp 575"))),
    orgs=(
        OrgRule("corner", ("corner drugs",), "Pharmacy"), OrgRule("bloodlab", ("blood works",), "Lab"), OrgRule("clinic", ("north clinic",), "Medical"), OrgRule("insco", ("insure co",), "Insurance"), OrgRule("townhall", ("town hall",), "Government"),
        OrgRule("shop", ("garden shop",), "Retail", destination="Shop/"), OrgRule("mill", ("old mill",), "Utility")),
    people=(("Ada", ("ada kay",)), ("Bo", ("bo lin",))),
    routes={
        "Bill": "Finance/{provider}/{year}/", "Medical_record": "Health/{person}/Records/", "Employment": "Archive/Employment/", "Pharmacy": "Health/{person}/Pharmacy/", "Lab": "Health/{person}/Lab/", "Business": "Companies/{company}/",
        "Insurance": "Insurance/{person}/{year}/", "Education": "School/{person}/{grade}/", "Creative_Work": "Pictures/{year}/"},
    archives={"Utility": "Archive/{year}/Utility/"}, current_year=2050, path_people=(("/cy/", "Cy"),), companies=(("ACME PARTS LLC", "Acme_Parts"),),
    folders=(
        FolderRule("/work/", "Employment", company="Acme"), FolderRule("/firm/", "Business", company="Acme Parts"), FolderRule("/school/", "Education", "Dee", event="Homework"), FolderRule("/art/", "Creative_Work"),
        FolderRule("/bank/", ambiguous=True, question="Whose?"), FolderRule("/both/", company="Acme", ambiguous=True, question="Whose?"), FolderRule("/meds/", "Medical_record")))

LONG = " Common words of the page stand here so that it is long enough to be read with some trust by anyone who looks."
SHORT = " a b c d" * 20


class Case(NamedTuple):
    """{d}: the order's date, {d9}: nine days later, as MM/DD/YYYY; {iso}, {iso9}, {y}, {ym}: the same; {s}: the day of the scan,
    three days later; {k}: the order's number in six digits."""

    text: str
    path: str
    doc_type: str | None
    org: str | None
    person: str
    label: str
    name: str
    destination: str
    match: str
    rule: float
    confidence: float
    question: str | None = None


LETTER, UNSORTED = "/in/mail/letter_{k}.pdf", "Inbox/Unsorted/"
CASES = (
    Case("Invoice account number statement period closing date {d}." + LONG, LETTER, "business", None, "Shared", "Business", "{iso}_Business.pdf", "Companies/", "business:no-org", 0.55, 0.55),
    Case("Passport SSN form 2553 account number." + LONG, LETTER, "business", None, "Shared", "SCorporationElection", "{s}_SCorporationElection.pdf", "Companies/", "business:no-org", 0.55, 0.55),
    Case("Passport of Ada Kay at Blood Works {d}." + LONG, LETTER, "lab_requisition", "bloodlab", "Ada", "Lab_requisition", "{iso}_blood_works_Lab_requisition_Ada.pdf", "Health/Ada/Lab/", "lab_requisition:bloodlab", 0.88, 0.93),
    Case("Passport requisition specimen {d}." + LONG, LETTER, "lab_requisition", None, "Shared", "Lab_requisition", "{iso}_Unknown_Lab_requisition_Shared.pdf", UNSORTED, "lab_requisition:no-org", 0.55, 0.55),
    Case("Passport of Bo Lin, Town Hall {d}." + LONG, LETTER, "identity_card", "townhall", "Bo", "Passport", "{s}_Passport_Bo.pdf", "Legal/Identity/Bo/", "identity_card:townhall", 0.88, 0.93),
    Case("Passport of Bo Lin, Garden Shop." + LONG, "/in/mail/card back_{k}.pdf", "identity_card", "shop", "Bo", "PassportBack", "{s}_PassportBack_Bo.pdf", "Legal/Identity/Bo/", "identity_card:shop", 0.88, 0.68),
    Case("Surgery invoice for Ada Kay, North Clinic {d}, total $12.50." + LONG, LETTER, "bill", "clinic", "Ada", "Bill", "{iso}_north_clinic_Bill_Ada.pdf", "Finance/north_clinic/{y}/", "bill:clinic", 0.88, 0.88),
    Case("Surgery prescription, Bo Lin {d}." + LONG, LETTER, "prescription", None, "Bo", "Prescription", "{iso}_Unknown_Rx_Bo.pdf", UNSORTED, "prescription:no-org", 0.55, 0.55),
    Case("Prescription MEDICATION AMOXICILLIN 500 mg BRAND NAME: Amoxil Insure Co Corner Drugs Ada Kay {d} $7.00." + LONG, LETTER, "prescription", "corner", "Ada", "Prescription", "{iso}_corner_drugs_Rx_Amoxicillin_BrandName_Amoxil_Ada.pdf", "Health/Ada/Pharmacy/", "prescription:corner", 0.88, 0.78),
    Case("Vehicle registration TAG/DECAL/VESS#: XK{k}77 Bo Lin {d}." + LONG, LETTER, "vehicle", None, "Bo", "RegistrationRenewal", "{iso}_RegistrationRenewal_TagDecal_XK{k}77_Bo.pdf", UNSORTED, "vehicle:no-org", 0.55, 0.55),
    Case("Title transfer VIN/HIN: ABCDEFGH12345678 Bo Lin {d}." + LONG, LETTER, "vehicle", None, "Bo", "TitleTransfer", "{iso}_TitleTransfer_VIN_ABCDEFGH_Bo.pdf", UNSORTED, "vehicle:no-org", 0.55, 0.55),
    Case("Employee performance evaluation, performance review, Ada Kay {d}." + LONG, "/in/work/Staff 19950607/letter_{k}.pdf", "employment", None, "Ada", "Review", "1995-06-07_Acme_Review_Ada_{k}.pdf", "Archive/Employment/Acme/", "employment:no-org", 0.72, 0.72),
    Case("Credit limit available credit closing date {d} passport." + LONG, "/in/firm/letter_{k}.pdf", "business", None, "Shared", "Business", "{ym}_Acme_Parts_BusinessCreditCard.pdf", "Companies/Acme_Parts/Financial/{y}/Banking/", "business:no-org", 0.72, 0.72),
    Case("CP 575 notice internal revenue service." + LONG, "/in/firm/letter_{k}.pdf", "business", None, "Shared", "EINConfirmation", "{s}_Acme_Parts_EINConfirmation.pdf", "Companies/Acme_Parts/Legal/", "business:no-org", 0.72, 0.72),
    Case("Amount due {d} Bo Lin." + LONG, "/in/bank/letter_{k}.pdf", "bill", None, "Bo", "Bill", "{iso}_Unknown_Bill_Bo.pdf", "Finance/{y}/", "bill:no-org", 0.55, 0.45, "Whose?"),
    Case("Amount due {d} Bo Lin." + LONG, "/in/both/letter_{k}.pdf", "bill", None, "Bo", "Bill", "{iso}_Unknown_Bill_Bo.pdf", "Finance/{y}/", "bill:no-org", 0.55, 0.55),
    Case("Policy account number Ada Kay {d}." + LONG, LETTER, "insurance", None, "Ada", "Insurance", "{iso}_Unknown_Insurance_Ada.pdf", "Insurance/Ada/{y}/", "insurance:no-org", 0.40, 0.40),
    Case("{d} policy Insure Co total $1,234.56 payment due by {d9}." + LONG, LETTER, "insurance", "insco", "Shared", "Insurance", "{iso}_insure_co_Insurance_Shared_1234.56_DueDate_{iso9}.pdf", "Insurance/Shared/{y}/", "insurance:insco", 0.88, 0.93),
    Case("hello", "/in/school/1995-1996/Homework Book/Scan1999-01-01_{k}.jpg", None, None, "Dee", "Education", "1995-1996_Homework_Homework_Book_Dee_{k}.jpg", "School/Dee/1995-1996/", "folder-hint:Education", 0.55, 0.40),
    Case("hello", "/in/art/19950607 Park Party/Scan1999-01-01_{k}.jpg", None, None, "Shared", "Creative_Work", "1995-06-07_Park_Party_Pics_Shared_{k}.jpg", "Pictures/1995/", "folder-hint:Creative_Work", 0.55, 0.40),
    Case("hello", "/in/work/Staff Recognition/Scan1999-01-01_{k}.jpg", None, None, "Shared", "Employment", "{s}_Acme_EmployeeRecognition_Shared_{k}.jpg", "Archive/Employment/", "folder-hint:EmployeeRecognition", 0.55, 0.40),
    Case("hello", "/in/meds/plain_{k}.txt", None, None, "Shared", "Medical_record", "{s}_Medical_record_Shared.txt", "Health/Shared/Records/", "fallback-folder", 0.40, 0.25),
    Case("hello", "/in/x/plain_{k}.txt", None, None, "Shared", "Unknown", "{s}_Unknown_Shared.txt", UNSORTED, "fallback-folder", 0.25, 0.10),
    Case("Invoice {d}." + LONG, "/in/cy/letter_{k}.pdf", "bill", None, "Cy", "Bill", "{iso}_Unknown_Bill_Cy.pdf", "Finance/{y}/", "bill:no-org", 0.55, 0.55),
    Case("Invoice {d} Garden Shop." + LONG, "/in/1994-05-06 trip/letter_{k}.pdf", "bill", "shop", "Shared", "Bill", "1994-05-06_garden_shop_Bill_Shared.pdf", "Finance/garden_shop/1994/", "bill:shop", 0.88, 0.88),
    Case("Policy Garden Shop {d}." + LONG, LETTER, "insurance", "shop", "Shared", "Insurance", "{iso}_garden_shop_Insurance_Shared.pdf", "Shop/", "insurance:shop", 0.88, 0.88),
    Case("Policy Old Mill {d}." + LONG, LETTER, "insurance", "mill", "Shared", "Insurance", "{iso}_old_mill_Insurance_Shared.pdf", "Archive/{y}/Utility/", "insurance:mill", 0.88, 0.88),
    Case("Invoice" + SHORT, LETTER, "bill", None, "Shared", "Bill", "{s}_Unknown_Bill_Shared.pdf", "Finance/{sy}/", "bill:no-org", 0.55, 0.40),
    Case("Invoice for Ada Kay, patient: Bo Lin {d}." + LONG, LETTER, "bill", None, "Bo", "Bill", "{iso}_Unknown_Bill_Bo.pdf", "Finance/{y}/", "bill:no-org", 0.55, 0.55),
)


def case_docs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, path, text, mtime of every order, as the case of its key says."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    later = day + F.expr("interval 9 days")
    values = {"d": F.date_format(day, "MM/dd/yyyy"), "d9": F.date_format(later, "MM/dd/yyyy"), "k": F.lpad((key % 1_000_000).cast("string"), 6, "0")}

    def of_case(field: str) -> Column:
        out = F.element_at(F.array(*[F.lit(getattr(c, field)) for c in CASES]), (key % len(CASES) + 1).cast("int"))
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), value)
        return out

    return t(spark, sf, "orders").select(key.alias("doc_id"), of_case("path").alias("path"), of_case("text").alias("text"), (day + F.expr("interval 3 days")).alias("mtime"))


def answers_sql() -> str:
    """SQL for the answers of all orders."""
    quote = lambda v: "null" if v is None else repr(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {', '.join(quote(v) for v in c[2:])})" for i, c in enumerate(CASES))
    filled = lambda column: (
        f"replace(replace(replace(replace(replace(replace(replace({column}, '{{iso}}', strftime(d, '%Y-%m-%d')), '{{iso9}}', strftime(d + interval 9 day, '%Y-%m-%d')), '{{ym}}', strftime(d, '%Y-%m')), '{{y}}', strftime(d, '%Y')), "
        "'{s}', strftime(d + interval 3 day, '%Y-%m-%d')), '{sy}', strftime(d + interval 3 day, '%Y')), '{k}', lpad(cast(doc_id % 1000000 as varchar), 6, '0'))")
    return f"""with c(i, doc_type, org, person, label, name, destination, match, rule, confidence, question) as (values {rows}),
 o as (select o_orderkey as doc_id, cast(o_orderdate as timestamp) as d from orders)
 select doc_id, doc_type, org, person, label, {filled('name')} as proposed_name, {filled('destination')} as destination, match as rule_match_id, cast(rule as double) as rule_confidence, cast(confidence as double) as confidence, question
 from o join c on i = doc_id % {len(CASES)}"""
