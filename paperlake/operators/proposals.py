"""Branches of the proposal by kind of document: identity cards, patients, ambiguous folders, business context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.dates import let
from .pages import sides
from ..functions.phrases import PhraseIndex, listed

#: Words of identity documents and their labels, in the order in which they are tried.
IDENTITY = (("driver license", "DriverLicense"), ("driver's license", "DriverLicense"), ("passport", "Passport"), ("social security", "SSN"), ("ssn", "SSN"), ("birth certificate", "BirthCertificate"), ("naturalization", "NaturalizationCert"))
#: Kinds of business documents by their words, in order.
BUSINESS = (
    ("BusinessChecking", ("checking account", "business checking")),
    ("BusinessCreditCard", ("credit limit", "available credit")),
    ("Election", ("s corporation", "s-corp", "form 2553")),
    ("Tax", ("internal revenue service", "department of the treasury", "employer id")),
)
#: Papers of a company by their words, in order; words in one entry stand together.
PAPERS = (
    ("EINConfirmation", (("cp 575",), ("ss-4",))),
    ("SCorporationElection", (("form 2553",), ("s-corp",), ("s corporation", "election"))),
    ("SCorporationElection", (("cp 261",), ("cp261",), ("accepted", "s corporation"))),
    ("GovernmentFiling", (("division of corporations",), ("department of state",), ("sunbiz",), ("tracking number", "document number"))),
    ("EINConfirmation", (("employer identification number",), ("ein ",))),
)
PATIENT_TYPES = ("medical_record", "lab_requisition", "prescription", "referral", "bill", "medical_bill")


def identity_label(low: Column, stem: Column) -> Column:
    """The kind of identity document, from the text, else from the file name."""
    tests = [F.when(low.contains(w), label) for w, label in IDENTITY] + [F.when(F.lower(stem).contains(w), label) for w, label in IDENTITY]
    return F.coalesce(*tests, F.lit("IDCard"))


def identity_date(doc_date: Column, scan_date: Column, first_year: int = 2010) -> Column:
    """The document's date unless it is so early that it is a date of birth."""
    return F.when(F.substring(doc_date, 1, 4).cast("int") < first_year, scan_date).otherwise(F.coalesce(doc_date, scan_date))


def identity_labels(scans: DataFrame) -> DataFrame:
    """scans (scan_id, person, low, stem, doc_date, scan_date, ts) with label, its side and whether it needs confirmation.

    A side in the file name wins; the other scans of one person, kind and date take theirs from their order in time.
    """
    rows = scans.withColumns({"kind": identity_label(F.col("low"), F.col("stem")), "day": identity_date(F.col("doc_date"), F.col("scan_date")), "named": fields.side_in_name(F.col("stem"))})
    order = sides(rows.where("named is null").select("person", F.col("kind").alias("doc_type"), "day", "scan_id", "ts")).select("scan_id", "side")
    out = rows.join(order.hint("merge"), "scan_id", "left").withColumn("side", F.coalesce("named", "side"))
    return out.select("scan_id", F.concat("kind", F.coalesce("side", F.lit(""))).alias("label"), "day", F.col("side").isNull().alias("needs_side"))


#: Words that may stand between a patient's label and the name, and words that end the name.
PATIENT_LEADS = ("name", "information")
PATIENT_ENDS = ("m", "f", "male", "female", "dob", "date", "ssn", "mrn", "born", "age")


def labelled_name(low: Column) -> Column:
    """The words after the first "patient" up to a word that ends names or is none (a number, other marks); null without such an end."""
    at = F.locate("patient", low)
    words = F.regexp_extract_all(F.when(at > 0, F.substring(low, at + len("patient"), F.lit(200))), F.lit(r"[^\s,:\-]+"), F.lit(0))

    def named(words):
        end = F.array_position(F.transform(words, lambda w: w.isin(*PATIENT_ENDS) | w.rlike(r"[^\p{L}_]")), F.lit(True)).cast("int")
        return F.when(end > 1, F.array_join(F.slice(words, F.lit(1), end - 1), " "))

    return let(F.when(F.get(words, F.lit(0)).isin(*PATIENT_LEADS), F.slice(words, F.lit(2), F.lit(200))).otherwise(words), named)


def patient(low: Column, people: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first person with an alias in what follows a patient's label, else the one of whom an alias is nearest to the first
    "patient" (ten characters before to two hundred after)."""
    aliases = [(a, n, p) for n, (p, names) in enumerate(people) for a in names]
    index = PhraseIndex().add("alias", [(a,) for a, _, _ in aliases])
    table = listed([{"alias": a, "ord": n, "person": p} for a, n, p in aliases], "struct<alias:string,ord:int,person:string>")
    at = F.locate("patient", low)
    near = F.when(at > 0, F.substring(low, F.greatest(at - 10, F.lit(1)), F.lit(210)))
    placed = let(near, lambda part: F.transform(index.found(part), lambda m: let(F.get(table, m), lambda e: F.struct(F.position(e["alias"], part).alias("pos"), e["ord"], e["person"]))))
    return F.coalesce(F.get(table, F.get(index.found(labelled_name(low)), F.lit(0)))["person"], F.array_min(placed)["person"])


def prefer_patient(doc_type: Column, patient_: Column, person: Column) -> Column:
    return F.when(doc_type.isin(*PATIENT_TYPES), F.coalesce(patient_, person)).otherwise(person)


def ambiguity(ambiguous: Column, question: Column, company: Column) -> Column:
    """The question to ask, unless the folder already names a company."""
    return F.when(ambiguous & company.isNull(), question)


def business_kind(low: Column, in_company_folder: Column) -> Column:
    more = {"BusinessCreditCard": low.contains("minimum payment due") & low.contains("new balance"), "Tax": low.rlike(r"(?:^|\s)irs(?:\s|$)")}
    tests = [F.when(in_company_folder & (F.greatest(*[low.contains(w) for w in words], F.lit(False)) | more.get(kind, F.lit(False))), kind) for kind, words in BUSINESS]
    return F.coalesce(*tests)


def company_paper(low: Column) -> Column:
    """The kind of a company's paper: tax number, election, its acceptance, filing; null for others."""
    together = lambda words: F.least(*[low.contains(w) for w in words], F.lit(True))
    return F.when(low.isNotNull(), F.coalesce(*[F.when(F.greatest(*[together(words) for words in entry], F.lit(False)), label) for label, entry in PAPERS]))
