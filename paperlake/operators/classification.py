"""Classification of documents: type, organisation, person, dates, name, destination and two confidences.

One chain of projections without a shuffle. Rules are data (see rules.Rules); their patterns are compiled to Columns once, on
the driver. The steps and what they read:

text and path -> folder facts -> person, type, organisations -> overrides of the type -> dates, provider -> business context
-> label and destination -> name by type, or by folder where no type is found -> suffixes -> confidences.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fields, text
from . import proposals
from ..functions.phrases import PhraseIndex, listed
from .rules import Rules, best_org, first_of, matched_orgs, nth, person_match, phrase_index

#: Words that speak for a statement of a bank; three of them overrule the types below.
BANK_WORDS = (
    "account number", "routing number", "statement period", "closing date", "available credit", "minimum payment due", "new balance", "credit limit", "cash advance", "payment due date", "finance charge", "purchase(s)",
    "balance transfer", "business advantage", "business checking", "member fdic", "fdic insured", "bank of america", "wells fargo", "chase", "citibank", "account summary", "cardholder activity", "transactions",
    "posting date", "reference number", "cardholder")
NOT_OF_A_BANK = ("bill", "insurance", "vehicle", "medical_record", "prescription", "receipt")
#: Words by which an identity card is a business paper, or a laboratory's (two of them).
COMPANY_WORDS = ("form 2553", "s-corp", "s corporation election", "cp 575", "ss-4", "employer identification number", "ein ", "incorporation")
LAB_WORDS = ("quest diagnostics", "labcorp", "requisition", "specimen", "collection date", "ordering physician", "patient preparation", "fasting", "cbc ", "metabolic panel", "lipid panel", "urinalysis", "vitamin d", "lab test", "tests ordered", "test ordered", "ereq", "e-req")
#: Words that make a bill, an insurance or a vehicle paper doubtful.
DOUBT_WORDS = ("account number", "routing number", "statement period", "closing date", "available credit", "minimum payment due", "new balance", "business advantage", "business checking", "credit limit", "member fdic", "fdic", "bank of america", "wells fargo", "chase", "citibank")
#: Categories and types that stand for one another.
CLINICAL = ("Lab", "Medical", "Pediatric", "Dental", "Vision", "Pharmacy")
PATIENT_TYPES = ("lab_requisition", "medical_record", "prescription", "bill", "medical_bill", "lab_bill", "dental_bill", "hospital_bill", "vision_bill", "dental")
BILLS = ("Bill", "MedicalBill", "LabBill", "DentalBill", "HospitalBill", "VisionBill")
NO_AMOUNT = ("Unknown", "Rx", "VehicleRegistration", "RegistrationRenewal", "Business", "BusinessChecking", "BusinessCreditCard", *BILLS)
AGREEING = (
    (("lab_requisition", "medical_record", "prescription"), (*CLINICAL, "Hospital", "PrimaryCare", "BehavioralHealth")),
    (("bill", "medical_bill", "insurance"), ("Insurance",)), (("identity_card",), ("Legal", "Government")), (("business",), ("Business",)))
#: Destinations of scanned documents by the kind of a run of pages, for {person}.
RUN_DESTINATIONS = {
    "Hospitalization/": ("dischargesummary", "hospitalrecord", "emergencycare", "errecord", "surgicalrecord", "operativereport"),
    "Lab/": ("labresults", "labrequisition", "labreport"),
    "Diagnostics/": ("ultrasound", "imaging", "xray", "mri", "ct", "radiology"),
    "Prescriptions/": ("prescription", "rx", "medication"),
    "Vision/": ("eyeexam", "vision", "optometry", "ophthalmology"),
    "Dental/Records/": ("dental", "dentist", "orthodontics"),
    "": ("fmla", "workexcuse", "disability", "insurance", "referral"),
}

#: Tasks for each core.
SPREAD = 4


def either(column: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [column.contains(w) for w in words])


def value_of(key: Column, found: dict) -> Column:
    """The value of a key in a small table, null for other keys."""
    rows = [{"key": k, "value": v} for k, v in found.items() if v is not None]
    return F.get(F.filter(listed(rows, "struct<key:string,value:string>"), lambda e: e["key"] == key), F.lit(0))["value"] if rows else F.lit(None).cast("string")


def parts(*columns: Column) -> Column:
    """A name of its parts; null and Unknown ones are left out."""
    return F.concat_ws("_", *columns)


def known(column: Column) -> Column:
    return F.nullif(column, F.lit("Unknown"))


def company_folder(name: Column, rules: Rules) -> Column:
    """A company's canonical folder by its aliases, else its name as a file name part; null for null."""
    table = {}
    for alias, folder in rules.companies:
        table.setdefault(alias, folder)
    if not table:
        return F.when(name.isNotNull(), text.safe_part(name))
    place = F.array_position(F.array(*[fields.company_key(F.lit(a)) for a in table]), fields.company_key(name))
    return F.when(name.isNotNull(), F.coalesce(nth(list(table.values()), (place - 1).cast("int")), text.safe_part(name)))


def with_type(docs: DataFrame, rules: Rules, default_person: str) -> DataFrame:
    """Text, folder facts, person, organisations and the type after its overrides.

    One phrase index says in one pass which rules have a phrase in the text; all that follows asks for its marks."""
    low = F.col("low")
    ids = {r.id: n for n, r in reversed(list(enumerate(rules.types)))}
    as_type = lambda name, other=None: F.lit(name if name in ids else other)
    index = phrase_index(rules, bank=rules.bank_words or BANK_WORDS, company=COMPANY_WORDS, lab=LAB_WORDS, doubt=DOUBT_WORDS)
    in_stem = PhraseIndex().add("type", [r.patterns for r in rules.types], patterns=True).add("person", [names for _, names in rules.people])
    says = lambda type_: index.has(F.col("marks"), "type", ids[type_]) if type_ in ids else F.lit(False)
    out = docs.withColumn("norm", text.normalise_spaces(F.coalesce("text", F.lit("")))).withColumn("low", F.lower("norm")).withColumn("stem", text.stem(F.col("path"))).withColumn("low_stem", F.lower("stem"))
    out = out.withColumns({
        "folder": fields.folder_walk(F.col("path"), rules), "scanner": fields.scanner_default(F.col("stem")), "scan_date": F.date_format("mtime", "yyyy-MM-dd"),
        "marks": index.found(low, plain=True), "stem_marks": in_stem.found(F.col("low_stem"), plain=True)})
    numbers = lambda group: [index.first(F.col("marks"), group), in_stem.first(F.col("stem_marks"), group)]
    out = out.withColumns({
        "person0": person_match(numbers("person"), rules, default_person, F.col("path")), "type0": nth([r.id for r in rules.types], F.coalesce(*numbers("type"))), "matched": matched_orgs(index, F.col("marks"), rules),
        "bank_words": index.count(F.col("marks"), "bank"), "lab_words": index.count(F.col("marks"), "lab"), "doubtful": index.has(F.col("marks"), "doubt"), "company_words": index.has(F.col("marks"), "company")})
    out = out.withColumn("best", best_org(F.col("matched"), F.col("type0")))
    doc_type = F.col("type0")
    doc_type = F.when((F.col("bank_words") >= 3) & doc_type.isin(*NOT_OF_A_BANK), F.coalesce(as_type("business"), doc_type)).otherwise(doc_type)
    doc_type = F.when((doc_type == "identity_card") & says("business") & F.col("company_words"), "business").otherwise(doc_type)
    out = out.withColumn("type1", doc_type).withColumn("clinic", first_of(F.col("matched"), CLINICAL))
    identity, at_clinic = F.col("type1") == "identity_card", F.col("clinic.id").isNotNull()
    official = F.coalesce(F.col("best.category").isin("Legal", "Government"), F.lit(False))
    laboratory = as_type("lab_requisition", "medical_record")
    out = out.withColumn("type2", F.when(identity & at_clinic, F.when(F.col("clinic.category") == "Lab", laboratory).otherwise("medical_record"))
                         .when(identity & ~official & (F.col("lab_words") >= 2), laboratory).otherwise(F.col("type1")))
    out = out.withColumn("own", F.when(identity & at_clinic, F.col("clinic")).otherwise(F.col("best"))).withColumns({"org": F.col("own.id"), "orgs": F.col("matched.id")})
    seen = F.when(F.col("type2").isin(*PATIENT_TYPES), proposals.patient(low, rules.people)) if rules.people else F.lit(None).cast("string")
    out = out.withColumn("person", F.coalesce("folder.person", seen, "person0"))
    billed = F.when(F.col("type2").isin("medical_record", "prescription") & says("bill"), "bill").otherwise(F.col("type2"))
    return out.withColumn("type3", billed).withColumn("type3", F.when((F.col("type3") == "medical_record") & says("prescription"), "prescription").otherwise(F.col("type3")))


def with_business(out: DataFrame, rules: Rules) -> DataFrame:
    """Dates and provider, and within a company's folder the business context, which may overrule the type."""
    low, norm = F.col("low"), F.col("norm")
    out = out.withColumn("category", F.nullif("own.category", F.lit("")))
    out = out.withColumn("provider", F.coalesce("own.folder_alias", text.safe_part(F.coalesce("own.name", F.lit("Unknown")))))
    dated = F.when(F.col("scanner"), F.col("scan_date")).otherwise(F.coalesce(dates.document_date(norm), F.col("scan_date")))
    out = out.withColumn("date0", dated).withColumn("amount", dates.amount(norm))
    by_folder = F.col("type3").isin("medical_record", "prescription", "bill", "dental_bill") & F.col("folder.date").isNotNull()
    out = out.withColumn("date1", F.when(by_folder, F.col("folder.date")).otherwise(F.col("date0")))
    out = out.withColumns({
        "ambiguous": F.coalesce(F.col("folder.ambiguous"), F.lit(False)) & F.col("folder.company").isNull(),
        "question": proposals.ambiguity(F.coalesce(F.col("folder.ambiguous"), F.lit(False)), F.col("folder.question"), F.col("folder.company"))})
    inside = F.coalesce(F.col("folder.company").isNotNull() & (F.col("folder.doc_type") == "Business"), F.lit(False))
    out = out.withColumn("business0", F.when(inside, proposals.business_kind(low, F.lit(True))))
    out = out.withColumn("doc_type", F.when(F.col("business0").isNotNull(), "business").otherwise(F.col("type3")))
    out = out.withColumn("subcategory", F.when(F.col("business0").isin("BusinessChecking", "BusinessCreditCard"), F.col("business0")))
    is_business, is_company = F.col("doc_type") == "business", F.coalesce(F.col("category") == "Business", F.lit(False))
    out = out.withColumn("stated", dates.statement_date(norm)).withColumn("date2", F.when(inside | is_business, F.coalesce("stated", "date1")).otherwise(F.col("date1")))
    alias, name = F.when(is_company, F.col("own.folder_alias")), F.when(is_company, F.col("own.name"))
    out = out.withColumn("written", F.when(is_business, fields.business_name(F.col("text"))))
    first = F.when(inside, F.coalesce("written", "folder.company"))
    out = out.withColumn("business_name", F.when(is_business, F.coalesce(first, F.when(alias.isNotNull(), name), F.col("written"), name)))
    # the folder by the folder's company or the text, by the organisation's own folder, by its name
    folder = F.coalesce(company_folder(first, rules), alias, company_folder(F.col("written"), rules), company_folder(name, rules))
    return out.withColumn("business_folder", F.when(is_business, folder))


def with_label(out: DataFrame, rules: Rules) -> DataFrame:
    """Label by organisation category, then default, then the type's name; and the destination by the routing rules."""
    kind = lambda r: r.category or r.id.capitalize()
    types = [{"id": r.id, "kind": kind(r), "plain": r.labels.get("default", r.id.capitalize()), "labels": [{"category": c, "label": v} for c, v in r.labels.items() if c != "default"]} for r in rules.types]
    listed_types = listed(types, "struct<id:string,kind:string,plain:string,labels:array<struct<category:string,label:string>>>")
    out = out.withColumn("rule", F.get(F.filter(listed_types, lambda r: r["id"] == F.col("doc_type")), F.lit(0)))
    named = F.get(F.filter("rule.labels", lambda x: x["category"] == F.col("category")), F.lit(0))["label"]
    out = out.withColumn("label0", F.coalesce(named, "rule.plain", "folder.doc_type", F.lit("Unknown"))).withColumn("type_category", F.col("rule.kind"))
    routed = [c for c in rules.priority if c in rules.routes]
    first = F.when(F.col("type_category").isin(*routed), F.col("type_category")) if routed else F.lit(None).cast("string")
    hint = F.when(F.col("doc_type").isNull(), F.col("folder.doc_type"))
    out = out.withColumn("route", F.coalesce(first, "category", "type_category", hint))
    year = F.substring("date1", 1, 4)
    company = F.coalesce("business_folder", "business_name", "own.name", F.lit(""))
    values = {"person": F.col("person"), "year": year, "provider": F.col("provider"), "company": company, "org_name": company, "subcategory": F.coalesce("subcategory", F.lit("")), "month": dates.month_bucket(F.col("date1")), "date_range": F.lit(""), "grade": F.lit("")}
    filled = lambda template, more=None: text.tidy_path(text.fill_template(template, values | (more or {})))
    past = (year.cast("int") != rules.current_year) & F.col("category").isin(*rules.archives) if rules.archives else F.lit(False)
    out = out.withColumn("routing", value_of(F.col("route"), rules.routes))
    out = out.withColumn("filled", filled(F.coalesce("routing", F.when(past, value_of(F.col("category"), rules.archives)))))
    return out.withColumn("destination0", F.coalesce(F.when(F.col("routing").isNotNull(), F.col("filled")), "own.destination", "filled", F.lit(rules.default_destination)))


def with_name(out: DataFrame, rules: Rules) -> DataFrame:
    """The proposed name, the final label and destination, by type, or from the folders where no type is found."""
    low, norm, stem, person = F.col("low"), F.col("norm"), F.col("stem"), text.safe_part(F.col("person"))
    type_is = lambda name: F.col("doc_type") == name
    page = F.nullif(text.sequence_suffix(stem), F.lit(""))
    out = out.withColumn("pharmacy", F.when(type_is("prescription"), first_of(F.col("matched"), ("Pharmacy", "Medical"))))
    at_pharmacy = F.col("pharmacy.id").isNotNull()
    values = {"person": person, "year": F.substring("date1", 1, 4)}
    counter = F.when(at_pharmacy, F.coalesce("pharmacy.destination", F.lit(rules.routes.get("Pharmacy") or None).cast("string"))).when(either(low, ("pharmacy", "walgreens", "cv s")), rules.health_template)
    dispensed = text.tidy_path(text.fill_template(counter, values))
    rx_provider = F.when(at_pharmacy, text.safe_part(F.col("pharmacy.name"))).otherwise(F.col("provider"))
    drug = fields.medication(norm, rules.medications)
    employed = fields.employment_kind(norm)
    out = out.withColumns({
        "date": F.when(type_is("identity_card"), proposals.identity_date(F.col("date2"), F.col("scan_date"))).when(type_is("employment"), F.coalesce(
            F.col("folder.date"), F.when(F.col("date2") == F.col("scan_date"), dates.date_anywhere(stem)), F.col("date2"))).otherwise(F.col("date2")),
        "company": F.coalesce("folder.company", known(F.col("provider"))),
        "label": F.when(type_is("identity_card"), F.concat(proposals.identity_label(low, stem), F.coalesce(fields.side_in_name(stem), F.lit(""))))
        .when(type_is("vehicle"), F.when(low.contains("registration"), "RegistrationRenewal").when(low.contains("title transfer"), "TitleTransfer").when(low.contains("lease"), "LeaseEnd").otherwise(F.col("label0")))
        .when(type_is("employment"), F.coalesce(*[F.when(employed == k, F.lit(v)) for r in rules.types if r.id == "employment" for k, v in r.labels.items() if k != "default"], F.col("label0")))
        .when(type_is("business"), F.coalesce(proposals.company_paper(low), F.col("label0"))).otherwise(F.col("label0"))})
    vehicle = fields.vehicle(norm)
    mark = F.coalesce(F.concat(F.lit("TagDecal_"), vehicle["tag"]), F.concat(F.lit("VIN_"), F.substring(vehicle["vin"], 1, 8)))
    shown = F.coalesce("business_folder", text.safe_part(F.col("business_name")))
    of_month = F.when(F.col("subcategory").isNotNull(), F.substring("date", 1, 7)).otherwise(F.col("date"))
    by_type = (
        F.when(type_is("identity_card"), parts(F.col("date"), F.col("label"), person))
        .when(type_is("prescription"), parts(F.col("date"), rx_provider, F.lit("Rx"), drug["generic"], F.when(drug["brand"].isNotNull(), F.concat(F.lit("BrandName_"), drug["brand"])), person))
        .when(type_is("vehicle"), parts(F.col("date"), known(F.col("provider")), F.col("label"), mark, person))
        .when(type_is("employment"), parts(F.col("date"), F.when(F.col("company").isNotNull(), text.safe_part(F.col("company"))), F.col("label"), person, page))
        .when(type_is("business") & F.col("business_name").isNotNull(), parts(of_month, shown, F.coalesce("subcategory", "label")))
        .when(type_is("business"), parts(F.col("date"), F.col("label")))
        .otherwise(parts(F.col("date"), F.col("provider"), F.col("label"), person)))
    # no type: the folders tell what it is
    event = F.col("folder.event")
    kind = F.coalesce("folder.doc_type", F.when(F.col("scanner"), F.lit("Scan")), F.lit("Unknown"))
    staff = F.when(employed != "Employment", F.concat(F.lit("Employee"), employed)).when(F.lower(event).contains("recognition"), "EmployeeRecognition").when(F.lower(event).contains("evaluation"), "EmployeeEvaluation").otherwise(kind)
    kind = F.when(F.col("scanner") & (kind == "Employment"), staff).otherwise(kind)
    when = F.coalesce("folder.date", "date2")
    company = F.when(F.col("company").isNotNull(), text.safe_part(F.col("company")))
    event = F.when(event.isNotNull(), text.safe_part(event))
    more = F.when(F.col("folder.event_suffix").isNotNull(), text.safe_part(F.col("folder.event_suffix")))
    by_folder = (
        F.when(~F.col("scanner"), parts(when, company, text.safe_part(kind), F.col("folder.subcategory"), person))
        .when((kind == "Creative_Work") & event.isNotNull(), parts(when, event, F.lit("Pics"), person, page))
        .when(kind.isin("EmployeeEvaluation", "EmployeeRecognition"), parts(when, company, kind, person, page))
        .when(kind == "Education", parts(F.coalesce("folder.date_range", when), event, more, person, page))
        .otherwise(parts(when, kind, F.col("folder.subcategory"), F.when(kind != "Creative_Work", event), person, page)))
    typed = F.col("doc_type").isNotNull()
    out = out.withColumns({"kind": F.when(~typed, kind), "name0": F.when(typed, by_type).otherwise(by_folder)})
    legal = F.col("label").isin("SCorporationElection", "EINConfirmation", "GovernmentFiling")
    paper = F.when(legal, "Legal/").when(F.col("subcategory").isNotNull(), F.concat(F.lit("Financial/"), F.substring("date", 1, 4), F.lit("/Banking/"))).otherwise("Financial/00_Foundational/")
    folder_values = {
        "person": person, "year": F.coalesce("folder.year", F.substring("date1", 1, 4)), "org_name": F.coalesce("company", F.lit("")), "company": F.coalesce("company", F.lit("")), "provider": F.coalesce("company", F.lit("")),
        "subcategory": F.coalesce("folder.subcategory", F.lit("")), "date_range": F.coalesce("folder.date_range", F.lit("")), "grade": F.coalesce("folder.date_range", "folder.year", F.lit("")), "month": dates.month_bucket(F.col("date2"))}
    hinted = value_of(F.col("folder.doc_type"), rules.routes)
    return out.withColumn("destination", F.coalesce(
        F.when(type_is("identity_card"), text.tidy_path(text.fill_template(F.lit(rules.identity_template), values))), F.when(type_is("prescription"), dispensed),
        F.when(type_is("employment") & F.col("company").isNotNull() & F.col("destination0").contains("Employment") & ~F.coalesce(F.col("destination0").contains(F.col("company")), F.lit(False)), F.concat(F.lit(rules.employment_folder), text.safe_part(F.col("company")), F.lit("/"))),
        F.when(type_is("business") & F.col("business_name").isNotNull() & F.col("business_folder").isNotNull(), F.concat(F.lit(rules.business_root), F.col("business_folder"), F.lit("/"), paper)),
        F.when(~typed & hinted.isNotNull(), text.tidy_path(text.fill_template(hinted, folder_values))), F.col("destination0")))


def with_confidence(out: DataFrame) -> DataFrame:
    """Confidence of the rule in tiers, and of the classification: what speaks against and for it."""
    words = F.split("norm", " ")
    typed, has_org, hinted = F.col("doc_type").isNotNull(), F.col("org").isNotNull(), F.col("folder.doc_type").isNotNull()
    tier = F.when(has_org & hinted, 0.92).when(has_org, 0.88).when(hinted, 0.72).otherwise(0.55)
    tier = F.when(F.col("doc_type").isin("bill", "insurance", "vehicle") & F.col("doubtful"), F.least(tier, F.lit(0.40))).otherwise(tier)
    clues = sum((F.col(f"folder.{c}").isNotNull().cast("int") for c in ("person", "doc_type", "company", "date")), F.lit(0))
    of_folder = F.when(F.col("scanner"), F.when(clues >= 3, 0.72).when(clues >= 2, 0.55).otherwise(0.40)).otherwise(F.when(clues >= 2, 0.55).when(clues >= 1, 0.40).otherwise(0.25))
    match = F.when(typed, F.concat_ws(":", "doc_type", F.coalesce("org", F.lit("no-org")))).when(F.col("scanner"), F.concat(F.lit("folder-hint:"), F.col("kind"))).otherwise("fallback-folder")
    out = out.withColumns({"rule_confidence": F.when(typed, tier).otherwise(of_folder), "rule_match_id": match})
    categories = F.size(F.array_distinct("matched.category"))
    mean = F.length(F.array_join(words, "")) / F.size(words)
    agrees = reduce(lambda a, b: a | b, [F.col("doc_type").isin(*types) & F.col("category").isin(*cats) for types, cats in AGREEING])
    minus = lambda when, x: F.when(when, x).otherwise(0.0)
    score = (
        F.col("rule_confidence") - minus(categories > 1, 0.15) - minus((F.col("doc_type") == "identity_card") & has_org & ~F.col("category").isin("Legal", "Government"), 0.20)
        - minus(F.col("ambiguous"), 0.10) - minus((F.length("norm") < 100) | (mean < 3.0), 0.15) + minus(agrees, 0.05))
    return out.withColumn("confidence", F.round(dates.clamp(score), 4))


def with_suffixes(out: DataFrame) -> DataFrame:
    """Amount and due date at the end of the name, by the document's label, and the file's ending."""
    shown = F.when(F.col("doc_type") == "prescription", "Rx").otherwise(F.coalesce(F.when(F.col("doc_type").isNotNull(), F.col("label")), "kind"))
    out = out.withColumn("shown_type", shown)
    paid = F.col("amount").isNotNull() & ~F.col("name0").contains(F.coalesce("amount", F.lit(""))) & ~F.col("shown_type").isin(*NO_AMOUNT)
    out = out.withColumn("name1", F.concat("name0", F.when(paid, F.concat(F.lit("_"), F.col("amount"))).otherwise("")))
    out = out.withColumn("due", F.when(F.col("shown_type").isin(*BILLS, "Insurance"), dates.due_date(F.col("norm"))))
    late = F.col("due").isNotNull() & ~F.col("name1").contains(F.coalesce("due", F.lit("")))
    return out.withColumn("proposed_name", F.concat("name1", F.when(late, F.concat(F.lit("_DueDate_"), F.col("due"))).otherwise(""), text.suffix(F.col("path"))))


def classify(docs: DataFrame, rules: Rules, *, default_person: str = "Shared") -> DataFrame:
    """docs (doc_id, path, text, mtime) with doc_type, org, orgs, person, label, shown_type, doc_date, amount, provider,
    destination, proposed_name, ambiguous, question, rule_confidence, rule_match_id and confidence."""
    tasks = SPREAD * docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.repartition(tasks, "doc_id")  # a few files would be a few tasks: rules take far longer than the shuffle
    out = with_suffixes(with_name(with_label(with_business(with_type(docs, rules, default_person), rules), rules), rules))
    return with_confidence(out).withColumn("doc_date", F.coalesce(F.when(F.col("doc_type").isNull(), F.col("folder.date")), F.col("date")))


def run_destination(doc_type: Column, person: Column, current: Column, root: str = "Health/{person}/") -> Column:
    """Where a run of pages goes by its kind; elsewhere the current destination stays."""
    kind = F.lower(doc_type)
    base = text.fill_template(F.lit(root), {"person": person})
    return F.coalesce(*[F.when(kind.isin(*kinds), F.concat(base, F.lit(folder))) for folder, kinds in RUN_DESTINATIONS.items()], current)


def apply_overrides(results: DataFrame, overrides: DataFrame) -> DataFrame:
    """Keyword overrides after classification: the first rule (ord) whose word is in the path sets what it gives.

    overrides: ord, word, name, destination, confidence; {page} in a name is the number at the end of the file's. A small table
    of rules, which is checked to be one before it is told to all tasks."""
    if overrides.count() > 10_000:
        raise ValueError("over 10,000 override rules")
    found = results.select("doc_id", "path").join(F.broadcast(overrides), F.lower("path").contains(F.lower("word")))
    best = found.groupBy("doc_id").agg(F.min(F.struct("ord", "name", "destination", F.col("confidence").alias("sure"))).alias("o"))
    page = text.sequence_suffix(text.stem(F.col("path")))
    joined = results.join(best, "doc_id", "left")
    return joined.withColumns({
        "proposed_name": F.coalesce(F.replace(F.col("o.name"), F.lit("{page}"), page), "proposed_name"), "destination": F.coalesce("o.destination", "destination"), "rule_confidence": F.coalesce("o.sure", "rule_confidence")}).drop("o")
