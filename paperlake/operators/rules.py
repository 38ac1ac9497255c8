"""Rule tables, their patterns compiled to Columns, the approval gate and learned corrections."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.phrases import PhraseIndex, listed


@dataclass(frozen=True)
class TypeRule:
    id: str
    patterns: tuple[str, ...]
    category: str = ""
    labels: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class FolderRule:
    """What a pattern in a path says of the documents below it."""

    pattern: str
    doc_type: str | None = None
    person: str | None = None
    company: str | None = None
    event: str | None = None
    ambiguous: bool = False
    question: str | None = None


@dataclass(frozen=True)
class OrgRule:
    id: str
    names: tuple[str, ...]
    category: str
    person: str | None = None
    destination: str | None = None
    folder_alias: str | None = None


@dataclass(frozen=True)
class Rules:
    """Small rule tables, in order: the first that matches wins."""

    types: tuple[TypeRule, ...]
    orgs: tuple[OrgRule, ...]
    people: tuple[tuple[str, tuple[str, ...]], ...]
    routes: dict[str, str]
    archives: dict[str, str] = field(default_factory=dict)
    default_destination: str = "Inbox/Unsorted/"
    current_year: int = 1998
    bank_words: tuple[str, ...] = ()
    #: Categories of types whose own route comes before the organisation's.
    priority: tuple[str, ...] = ("Prescription", "EyeExam", "SchoolEntry", "Business", "Bill", "MedicalBill", "LabBill", "DentalBill", "HospitalBill", "VisionBill")
    folders: tuple[FolderRule, ...] = ()
    path_people: tuple[tuple[str, str], ...] = ()
    companies: tuple[tuple[str, str], ...] = ()
    medications: tuple[tuple[str, str], ...] = ()
    health_template: str = "Health/{person}/"
    identity_template: str = "Legal/Identity/{person}/"
    employment_folder: str = "Archive/Employment/"
    business_root: str = "Companies/"

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The same rules as DataFrames."""
        return {
            "rules_type": spark.createDataFrame([(i, r.id, r.category, list(r.patterns), r.labels) for i, r in enumerate(self.types)], "ord int, id string, category string, patterns array<string>, labels map<string,string>"),
            "rules_org": spark.createDataFrame([(i, r.id, list(r.names), r.category, r.person, r.destination, r.folder_alias) for i, r in enumerate(self.orgs)], "ord int, id string, names array<string>, category string, person string, destination string, folder_alias string"),
            "rules_person": spark.createDataFrame([(i, j, p, a) for i, (p, names) in enumerate(self.people) for j, a in enumerate(names)], "ord int, alias_ord int, person string, alias string"),
            "rules_folder": spark.createDataFrame([(i, r.pattern, r.doc_type, r.person, r.company, r.event, r.ambiguous, r.question) for i, r in enumerate(self.folders)], "ord int, pattern string, doc_type string, person string, company string, event string, ambiguous boolean, question string"),
            "rules_route": spark.createDataFrame(list(self.routes.items()), "category string, template string"),
        }


#: What each context of document types prefers among the organisations that match.
CONTEXTS = {
    ("Lab", "Medical", "Pharmacy", "Dental", "Vision", "Hospital"): ("lab_requisition", "medical_record", "prescription", "eye_exam", "referral"),
    ("Insurance", "AutoInsurance"): ("bill", "medical_bill", "insurance"),
    ("Government", "Legal"): ("identity_card",),
    ("Business",): ("business", "bank_statement", "employment"),
}


def pattern_of(raw: str) -> str:
    """Raw if it holds a class or boundary, bounded if it is short, else literal."""
    if any(m in raw for m in (r"\b", r"\d", r"\s")):
        return raw
    return rf"\b{re.escape(raw)}\b" if len(raw) <= 3 else re.escape(raw)


def phrase_index(rules: Rules, **words: tuple[str, ...]) -> PhraseIndex:
    """Index of what is looked for in texts: names of organisations (bounded), patterns of types, aliases of people (anywhere), and
    lists of words by the name of the list, each word a rule of its own."""
    index = PhraseIndex().add("org", [tuple(n.lower() for n in o.names) for o in rules.orgs], bounded=True)
    index.add("type", [r.patterns for r in rules.types], patterns=True).add("person", [names for _, names in rules.people])
    for name, own in words.items():
        index.add(name, [(w,) for w in own])
    return index


#: What is kept of an organisation that stands in a text.
ORG = "struct<id:string,category:string,person:string,destination:string,folder_alias:string,name:string>"


def org_table(rules: Rules) -> Column:
    """All organisations, in rule order, as one literal array of ORG."""
    return listed([{"id": o.id, "category": o.category, "person": o.person or None, "destination": o.destination or None, "folder_alias": o.folder_alias or None, "name": o.names[0]} for o in rules.orgs], f"{ORG}")


def matched_orgs(index: PhraseIndex, marks: Column, rules: Rules) -> Column:
    """All organisations named in the text, in rule order."""
    if not rules.orgs:
        return F.array().cast(f"array<{ORG}>")
    return F.transform(index.all(marks, "org"), lambda n: F.get(org_table(rules), n))


def first_of(orgs: Column, categories: tuple[str, ...]) -> Column:
    """The first organisation of one of the categories."""
    return F.get(F.filter(orgs, lambda o: o["category"].isin(*categories)), F.lit(0))


def best_org(orgs: Column, doc_type: Column) -> Column:
    """The first organisation of the context's categories, else the first of all."""
    out = None
    for categories, types in CONTEXTS.items():
        out = F.when(doc_type.isin(*types), first_of(orgs, categories)) if out is None else out.when(doc_type.isin(*types), first_of(orgs, categories))
    return F.coalesce(out, F.get(orgs, F.lit(0)))


def nth(values: list, number: Column) -> Column:
    """The value with a number, null for none."""
    return F.get(listed(values), number) if values else F.lit(None).cast("string")


def rules_of(document: dict) -> Rules:
    """Rules from a parsed rules document: lists document_types, organizations and people, and a routing table."""
    routing = document.get("routing", {})
    return Rules(
        types=tuple(TypeRule(r["id"], tuple(r["patterns"]), r.get("category", ""), dict(r.get("labels", {}))) for r in document.get("document_types", ())),
        orgs=tuple(OrgRule(r["id"], tuple(r["names"]), r.get("category", ""), r.get("person"), r.get("destination"), r.get("folder_alias")) for r in document.get("organizations", ())),
        people=tuple((r["name"], tuple(r["aliases"])) for r in document.get("people", ())),
        routes={k: v["template"] for k, v in routing.get("category_routing", {}).items() if v.get("template")},
        archives=dict(routing.get("archive_templates", {})),
        folders=tuple(FolderRule(**r) for r in routing.get("folders", ())),
        path_people=tuple((r["pattern"], r["person"]) for r in routing.get("path_people", ())),
        companies=tuple((a, r["folder"]) for r in routing.get("business_companies", ()) for a in r["match"]),
        **{k: document[k] for k in ("default_destination", "current_year") if k in document})


def person_match(found: list[Column], rules: Rules, default: str, path: Column) -> Column:
    """The first person named in the text, else in the file name (numbers of both in found), else by a pattern of the path, else
    the default."""
    by_path = [F.when(path.rlike("(?i)" + p), F.lit(who)) for p, who in rules.path_people]
    return F.coalesce(nth([p for p, _ in rules.people], F.coalesce(*found)), *by_path, F.lit(default))


def auto_approve(results: DataFrame, *, threshold: float = 0.9, never: tuple[str, ...] = ("identity_card", "business"), safe: tuple[str, ...] = ("prescription", "lab_requisition", "bill"), people: tuple[str, ...] = ()) -> DataFrame:
    """results with approved and the reason. What is asked beyond text, confidence and type: the columns quality, duplicates (a
    number), ambiguous, needs_side, if results has them; and that the person is one of people, if any are given."""
    has = lambda c, test: F.coalesce(test(F.col(c)), F.lit(False)) if c in results.columns else F.lit(False)
    reason = (
        F.when((F.length("norm") < 20) | has("quality", lambda q: q < 0.2), "weak text").when(F.col("confidence") < threshold, "low confidence").when(F.col("doc_type").isin(*never), "never")
        .when(~F.coalesce(F.col("doc_type").isin(*safe), F.lit(False)), "not safe").when(has("duplicates", lambda n: n > 0), "duplicate").when(has("ambiguous", lambda x: x), "ambiguous").when(has("needs_side", lambda x: x), "side open")
        .when(~F.coalesce(F.col("person").isin(*people), F.lit(False)) if people else F.lit(False), "unknown person").otherwise("ok"))
    return results.withColumn("reason", reason).withColumn("approved", F.col("reason") == "ok")


def with_corrections(results: DataFrame, corrections: DataFrame, rules: Rules | None = None, **options) -> DataFrame:
    """results with what their best learned correction says: type, person and provider (as far as the corrections have these
    columns), and its boost of the confidence; corrected says whether there was one.

    With rules, a type counts only if it is one of theirs, in any case, and brings its default label; without, every type counts.
    Null and Unknown correct nothing. Proposed names and destinations stay as they were found."""
    says = {c: f"corrected_{c}" for c in ("doc_type", "person", "provider") if f"corrected_{c}" in corrections.columns and c in results.columns}
    out = best_correction(results, corrections, **options).withColumn("_boost", boost())
    out = out.withColumns({f"_{c}": F.nullif(F.col(f"_best.{v}"), F.lit("Unknown")) for c, v in says.items()})
    if rules is not None and "doc_type" in says:
        out = out.withColumn("_doc_type", F.when(F.lower("_doc_type").isin(*[r.id for r in rules.types]), F.lower("_doc_type")))
    changed = {c: F.coalesce(f"_{c}", c) for c in says}
    changed["confidence"] = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.coalesce("_boost", F.lit(0.0)))), 4)
    if rules is not None and "doc_type" in says and "label" in results.columns:
        names = {r.id: r.labels.get("default", r.id) for r in rules.types}
        label = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("_doc_type")) if names else F.lit(None).cast("string")
        changed["label"] = F.when(F.col("_doc_type").isNotNull() & ~F.col("_doc_type").eqNullSafe(F.col("doc_type")), label).otherwise(F.col("label"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in results.columns], F.col("_boost").isNotNull().alias("corrected"))


def best_correction(results: DataFrame, corrections: DataFrame, *, newest: int = 100, overlap: int = 3) -> DataFrame:
    """results with _best, what apply_corrections finds for each, or null. The newest corrections are one row of `newest` at most,
    which every task has beside its documents: no shuffle, and no second run of what results are made of."""
    says = [c for c in ("corrected_doc_type", "corrected_person", "corrected_provider") if c in corrections.columns]
    held = corrections.orderBy(F.desc("correction_date"), F.desc("id")).limit(newest).select("id", "org_id", "keywords", *says, "correction_date")
    held = held.agg(F.collect_list(F.struct(*held.columns)).alias("_held"))
    out = results.withColumn("_words", text.keywords(F.col("text"))).crossJoin(F.broadcast(held))
    fits = lambda h: h["org_id"].isNull() | F.col("org").isNull() | (h["org_id"] == F.col("org"))
    shared = F.transform(F.filter("_held", fits), lambda h: F.struct(
        F.size(F.array_intersect("_words", h["keywords"])).alias("overlap"), h["correction_date"].alias("correction_date"), h["id"].alias("id"), *[h[c].alias(c) for c in says], F.size(h["keywords"]).alias("n")))
    best = F.array_max(F.filter(shared, lambda x: x["overlap"] >= overlap))
    return out.withColumn("_best", best).drop("_words", "_held")


def boost() -> Column:
    """The boost of the confidence by _best, null without."""
    return F.when(F.col("_best").isNotNull(), F.least(F.lit(0.10), 0.05 + 0.05 * F.col("_best.overlap") / F.col("_best.n")))


def apply_corrections(results: DataFrame, corrections: DataFrame, **options) -> DataFrame:
    """Each document's best learned correction: newest `newest` ones, same organisation or none on either side, largest keyword
    overlap, of equal ones the newest."""
    says = [c for c in ("corrected_doc_type", "corrected_person", "corrected_provider") if c in corrections.columns]
    best = best_correction(results, corrections, **options).where(F.col("_best").isNotNull())
    return best.select("doc_id", F.col("_best.id").alias("correction_id"), *[F.col(f"_best.{c}").alias(c) for c in says], boost().alias("boost"))
