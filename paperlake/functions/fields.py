"""Fields from text, file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import let
from .phrases import PhraseIndex, listed

#: Dosage forms, and phrases of recognitions and of evaluations.
DOSAGE = ("TABLET", "TABLETS", "CAPSULE", "CAPSULES", "CHEWABLES", "SOLUTION", "SYRUP", "CREAM", "OINTMENT", "DROPS", "INHALER", "INJECTION", "PATCH", "SPRAY", "SUSPENSION")
RECOGNITION = ("on the spot award", "employee recognition", "recognition award", "recognition certificate", "recognition letter", "award for", "award certificate", "nominated by", "performance award")
EVALUATION = ("performance evaluation", "employee evaluation", "performance review", "employee performance", "meets expectations", "exceeds expectations", "development plan", "development planning")
#: Phrases that count as one.
ONE_OF = {"recognition award": "recognition", "recognition certificate": "recognition", "recognition letter": "recognition", "award for": "award", "award certificate": "award", "development plan": "plan", "development planning": "plan"}


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


#: Legal forms that end a company's name, banks that head statements, and streets.
LEGAL_FORMS = ("LLC", "INC", "LTD", "LLP", "CORP", "CORPORATION", "CO", "COMPANY")
BANKS = ("bank of america", "wells fargo", "chase", "citibank", "bank")
STREETS = ("st", "ave", "rd", "blvd", "dr", "way", "ct", "cir", "pl", "ln")
#: Words of capitals up to a legal form.
CAPITALS = rf"[A-Z0-9&][A-Z0-9&.-]*(?: +[A-Z0-9&.-]+)*? +(?:{'|'.join(LEGAL_FORMS)})\b\.?"


def _company_lines(text: Column) -> Column:
    """Every line with a company's name: struct(name, lead: the line before it, rest: the line behind it, above, below: the lines
    around, without empty ones, alone: whether the line is the name only)."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def named(lines):
        def of_line(line, i):
            # a notice's number and its letter in front are no part of the name
            lead = F.regexp_extract(line, r"(?i)^(?:.*employer identification number|cp ?575(?: [a-z](?= ))?) *", 0)
            return let(F.substring(line, F.length(lead) + 1, F.length(line)), lambda own: let(F.regexp_extract(own, CAPITALS, 0), lambda name: F.struct(
                name.alias("name"), F.lower(F.concat(lead, F.substring(own, F.lit(1), F.position(name, own) - 1))).alias("lead"), F.lower(F.trim(F.substring(own, F.position(name, own) + F.length(name), F.length(own)))).alias("rest"),
                F.lower(F.when(i > 0, F.get(lines, i - 1)).otherwise("")).alias("above"), F.lower(F.coalesce(F.get(lines, i + 1), F.lit(""))).alias("below"), (F.trim(own) == name).alias("alone"))))

        return F.filter(F.transform(lines, of_line), lambda x: x["name"] != "")

    return let(lines, named)


def _has(column: Column, *words: str) -> Column:
    return F.greatest(*[column.contains(w) for w in words], F.lit(False))


def business_name(text: Column) -> Column:
    """A company's name from the nine places where documents give it, in this order: a tax form's header, a notice of a tax number, an
    acceptance notice, below a bank's name, below an account's product, above a card number, above an account number, by the line
    of the deposit insurance or an offer, above a street address. Takes raw text (lines matter). A name that is only a legal form or a
    bank's own is none."""
    digits = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    plain = lambda x: x.rlike(r"^[\d *x-]+$")
    below = lambda c: F.concat_ws(" ", c["rest"], c["below"])
    places = (
        lambda c: _has(F.concat_ws(" ", c["above"], c["lead"]), "employer identification number") & below(c).rlike(r"^\d{2}-\d{7}\b"),
        lambda c: _has(c["lead"], "cp 575", "cp575") | (c["alone"] & _has(c["above"], "cp 575", "cp575")),
        lambda c: below(c).rlike(r"^notice\b.{0,25}\b\d{4}\b"),
        lambda c: c["alone"] & _has(c["above"], *BANKS),
        lambda c: c["alone"] & _has(c["above"], "business advantage", "business checking"),
        lambda c: c["alone"] & plain(c["below"]) & digits(c["below"]).between(12, 24),
        lambda c: c["alone"] & _has(c["below"], "account number", "account #") & (digits(c["below"]) >= 4),
        lambda c: c["alone"] & _has(F.concat_ws(" ", c["above"], c["lead"]), "member fdic", "offered by"),
        lambda c: c["alone"] & (c["below"].rlike(rf"^\d+ .*\b(?:{'|'.join(STREETS)})\b") | F.replace(F.replace(c["below"], F.lit("."), F.lit("")), F.lit(" "), F.lit("")).startswith("pobox")))

    def first(lines):
        sane = F.filter(lines, lambda c: ~F.lower(c["name"]).isin(*BANKS, *[f.lower() for f in LEGAL_FORMS]))
        return F.coalesce(*[F.get(F.filter(sane, place), F.lit(0))["name"] for place in places])

    return let(_company_lines(text), first)


def company_key(name: Column) -> Column:
    """A name as companies are compared: upper case, & as AND, no legal ending."""
    return F.trim(F.regexp_replace(F.replace(F.upper(F.trim(name)), F.lit("&"), F.lit("AND")), r"[ ,]*\b(?:CORPORATION|COMPANY|CORP|INC|LLC|LTD|LLP)\.?$", ""))


def _behind(text: Column, label: str, reach: int = 120) -> Column:
    """What stands behind the first place of a label (in any case), or null."""
    return let(F.position(F.lit(label), F.lower(text)), lambda at: F.when(at > 0, F.substring(text, at + len(label), F.lit(reach))))


def medication(text: Column, names: tuple[tuple[str, str], ...] = ()) -> Column:
    """struct(generic, brand): the words behind "medication", or of the named ingredient, up to a dosage word, a number or a bracket,
    four at most; the first brand name. names: aliases and the name that stands for each."""

    def words(part):
        own = F.filter(F.split(F.regexp_replace(F.upper(part), r"[^A-Z0-9.()]+", " "), " "), lambda w: w != "")
        return let(own, lambda w: let(F.array_position(F.transform(w, lambda x: x.isin(*DOSAGE) | x.rlike(r"^[\d(]")), F.lit(True)).cast("int"), lambda stop: F.slice(w, F.lit(1), F.when(stop > 0, F.least(stop - 1, F.lit(4))).otherwise(4))))

    line = let(words(_behind(text, "medication ")), lambda w: F.when(F.length(F.get(w, F.lit(0))) >= 5, F.array_join(w, " ")))
    ingredient = F.array_join(words(_behind(text, "generic ingredient:")), " ")
    found = let(F.coalesce(line, ingredient), lambda g: F.nullif(g, F.lit("")))
    listed_names = listed([{"alias": a.lower(), "name": n} for a, n in names], "struct<alias:string,name:string>")
    generic = let(found, lambda g: F.coalesce(F.get(F.filter(listed_names, lambda e: e["alias"] == F.lower(g)), F.lit(0))["name"], F.initcap(g)))
    brand = F.regexp_extract(F.coalesce(_behind(text, "brand name:"), _behind(text, "brand names:")), r"^\s*([A-Za-z]+)", 1)
    return F.struct(generic.alias("generic"), F.initcap(let(brand, lambda b: F.nullif(b, F.lit("")))).alias("brand"))


#: The printed leads of a vehicle's marks (either slash), and the least length of the mark behind each.
VEHICLE_MARKS = {"tag": ("tag/decal/vess", 5), "vin": ("vin/hin", 10)}
#: Loose words before a plate's number, and what may stand between.
PLATE_WORDS, PLATE_FILLERS = ("tag", "plate", "decal"), ("number", "no")


def vehicle(text: Column) -> Column:
    """struct(tag, vin): the letters and digits behind their printed leads."""
    same = F.replace(text, F.lit("\\"), F.lit("/"))
    mark = lambda lead: F.regexp_extract(_behind(same, lead, 60), r"^[#:\s]*([A-Za-z0-9]+)", 1)
    return F.struct(*[let(mark(lead), lambda m: F.when(F.length(m) >= least, m)).alias(name) for name, (lead, least) in VEHICLE_MARKS.items()])  # noqa: B023


def plate(text: Column) -> Column:
    """The first mark of two characters or more behind a plate word, with a filler, # or colon between."""
    words = F.split(F.regexp_replace(text, r"[\s:#]+", " "), " ")

    def first(w):
        at = F.array_position(F.transform(w, lambda x: F.lower(x).isin(*PLATE_WORDS)), F.lit(True)).cast("int")
        return let(F.when(at > 0, F.when(F.lower(F.get(w, at)).isin(*PLATE_FILLERS), F.get(w, at + 1)).otherwise(F.get(w, at))), lambda m: F.when(m.rlike(r"^\w{2}"), F.regexp_extract(m, r"^\w+", 0)))

    return let(words, first)


def employment_kind(text: Column) -> Column:
    """Recognition or Evaluation by which has more of its phrases, if it has two or the other none; else Employment."""
    kinds = {"r": RECOGNITION, "e": EVALUATION}
    rules = {kind: {} for kind in kinds}
    for kind, phrases in kinds.items():
        for p in phrases:
            rules[kind].setdefault(ONE_OF.get(p, p), []).append(p)
    index = PhraseIndex()
    for kind, own in rules.items():
        index.add(kind, [tuple(x) for x in own.values()], bounded=True)
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    counts = let(index.found(low), lambda m: F.struct(index.count(m, "r").alias("r"), index.count(m, "e").alias("e")))
    return let(counts, lambda n: F.when((n["r"] > n["e"]) & ((n["r"] >= 2) | (n["e"] == 0)), "Recognition").when((n["e"] > n["r"]) & ((n["e"] >= 2) | (n["r"] == 0)), "Evaluation").otherwise("Employment"))


def clinical(text: Column) -> Column:
    """struct(reason, diagnosis, physician), 200 characters at most each, from raw text."""
    line = lambda *labels: F.coalesce(*[F.substring(_first(text, rf"(?i){x}\s*[:\-]\s*([^\n]+)"), 1, 200) for x in labels])
    return F.struct(
        line(r"Reason\s+For\s+Visit", r"Chief\s+Complaint").alias("reason"),
        line(r"Final\s+Diagnosis", r"Admission\s+Diagnosis", r"Principal\s+Diagnosis", r"Discharge\s+Diagnosis").alias("diagnosis"),
        F.coalesce(_first(text, r"([A-Z][a-z]+, [A-Z][a-z]+(?: [A-Z]\.?)? MD)\b"), line(r"Primary\s+Physician", r"Attending\s+Physician")).alias("physician"))


def side_in_name(stem: Column) -> Column:
    low = F.lower(stem)
    edge = r"(?:$|[\s_\-])"
    return F.when(low.rlike(rf"(?:^|[\s_\-a-z])(?:front|recto){edge}"), "Front").when(low.rlike(rf"(?:^|[\s_\-a-z])(?:back|reverso|reverse|verso){edge}"), "Back")


#: Words that scanners and cameras number, and forms of their names, 9 for a digit. A form with a star may go on.
SCANNER_WORDS = ("s-corp", "doc", "document", "image", "scan", "img", "photo", "page", "file")
SCANNER_FORMS = ("scan9999-99-99_999999*", "99999999_999999_999", "docfile(9)", "skmbt_*")


def scanner_default(stem: Column) -> Column:
    """Whether a file name is one that scanners give: a known word with a number, a known form, a short model's name with _C and a
    digit, or a date of eight digits with a word behind it."""
    low = F.lower(stem)
    shape = F.regexp_replace(low, "[0-9]", "9")
    short = F.replace(F.regexp_replace(shape, "9+", "9"), F.lit(" "), F.lit(""))
    word = F.trim(F.regexp_replace(low, "[0-9]+$", ""))
    forms = [shape.startswith(f[:-1]) if f.endswith("*") else (short if "(" in f else shape) == f for f in SCANNER_FORMS]
    model = let(F.split(shape, "_"), lambda p: F.get(p, F.lit(0)).rlike("^[a-z]{2,6}$") & F.coalesce(F.get(p, F.lit(1)).startswith("c9"), F.lit(False)))
    dated = let(F.split(shape, " "), lambda p: (F.get(p, F.lit(0)) == "9" * 8) & F.coalesce(F.array_join(F.slice(p, F.lit(2), F.size(p)), "").rlike(r"^\w"), F.lit(False)))
    return F.when(stem.isNotNull(), word.isin(*SCANNER_WORDS) | F.greatest(*forms) | F.coalesce(model, F.lit(False)) | F.coalesce(dated, F.lit(False)))


def name_convention(stem: Column) -> Column:
    """struct(date, provider, doc_type, person, number) of date_provider_..._person_NNN."""
    number = F.nullif(F.regexp_extract(stem, r"_(\d{1,3})$", 1), F.lit(""))
    parts = F.split(F.regexp_replace(stem, r"_\d{1,3}$", ""), "_")
    return F.struct(
        F.when(F.get(parts, F.lit(0)).rlike(r"^\d{4}(?:-\d{2}-\d{2})?$"), F.get(parts, F.lit(0))).alias("date"), F.get(parts, F.lit(1)).alias("provider"),
        F.when(F.size(parts) > 3, F.array_join(F.slice(parts, F.lit(3), F.size(parts) - 3), " ")).alias("doc_type"), F.when(F.size(parts) > 2, F.element_at(parts, -1)).alias("person"), number.alias("number"))


def folder_facts(path: Column) -> Column:
    """struct(date, year, event, company) from the folders of a path, the nearest first; a later folder fills what is empty."""
    folders = F.reverse(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))
    empty = F.lit(None).cast("string")
    start = F.struct(empty.alias("date"), empty.alias("year"), empty.alias("event"), empty.alias("company"))

    def step(acc, f):
        date = F.nullif(F.regexp_extract(f, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
        year = F.nullif(F.regexp_extract(f, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit(""))
        event = F.when(date.isNotNull(), F.nullif(F.btrim(F.regexp_replace(f, r"\d{4}-\d{2}-\d{2}", ""), F.lit(" _-")), F.lit("")))
        company = F.when(date.isNull() & year.isNull() & f.rlike("^[A-Z]") & (F.length(f) > 2), f)
        return F.struct(F.coalesce(acc["date"], date).alias("date"), F.coalesce(acc["year"], year).alias("year"), F.coalesce(acc["event"], event).alias("event"), F.coalesce(acc["company"], company).alias("company"))

    return F.aggregate(folders, start, step)


#: Words that say nothing of an event, folders that say nothing at all, and sub-categories by words of folders.
EVENT_NOISE = ("scan", "img", "image", "document", "doc")
PICTURE_NOISE = ("pics", "pictures", "photos")
NO_FOLDERS = ("check", "scans", "inbox", "new", "pending", "todo", "!!!check", "export", "scan")
SUBCATEGORIES = (
    ("checking statements", "Checking"), ("credit card statements", "CreditCard"), ("credit card", "CreditCard"), ("savings statements", "Savings"), ("irs documentation", "IRS"), ("irs", "IRS"), ("eye exams", "Eye-Exams"),
    ("dental", "Dental"), ("vision", "Vision"), ("bofa statements", "BusinessChecking"), ("bankofamerica", "BusinessChecking"), ("bank of america", "BusinessChecking"), ("sunbiz payment", "GovernmentFiling"),
    ("sunbiz", "GovernmentFiling"), ("corporation docs", "SCorporationElection"))
WALKED = ("date", "year", "date_range", "event", "event_suffix", "company", "person", "subcategory")


def folder_walk(path: Column, rules) -> Column:
    """What a path tells, the nearest folder first: struct(date, year, date_range, event, event_suffix, company, person,
    subcategory, doc_type, ambiguous, question). Folder rules and path patterns come before the folders' names.

    Each folder is one thing: a range of years, a date (with an event beside it), a year, or a name that may hold an
    organisation and an event."""
    none = F.lit(None).cast("string")
    hint = F.coalesce(*[
        F.when(path.rlike("(?i)" + r.pattern), F.struct(*[F.lit(getattr(r, c)).cast("string").alias(c) for c in ("doc_type", "person", "company", "event", "question")], F.lit(r.ambiguous).alias("ambiguous"))) for r in rules.folders],
        F.lit(None).cast("struct<doc_type:string,person:string,company:string,event:string,question:string,ambiguous:boolean>"))
    by_path = [F.when(path.rlike("(?i)" + p), F.lit(who)) for p, who in rules.path_people]
    folders = F.filter(F.reverse(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))), lambda f: ~f.isin("", "!!!Check"))
    index = PhraseIndex().add("org", [tuple(n.lower() for n in o.names) for o in rules.orgs])
    orgs = listed([{"name": o.names[0], "person": o.person or None} for o in rules.orgs], "struct<name:string,person:string>")
    index.add("kind", [(w,) for w, _ in SUBCATEGORIES])
    kinds = listed([kind for _, kind in SUBCATEGORIES])
    seen = F.transform(folders, lambda f: let(index.found(F.lower(f)), lambda marks: F.struct(
        f.alias("folder"), F.transform(index.all(marks, "org"), lambda m: F.get(orgs, m)).alias("orgs"), F.transform(index.all(marks, "kind"), lambda m: F.get(kinds, m)).alias("kinds"))))

    def event_of(name, noise):
        words = F.filter(F.split(F.regexp_replace(name, "[^A-Za-z0-9]+", " "), " "), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*noise))
        return let(F.array_join(words, "_"), lambda e: F.nullif(e, F.lit("")))

    def step(acc, held):
        f = held["folder"]
        digits = F.nullif(F.regexp_extract(f, r"\d{8}", 0), F.lit(""))
        compact = lambda d: F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))

        def with_kind(found):
            years, full = f.rlike(r"^\d{4}-\d{4}"), f.rlike(r"^\d{4}-\d{2}-\d{2}")
            first = found.isNotNull() & acc["date"].isNull()  # a date anywhere in the name, if none is known
            again = found.isNotNull() & f.rlike(r"^\d{8}(?: +.+)?$")  # later only where the name starts with it
            kind = F.when(years, "years").when(first, "first").when(full, "full").when(again, "again").when(f.rlike(r"^\d{4}") & acc["year"].isNull(), "year").otherwise("name")
            return F.struct(kind.alias("kind"), found.alias("found"))

        def with_facts(k):
            kind, found = k["kind"], k["found"]
            dated = F.when(kind.isin("first", "again"), compact(found)).when(kind == "full", F.substring(f, 1, 10))
            event = F.when(kind.isin("first", "again"), event_of(F.replace(f, found, F.lit(" ")), EVENT_NOISE)).when(
                (kind == "name") & ~F.lower(F.trim(f)).isin(*NO_FOLDERS) & (F.length(F.trim(f)) > 2), event_of(F.regexp_replace(f, r"\d{8}|\d{4}-\d{2}-\d{2}", ""), (*EVENT_NOISE, *PICTURE_NOISE)))
            return F.struct(kind.alias("kind"), dated.alias("dated"), event.alias("event"), ((kind == "name") & acc["company"].isNull()).alias("org"))

        def merged(k):
            kind, dated, event = k["kind"], k["dated"], k["event"]
            new = {
                "date": F.coalesce(dated, acc["date"]),
                "year": F.when(kind == "years", F.substring(f, 1, 4)).when(kind == "first", F.coalesce(acc["year"], F.substring(dated, 1, 4))).when(dated.isNotNull(), F.substring(dated, 1, 4)).when(kind == "year", F.substring(f, 1, 4)).otherwise(acc["year"]),
                "date_range": F.when(kind == "years", F.substring(f, 1, 9)).otherwise(acc["date_range"]),
                "event": F.coalesce(acc["event"], event),
                "event_suffix": F.when(acc["event"].isNotNull(), F.coalesce(acc["event_suffix"], event)).otherwise(acc["event_suffix"]),
                "company": F.when(k["org"], F.get(held["orgs"], F.lit(0))["name"]).otherwise(acc["company"]),
                "person": F.coalesce(acc["person"], F.when(k["org"], F.get(F.filter(held["orgs"], lambda o: o["person"].isNotNull()), F.lit(0))["person"])),
                "subcategory": F.coalesce(F.get(held["kinds"], F.lit(0)), acc["subcategory"]),
            }
            return F.struct(*[new[c].alias(c) for c in WALKED])

        return let(let(let(digits, with_kind), with_facts), merged)

    def walk(hint):
        start = F.struct(*[{"event": hint["event"], "company": hint["company"], "person": F.coalesce(hint["person"], *by_path, none)}.get(c, none).alias(c) for c in WALKED])
        return F.aggregate(seen, start, step, lambda a: F.struct(
            *[a[c].alias(c) for c in WALKED], hint["doc_type"].alias("doc_type"), F.coalesce(hint["ambiguous"], F.lit(False)).alias("ambiguous"), hint["question"].alias("question")))

    return let(hint, walk)
