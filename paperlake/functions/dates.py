"""Date, number and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"\b(20\d{2}-\d{2}-\d{2})\b"
LONG, SHORT = r"\b(\d{2}/\d{2}/\d{4})\b", r"\b(\d{2}/\d{2}/\d{2})\b"
#: Fixed values.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DUE_WORDS = ("due date", "payment due", "pay before", "pay by", "must be received by", "due ")
EXPIRY_WORDS = ("exp", "expires", "expiration", "exp date", "exp.")
#: A date after one of these, whole within the 30 characters before it, is a date of birth.
BIRTH_MARKS = ("dob", "date of birth", "born", "birthday")
OF_BIRTH = rf"(?i)(?:{'|'.join(BIRTH_MARKS)}) ?:.*\z"
#: Any of the three forms of a date.
DATE = r"\b(20\d{2}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}/\d{2}/\d{2})\b"
CUT = "\x01"


def four_digit_year(year: Column) -> Column:
    return F.when(F.length(year) > 2, year).when(year.cast("int") < 50, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often use reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def iso_date(slashed: Column) -> Column:
    """MM/DD/YYYY or MM/DD/YY as YYYY-MM-DD; null for an empty string."""
    two = lambda x: F.lpad(x, 2, "0")
    return let(F.split(F.nullif(slashed, F.lit("")), "/"), lambda p: F.when(p.isNotNull(), F.concat_ws("-", four_digit_year(F.get(p, F.lit(2))), two(F.get(p, F.lit(0))), two(F.get(p, F.lit(1))))))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def document_date(text: Column) -> Column:
    """The first date that is no date of birth: ISO before MM/DD/YYYY before MM/DD/YY. The text is cut at its dates in one pass;
    only the thirty characters before each are looked at."""
    parts = F.split(F.regexp_replace(F.translate(text, CUT, " "), DATE, f"{CUT}$1{CUT}"), CUT)  # text, date, text, date, ... text

    def kept(parts):
        places = F.when(F.size(parts) > 2, F.sequence(F.lit(2), F.size(parts) - 1, F.lit(2)))
        # dates among the thirty characters before count as text: four of them at most
        before = lambda k: F.right(F.array_join(F.slice(parts, F.greatest(k - 9, F.lit(1)), F.least(k - 1, F.lit(9))), ""), F.lit(30))
        return F.transform(F.filter(places, lambda k: ~before(k).rlike(OF_BIRTH)), lambda k: F.get(parts, k - 1))

    first = lambda found, form: F.get(F.filter(found, lambda x: x.rlike(form)), F.lit(0))
    best = let(let(parts, kept), lambda found: F.coalesce(first(found, "-"), first(found, r"/\d{4}$"), F.get(found, F.lit(0))))
    return let(best, lambda d: F.when(d.contains("/"), iso_date(d)).otherwise(d))


#: Words before the date of a statement, in the order in which they are looked for; the first begins a period.
STATEMENT_WORDS = ("statement period", "closing date", "as of")
NOTICE_WORDS = "notice date"
SLASHED = r"\d{1,2}/\d{1,2}/\d{2,4}"


def _lead(words: str) -> str:
    return r"\b" + r"\s+".join(words.split()) + r"\b[:\s]*"


def statement_date(text: Column) -> Column:
    """The end of a statement period, a closing date, an as-of date or a notice date with its month in words, in this order."""
    low = F.lower(text)
    period, *others = STATEMENT_WORDS
    slashed = iso_date(F.coalesce(_first(low, rf"{_lead(period)}{SLASHED}\s*-\s*({SLASHED})"), *[_first(low, f"{_lead(words)}({SLASHED})") for words in others]))
    worded = F.regexp_extract(low, _lead(NOTICE_WORDS) + r"([a-z]+\s+\d{1,2},?\s*\d{4})", 1)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(worded, "^[a-z]+", 0))
    number = lambda p: F.regexp_extract(worded, p, 1)
    return F.coalesce(slashed, F.when(month > 0, F.concat_ws("-", number(r"(\d{4})$"), F.lpad(month.cast("string"), 2, "0"), F.lpad(number(r"\s(\d{1,2})"), 2, "0"))))


def _near(text: Column, words: tuple[str, ...], reach: int) -> Column:
    """The first date within reach of the first place of each word, words in order."""
    date = lambda part: F.coalesce(_first(part, LONG), _first(part, SHORT))
    found = let(F.lower(text), lambda low: F.transform(F.array(*map(F.lit, words)), lambda w: let(F.position(w, low), lambda at: F.when(at > 0, date(F.substring(text, at, F.lit(reach)))))))
    return iso_date(F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0)))


def due_date(text: Column) -> Column:
    behind = r"(?is)due(?:(?!\b\d{2}/\d{2}/\d{4}\b).){0,37}?"
    return F.coalesce(_near(text, DUE_WORDS, 80), iso_date(_first(text, behind + LONG)), iso_date(_first(text, r"(?is)due.{0,37}?" + SHORT)))


def expiry_date(text: Column, from_year: int = 2026) -> Column:
    later = lambda p: F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), iso_date), lambda d: F.substring(d, 1, 4).cast("int") >= from_year), F.lit(0))
    return F.coalesce(_near(text, EXPIRY_WORDS, 50), later(LONG), later(SHORT))


def date_in_name(stem: Column) -> Column:
    m = r"^(\d{4})(\d{2})(\d{2})"
    return F.when(stem.rlike(m), F.concat_ws("-", *[F.regexp_extract(stem, m, k) for k in (1, 2, 3)]))


def date_anywhere(stem: Column) -> Column:
    """The first eight digits of a file name as a date."""
    d = F.regexp_extract(stem, r"\d{8}", 0)
    return F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def month_bucket(date: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(date, 1, 7), F.lit("")), F.lit("unknown"))


#: Fixed value: the form of an amount.
AMOUNT = r"\$\s*([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?)"


def amount(text: Column) -> Column:
    """The first $ amount without its commas; without commas three digits at most, as in the source data."""
    return F.replace(_first(text, AMOUNT), F.lit(","), F.lit(""))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def percent_text(x: Column) -> Column:
    return F.format_string("%.0f%%", F.when(x <= 1, x * 100).otherwise(x))


def band(x: Column, edges: tuple[tuple[float, str], ...], rest: str) -> Column:
    out = F.when(x >= edges[0][0], edges[0][1])
    for edge, name in edges[1:]:
        out = out.when(x >= edge, name)
    return out.otherwise(rest)


CONFIDENCE_BANDS = ((0.90, "high"), (0.75, "good"), (0.50, "medium"))


def age_label(minutes: Column) -> Column:
    return F.when(minutes < 60, F.format_string("%dm", minutes.cast("int"))).when(minutes < 1440, F.format_string("%dh", F.floor(minutes / 60).cast("int"))).otherwise(F.format_string("%dd", F.floor(minutes / 1440).cast("int")))


def denormalise_meta(json: Column) -> dict[str, Column]:
    """provider, patient and doc_type of a JSON text, trimmed and lower; empty where it is broken or has none."""
    parsed = F.from_json(json, "provider string, patient string, doc_type string")
    return {k: F.lower(F.trim(F.coalesce(parsed[k], F.lit("")))) for k in ("provider", "patient", "doc_type")}
