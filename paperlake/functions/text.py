"""Text, hash and path expressions: builders that take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import let

#: Words that keywords leave out.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might can this that these those it its not no nor as if "
    "then than too very just about above after again all also am any because before between both each few more most other our out over own same she he they them their there through under until up we "
    "what when where which while who whom why you your date time name address phone number page please see print yes true false none null void").split()
#: Words that speak for readable text.
COMMON_WORDS = (
    "the and for are but not you all can had her was one our out has have this that with from they been will date name patient medical doctor prescription diagnosis bill invoice statement total amount due").split()


def normalise_spaces(text: Column) -> Column:
    """Runs of white space (any, not only ASCII) as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def safe_part(text: Column) -> Column:
    """A file name part: other characters than letters, digits, dot, underscore and dash become underscores."""
    part = F.btrim(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(part, F.lit("")), F.lit("Unknown"))


def clean_name(text: Column) -> Column:
    return F.btrim(F.rtrim(F.replace(text, F.lit(" "), F.lit("_")), F.lit("_.")), F.lit("()"))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def prefix_fingerprint(content: Column, size: int = 524_288) -> Column:
    return F.sha2(F.substring(content, 1, size), 256)


def keywords(text: Column, most: int = 20) -> Column:
    """The first distinct words of three letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS))), 1, most)


def title_case(text: Column) -> Column:
    """A capital after every character that is no letter."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} by its value; null values and unknown names become Unknown."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("Unknown")))
    return F.regexp_replace(out, r"\{\w+\}", "Unknown")


def tidy_path(path: Column) -> Column:
    """Empty and placeholder folders go; one slash at the end."""
    out = F.regexp_replace(path, r"/(?:_|Unknown|None)(?=/|$)", "")
    return F.concat(F.rtrim(F.regexp_replace(out, "/{2,}", "/"), F.lit("/")), F.lit("/"))


def guard_length(path: Column, most: int = 240) -> Column:
    """Paths over `most` characters lose the end of their stem."""
    suffix = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.when(F.length(path) > most, F.concat(F.substring(path, F.lit(1), F.lit(most - 1) - F.length(suffix)), F.lit("…"), suffix)).otherwise(path)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def short_display(path: Column) -> Column:
    """The last three parts of a path."""
    return F.array_join(F.slice(F.split(path, "/"), -3, 3), "/")


def sequence_suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"_(\d+)$", 1)


def page_indicator(text: Column) -> Column:
    """struct(page, total) of "X of Y": the most frequent Y (first seen among equals) and its first X; null if none.

    A number whose token holds a slash is part of a date or a fraction; totals lie between 3 and 50."""
    at = r"(?i)\S*?\d{1,2}\s+of\s+\d{1,3}(?!\d)"
    pairs = F.transform(F.filter(F.regexp_extract_all(text, F.lit(at), F.lit(0)), lambda m: ~m.contains("/")), lambda m: F.struct(
        F.regexp_extract(m, r"(?i)(\d{1,2})\s+of", 1).cast("int").alias("page"), F.regexp_extract(m, r"(\d+)$", 1).cast("int").alias("total")))
    good = F.filter(pairs, lambda p: p["page"].between(1, p["total"]) & p["total"].between(3, 50))

    def best(found):
        # sorted by total, each run's length is its count: at most 48 totals are counted, once each
        totals = F.array_distinct(F.transform(found, lambda p: p["total"]))
        ranked = F.transform(totals, lambda y, i: F.struct(F.size(F.filter(found, lambda q: q["total"] == y)).alias("n"), (-i).alias("first"), y.alias("total")))
        top = F.array_max(ranked)["total"]
        return F.when(F.size(found) > 0, let(top, lambda y: F.get(F.filter(found, lambda p: p["total"] == y), F.lit(0))))

    return let(good, best)


def quality(text: Column) -> Column:
    """0 (unreadable) to 1 of recognised text: printable share, word length, artefacts, noise lines, common words.

    Each step is worked out once for a text and handed to the next."""
    letters = lambda s: F.length(F.regexp_replace(s, r"[^\p{L}\s]", ""))
    trim = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda s: s != "")
    signal = lambda x: F.struct(F.size(x).alias("lines"), F.filter(x, lambda s: letters(s) / F.length(s) >= 0.2).alias("signal"))
    joined = lambda z: F.struct(z["lines"].alias("lines"), z["signal"].alias("signal"), F.array_join(z["signal"], "\n").alias("joined"))
    words = lambda z: F.struct(*[z[c].alias(c) for c in ("lines", "signal", "joined")], F.filter(F.split(z["joined"], r"(?U)\s+"), lambda w: w != "").alias("words"))

    def measures(z):
        printable = F.length(F.regexp_replace(z["joined"], r"[^\p{L}\p{N}.,;:!?\-'\"()/@#$%&+= ]", ""))
        bars = F.size(F.filter(z["signal"], lambda s: (F.length(s) > 5) & (F.size(F.array_distinct(F.split(F.replace(s, F.lit(" "), F.lit("")), ""))) <= 2)))
        garbled = F.size(F.filter(z["words"], lambda w: (F.length(w) > 4) & (F.length(F.regexp_replace(w, r"\p{L}", "")) / F.length(w) > 0.5)))
        return F.struct(
            F.size(z["signal"]).alias("n"), F.least(F.lit(1.0), over(printable, F.length(F.replace(z["joined"], F.lit(" "), F.lit(""))))).alias("base"), over(F.length(F.array_join(z["words"], "")), F.size(z["words"])).alias("mean"),
            (bars + garbled).alias("artefacts"), over(z["lines"] - F.size(z["signal"]), z["lines"]).alias("noise"),
            let(F.lower(z["joined"]), lambda low: sum((low.contains(w).cast("int") for w in COMMON_WORDS), F.lit(0))).alias("hits"))

    def score(m):
        of = (
            m["base"] * F.when(m["mean"] < 2, 0.3).when(m["mean"] < 3, 0.7).otherwise(1.0) * F.when(m["artefacts"] > 5, 0.7).when(m["artefacts"] > 2, 0.85).otherwise(1.0)
            * F.when(m["noise"] > 0.5, 0.5).when(m["noise"] > 0.3, 0.75).otherwise(1.0))
        of = F.least(F.lit(1.0), of + F.when(m["hits"] >= 5, 0.10).when(m["hits"] >= 2, 0.05).otherwise(0.0))
        return F.when(m["n"] == 0, 0.1).otherwise(F.greatest(F.lit(0.0), of))

    return F.when(F.coalesce(F.length(trim(text)), F.lit(0)) < 10, 0.0).otherwise(let(let(let(let(let(lines, signal), joined), words), measures), score))


def markdown_kind(line: Column) -> Column:
    """The kind of block that a line of Markdown starts or continues."""
    t = F.trim(line)
    return (
        F.when(t == "", "blank").when(t.startswith("### "), "heading_3").when(t.startswith("## "), "heading_2").when(t.startswith("# "), "heading_1")
        .when(t.rlike(r"^-{3,}$"), "divider").when(t.rlike(r"^[-*] "), "bullet").when(t.startswith("|"), "table").otherwise("paragraph")
    )


def front_matter(text: Column, key: str) -> Column:
    """A key's value between the --- lines at the start of a text."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{key}:\s*(.*)$", 1)), F.lit(""))
