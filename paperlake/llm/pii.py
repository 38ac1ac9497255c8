"""Surrogates for personal data and credentials (native DataFrame operators only).

Entities are found by one pattern, in one pass whose matches are stored with the documents. Each has a type and a canonical
form (an e-mail address in lower case, a phone number's digits), so that all spellings of one entity share one surrogate. A
name is its words: given names and family names are entities of their own, whatever the title, so that Dr. Korn and Mrs. Anna
Korn stay one person, and so do all mentions of one word over the corpus. Words of a name that has a title somewhere in a text
are replaced where they stand alone in that text too.

Surrogates are drawn from a keyed hash and keep the type's form: digits stay digits, letters keep their case, card numbers keep
their check digit, addresses keep their shape, given names keep the gender that the corpus's titles give them, names keep
script, number of words and case. All entities of the corpus are checked together: a surrogate that another entity has, or
that is itself an entity of the corpus, is drawn anew, in a growing space, until all are distinct.

The key is the caller's: an argument, or the session's setting spark.paperlake.surrogateKey; without either the fixed
UNSAFE_KEY is taken, which anyone can repeat, and a warning is given.

Only texts with an entity are shuffled. Defined results: null texts stay null; texts without an entity keep every byte;
repeated rows get equal texts; rows without an id are treated like others; other columns keep their values, whatever their
names, but n_chars is counted anew; empty tables give no rows; the same key always gives the same surrogates for the same
corpus, whatever the order of its rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, store, table

UNSAFE_KEY = "paperlake"
KEY_SETTING = "spark.paperlake.surrogateKey"
#: Draws after which surrogates grow by a character a draw, for forms with few values; names grow by a syllable from the second on.
GROW_AFTER = 8

#: Titles and what they say of gender.
MALE, FEMALE, NEUTRAL = ("mr", "herr", "monsieur", "señor", "sr", "г-н"), ("mrs", "ms", "miss", "frau", "madame", "mme", "señora", "sra", "г-жа"), ("dr", "prof")
#: English titles that stand in other cases than a capital too, with their full stop.
ANY_CASE = ("mr", "mrs", "ms", "dr", "prof")
#: Words after Sr. that make it a rank, and words that are no part of a name in lower case.
RANKS = ("Software", "Engineer", "Developer", "Manager", "Director", "Analyst", "Architect", "Designer", "Consultant", "Product", "Project", "Data", "Vice", "Staff", "Research", "Scientist", "Associate", "Account", "Sales", "Systems", "Business", "Executive", "Advisor", "Technical", "Marketing", "Program", "Principal")
NO_NAME = ("a", "an", "and", "as", "at", "but", "by", "did", "does", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it", "of", "on", "or", "said", "says", "she", "that", "the", "then", "they", "to", "was", "were", "when", "who", "will", "with", "would")
#: Words before credentials, in any case.
PASSWORDS, TOKENS = ("password", "passwd", "pwd"), ("token", "secret", "api_key", "apikey", "access_key")
NAMES = {
    ("latin", "male"): ("Adrian", "Bruno", "Casper", "Dario", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Leon", "Milan", "Nico", "Oscar", "Pablo", "Ruben"),
    ("latin", "female"): ("Alma", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Laura", "Marta", "Nora", "Olivia", "Paula", "Rosa"),
    ("latin", "neutral"): ("Alex", "Andrea", "Charlie", "Dominique", "Jessie", "Kim", "Lee", "Maxime", "Noa", "Robin", "Sascha", "Toni", "Alexis", "Camille", "Sam", "Yael"),
    ("cyrillic", "male"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("cyrillic", "female"): ("Алла", "Вера", "Дарья", "Елена", "Жанна", "Ирина", "Лидия", "Майя"),
    ("cyrillic", "neutral"): ("Саша", "Женя", "Валя", "Слава", "Юля", "Тоня", "Паша", "Ася"),
}
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "za", "lor"), "cyrillic": ("ба", "ве", "ди", "го", "ку", "ла", "ме", "ни", "по", "ру", "са", "те", "ви", "во", "за", "лор")}

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
either = lambda words: "|".join(sorted(words, key=lambda t: (-len(t), t)))
CAPITAL = either({t.capitalize() for t in (*MALE, *FEMALE, *NEUTRAL)} | {"г-н", "г-жа"})
TITLE = rf"(?:(?:{CAPITAL})\.?|(?:{either([*ANY_CASE, *map(str.upper, ANY_CASE)])})\.)"
NAME = r"(?!A[KS]IA[A-Z0-9]{16}\b)\p{Lu}(?:\p{L}+|['’]\p{Lu}\p{L}+)(?:[-'’]\p{Lu}\p{L}+)*"
LOW_NAME = rf"(?!(?:{either(NO_NAME)})\b)\p{{Ll}}\p{{L}}+"
#: What is found, in the order in which alternatives are tried; a pattern that tells a match's type; and what every match holds:
#: one of some characters (first) or strings (others). A text without any of these has no entity, which is cheap to see.
ENTITIES = {
    "email": (r"(?<![\w.+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}", r"^[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}$", "@", ()),
    "ip": (rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)", r"^\d{1,3}(?:\.\d{1,3}){3}$", "0-9", ()),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", r"^\d{3}-\d{2}-\d{4}$", "0-9", ()),
    "card": (r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])", r"^\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}$", "0-9", ()),
    "phone": (r"(?<![\w])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", r"^\+?[\d(][\d ().-]+$", "0-9", ()),
    "iban": (r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$", "0-9", ()),
    "key": (r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)", r"^A[KS]IA[A-Z0-9]{16}$", "", ("AKIA", "ASIA")),
    "password": (rf"(?<=\b(?i:{either(PASSWORDS)})[=:]\s?)[^\s\"',;]{{4,}}", None, "=:", ()),
    "token": (rf"(?<=\b(?i:{either(TOKENS)})\s?[=:]\s?[\"'])[A-Za-z0-9+/_=-]{{16,}}", None, "=:", ()),
    "name": (
        rf"(?<![\p{{L}}\p{{N}}_])(?!Sr\.? (?:{either(RANKS)})\b)(?:{TITLE} {NAME}(?: {NAME}){{0,2}}|(?:mr|mrs|ms)\. {LOW_NAME}(?: {LOW_NAME})?)", rf"^{TITLE} \p{{L}}", "",
        (*(t for t in CAPITAL.split("|") if not any(t.startswith(x) and t != x for x in CAPITAL.split("|"))), *(f"{t}. " for t in (*ANY_CASE, *map(str.upper, ANY_CASE))))),
}
PATTERN = "|".join(f"(?:{e[0]})" for e in ENTITIES.values())


def may_hold_entity(text: Column) -> Column:
    """Whether a text has what every match of some type holds; null for null."""
    sign = text.rlike(f"[{''.join(sorted({e[2] for e in ENTITIES.values()} - {''}))}]")
    for word in dict.fromkeys(w for e in ENTITIES.values() for w in e[3]):
        sign = sign | text.contains(word)
    return sign


def type_of(match: Column) -> Column:
    out = None
    for name, (_, test, _, _) in ENTITIES.items():
        if test:
            out = F.when(match.rlike(test), name) if out is None else out.when(match.rlike(test), name)
    return out.otherwise("secret")


def canonical(type_: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, r"[^0-9]", "")
    return (
        F.when(type_ == "email", F.lower(match))
        .when(type_ == "phone", F.concat(F.when(match.startswith("+"), "+").otherwise(""), digits))
        .when(type_.isin("card", "ssn"), digits)
        .when(type_ == "iban", F.replace(match, F.lit(" "), F.lit("")))
        .otherwise(match)
    )


def canonical_word(word: Column) -> Column:
    """A word of a name in lower case; Russian family names without the ending of women."""
    return F.regexp_replace(F.lower(word), r"(?<=(?:ов|ев|ёв|ин|ын))а$", "")


def gender(match: Column) -> Column:
    title = F.lower(F.regexp_extract(match, rf"^({TITLE}) ", 1))
    title = F.rtrim(title, F.lit("."))
    return F.when(title.isin(*MALE), "male").when(title.isin(*FEMALE), "female")


def byte(h: Column, i: Column) -> Column:
    """The i-th byte of a hex digest, as a number, from its start again after 64."""
    return F.conv(F.substring(h, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def redraw(value: Column, h: Column, keep: Column | int = 0) -> Column:
    """value with other digits and letters of the same kind; the first `keep` characters stay."""
    hexes = value.rlike(r"^[0-9a-f]{16,}$")
    pick = lambda alphabet, b: F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))

    def one(c, i):
        b = byte(h, i)
        kept = F.lit(keep) if isinstance(keep, int) else keep
        return (
            F.when(i < kept, c).when(hexes & c.rlike("[0-9a-f]") & value.rlike("[a-f]"), pick("0123456789abcdef", b))
            .when(c.rlike("[0-9]"), F.when((i == kept) & (c != "0"), pick("123456789", b)).otherwise(pick("0123456789", b)))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", b)).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """The sum that a number's check digit brings to a multiple of ten."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def from_list(words: tuple[str, ...], b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), b % len(words) + 1)


def draw(type_: Column, value: Column, key: str, attempt: int) -> Column:
    """The surrogate of a canonical value in canonical form, at this attempt. Given names read the columns male and female."""
    h = F.sha2(F.concat_ws("\u0001", F.lit(key), type_, value, F.lit(str(attempt))), 512)
    more = max(0, attempt - GROW_AFTER + 1)
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(more)), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), byte(h, i + 40) % 26 + 1, F.lit(1))), "") if more else F.lit("")
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(more)), lambda i: (byte(h, i + 40) % 10).cast("string")), "") if more else F.lit("")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    hd = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("domain"), domain), 512)
    host = F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", 1)
    email = F.concat(redraw(local, h), letters, F.lit("@"), redraw(host, hd), F.regexp_extract(domain, r"(\.[^.]+)$", 1))
    ip = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (byte(h, i) % 254 + 1).cast("string")), "."), digits)
    body = F.concat(F.substring(redraw(value, h, 1), F.lit(1), F.length(value) - 1), digits)
    card = F.when(luhn_sum(value) % 10 == 0, F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))).otherwise(F.concat(redraw(value, h, 1), digits))
    script = lambda s: F.when(value.rlike(r"\p{IsCyrillic}"), s["cyrillic"]).otherwise(s["latin"])
    syllables = lambda s, n, at: F.concat(F.lit(""), *[from_list(SYLLABLES[s], byte(h, F.lit(at + k))) for k in range(n)])
    male, female = F.col("male") & ~F.col("female"), F.col("female") & ~F.col("male")
    given = script({s: F.concat(F.when(male, from_list(NAMES[s, "male"], byte(h, F.lit(0)))).when(female, from_list(NAMES[s, "female"], byte(h, F.lit(0)))).otherwise(from_list(NAMES[s, "neutral"], byte(h, F.lit(0)))), syllables(s, attempt, 20)) for s in SYLLABLES})
    family = F.concat(script({s: F.initcap(syllables(s, 3 + attempt, 1)) for s in SYLLABLES}), F.when(value.rlike("(?:ов|ев|ёв|ин|ын)$"), "ов").otherwise(""))
    return (
        F.when(type_ == "email", email).when(type_ == "ip", ip).when(type_ == "card", card)
        .when(type_ == "phone", F.concat(redraw(value, h, F.when(value.startswith("+"), 2).otherwise(0)), digits))
        .when(type_ == "iban", F.concat(redraw(value, h, 2), digits)).when(type_ == "key", F.concat(redraw(value, h, 4), F.upper(letters)))
        .when(type_ == "given", given).when(type_ == "family", family)
        .when(type_ == "ssn", F.concat(redraw(value, h), digits)).otherwise(F.concat(redraw(value, h), letters))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, value, surrogate) for all distinct entities (type, value, male, female): no two of a type share one, and none is
    an entity itself. Every draw has more values than the one before, so that the rounds end; the driver sees whether any is left."""
    left = store(entities.groupBy("type", "value").agg(F.bool_or("male").alias("male"), F.bool_or("female").alias("female")), "entities")
    name = F.col("type").isin("given", "family")
    own = left.select(F.explode(F.when(name, F.array(F.lit("given"), F.lit("family"))).otherwise(F.array("type"))).alias("type"), F.lower("value").alias("form")).distinct()
    own = store(own, "own-forms")
    done, attempt = None, 0
    while True:
        drawn = left.select("type", "value", draw(F.col("type"), F.col("value"), key, attempt).alias("surrogate")).withColumn("form", F.lower("surrogate"))
        best = drawn.groupBy("type", "form").agg(F.min(F.struct("value", "surrogate")).alias("best")).join(own.hint("merge"), ["type", "form"], "left_anti")
        if done is not None:
            best = best.join(done.select("type", "form").hint("merge"), ["type", "form"], "left_anti")
        best = store(best.select("type", "form", "best.value", "best.surrogate"), "drawn")
        done = best if done is None else done.unionByName(best)
        left = store(left.join(best.select("type", "value").hint("merge"), ["type", "value"], "left_anti"), "left")
        if left.isEmpty():
            return done.select("type", "value", "surrogate")
        attempt += 1


def render(type_: Column, match: Column, surrogate: Column) -> Column:
    """A surrogate in the format in which the entity is written here."""
    plain = F.replace(surrogate, F.lit("+"), F.lit(""))
    slots = F.regexp_replace(match, r"[^0-9A-Za-z]", "")
    filled = F.transform(F.split(match, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(plain, F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), r"[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c))
    spread = F.concat(F.array_join(filled, ""), F.substring(plain, F.length(slots) + 1, F.lit(64)))
    upper = (match == F.upper(match)) & (F.lower(match) != match)
    word = F.concat(surrogate, F.when(match.rlike("(?:ов|ев|ёв|ин|ын)а$") & (type_ == "family"), "а").otherwise(""))
    return (
        F.when(type_.isin("phone", "card", "ssn", "iban"), spread)
        .when(type_.isin("given", "family"), F.when(upper, F.upper(word)).when(match == F.lower(match), F.lower(word)).otherwise(word))
        .when((type_ == "email") & upper, F.upper(surrogate)).otherwise(surrogate)
    )


def entities_of(rows: DataFrame, row: str, found: str) -> DataFrame:
    """Of the matches of each text: (row, i: the match, k: the word in it, type, value, written, male, female). A name is split
    into its words: the last is the family name; a single word is one too, unless others give it as a given name."""
    words = lambda m: F.split(F.regexp_replace(m, rf"^{TITLE} ", ""), " ")
    rows = rows.select(F.col(row).alias("row"), F.transform(F.col(found), lambda m: F.struct(m.alias("m"), type_of(m).alias("type"))).alias("found"))
    rows = rows.select("row", F.transform("found", lambda x: F.struct(x["m"].alias("m"), x["type"].alias("type"), F.when(x["type"] == "name", words(x["m"])).alias("w"))).alias("found"))
    several = F.transform(F.filter("found", lambda x: F.coalesce(F.size(x["w"]) > 1, F.lit(False))), lambda x: x["w"])
    given = F.array_distinct(F.flatten(F.transform(several, lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), F.lower))))
    family = F.array_distinct(F.transform(several, lambda w: F.lower(F.element_at(w, -1))))
    # an array of one struct, so that the given names of a text are looked for once
    known = F.array(F.struct(F.col("found").alias("found"), F.array_except(given, family).alias("given")))
    part = lambda x, w, k, of: F.struct(k.alias("k"), w.alias("written"), of.alias("is_given"))
    parts = lambda z: F.transform(z["found"], lambda x, i: F.struct(
        i.alias("i"), x["m"].alias("m"), x["type"].alias("type"),
        F.when(x["w"].isNull(), F.array(part(x, x["m"], F.lit(0), F.lit(False))))
        .when(F.size(x["w"]) == 1, F.array(part(x, F.get(x["w"], F.lit(0)), F.lit(0), F.array_contains(z["given"], F.lower(F.get(x["w"], F.lit(0)))))))
        .otherwise(F.transform(x["w"], lambda w, k: part(x, w, k, k < F.size(x["w"]) - 1))).alias("parts")))
    rows = rows.select("row", F.explode(F.get(F.transform(known, parts), F.lit(0))).alias("x")).select("row", "x.i", "x.m", "x.type", F.explode("x.parts").alias("p"))
    is_name, written, is_given = F.col("type") == "name", F.col("p.written"), F.col("p.is_given")
    title = F.when(is_name, gender(F.col("m")))
    return rows.select(
        "row", "i", "p.k", F.when(is_name, F.when(is_given, "given").otherwise("family")).otherwise(F.col("type")).alias("type"), F.when(is_name, canonical_word(written)).otherwise(canonical(F.col("type"), written)).alias("value"),
        written.alias("written"), F.coalesce(title == "male", F.lit(False)).alias("male"), F.coalesce(title == "female", F.lit(False)).alias("female"))


def session_key(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are drawn with a key that is no secret", stacklevel=3)
    return key or UNSAFE_KEY


def pseudonymise(docs: DataFrame, *, key: str | None = None) -> DataFrame:
    """docs with text replaced and n_entities added (under a free name if docs has such a column)."""
    key = session_key(docs.sparkSession) if key is None else key
    count = free_name(docs, "n_entities")
    row, found = (free_name(docs, n) for n in ("_row", "_found"))
    matches = F.when(may_hold_entity(F.col("text")), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    # one pass over all texts; what follows reads its matches
    seen = store(docs.withColumns({row: F.monotonically_increasing_id(), found: matches}), "matches")
    some = F.coalesce(F.size(F.col(found)) > 0, F.lit(False))
    each = store(entities_of(seen.where(some), row, found), "mentions")
    map_ = store(surrogates(each, key), "surrogates")
    drawn = each.join(map_.hint("merge"), ["type", "value"]).select("row", "i", "k", "type", "written", render(F.col("type"), F.col("written"), F.col("surrogate")).alias("new"))
    is_name = F.col("type").isin("given", "family")
    word = F.struct(F.col("written").alias("key"), "type", F.col("new").alias("value"))
    drawn = drawn.repartition("row").groupBy("row", "i").agg(  # both groupings keep this partitioning
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "new"))), lambda x: x["new"]), " ").alias("new"), F.collect_list(F.when(is_name & F.col("written").rlike(r"^\p{Lu}"), word)).alias("words"))
    drawn = drawn.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias("new"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))
    once = F.filter("words", lambda w, j: (j == 0) | (F.get("words", j - 1)["key"] != w["key"]))
    entries = F.transform(once, lambda w: F.struct(w["key"].alias("key"), w["value"].alias("value")))
    alone = F.when(F.size("words") > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join(F.transform(once, lambda w: w["key"]), "|"), F.lit(r")(?![\p{L}\p{N}_])")))
    drawn = drawn.select(F.col("row").alias("_of"), F.struct("new", F.map_from_entries(entries).alias("by_word"), alone.alias("alone")).alias("_drawn"))
    texts = seen.where(some).select(F.col(row).alias("_at"), F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("_doc"), F.col("text").alias("_text"), F.col(found).alias("_found"))
    joined = texts.join(drawn.hint("merge"), F.col("_at") == F.col("_of"))
    # the words of a gap and what is between them, each looked for once
    pieces = lambda gap: F.array(F.struct(F.split(gap, F.col("_drawn.alone"), -1).alias("between"), F.regexp_extract_all(gap, F.col("_drawn.alone"), F.lit(0)).alias("words")))
    fill = lambda p: F.array_join(F.transform(p["between"], lambda x, j: F.concat(x, F.coalesce(F.element_at("_drawn.by_word", F.get(p["words"], j)), F.lit("")))), "")
    bare = lambda gap: F.when(F.col("_drawn.alone").isNull(), gap).otherwise(F.get(F.transform(pieces(gap), fill), F.lit(0)))
    title = lambda i: F.coalesce(F.regexp_extract(F.when(type_of(F.get("_found", i)) == "name", F.get("_found", i)), rf"^({TITLE} )", 1), F.lit(""))
    new = F.array_join(F.transform(F.split("_text", PATTERN, -1), lambda gap, i: F.concat(bare(gap), title(i), F.coalesce(F.get("_drawn.new", i), F.lit("")))), "")
    done = joined.select("_doc", new.alias("_new"), F.size("_found").cast("long").alias("_count"))
    columns = [F.col("_new").alias(c) if c == "text" else F.length("_new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_doc.c{k}").alias(c) for k, c in enumerate(docs.columns)]
    replaced = done.select(*columns, F.col("_count").alias(count))
    return replaced.unionByName(seen.where(~some).select(*docs.columns, F.lit(0).cast("long").alias(count)))


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
