"""The phrase index against one test per phrase, and rule tables of ten thousand names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperlake.functions import phrases
from paperlake.functions.phrases import PhraseIndex, listed, tree_pattern
from paperlake.operators import classification
from paperlake.operators.rules import OrgRule, Rules, TypeRule
from paperlake.plans.views import RULES

WORDS = ["blue", "cross", "lab", "co", "größe", "x1", "quest", "drugs", "north", "clinic", "old", "mill", "e-req", "ss-4", "irs", "a.b", "(co)", "rx", "patient", "ein ", "a_b"]


def test_trees_prefer_the_longest_phrase():
    pattern = re.compile(tree_pattern({"a", "ab", "abc", "b.d", "ba"}))
    assert [pattern.match(x)[0] for x in ("abcd", "abd", "ac", "b.d", "bad")] == ["abc", "ab", "a", "b.d", "ba"] and not pattern.match("bxd")


@pytest.mark.parametrize("few", [0, 200])
def test_marks_are_those_of_single_tests(spark, monkeypatch, few):
    monkeypatch.setattr(phrases, "FEW", few)
    rng = random.Random(few)
    names = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    types = [(n, "rx", "") if k % 9 == 0 else (n, "rx") if k % 3 else (r"lab\s+x1", n) for k, n in enumerate(names[:40])]
    index = PhraseIndex().add("org", [(n, n + " co") for n in names], bounded=True).add("type", types, patterns=True).add("word", [(n,) for n in names[:30]]).add("none", [])
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", ",", "", "-"]) for _ in range(rng.randrange(30))) for _ in range(120)] + [None, "", " ", "lab  x1"]

    def bounded(text, p):
        return re.search(rf"\b{re.escape(p)}\b", text) is not None

    def by_pattern(text, p):
        return re.search(p, text) is not None if not p or "\\s" in p else bounded(text, p) if len(p) <= 3 else p in text

    wanted = {}
    for i, text in enumerate(texts):
        tests = [any(bounded(text, p) for p in (n, n + " co")) for n in names] + [any(by_pattern(text, p) for p in t) for t in types] + [n in text for n in names[:30]] if text is not None else []
        wanted[i] = [k for k, hit in enumerate(tests) if hit]
    marks = spark.createDataFrame(list(enumerate(texts)), "i int, low string").withColumn("marks", index.found(F.col("low")))
    got = marks.select("i", "marks", index.first(F.col("marks"), "type").alias("first"), index.count(F.col("marks"), "word").alias("n"), index.has(F.col("marks"), "word", 3).alias("third"), index.has(F.col("marks"), "none").alias("none")).collect()
    assert {r["i"]: r["marks"] for r in got} == wanted
    for r in got:
        own = [m - 150 for m in r["marks"] if 150 <= m < 190]
        assert r["first"] == (own[0] if own else None) and r["n"] == sum(m >= 190 for m in r["marks"]) and r["third"] == (193 in r["marks"]) and not r["none"]


def test_tables_are_literals(spark):
    df = spark.range(3).select(F.get(listed(["a", None, "c"]), F.col("id").cast("int")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["a", None, "c"]
    assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_ten_thousand_names(spark):
    """The same rows with 10,000 names that do not occur as without them, and each name where it occurs, in compiled code."""
    more = tuple(OrgRule(f"org{k}", (f"firm number {k} of town {k % 97}",), "Lab", destination=f"Labs/{k}/") for k in range(10_000))
    small = Rules(types=RULES.types, orgs=RULES.orgs, people=RULES.people, routes=RULES.routes)
    large = Rules(types=(*RULES.types, TypeRule("test", ("titration",))), orgs=(*RULES.orgs, *more), people=RULES.people, routes=RULES.routes)
    docs = spark.createDataFrame(
        [(k, f"/in/a/letter_{k}.pdf", f"Invoice {k} for household goods 01/02/1996, total $12.50") for k in range(20)] + [(100, "/in/x.pdf", "titration by firm number 4711 of town 55"), (101, "/in/x.pdf", "firm number 4711 of town 551")],
        "doc_id long, path string, text string").withColumn("mtime", F.lit("1996-05-05").cast("timestamp"))
    columns = ("doc_id", "doc_type", "org", "destination", "proposed_name", "confidence")
    a, b = ({r["doc_id"]: r for r in classification.classify(docs, rules).select(*columns).collect()} for rules in (small, large))
    assert all(a[k] == b[k] for k in range(20))
    assert b[100]["org"] == "org4711" and b[100]["doc_type"] == "test" and b[101]["org"] is None


def test_marks_of_a_column_need_no_function_over_arrays(spark):
    index = PhraseIndex().add("a", [("one",), ("two", "three"), (r"\bfo+ur\b",)], patterns=True).add("b", [("one",), ("five",)])
    rows = spark.createDataFrame([("one three",), ("xfour",), ("foour five five",), ("",), (None,)], "low string")
    out = rows.select(index.found(F.col("low"), plain=True).alias("m"), index.found(F.col("low")).alias("want"))
    assert [list(r["m"]) for r in out.collect()] == [list(r["want"]) for r in out.collect()] == [[0, 1, 3], [], [2, 4], [], []]
    anywhere = PhraseIndex().add("a", [("three",), (r"\bfo+ur\b",)], patterns=True)  # bounded phrases have a tree
    assert "lambda" not in rows.select(anywhere.found(F.col("low"), plain=True))._jdf.queryExecution().optimizedPlan().toString()
