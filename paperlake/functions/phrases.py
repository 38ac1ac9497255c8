"""Phrase index: which of many phrases stand in a text, in one pass over the text, as a Column without a shuffle.

The phrases of all rules become one prefix tree, written as one regular expression that is compiled once a task: at every
place of the text the tree is entered by the next character and left at the longest phrase that begins there. The phrases
that are beginnings of that one are known beforehand, so each found phrase names all rules to mark, by a hash table that is
one literal of the plan. Bounded phrases, which no letter or digit may touch, have a tree of their own that is entered at
the beginnings of words only. The work per text grows with the text, not with the number of phrases.

Raw patterns of rule tables cannot be merged and are tried one by one; rule tables hold few of these.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import let

END = ""
#: Up to so many phrases that may stand anywhere are looked for one by one, which compares bytes and is sooner than a tree that
#: is entered at every character. The rows are the same.
FEW = 200


def listed(values: list, type_: str = "string") -> Column:
    """A list as one literal of the plan, nulls included."""
    return F.from_json(F.lit(json.dumps({"v": values})), f"v array<{type_}>")["v"]


def tree_pattern(phrases: set[str], end: str = "") -> str:
    """A regular expression for the longest of the phrases that stands at a place with end behind it."""
    tree: dict = {}
    for p in phrases:
        node = tree
        for c in p:
            node = node.setdefault(c, {})
        node[END] = {}

    def written(node: dict) -> str:
        branches = []
        for c in sorted(k for k in node if k != END):
            run, below = c, node[c]
            while len(below) == 1 and END not in below:  # a chain without branches
                c, below = next(iter(below.items()))
                run += c
            branches.append(re.escape(run) + written(below))
        if END in node:
            branches.append(end)  # last: longer phrases first
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return written(tree)


def _edge(before: str, after: str) -> bool:
    """Whether a word begins or ends between two characters."""
    letter = lambda c: c == "_" or c.isalnum()
    return letter(before) != letter(after)


class PhraseIndex:
    """Groups of rules, each a list of phrases. A mark is the number of a rule over all groups."""

    def __init__(self):
        self.phrases: dict[bool, dict[str, set[int]]] = {False: {}, True: {}}  # marks by phrase: anywhere, bounded
        self.raw: list[tuple[str, int]] = []  # pattern, mark
        self.ranges: dict[str, tuple[int, int]] = {}

    def add(self, group: str, rules: list[tuple[str, ...]], *, bounded: bool = False, patterns: bool = False) -> PhraseIndex:
        """rules: the phrases of each rule, in lower case. bounded: no letter or digit may touch them. patterns: phrases are
        patterns as rule tables have them: raw with a class or boundary in them, bounded up to three characters, else plain."""
        first = max((hi for _, hi in self.ranges.values()), default=0)
        self.ranges[group] = (first, first + len(rules))
        for mark, phrases in enumerate(rules, first):
            for p in phrases:
                if not p or (patterns and any(m in p for m in (r"\b", r"\d", r"\s"))):
                    self.raw.append((p, mark))
                else:
                    self.phrases[bounded or (patterns and len(p) <= 3)].setdefault(p, set()).add(mark)
        return self

    def _table(self, bounded: bool) -> list[list[dict]]:
        """For each phrase the marks of it and of all phrases that stand wherever it does at its beginning, in buckets by hash."""
        own = self.phrases[bounded]
        size = 1 << len(own).bit_length()
        buckets: list[list[dict]] = [[] for _ in range(size)]
        for p, marks in sorted(own.items()):
            within = set(marks)
            for k in range(1, len(p)):
                if p[:k] in own and (not bounded or _edge(p[k - 1], p[k])):
                    within |= own[p[:k]]
            buckets[zlib.crc32(p.encode()) % size].append({"key": p, "marks": sorted(within)})
        return buckets

    def _in_tree(self, low: Column, bounded: bool) -> Column:
        phrases, buckets = set(self.phrases[bounded]), self._table(bounded)
        pattern = rf"(?=(\b{tree_pattern(phrases, chr(92) + 'b')}))" if bounded else f"(?=({tree_pattern(phrases)}))"
        table, size = listed(buckets, "array<struct<key:string,marks:array<int>>>"), len(buckets)
        marks = lambda k: F.get(F.filter(F.get(table, (F.crc32(k) % size).cast("int")), lambda e: e["key"] == k), F.lit(0))["marks"]
        return F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1))), marks))

    def found(self, low: Column, *, plain: bool = False) -> Column:
        """The marks of all rules with a phrase in a text in lower case, rising; empty for null. plain: the text is a column as it
        stands, no expression; then the phrases are looked for in compiled code, without a function over an array."""
        out, single = [], list(self.raw)
        for bounded, own in self.phrases.items():
            if len(own) > FEW or (own and bounded):
                out.append(self._in_tree(low, bounded))
            else:
                single += [(p, m) for p, marks in own.items() for m in marks]
        if single:
            raw = set(self.raw)
            marks = lambda x: F.array(*[F.when(x.rlike(p) if (p, m) in raw else x.contains(p), F.lit(m)) for p, m in single])
            out.append(F.array_except(marks(low), F.array(F.lit(None).cast("int"))) if plain else let(low, lambda x: F.array_compact(marks(x))))
        none = F.array().cast("array<int>")
        return F.coalesce(F.sort_array(F.array_distinct(F.concat(*out))), none) if out else none

    def all(self, found: Column, group: str) -> Column:
        """Numbers of the group's rules among the marks, rising."""
        first, end = self.ranges[group]
        return F.transform(F.filter(found, lambda m: (m >= first) & (m < end)), lambda m: m - first)

    def first(self, found: Column, group: str) -> Column:
        """The group's first rule among the marks, or null."""
        first, end = self.ranges[group]
        return F.get(F.filter(found, lambda m: (m >= first) & (m < end)), F.lit(0)) - first

    def count(self, found: Column, group: str) -> Column:
        first, end = self.ranges[group]
        return F.size(F.filter(found, lambda m: (m >= first) & (m < end)))

    def has(self, found: Column, group: str, rule: int | None = None) -> Column:
        """Whether a rule of the group, or the one with this number, is among the marks."""
        first, end = self.ranges[group]
        return F.array_contains(found, first + rule) if rule is not None else F.exists(found, lambda m: (m >= first) & (m < end))
