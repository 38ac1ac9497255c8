"""Slots of a host's pages: against a plain recursive matcher, with and without the other pages, and on deep pages."""

import random
import time
from functools import cache

import pytest

from paperlake.llm import wrapper_extraction as w


def learned(pages):
    wrapper = w.Wrapper()
    for p in pages:
        wrapper.learn(w.parse(p))
    return [wrapper.text(w.parse(p)) for p in pages]


def words(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))


def test_template_decides_within_and_outside_articles():
    """The same pages one by one, where nothing is known to be template, and together."""
    rng = random.Random(4)
    inside = [f"<article><h1>{words(rng, 3)}</h1><p>Fixed promotion text</p><p>{words(rng, 9)}</p><p>Fixed ending</p></article>" for _ in range(9)]
    outside = [f"<div><p>Fixed head</p><h2>{words(rng, 3)}</h2><p>{words(rng, 9)}</p><p>Fixed foot</p></div>" for _ in range(9)]
    for pages in (inside, outside):
        alone, together = [learned([p])[0] for p in pages], learned(pages)
        assert all("Fixed" in a and "Fixed" not in b and [x for x in a.split("\n") if "Fixed" not in x] == b.split("\n") for a, b in zip(alone, together, strict=True))


def test_the_host_decides_what_a_slot_is():
    """A slot that is hidden on most pages is no content on the others either; one that is an article on most is one on all."""
    pages = [f"<p>Own {i}</p><section {'hidden' if i else ''}>Offer {i}</section>" for i in range(6)]
    assert learned(pages) == [f"Own {i}" for i in range(6)] and learned(pages[:1]) == ["Own 0\nOffer 0"]


def plain_matching(a, b):
    """Simple tree matching without memory: nodes of the largest common ordered tree; equal trees count threefold."""
    if a == b:
        return 3 * weight(a)
    one, two = a[1], b[1]

    @cache
    def best(i, j):
        if not i or not j:
            return 0
        own = plain_matching(one[i - 1], two[j - 1]) if one[i - 1][0] == two[j - 1][0] else 0
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + own)

    return 1 + best(len(one), len(two))


def weight(t):
    return 1 + sum(map(weight, t[1]))


def html_of(t):
    return f"<{t[0]}>{t[2]}{''.join(map(html_of, t[1]))}</{t[0]}>"


def tree(rng, depth):
    return (rng.choice(("div", "section", "h2")), tuple(tree(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)), f"t{rng.randrange(10**9)}")


@pytest.mark.parametrize("seed", range(40))
def test_simple_tree_matching(seed):
    rng = random.Random(seed)
    a, b = (("div", tuple(tree(rng, 2) for _ in range(3)), f"r{k}") for k in (1, 2))
    wrapper = w.Wrapper()
    wrapper.learn(w.parse(html_of(a)))
    shape = w.shapes(w.parse(html_of(b)))[0].children[0]
    assert w.likeness(wrapper.root.children[0], shape, {}) == plain_matching(a, b)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text" + "</div>" * 100_000, "<div>" * 50_000 + "<td>text</td>" * 5000, "<div>" * 50_000 + "</section>" * 50_000 + "text", "<ul><li>" * 20_000 + "text"])
def test_deep_pages(page):
    import sys

    old = sys.getrecursionlimit()
    sys.setrecursionlimit(1_000_000)
    began = time.perf_counter()
    try:
        assert "text" in learned([page])[0] and time.perf_counter() - began < 60
    finally:
        sys.setrecursionlimit(old)


def test_a_single_pair_is_not_measured(monkeypatch):
    """Between fixed texts a slot and a shape of one name are a pair, whatever is in them."""
    pages = [f"<h1>Same head</h1><div><p>{i} a</p><p>{i} b</p></div><h2>Same foot</h2>" for i in range(4)]
    want = learned(pages)
    monkeypatch.setattr(w, "likeness", lambda *_: pytest.fail("measured"))
    assert w.between([w.Slot("p", "p")], [w.Slot("p", "p")], ["p"], ["p"], {}) and not w.between([w.Slot("p", "p")], [w.Slot("b", "b")], ["p"], ["b"], {})
    wrapper = w.Wrapper()
    for p in pages[:1]:
        wrapper.learn(w.parse(p))
    assert want == [f"{i} a\n{i} b" for i in range(4)]
    root = wrapper.root.children
    assert len(w.align(root, w.shapes(w.parse(pages[1]))[0].children, {})) == 3
