"""Which style rule wins, by cases and against a plain reading of all rules."""

import itertools

import pytest
from hypothesis import given, settings, strategies as st

from affinis.llm import cascade, rendering

A = "<p class=a>x</p>"


@pytest.mark.parametrize("html, shown", [
    ("<style>.a{display:none}</style>" + A, False),
    ("<style>.a{display:none}</style><style>.a{display:block}</style>" + A, True),
    ("<style>.a{display:block}</style><style>.a{display:none}</style>" + A, False),
    ("<style>.a{display:none;display:block}</style>" + A, True),
    ("<style>.a{display:none;display:bogus}</style>" + A, False),
    ("<style>.a{display:none} #m .a{display:block}</style><div id=m>" + A + "</div>", True),
    ("<style>.a{display:none} #m .a{display:block}</style><div id=n>" + A + "</div>", False),
    ("<style>.a{display:none} #m>.a{display:block}</style><div id=m><div>" + A + "</div></div>", False),
    ("<style>p{display:none} p.k{display:block}</style><p class='j k'>x</p>", True),
    ("<style>p.k{display:block} p{display:none}</style><p class='j k'>x</p>", True),
    ("<style>.a{visibility:hidden}</style><style>.a{visibility:visible}</style>" + A, True),
    ("<style>.a{visibility:visible}</style><style>.a{visibility:hidden}</style>" + A, False),
    ("<p style='--x-display:none'>x</p>", True),
    ("<p style='display:none'>x</p>", False),
    ("<p style='display : NONE ! important; display:block'>x</p>", False),
    ("<style>.a{display:block!important}</style><p class=a style='display:none'>x</p>", True),
    ("<style>.a{display:block}</style><p class=a style='display:none'>x</p>", False),
    ("<style>.a{display:none} .m:hover .a{display:block}</style><div class=m>" + A + "</div>", False),
    ("<style>.a{display:none} .a:not(.b){display:block}</style>" + A, True),
    ("<style>.a{display:none} li + .a{display:block}</style>" + A, True),
    ("<style>.b ~ .a{display:none}</style>" + A, True),
    ("<style>.a::before{display:none}</style>" + A, True),
    ("<p hidden>x</p>", False),
    ("<style>.a{display:block}</style><p class=a hidden>x</p>", True),
    ("<style>[hidden]{display:none}</style><p hidden>x</p>", False),
    ("<style>[data-k=v]{display:none}</style><p data-k=v>x</p>", False),
    ("<style>[data-k=v]{display:none}</style><p data-k=w>x</p>", True),
    ("<p style='/* display:none; */color:red'>x</p>", True),
    ("<style>*{display:none} .a{display:block}</style><div>" + A + "</div>", False),  # what it lies within is hidden
])
def test_the_strongest_rule_wins(html, shown):
    assert ("x" in rendering.render(html)) == shown


def test_what_ruby_needs_no_reader_sees():
    assert rendering.render("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>") == "ab"


SELECTORS = ["p", ".a", ".b", "#i", "p.a", ".a.b", "*", "div p", "div .a", "#d > p", "section > p", "#d p.b", "section p"]


def plain_winner(rules, node_chain, inline):
    """All declarations by rank, each matched by trying every way through the ancestors."""
    def fits(simple, node):
        tag, ids, classes = node
        parts = cascade.SIMPLE.findall(simple)
        name = simple.split(".")[0].split("#")[0]
        return (name in ("", "*", tag)) and all((n == ids) if s == "#" else (n in classes) for s, n, *_ in parts)

    def matches(selector):
        steps = selector.replace(" > ", " >").split()
        names = [s.lstrip(">") for s in steps]
        for places in itertools.combinations(range(len(node_chain)), len(names)):
            if places[-1] == len(node_chain) - 1 and all(fits(n, node_chain[p]) for n, p in zip(names, places)):
                if all(not s.startswith(">") or places[k] == places[k - 1] + 1 for k, s in enumerate(steps)):
                    return True
        return False

    def weight(selector):
        names = selector.replace(">", " ").split()
        return (sum(n.count("#") for n in names), sum(n.count(".") for n in names), sum(n[0].isalpha() for n in names))

    found = [((imp, 0, weight(s), k), v) for k, (s, v, imp) in enumerate(rules) if matches(s)]
    if inline:
        found.append(((inline[1], 1, (0, 0, 0), 0), inline[0]))
    return max(found)[1] if found else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SELECTORS), st.sampled_from(["none", "block", "inline"]), st.booleans()), max_size=7),
       st.sets(st.sampled_from("ab")), st.booleans(), st.booleans(), st.none() | st.tuples(st.sampled_from(["none", "block"]), st.booleans()))
def test_winner_equals_a_plain_reading(rules, classes, has_id, between, inline):
    chain = [("body", None, set()), ("div", "d", set()), *([("section", None, set())] if between else []), ("p", "i" if has_id else None, classes)]
    sheet, node = cascade.Sheet(), None
    for selector, value, important in rules:
        sheet.add(selector, f"display:{value}{'!important' if important else ''}")
    for tag, ids, names in chain:
        inner = rendering.Node(tag, ({"id": ids} if ids else {}) | ({"class": " ".join(names)} if names else {}))
        inner.parent, node = node, inner
    style = f"display:{inline[0]}{' !important' if inline[1] else ''}" if inline else ""
    assert sheet.says(node, style).get("display") == plain_winner(rules, chain, inline)
