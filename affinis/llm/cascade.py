"""Whether style rules show or hide an element: declarations, selectors, and which of several rules wins.

Only ``display`` and ``visibility`` are read. Of all declarations that match, an important one wins, then one of the style attribute,
then the more specific selector, then the later one. Selectors of tags, classes, ids and attributes, within (`` ``) or directly
within (``>``) others, are matched. Of others, rules that depend on what a reader does (``:hover`` and the like) or style no
element count for nothing; the rest hide nothing, and what they show is taken as shown, so that no visible text is lost.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Values a browser takes; a declaration with another one is passed over. Fixed values.
DISPLAY = frozenset(
    "none block inline inline-block flow flow-root flex inline-flex grid inline-grid list-item contents run-in table inline-table "
    "table-row table-cell table-caption table-column table-column-group table-row-group table-header-group table-footer-group ruby "
    "ruby-base ruby-text math initial inherit unset revert revert-layer -webkit-box -webkit-inline-box".split())
VISIBILITY = frozenset("visible hidden collapse initial inherit unset revert revert-layer".split())
#: States a reader brings about, and parts that are no elements. Fixed values.
DYNAMIC = re.compile(r":(?:hover|focus|active|target|checked|visited|open|popover-open|fullscreen|modal|invalid|valid|disabled|indeterminate|:)")
NAME = r"(?:[\w-]|[^\x00-\x7f])+"
COMPOUND = re.compile(rf"(\*|{NAME})?((?:[.#]{NAME}|\[\s*{NAME}\s*(?:=\s*{NAME}\s*)?\])*)")
SIMPLE = re.compile(rf"([.#])({NAME})|\[\s*({NAME})\s*(?:=\s*({NAME})\s*)?\]")


class Compound(NamedTuple):
    tag: str
    ids: frozenset[str]
    classes: frozenset[str]
    attributes: tuple[tuple[str, str | None], ...]

    def fits(self, node) -> bool:
        a = node.attrs
        return ((not self.tag or self.tag == node.tag) and (not self.ids or self.ids <= {a.get("id")})
                and (not self.classes or self.classes <= set(a.get("class", "").split()))
                and all(n in a and (v is None or a[n] == v) for n, v in self.attributes))

    def key(self) -> str:
        """What an element must have to fit: the rarest of its parts."""
        return "#" + min(self.ids) if self.ids else "." + min(self.classes) if self.classes else self.tag or "*"


class Rule(NamedTuple):
    path: tuple[tuple[str, Compound], ...]  # the element's own compound first; with each, how it lies within the next
    weight: tuple[int, int, int]
    place: int
    said: dict[str, tuple[str, bool]]


def declarations(body: str) -> dict[str, tuple[str, bool]]:
    """Value and importance of ``display`` and ``visibility``: the last valid declaration, an important one before others."""
    out: dict[str, tuple[str, bool]] = {}
    for part in body.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        plain = re.sub(r"\s*!\s*important$", "", value)
        valid = {"display": DISPLAY, "visibility": VISIBILITY}.get(name)
        if not valid or not colon or not plain or not valid.issuperset(plain.split()):
            continue
        important = plain != value
        if important or not out.get(name, ("", False))[1]:
            out[name] = plain, important
    return out


def _compound(text: str) -> Compound | None:
    found = COMPOUND.fullmatch(text)
    if not text or not found:
        return None
    parts = SIMPLE.findall(found[2])
    tag = (found[1] or "").lower()
    return Compound(
        "" if tag == "*" else tag, frozenset(n for s, n, *_ in parts if s == "#"), frozenset(n for s, n, *_ in parts if s == "."),
        tuple((n.lower(), v or None) for s, _, n, v in parts if n))


def rules(selectors: str, body: str, place: int) -> list[Rule]:
    """The rules of a list of selectors."""
    said = declarations(body)
    out = []
    for selector in selectors.split(",") if said else []:
        steps = re.findall(r"\s*>\s*|\s+|[^\s>]+", selector.strip())
        compounds = [_compound(s) for s in steps[::2]]
        if not steps or DYNAMIC.search(selector):
            continue
        mine = said
        if None in compounds or any(s.strip() not in ("", ">") for s in steps[1::2]):
            mine = {n: (v, i) for n, (v, i) in said.items() if v not in ("none", "hidden", "collapse")}
            last = _compound(re.sub(r":.*", "", re.split(r"[\s>+~]", selector.strip())[-1])) if "(" not in selector else _compound(
                re.split(r"[\s>+~:]", re.sub(r":[\w-]+\([^()]*\)", "", selector.strip()))[-1])
            compounds, steps = [last or Compound("", frozenset(), frozenset(), ())], ["x"]
        if not mine:
            continue
        ways = [">" if s.strip() else " " for s in steps[1::2]]
        path = tuple(zip([*ways, ""][::-1], compounds[::-1])) if len(compounds) == 1 else tuple(
            (way, c) for c, way in zip(compounds[::-1], [*ways[::-1], ""]))
        weight = (sum(len(c.ids) for c in compounds), sum(len(c.classes) + len(c.attributes) for c in compounds), sum(bool(c.tag) for c in compounds))
        out.append(Rule(path, weight, place, mine))
    return out


def _within(node, path: tuple[tuple[str, Compound], ...]) -> bool:
    """Does the path end at this element? The way of each step leads to the next, further out."""
    if not path[0][1].fits(node):
        return False
    if len(path) == 1:
        return True
    outer = node.parent
    while outer is not None:
        if _within(outer, path[1:]):
            return True
        if path[0][0] == ">":
            return False
        outer = outer.parent
    return False


class Sheet:
    """All rules of a page, found by a part that an element must have."""

    def __init__(self):
        self.by_key: dict[str, list[Rule]] = {}
        self.size = 0

    def add(self, selectors: str, body: str) -> None:
        self.size += 1
        for rule in rules(selectors, body, self.size):
            self.by_key.setdefault(rule.path[0][1].key(), []).append(rule)

    def says(self, node, inline: str = "") -> dict[str, str]:
        """The winning values of ``display`` and ``visibility``, where any rule or the style attribute gives one."""
        best: dict[str, tuple] = {}
        if self.by_key:
            a = node.attrs
            keys = ["*", node.tag, *("." + c for c in set(a.get("class", "").split())), *(["#" + a["id"]] if "id" in a else [])]
            for rule in (r for k in keys for r in self.by_key.get(k, ())):
                ranks = {n: (important, False, rule.weight, rule.place, value) for n, (value, important) in rule.said.items()}
                if any(n not in best or best[n] < rank for n, rank in ranks.items()) and _within(node, rule.path):
                    best |= {n: rank for n, rank in ranks.items() if n not in best or best[n] < rank}
        for n, (value, important) in declarations(inline).items() if inline else ():
            rank = (important, True, (0, 0, 0), 0, value)
            if n not in best or best[n] < rank:
                best[n] = rank
        return {n: rank[-1] for n, rank in best.items()}
