"""Style sheets applied to a page's tree: selectors, the cascade and inheritance; plain Python, without Spark.

A selector is a chain of compounds (tag or *, #id, .class, [attribute] with = ~= |= ^= $= *=, :first-child, :last-child)
joined by descendant (blank), child (>), next sibling (+) and later sibling (~) combinators. Rules are indexed by what their last
compound asks for first (id, else class, else tag), so an element meets only rules that may fit it, and a chain is matched from
the right, going up parents and back along siblings. Of declarations for one property the important one wins, then
inline style, then the more specific selector, then the later one. Selectors with anything else, and at-rules, are passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import markup

#: Properties that children take from their parents (fixed values).
INHERITED = frozenset("color cursor direction font font-family font-size font-style font-variant font-weight letter-spacing line-height list-style list-style-type text-align text-indent text-transform visibility white-space word-spacing".split())

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_PART = re.compile(r"""\s*(?:(?P<comb>[>+~])\s*)?(?P<compound>(?:\*|[\w-]+)?(?:[.#][\w-]+|\[\s*[\w:-]+\s*(?:[~|^$*]?=\s*(?:"[^"]*"|'[^']*'|[\w-]+)\s*)?\]|:(?:first|last)-child)*)""")
_SIMPLE = re.compile(r"""(?P<tag>\A(?:\*|[\w-]+))|\.(?P<class>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>"[^"]*"|'[^']*'|[\w-]+)\s*)?\]|:(?P<place>first|last)-child""")


@dataclass(frozen=True)
class Compound:
    tag: str
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str, str], ...]
    places: tuple[str, ...]

    def fits(self, e: markup.Element) -> bool:
        if self.tag and self.tag != e.tag or any(e.attrs.get("id") != i for i in self.ids):
            return False
        if self.classes and not set(self.classes) <= set(e.attrs.get("class", "").split()):
            return False
        return all(_attribute(e, *a) for a in self.attributes) and all(_placed(e, x) for x in self.places)


def _attribute(e: markup.Element, name: str, op: str, value: str) -> bool:
    own = e.attrs.get(name)
    if own is None or op and not value and op not in ("=", "|="):
        return own is not None and not op
    return {
        "": lambda: True, "=": lambda: own == value, "~=": lambda: value in own.split(), "|=": lambda: own == value or own.startswith(f"{value}-"),
        "^=": lambda: own.startswith(value), "$=": lambda: own.endswith(value), "*=": lambda: value in own,
    }[op]()


def _placed(e: markup.Element, place: str) -> bool:
    around = e.parent.elements()
    return around[0 if place == "first" else -1] is e


@dataclass(frozen=True)
class Selector:
    """Compounds from left to right; combinators[k] stands before compound k + 1."""

    compounds: tuple[Compound, ...]
    combinators: tuple[str, ...]

    @property
    def weight(self) -> tuple[int, int, int]:
        c = self.compounds
        return sum(len(x.ids) for x in c), sum(len(x.classes) + len(x.attributes) + len(x.places) for x in c), sum(bool(x.tag) for x in c)

    def fits(self, e: markup.Element, at: int | None = None) -> bool:
        """Whether the compounds up to `at` (the last) fit with e as the last one's element."""
        at = len(self.compounds) - 1 if at is None else at
        if e.number < 0 or not self.compounds[at].fits(e):
            return False
        if not at:
            return True
        comb = self.combinators[at - 1]
        if comb == ">":
            return self.fits(e.parent, at - 1)
        if comb == " ":
            above = e.parent
            while above is not None and above.number >= 0:
                if self.fits(above, at - 1):
                    return True
                above = above.parent
            return False
        before = e.parent.elements()[: e.sibling]
        return any(self.fits(x, at - 1) for x in (before[-1:] if comb == "+" else before))


def parse_selector(text: str) -> Selector | None:
    """The selector, or None if it has anything that is not known here."""
    compounds, combinators, at, text = [], [], 0, text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m or not m["compound"] or m["comb"] and not compounds:
            return None
        found = list(_SIMPLE.finditer(m["compound"]))
        tag = next((x["tag"] for x in found if x["tag"]), "").lower()
        pick = lambda k: tuple(x[k] for x in found if x[k])
        attributes = tuple((x["name"].lower(), x["op"] or "", (x["value"] or "").strip("\"'")) for x in found if x["name"])
        if compounds:
            combinators.append(m["comb"] or " ")
        compounds.append(Compound("" if tag == "*" else tag, pick("id"), pick("class"), attributes, pick("place")))
        at = m.end()
        if at < len(text) and not re.match(r"[\s>+~]", text[at:]):
            return None
    return Selector(tuple(compounds), tuple(combinators)) if compounds else None


def declarations(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) in order; parts without a property or value go."""
    out = []
    for part in re.findall(r"""(?:[^;"'(]|"[^"]*"|'[^']*'|\([^)]*\)|["'(])+""", body):
        name, _, value = part.partition(":")
        value, important = re.subn(r"\s*!\s*important\s*$", "", value.strip(), flags=re.I)
        if name.strip() and value:
            out.append((name.strip().lower(), value, bool(important)))
    return out


def _blocks(text: str) -> list[tuple[str, str]]:
    """(head, body) of a sheet's plain rules; an at-rule goes with all in its braces."""
    out, at, n = [], 0, len(text)
    while at < n:
        brace, end = text.find("{", at), text.find(";", at)
        head = text[at : brace if brace >= 0 else n].strip()
        if head.startswith("@") and 0 <= end < (brace if brace >= 0 else n):
            at = end + 1
            continue
        if brace < 0:
            break
        depth, k = 1, brace + 1
        while k < n and depth:
            depth += {"{": 1, "}": -1}.get(text[k], 0)
            k += 1
        if not head.startswith("@"):
            out.append((head, text[brace + 1 : k - (depth == 0)]))
        at = k
    return out


class Sheet:
    """The rules of style sheets, found by what their last compound asks for."""

    def __init__(self, text: str):
        self.rules: list[tuple[Selector, str]] = []
        self.by_key: dict[tuple[str, str], list[int]] = {}
        for head, body in _blocks(_COMMENT.sub("", text)):
            for one in re.findall(r"(?:[^,\[\]]|\[[^\]]*\]|[\[\]])+", head):  # at commas outside attributes
                selector = parse_selector(one)
                if selector is not None and body.strip():
                    last = selector.compounds[-1]
                    key = ("id", last.ids[0]) if last.ids else ("class", last.classes[0]) if last.classes else ("tag", last.tag)
                    self.by_key.setdefault(key, []).append(len(self.rules))
                    self.rules.append((selector, body.strip().rstrip(";")))

    def matches(self, e: markup.Element) -> list[int]:
        """Numbers of the rules that fit, the less specific and the earlier ones first."""
        keys = [("tag", ""), ("tag", e.tag), ("id", e.attrs.get("id", "")), *(("class", c) for c in set(e.attrs.get("class", "").split()))]
        found = {k for key in keys for k in self.by_key.get(key, ()) if self.rules[k][0].fits(e)}
        return sorted(found, key=lambda k: (self.rules[k][0].weight, k))


def sheet_text(found: list[markup.Element]) -> str:
    return "\n".join(x.text for e in found if e.tag == "style" for x in e.children if isinstance(x, markup.Text))


def inline_css(html: str | None, drop: frozenset[str] = markup.DROPPED) -> markup.Element:
    """The page's tree with the rules of its <style> elements written into style attributes: the more specific and the
    later ones last, inline declarations behind them, and important ones of the sheets behind those. Nothing is fetched."""
    root = markup.parse(html, drop)
    found = markup.elements(root)
    sheet = Sheet(sheet_text(found))
    for e in found if sheet.rules else ():
        applied = [sheet.rules[k][1] for k in sheet.matches(e)]
        if applied:
            own = e.attrs.get("style", "").strip().rstrip(";")
            late = "; ".join(f"{name}: {value} !important" for body in applied for name, value, important in declarations(body) if important) if own else ""
            e.attrs["style"] = "; ".join(x for x in (*applied, own, late) if x)
    return root


def computed_styles(root: markup.Element, sheet: Sheet) -> dict[int, dict[str, str]]:
    """Each element's properties after the cascade, those it inherits among them; `inherit` takes the parent's value and
    `initial` none."""
    out: dict[int, dict[str, str]] = {-1: {}}
    for e in markup.elements(root):
        best: dict[str, tuple[tuple, str]] = {}
        sources = [(sheet.rules[k][0].weight, 0, k, sheet.rules[k][1]) for k in sheet.matches(e)] + [((0, 0, 0), 1, 0, e.attrs.get("style", ""))]
        for weight, inline, number, body in sources:
            for place, (name, value, important) in enumerate(declarations(body)):
                rank = (important, inline, weight, number, place)
                if name not in best or best[name][0] <= rank:
                    best[name] = (rank, value)
        above = out[e.parent.number]
        own = {k: v for k, v in above.items() if k in INHERITED}
        for name, (_, value) in best.items():
            if value.lower() in ("inherit", "initial", "unset"):
                keep = value.lower() == "inherit" or value.lower() == "unset" and name in INHERITED
                own.pop(name, None)
                if keep and name in above:
                    own[name] = above[name]
            else:
                own[name] = value
        out[e.number] = own
    del out[-1]
    return out
