"""Main-content extractors: page -> text. Plain Python kernels run in Arrow batches, by name."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import few_rows, spread

from . import markup

LINKS = frozenset({"a", "button", "select"})
_BLANKS = re.compile(r"(\s{2,}|\t)")


def tidy(text: str) -> str:
    """Runs of blanks and tabs become one blank, empty lines go."""
    return "\n".join(line for line in _BLANKS.sub(" ", text).splitlines() if line.strip())


def body_of(html: str | None) -> markup.Element | None:
    """The body without elements that carry display="none"; the whole document where there is no body."""
    root = markup.parse(html, frozenset())
    body = next((e for e in markup.elements(root) if e.tag == "body"), root)
    for e in [body, *markup.elements(body)]:
        e.children = [c for c in e.children if not (isinstance(c, markup.Element) and c.attrs.get("display") == "none")]
    return body


class Density:
    """Composite text density of a body's elements, held in lists by their place in document order."""

    def __init__(self, body: markup.Element, variant: bool = False):
        self.elements = [body, *markup.elements(body)]
        self.place = {id(e): k for k, e in enumerate(self.elements)}
        n = len(self.elements)
        self.kids = [[self.place[id(c)] for c in e.elements()] for e in self.elements]
        self.content, self.span = self._spans(body)
        self.chars = [hi - lo for lo, hi in self.span]
        self.tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n
        is_link = [e.tag in LINKS for e in self.elements]
        for k in reversed(range(n)):
            kids = self.kids[k]
            self.tags[k] = sum(self.tags[c] + 1 for c in kids)
            self.link_chars[k] = self.chars[k] if is_link[k] else sum(self.link_chars[c] for c in kids)
        below = [False] * n  # within a link every element counts as link text
        for k in range(n):
            for c in self.kids[k]:
                below[c] = below[k] or is_link[k]
                if below[c]:
                    self.link_chars[c] = self.chars[c]
        for k in reversed(range(n)):
            if is_link[k]:
                self.link_tags[k] = self.tags[k]
                continue
            for c in self.kids[k]:
                all_links = 0 != self.link_tags[c] == self.tags[c] and self.chars[c] == self.link_chars[c]
                self.link_tags[k] += self.link_tags[c] + (is_link[c] or all_links)
        if variant:
            self.chars = self._plain_chars(is_link)
            self.density = [c / max(t, 1) for c, t in zip(self.chars, self.tags)]
            self.sums = [self._simple_sum(k) for k in range(n)]
        else:
            self.ratio = self.link_chars[0] / self.chars[0] if self.chars[0] else 0.0
            self.density = [max(self._formula(k), 0.0) for k in range(n)]
            self.sums = [self._density_sum(k) for k in range(n)]
        self.top = self.sums[:]
        for k in reversed(range(n)):
            self.top[k] = max([self.sums[k], *(self.top[c] for c in self.kids[k])])

    def _spans(self, body: markup.Element) -> tuple[str, list[tuple[int, int]]]:
        """The body's strings joined by blanks, and where in it each element's own stand: they follow one another, so no
        element holds a copy of what is below it."""
        n = len(self.elements)
        strings, first, below = [], [0] * n, [0] * n
        for x in body.walk():
            if isinstance(x, markup.Element):
                first[self.place[id(x)]] = len(strings)
            elif x.parent.tag not in markup.RAW and (s := x.text.strip()):
                strings.append(s)
                below[self.place[id(x.parent)]] += 1
        for k in reversed(range(n)):
            below[k] += sum(below[c] for c in self.kids[k])
        starts = [0, *accumulate(len(s) + 1 for s in strings)]
        return " ".join(strings), [(starts[i], starts[i + m] - 1) if m else (0, 0) for i, m in zip(first, below)]

    @staticmethod
    def _strings(e: markup.Element) -> list[str]:
        return [s for x in e.walk() if isinstance(x, markup.Text) and x.parent.tag not in markup.RAW and (s := x.text.strip())]

    def _formula(self, k: int) -> float:
        c = self.chars[k]
        if not c:
            return 0.0
        t, lc, lt, rest = (max(x, 1) if x >= 0 else x for x in (self.tags[k], self.link_chars[k], self.link_tags[k], c - self.link_chars[k]))
        return c / t * math.log(c * t / (lc * lt)) / math.log(math.log(c * lc / rest + self.ratio * c + math.e))

    def _density_sum(self, k: int) -> float:
        if not self.elements[k].children:
            return self.density[k]
        total, seen, own = 0.0, 0, self._formula(k)
        for c in self.kids[k]:
            total += self.density[c]
            (low, high), (lo, hi) = self.span[k], self.span[c]
            at = self.content.find(self.content[lo:hi], low, high) - low
            if at >= 0:
                if at > seen and self.ratio * (at - seen) > 1 / math.e:
                    total += own
                seen = at + self.chars[c]
        return total

    def _plain_chars(self, is_link: list[bool]) -> list[int]:
        n = len(self.elements)
        out, dead = [0] * n, [False] * n
        for k in range(n):
            for c in self.kids[k]:
                dead[c] = dead[k] or is_link[k]
        for k in reversed(range(n)):
            if not (is_link[k] or dead[k]):
                kids = self.kids[k]
                out[k] = sum(out[c] for c in kids) + self.chars[k] - sum(self.chars[c] for c in kids)
        return out

    def _simple_sum(self, k: int) -> float:
        kids = self.kids[k]
        own = self.chars[k] - sum(self.chars[c] for c in kids)
        return sum(self.density[c] for c in kids) + own if own > 0 else self.density[k]

    def _end(self, k: int) -> int:
        while self.kids[k]:
            k = self.kids[k][-1]
        return k + 1

    def _first(self, k: int, value: float) -> int:
        return next(x for x in range(k, self._end(k)) if self.sums[x] == value)

    def _above(self, k: int) -> Iterator[int]:
        while k:
            k = self.place[id(self.elements[k].parent)]
            yield k

    def marks(self) -> list[int]:
        """1: kept with all below, 2: kept as an ancestor, 0: dropped."""
        mark = [0] * len(self.elements)

        def keep(k: int) -> None:
            for x in range(k, self._end(k)):
                mark[x] = 1
            for x in self._above(k):
                mark[x] = 2

        best = self._first(0, self.top[0])
        threshold = min([self.density[best], *(self.density[x] for x in self._above(best))])
        keep(best)
        stack = [0]
        while stack:
            k = stack.pop()
            if mark[k] != 1 and self.density[k] >= threshold:
                target = self._first(k, self.top[k])
                if mark[target] != 1:
                    keep(target)
                stack.extend(reversed(self.kids[k]))
        return mark

    def text(self, mark: list[int]) -> str:
        body = self.elements[0]
        parts = [x.text for x in body.walk() if isinstance(x, markup.Text) and x.parent.tag not in markup.RAW and (x.parent is body or mark[self.place[id(x.parent)]])]
        return tidy("".join(parts))


def cetd(html: str | None) -> str:
    """Text by composite text density; empty where the body has no text."""
    density = Density(body_of(html))
    return density.text(density.marks()) if density.chars[0] else ""


def cetd_variant(html: str | None) -> str:
    """The plain density (text outside links by tag), with the same selection."""
    density = Density(body_of(html), variant=True)
    return density.text(density.marks()) if density.chars[0] else ""


def filing(html: str | None) -> str:
    """What lies between <html> and </html>, without elements whose density sum is 0. An element that holds
    text alone has no child to sum over; its own density counts, so that its text is not lost."""
    found = re.search(r"(?is)<html.*?</html>", html or "")
    density = Density(body_of(found[0] if found else html))
    kept = [int(s > 0 or d > 0 and not kids) for s, d, kids in zip(density.sums, density.density, density.kids)]
    return density.text(kept) if density.chars[0] else ""


def body_text(html: str | None) -> str:
    """All words of the body, as the labeller sees them."""
    return " ".join(w for w, _ in markup.words(body_of(html)))


def link_density(e: markup.Element) -> float:
    all_chars = sum(map(len, e.strings()))
    return sum(len(s) for x in e.walk() if isinstance(x, markup.Element) and x.tag == "a" for s in x.strings()) / max(all_chars, 1)


def readability(html: str | None) -> str | None:
    """Paragraph scores summed into parents and, halved, grandparents; the best block by score times unlinked
    share gives the text. A stand-in for a library of this name, not its equal. None without a paragraph."""
    body = body_of(html)
    scores: dict[int, float] = {}
    by_id = {id(e): e for e in [body, *markup.elements(body)]}
    for e in by_id.values():
        text = " ".join(Density._strings(e)) if e.tag in ("p", "pre", "td", "blockquote") else ""
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        up, share = e.parent, 1.0
        for _ in range(2):
            if up is not None and id(up) in by_id:
                scores[id(up)] = scores.get(id(up), 0.0) + points * share
                up, share = up.parent, share / 2
    if not scores:
        return None
    best = max(scores, key=lambda k: scores[k] * (1 - link_density(by_id[k])))
    return tidy("\n".join(Density._strings(by_id[best])))


EXTRACTORS: dict[str, Callable[[str | None], str | None]] = {"body": body_text, "cetd": cetd, "cetd_variant": cetd_variant, "filing": filing, "readability": readability}


def extract(pages: DataFrame, name: str, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, extracted text and error; a page that fails has a null text and the reason, and the job goes on. Columns named in
    `keep` come along."""
    kernel = EXTRACTORS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts, errors = [], []
            for html in batch.column(1):
                try:
                    texts.append(kernel(html.as_py()))
                    errors.append(None)
                except (ValueError, ArithmeticError, RecursionError, AssertionError) as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string()), *batch.columns[2:]], [id_column, "text", "error", *keep])

    kind = lambda c: f"`{c}` {pages.schema[c].dataType.simpleString()}"
    schema = ", ".join([kind(id_column), "text string, error string", *map(kind, keep)])
    return spread(pages.select(id_column, html_column, *keep)).mapInArrow(run, schema)


def density_table(pages: DataFrame) -> DataFrame:
    """Per element of the body: page_id, place, tag, the four counts, density, density_sum and mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                d = Density(body_of(html.as_py()))
                marks = d.marks() if d.chars[0] else [0] * len(d.elements)
                rows += zip([page_id] * len(marks), range(len(marks)), [e.tag for e in d.elements], d.chars, d.tags, d.link_chars, d.link_tags, d.density, d.sums, marks)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            names = ["page_id", "place", "tag", "n_chars", "n_tags", "n_link_chars", "n_link_tags", "density", "density_sum", "mark"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 10, kinds)], names)

    return spread(pages.select("page_id", "html")).mapInArrow(run, "page_id long, place long, tag string, n_chars long, n_tags long, n_link_chars long, n_link_tags long, density double, density_sum double, mark long")


def text_of_nodes(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Page texts from chosen elements: texts whose owner is chosen, in order, joined at block boundaries."""
    from weftline.functions.text import join_strings

    rows = texts.join(chosen.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")
    grouped = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("text_id", "raw", "boundary"))).alias("t"))
    return grouped.select("page_id", join_strings(F.transform("t", lambda x: x["raw"]), F.transform("t", lambda x: x["boundary"])).alias("text"))
