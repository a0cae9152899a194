"""Main text of web pages by tag-path ratios.

A page is read into text leaves, each with its path of tags from the root. Over all leaves of one path the text length
and the punctuation are added up; a path's ratios are both, divided by its leaves. The ratios, taken in page order,
are smoothed, fused into one score by their geometric mean, and compared with a threshold. The smallest element that
holds nearly all accepted text is the article; its blocks are the result, without parts whose tag or role says that
they are something else. A class or id that says so is only a hint: it doesn't count for headings, for an element that
holds nearly all accepted text, nor for one whose own ratios are near those of the article, if its id has other words too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rawtext import slices

SMOOTH = np.array([0.25, 0.5, 1.0, 0.5, 0.25])
SPREAD = 0.5  # threshold, in standard deviations of the fused score
MAIN_SHARE = 0.85  # the article holds at least this share of the accepted text
NAMED = 0.5  # an element with a doubtful id needs this share of the article's ratios

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)|<[!?][^>]*+>|[^<]++|<",
    re.S | re.I,
)
#: Behind the last > there is no tag.
_TAIL = re.compile(r"<!--.*|[^<]++|<", re.S)
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_MARK = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…«»“”\"()]")
_WORD_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var br wbr img".split()
)
#: Block tags that hold one block of text.
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre figcaption caption summary".split())
#: Tags whose text is never part of an article.
_NEVER = frozenset("nav aside footer form button menu dialog script style noscript input option fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: Words in class or id that name something else than the article.
_OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay comment comments respond disqus replies share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login search pagination pager masthead toolbar widget widgets "
    "copyright disclaimer teaser teasers outbrain taboola hidden skip topbar rail".split()
)
#: A header named with one of these belongs to the article.
_ARTICLE = frozenset("article post entry content story".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KEEP_ANYWAY = frozenset(("html", "body", "article", "main"))
#: An open tag on the left is closed by a start tag on the right.
_CLOSED_BY = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)),
    "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",)),
}
#: Left out whole up to their end tag; one without an end tag ends at the next of _STARTS.
_SKIPPED = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in "noscript template svg math iframe select object video audio canvas head".split()}
_STARTS = frozenset(
    "body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th pre blockquote figure "
    "figcaption form fieldset address details summary hr".split()
)
_SCOPE = frozenset("table ul ol dl td th article section div main body html".split())


def _other(tag: str, attrs: str) -> bool:
    """Whether an element's tag, role or style says that its text isn't the article's."""
    if tag in _NEVER:
        return True
    if not attrs.strip() or tag in _KEEP_ANYWAY:
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(tag: str, attrs: str) -> str:
    """Whether class or id hint that an element's text isn't the article's: "" (no), "yes", or "doubtful" for an id with other words."""
    hint = ""
    if not attrs.strip() or tag in _KEEP_ANYWAY or tag in _HEADINGS:
        return hint
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        # ids inside a line are anchors
        if name == "class" or name == "id" and tag not in _INLINE:
            parts = _WORD_PARTS.findall(value)
            words = {w.lower() for w in parts}
            if words & _OTHER or "header" in words and not words & _ARTICLE:
                if name == "class" or not any(w not in _OTHER and not w.isdigit() for w in words):
                    return "yes"
                hint = "doubtful"
    return hint


class _Source:
    """A page's source, and where its tags end.

    A tag ends at the first > outside quotes. Where there is none, finding that out means reading on to the end of the
    page; so after the first such tag the ends of all are worked out at once, from the last mark to the first.
    """

    def __init__(self, source: str) -> None:
        self.source, self.last = source, source.rfind(">")
        self.marks: list[int] | None = None

    def rest(self, at: int) -> re.Match | None:
        """The attributes and the end of a tag, from behind its name on."""
        if at > self.last or self.marks is not None and not self.closed[bisect_left(self.marks, at)]:
            return None
        found = _REST.match(self.source, at)
        if found is None:
            self._work_out()
        return found

    def _work_out(self) -> None:
        places = [(m.start(), m.group()) for m in _MARK.finditer(self.source)]
        self.marks = [p for p, _ in places]
        # whether a tag that is outside quotes before mark k ends somewhere
        self.closed = [False] * (len(places) + 1)
        following = {"\"": len(places), "'": len(places)}
        for k in range(len(places) - 1, -1, -1):
            kind = places[k][1]
            if kind == ">":
                self.closed[k] = True
            else:
                end = following[kind]
                self.closed[k] = end < len(places) and self.closed[end + 1]
                following[kind] = k


_CLOSABLE = frozenset(_CLOSED_BY) | {"p"} | _SCOPE


class _Page:
    """Leaves (text, path number, block number) of one page, the innermost element that can hold blocks for each block, and
    for each leaf the innermost element that class or id name as something else. Elements are numbered in page order, so
    holders have smaller numbers than what they hold; 0 is the page itself, or none."""

    def __init__(self, source: str) -> None:
        self.leaves: list[tuple[str, int, int]] = []
        self.hints: dict[int, str] = {}  # elements that class or id name as something else
        self.hint_above: dict[int, int] = {}
        self.holder: dict[int, int] = {0: 0}  # of each element that can hold blocks the next one outside
        self.under: list[int] = []
        self.blocks: list[int] = []
        self.paths: dict[tuple[int, str], int] = {}
        # tag, element number, left out, path, innermost holder, innermost hint
        self.stack: list[tuple[str, int, bool, int, int, int]] = []
        self.open: dict[str, int] = {}  # how often each tag is on the stack
        self.closable: list[int] = []  # places on the stack that close_open looks at
        self.skipped: list[int] = []  # places of elements of _SKIPPED
        self.headings = 0
        self.number, self.fresh, self.top = 0, True, {0}
        at, page = 0, _Source(source)
        while m := (_TOKEN if at <= page.last else _TAIL).match(source, at):
            tag, at = m.group(3) if m.re is _TOKEN else None, m.end()
            if tag:
                rest = page.rest(at)
                if rest is None:
                    at = m.start() + 1
                    self.text("<")
                    continue
                tag, attrs, at = tag.lower(), rest.group(1), rest.end()
                if tag in _SKIPPED and not m.group(2) and not attrs.rstrip().endswith("/"):
                    other = _SKIPPED[tag].search(source, at) if at <= page.last else None
                    if other and other.group(1):
                        self.fresh |= tag not in _INLINE
                        at = other.end()
                        continue
                (self.end if m.group(2) else self.start)(tag, attrs)
            elif m.re is _TOKEN and m.group(1):
                if m.group(1).lower() not in _INLINE:
                    self.fresh = True
            elif not m.group().startswith(("<!", "<?")):
                self.text(m.group())

    def cut(self, k: int) -> None:
        """Takes everything from place k on off the stack."""
        for tag, *_ in self.stack[k:]:
            self.open[tag] -= 1
            self.headings -= tag in _HEADINGS
        del self.stack[k:]
        for places in (self.closable, self.skipped):
            while places and places[-1] >= k:
                places.pop()

    def start(self, tag: str, attrs: str) -> None:
        if self.skipped and tag in _STARTS:
            self.cut(self.skipped[0])
        if tag not in _INLINE:
            self.fresh = True
            if tag not in ("hr",):
                self.close_open(tag)
        if tag in _VOID:
            if tag == "br":
                self.text(" ")
            return
        if attrs.rstrip().endswith("/") and tag not in _KEEP_ANYWAY:
            return
        self.number += 1
        _, _, out, path, holder, hint = self.stack[-1] if self.stack else ("", 0, False, 0, 0, 0)
        if tag in ("html", "body"):
            self.top.add(self.number)
        if tag == "header" and not self.open.get("article") and not self.open.get("main"):
            out = True
        if named := _named(tag, attrs):
            self.hints[self.number], self.hint_above[self.number], hint = named, hint, self.number
        if tag not in _BLOCKS and tag not in _INLINE:
            self.holder[self.number], holder = holder, self.number
        if tag in _SKIPPED:
            self.skipped.append(len(self.stack))
        if tag in _CLOSABLE:
            self.closable.append(len(self.stack))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.headings += tag in _HEADINGS
        path = self.paths.setdefault((path, tag), len(self.paths) + 1)
        self.stack.append((tag, self.number, out or tag in _SKIPPED or _other(tag, attrs), path, holder, hint))

    def wide(self, element: int) -> bool:
        return element in self.top

    def close_open(self, tag: str) -> None:
        n = len(self.closable) - 1
        while n >= 0:
            k = self.closable[n]
            open_tag = self.stack[k][0]
            if open_tag == "p" or tag in _CLOSED_BY.get(open_tag, ()):
                self.cut(k)
                n = len(self.closable) - 1
            elif open_tag in _SCOPE:
                return
            else:
                n -= 1

    def end(self, tag: str, _: str) -> None:
        if tag not in _INLINE:
            self.fresh = True
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.cut(k)
                return
            if tag in _INLINE and self.stack[k][0] not in _INLINE:
                return

    def text(self, body: str) -> None:
        _, _, out, path, holder, hint = self.stack[-1] if self.stack else ("", 0, False, 0, 0, 0)
        if out or self.open.get("header") and not self.headings:
            return
        if self.fresh:
            if not body.strip():
                return
            self.blocks.append(holder)
            self.fresh = False
        self.under.append(hint)
        self.leaves.append((html.unescape(body), path, len(self.blocks) - 1))


def _handed_up(sums: dict[int, int], above: dict[int, int]) -> dict[int, int]:
    """Sums of elements with those of all that they hold."""
    out: dict[int, int] = {}
    for n in sorted(above, reverse=True):
        if s := sums.get(n, 0) + out.get(n, 0):
            out[n] = s
            if n:
                out[above[n]] = out.get(above[n], 0) + s
    return out


def path_scores(leaves: list[tuple[str, int, int]]) -> np.ndarray:
    """The fused, smoothed score of each leaf's path."""
    length, marks, times = {}, {}, {}
    for body, path, _ in leaves:
        size = len(body.strip())
        length[path] = length.get(path, 0) + size
        marks[path] = marks.get(path, 0) + len(_PUNCTUATION.findall(body))
        times[path] = times.get(path, 0) + (size > 0)
    ratio = lambda of: np.array([of[p] / max(times[p], 1) for _, p, _ in leaves])
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), SMOOTH / SMOOTH.sum(), mode="valid")
    return np.sqrt(smooth(ratio(length)) * smooth(ratio(marks)))


def _accepted(leaves: list[tuple[str, int, int]], size: np.ndarray) -> np.ndarray:
    score = path_scores(leaves)
    return (score >= min(SPREAD * score.std(), score.max())) & (size > 0)


def _ratios(leaves: list[tuple[str, int, int]]) -> float:
    """The fused ratios of leaves taken together."""
    texts = [b for b, _, _ in leaves if b.strip()]
    return (sum(len(b.strip()) for b in texts) * sum(len(_PUNCTUATION.findall(b)) for b in texts)) ** 0.5 / max(len(texts), 1)


def _left_out(page: _Page) -> tuple[set[int], list[int]]:
    """The elements named by class or id whose text is left out, and for each leaf the innermost of them, 0 for none."""
    size = np.array([len(b.strip()) for b, _, _ in page.leaves])
    accepted = _accepted(page.leaves, size)
    sums: dict[int, int] = {}
    for k in np.flatnonzero(accepted):
        sums[page.under[k]] = sums.get(page.under[k], 0) + int(size[k])
    held = _handed_up(sums, page.hint_above)
    enough, some = MAIN_SHARE * size[accepted].sum(), any(n for n in held)
    out = {n for n in page.hints if not some or held.get(n, 0) < enough}

    def innermost() -> list[int]:
        """Of each leaf the innermost of its elements that is out."""
        found = {0: 0}
        for n in sorted(page.hints):
            found[n] = n if n in out else found[page.hint_above[n]]
        return [found[u] for u in page.under]

    inside: dict[int, list] = {}
    owner = innermost()
    for x, o in zip(page.leaves, owner, strict=True):
        inside.setdefault(o, []).append(x)
    rest = inside.get(0, [])
    if not any(b.strip() for b, _, _ in rest):
        # nothing else is there: the one most like an article
        if best := max(out, key=lambda n: (_ratios(inside.get(n, [])), -n), default=0):
            holds = {0}
            for u in set(page.under):
                while u and u not in holds:
                    holds.add(u)
                    u = page.hint_above[u]
            if best in holds:
                o = best
                while o:
                    out.discard(o)
                    o = page.hint_above[o]
            out.discard(best)
        return out, innermost()
    good = _accepted(rest, np.array([len(b.strip()) for b, _, _ in rest]))
    level = NAMED * _ratios([rest[k] for k in np.flatnonzero(good)])
    out -= {n for n in sorted(out) if page.hints[n] == "doubtful" and _ratios(inside.get(n, [])) >= level > 0}
    return out, innermost()


def main_text(source: str) -> str:
    """The article of a page, blocks joined by blank lines; empty if there is none. Takes time in proportion to the source."""
    page = _Page(source)
    if page.leaves and any(page.under):
        _, owner = _left_out(page)
        page.leaves = [x for x, o in zip(page.leaves, owner, strict=True) if not o]
    if not page.leaves:
        return ""
    size = np.array([len(b.strip()) for b, _, _ in page.leaves])
    accepted = _accepted(page.leaves, size)
    if not accepted.any():
        return ""
    sums: dict[int, int] = {}
    for k in np.flatnonzero(accepted):
        n = page.blocks[page.leaves[k][2]]
        sums[n] = sums.get(n, 0) + int(size[k])
    held = _handed_up(sums, page.holder)
    # elements are numbered in page order, so the innermost of those with enough text is the last
    enough = MAIN_SHARE * size[accepted].sum()
    root = max((n for n, s in held.items() if s >= enough), default=0)
    within = {0: root == 0}
    for n in sorted(page.holder):
        if n:
            within[n] = n == root or within[page.holder[n]]

    def belongs(block: int) -> bool:
        # a page without an element for the article: what shares its innermost element with accepted text
        return page.blocks[block] in held if page.wide(root) else within[page.blocks[block]]

    parts: dict[int, list[str]] = {}
    for body, _, block in page.leaves:
        if belongs(block):
            parts.setdefault(block, []).append(body)
    texts = (" ".join("".join(p).split()) for _, p in sorted(parts.items()))
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """All columns of pages but ``source``, with text (empty if there is none) and n_chars, its code points.

    The whole source of every row is read; null is empty. Unclosed and stray tags are tolerated. Columns named text or
    n_chars are replaced. Rows are independent: no shuffle.
    """
    rest = [f for f in pages.schema if f.name not in (source, "text", "n_chars")]
    rows = pages.select(*(f.name for f in rest), source)

    def run(batches):
        for part, strings in slices(batches, source):
            texts = [main_text(s) if s else "" for s in strings.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*part.schema.names[:-1], "text", "n_chars"],
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return rows.mapInArrow(run, f"{kinds}text string, n_chars long")

