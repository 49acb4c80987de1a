"""Main text of web pages: the contiguous region with the greatest score.

A page is a sequence of words and tags. Words score for, tags score against; how much is learned from labelled pages,
where labelled means that the author marked the content (one <article> or <main>). A word scores by the share of words
with the same nearest block tag that stand inside marked content; a tag costs 1 plus 8 times the share of its kind that
stands outside. Everything in an element that is never content by its own kind (menus, footers, sidebars, forms, scripts,
styles, or by name: adverts, notices, comments, ...) costs as much as a tag word by word. One linear scan finds the
segment with the greatest sum. A segment inside marked content is widened to all of that element. Elsewhere it is widened
to each side as long as the words gained outweigh a share of the tags in between; tags of text blocks and what is never
content cost nothing there. The words of the segment outside of never-content are the text.

A name marks an element as never content if it has a word for such things and otherwise only words for places and
shapes ("ad-banner", "site-footer", but not "market-share"). A page is read once from front to back, and the open
elements are counted by name, so that work is in proportion to its length, whatever it holds. An unfinished tag ends the
page, an end tag without its start is passed over, a raw element (script, ...) that is not closed reaches to the end.

Character references are decoded after the markup is taken off, white space inside a block becomes one space, blocks are
joined by one space. Null and empty pages, and pages without a word of content, give an empty text; of segments with
equal sums the first is taken; repeated rows are extracted each. No page is cut: memory follows the longest page.
Training uses about `sample` labelled pages, by hash of their id and text; on an empty table all tags weigh alike.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.llm.words import slices

#: Kinds of elements, by the public HTML specification.
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
NEVER = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "noscript", "template", "svg", *RAW}
MARKED = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = set("a abbr b bdi bdo cite code data dfn em i kbd mark q s samp small span strong sub sup time u var wbr font".split())
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "br", "blockquote", "pre", "figure", "figcaption", "hr", "table", "tr", "td", "th", "tbody", "ul", "ol", "li", "dl", "dt", "dd"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
#: Words of a class or id that name what is never content, and words that say only where or in which shape.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr "
    "notice notices comment comments respond disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing sharebar social "
    "related newsletter subscribe subscription signup popup modal masthead footer skip".split()
)
PLACES = set(
    "site page main global primary secondary top bottom left right upper lower middle side block box wrap wrapper container inner outer list item items "
    "section widget area bar link links button buttons icons post posts article articles user reader form slot unit region group panel row col column "
    "mobile desktop header head title body text content small large sticky fixed the and to js".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_NAME_PARTS = re.compile(r"[-_]+|\d+")
GAP_SHARE = 0.25  # of the cost of tags between a segment and what it is widened to
LEAST_GAIN = 0.1  # of a word that a segment is widened to
_CLOSED_BY_BLOCK = INLINE | {"p"}


def _is_name_of_never(token: str) -> bool:
    parts = [p for p in _NAME_PARTS.split(token) if p]
    return any(p in NAMES for p in parts) and all(p in NAMES or p in PLACES for p in parts)


def _is_never(name: str, named: list[tuple[str, str]], inside_marked: bool) -> bool:
    if name in NEVER or (name == "header" and not inside_marked):
        return True
    if name in ("html", "body") or name in MARKED and not inside_marked:
        return False
    for key, value in named:
        tokens = value.lower().split()
        if any(t in ROLES for t in tokens) if key == "role" else any(map(_is_name_of_never, tokens)):
            return True
    return False


class Item:
    """A tag (words None) or a run of text: its tag or nearest block tag, number of words, inside never-content, number of
    the outermost marked element around it (0: none)."""

    __slots__ = ("name", "words", "text", "never", "marked")

    def __init__(self, name: str, words: int | None, text: str, never: bool, marked: int):
        self.name, self.words, self.text, self.never, self.marked = name, words, text, never, marked


def _tokens(page: str) -> Iterator[tuple[str, str, list[tuple[str, str]], bool]]:
    """(kind, name or text, class, id and role, closes itself); kind: text, start or end. Reads the page once."""
    low = at = 0
    while (at := page.find("<", at)) >= 0:
        end = page.startswith("/", at + 1)
        if m := _NAME.match(page, at + 1 + end):
            if low < at:
                yield "text", page[low:at], [], False
            name, named, at = m[0].lower(), [], m.end()
            while not page.startswith(">", at) and (a := _ATTRIBUTE.match(page, at)):
                at = a.end()
                if (key := a[1].lower()) in ("class", "id", "role"):
                    named.append((key, a[2] or a[3] or a[4] or ""))
            close = page.find(">", at)
            if close < 0:
                return
            closed = page[close - 1] == "/"
            at = low = close + 1
            if not end and not closed and name in _RAW_END:
                stop = _RAW_END[name].search(page, at)
                at = low = page.find(">", stop.end()) + 1 if stop else 0
                if not low:
                    return
                continue
            yield "end" if end else "start", name, named, closed
        elif page.startswith(("<!", "<?", "</"), at):
            if low < at:
                yield "text", page[low:at], [], False
            if page.startswith(("<!-->", "<!--->"), at):
                mark = ">"
            else:
                mark = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            stop = page.find(mark, at + 2)
            if stop < 0:
                return
            at = low = stop + len(mark)
        else:
            at += 1
    if low < len(page):
        yield "text", page[low:], [], False


class _Open:
    """The open elements. An end tag does not reach out of a marked element, that of an inline tag or of a paragraph not
    out of never-content either; how many elements of a name it can reach is counted."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int, str]] = []  # name, never, marked, nearest block tag
        self.any: list[Counter] = [Counter()]
        self.inline: list[Counter] = [Counter()]

    def top(self) -> tuple[str, bool, int, str]:
        return self.stack[-1] if self.stack else ("body", False, 0, "body")

    def _begins(self, k: int) -> tuple[bool, bool]:
        name, never, *_ = self.stack[k]
        return name in MARKED, never and not (k and self.stack[k - 1][1])

    def push(self, name: str, never: bool, marked: int) -> None:
        self.stack.append((name, never, marked, self.top()[3] if name in INLINE else name))
        is_marked, is_never = self._begins(-1 + len(self.stack))
        if is_marked:
            self.any.append(Counter())
        if is_marked or is_never:
            self.inline.append(Counter())
        self.any[-1][name] += 1
        self.inline[-1][name] += 1

    def pop(self) -> str:
        is_marked, is_never = self._begins(len(self.stack) - 1)
        name = self.stack.pop()[0]
        self.any[-1][name] -= 1
        self.inline[-1][name] -= 1
        if is_marked:
            self.any.pop()
        if is_marked or is_never:
            self.inline.pop()
        return name

    def end(self, name: str) -> None:
        if (self.inline if name in _CLOSED_BY_BLOCK else self.any)[-1][name] > 0:
            while self.pop() != name:
                pass


def items(page: str) -> list[Item]:
    found: list[Item] = []
    elements = _Open()
    marks = 0
    for kind, name, named, closed in _tokens(page):
        _, never, marked, block = elements.top()
        if kind == "text":
            if name.isspace():
                found.append(Item("", 0, " ", never, marked))
            else:
                plain = html.unescape(name)
                found.append(Item(block, len(plain.split()), plain, never, marked))
        elif kind == "end":
            found.append(Item(name, None, "", never, marked))
            elements.end(name)
        else:
            if name in TEXT_BLOCKS and name not in ("br", "hr"):
                while elements.top()[0] in _CLOSED_BY_BLOCK and elements.stack:
                    elements.pop()
                _, never, marked, _ = elements.top()
            never = never or _is_never(name, named, marked > 0)
            if never:
                marked = 0
            elif not marked and name in MARKED:
                marks += 1
                marked = marks
            found.append(Item(name, None, "", never, marked))
            if name not in VOID and not closed:
                elements.push(name, never, marked)
    return found


class Weights:
    """What a word gains by its nearest tag, and what a tag costs."""

    def __init__(self, counts: dict[tuple[str, bool, bool], int]):
        def share(kind: str, word: bool, inside: bool) -> float:
            yes, no = (counts.get((kind, word, x), 0) for x in (inside, not inside))
            return (yes + 1) / (yes + no + 2)

        kinds = {(k, w) for k, w, _ in counts}
        self.gain = {k: share(k, True, True) for k, w in kinds if w}
        self.cost = {k: 1 + 8 * share(k, False, False) for k, w in kinds if not w}

    def score(self, item: Item) -> float:
        if item.words is None:
            return -self.cost.get(item.name, 5.0)
        return -5.0 * item.words if item.never else item.words * self.gain.get(item.name, 0.5)


def count_labelled(pages: Iterator[str]) -> Counter:
    counts: Counter = Counter()
    for page in pages:
        for item in items(page or ""):
            counts[(item.name, item.words is not None, item.marked > 0)] += 1 if item.words is None else item.words
    return counts


def _widened(beside: list[Item], marked: int, weights: Weights) -> int:
    """How many of the items beside a segment, nearest first, join it; marked: the marked element at its edge."""
    reached, total = 0, 0.0
    for i, item in enumerate(beside):
        if marked:
            if item.marked == marked:
                reached = i + 1
            elif not item.never:
                break
        elif not item.never:
            if item.name in MARKED:
                break
            if item.words:
                total += item.words * (weights.gain.get(item.name, 0.5) - LEAST_GAIN)
                if total > 0:
                    reached, total = i + 1, 0.0
            elif item.words is None and item.name not in TEXT_BLOCKS and item.name not in INLINE:
                total -= GAP_SHARE * weights.cost.get(item.name, 5.0)
    return reached


def extract(page: str, weights: Weights) -> str:
    found = items(page)
    best, best_span, total, start = 0.0, (0, 0), 0.0, 0
    for i, item in enumerate(found):
        if total <= 0:
            total, start = 0.0, i
        total += weights.score(item)
        if total > best:
            best, best_span = total, (start, i + 1)
    low, high = best_span
    if low == high:
        return ""

    low -= _widened(found[:low][::-1], found[low].marked, weights)
    high += _widened(found[high:], found[high - 1].marked, weights)
    parts = []
    for item in found[low:high]:
        if item.words is None:
            parts.append("" if item.name in INLINE else " ")
        elif not item.never:
            parts.append(item.text)
    return " ".join("".join(parts).split())


def train(pages: DataFrame, sample: int = 5_000) -> Weights:
    """Weights from pages with marked content; pages without take no part."""
    labelled = pages.where(F.lower("html").rlike("<(article|main)[ >]")).select("page_id", "html")
    spot = F.pmod(F.xxhash64(F.lit("weights"), "page_id", "html"), F.lit(1 << 30))
    chosen = labelled.where(spot < (1 << 30) * min(1.0, sample / max(1, labelled.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            counts = count_labelled(batch.column("html").to_pylist())
            rows = [(*key, n) for key, n in counts.items()]
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.bool_(), pa.int64()))]
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays, ["kind", "word", "inside", "n"])

    counted = chosen.mapInArrow(run, "kind string, word boolean, inside boolean, n bigint")
    sums = counted.groupBy("kind", "word", "inside").agg(F.sum("n").alias("n"))
    return Weights({(r["kind"], r["word"], r["inside"]): r["n"] for r in sums.collect()})


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text and n_chars of every row; other columns play no part."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(page or "", shared.value) for page in batch.column("html").to_pylist()]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
