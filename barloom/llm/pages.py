"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive and tags negative; one linear scan finds the contiguous
run of greatest sum, the content region. Weights come from labelled pages: those of a bounded sample that mark their
article by one <article> element. A word's weight depends on the innermost block that holds it, a tag's on its name.

Elements have weights too, from two sources that add up: what their name, class, id or role is known to mean (menus,
footers, adverts, comments, ...), and how often the labelled pages have such a class, id or role inside and outside of
their article. An element of low weight is set aside: it counts as one tag and its words aren't text of the region.
An element that holds the article, or most of the page's words, is never set aside, whatever it is called. Where a page
marks one article, tags within it hardly cost anything: tables, lists and figures are parts of it, not its end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.labelled import least_hashed

#: Pages that the weights are fitted on: those of least hash.
SAMPLE = 400
#: Weights never exceed this, in either direction.
MOST = 6.0

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "noscript", "iframe", "template")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary "
    "table tbody tfoot thead title tr ul".split()
)
#: Cells and line breaks part words, but not blocks.
GAPS = frozenset("br td th wbr img input".split())
#: Blocks that an open paragraph ends before.
ENDS_P = BLOCKS - frozenset("body html head option button caption summary legend".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose text is no text of the page.
HIDDEN = frozenset("head script style textarea title xmp noscript iframe template button select option dialog menu svg math object audio video canvas".split())
#: Elements that are seldom content, words in class, id or role that say the same, and words that turn these around.
SELDOM = frozenset("nav aside footer form header".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pagination popup "
    "promo promoted related replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
TURNED = frozenset("no non not has have with without free less open closed enabled disabled layout".split())
#: Elements that no name or class sets aside, and those that an element with the article has in it.
HOLDERS = frozenset("html body main article".split())
ARTICLES = ("article", "main")

#: Weight of an element that is seldom content, the weight from which on one is set aside, and what that costs the region.
SAID, ASIDE, COST = -1.6, -1.5, -2.0
#: The most that labelled pages can say in favour of an element: less than what its name says against it.
FAVOUR = 1.0
#: What a tag within the page's only article costs of its weight, and the weight of a tag that the labels never show.
WITHIN, UNSEEN = 0.02, -0.25
#: Shares of the page's words from which on an element isn't set aside: by a word that is part of a class, by a whole one.
MOST_BY_PART, MOST_BY_WHOLE = 0.5, 0.8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(?:/?[A-Za-z]|[!?])[^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Element:
    """parent: number of the element around it. words: how many it holds. holds: whether an article is in it. articles: of
    the page, how many it has."""

    name: str
    parent: int
    marks: tuple[str, ...] = ()
    said: float = 0.0
    whole: bool = False
    in_article: bool = False
    words: int = 0
    holds: bool = False
    aside: bool = False
    articles: int = 0


@dataclass
class Token:
    """A tag (name) or text within the block ``name``, and the number of the element around it (or which it is)."""

    name: str
    element: int
    text: str | None = None
    drop: bool = False
    opens: bool = False


def _marks(attrs: str) -> tuple[str, ...]:
    """Words of class, id and role."""
    return tuple(w for m in _HINT.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").split())


def _hinted(mark: str) -> bool:
    parts = {p.lower() for p in _PART.findall(mark)}
    return bool(parts & HINTS) and not parts & TURNED


def parsed(html: str) -> tuple[list[Element], list[Token]]:
    """Elements, and tags and texts in page order. Open elements that HTML closes by itself are closed; stray end tags
    close nothing."""
    elements, out = [Element("", 0)], []
    stack: list[int] = []
    at_top = lambda: stack[-1] if stack else 0

    def nearest(names) -> int | None:
        return next((i for i in range(len(stack) - 1, -1, -1) if elements[stack[i]].name in names), None)

    def text(part: str) -> None:
        if part:
            at = nearest(BLOCKS)
            out.append(Token(elements[stack[at]].name if at is not None else "body", at_top(), part))
            elements[at_top()].words += len(part.split())

    last = 0
    for m in _TOKEN.finditer(html):
        text(html[last : m.start()])
        last = m.end()
        if m["raw"]:
            out.append(Token(m["raw"].lower(), at_top(), drop=True))
        if not m["name"]:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        if m["end"]:
            at = nearest((name,))
            out.append(Token(name, stack[at] if at is not None else at_top()))
            if at is not None:
                del stack[at:]
            continue
        if name in ENDS_P and (at := nearest(BLOCKS)) is not None and elements[stack[at]].name == "p":
            del stack[at:]
        if name in SAME_LEVEL:
            at = nearest(SAME_LEVEL[name] | {"ul", "ol", "dl", "table", "select"})
            if at is not None and elements[stack[at]].name in SAME_LEVEL[name]:
                del stack[at:]
        around = elements[at_top()]
        marks = _marks(attrs)
        hints = [w for w in marks if _hinted(w)] if name not in HOLDERS else []
        seldom = name in SELDOM and not (name == "header" and around.in_article)
        own = Element(name, at_top(), tuple(w.lower() for w in marks), SAID if seldom or hints else 0.0)
        # a form may be around a whole page
        own.whole = seldom and name != "form" or any(w.lower() in HINTS for w in hints)
        own.in_article = around.in_article or name == "article"
        out.append(Token(name, len(elements), opens=True))
        elements.append(own)
        # a slash closes foreign elements alone
        if name not in VOID and not (attrs.endswith("/") and nearest(("svg", "math")) is not None):
            stack.append(len(elements) - 1)
    text(html[last:])
    elements[0].articles = sum(e.name == "article" for e in elements)
    # an element comes after the one around it
    for e in elements:
        if e.name in HIDDEN or e.parent and elements[e.parent].name in HIDDEN:
            e.words = 0
    for e in reversed(elements[1:]):
        around = elements[e.parent]
        around.words += e.words
        around.holds |= e.holds or e.name in ARTICLES
    return elements, out


@dataclass
class Weights:
    """Of words by block, all positive; of tags by name, all negative; of words in class, id or role. The rest is for
    what the labels don't show."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    marks: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    tag: float = UNSEEN

    def set_aside(self, elements: list[Element], by_parts: bool = True) -> None:
        """Mark the elements that are set aside, and all within them. by_parts: also by a word that is part of a class."""
        page = elements[0]
        for e in elements[1:]:
            e.aside = elements[e.parent].aside or e.name in HIDDEN
            if not e.aside and e.name not in HOLDERS:
                learned = min((self.marks[m] for m in e.marks if m in self.marks), default=0.0)
                # of a page with an article elsewhere, an element may hold most words and be none of it
                most = 2.0 if page.holds and not e.in_article else MOST_BY_WHOLE if e.whole else MOST_BY_PART
                said = e.said if by_parts or e.whole else 0.0
                e.aside = said + min(learned, FAVOUR) <= ASIDE and not e.holds and e.words < most * max(1, page.words)

    def of(self, t: Token, elements: list[Element]) -> float:
        e = elements[t.element]
        if t.drop:
            return 0.0
        if e.aside:
            return COST if t.opens and not elements[e.parent].aside else 0.0
        if t.text is None:
            return self.tags.get(t.name, self.tag) * (WITHIN if e.in_article and elements[0].articles == 1 else 1.0)
        return self.words.get(t.name, self.word) * len(t.text.split())


#: Without labelled pages: links and list items part, paragraphs and emphasis don't.
PLAIN = Weights(tags={n: -0.1 for n in "p b i em strong u br span h1 h2 h3 h4 h5 h6 blockquote pre sub sup code".split()} | {n: -3.0 for n in "a li ul ol nav div table tr td".split()})


def fit(pages: list[str]) -> Weights:
    """Weights from pages with exactly one article; ``PLAIN`` if there are none."""
    words, tags, marks = (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter())
    for html in pages:
        elements, found = parsed(html)
        if elements[0].articles != 1:
            continue
        PLAIN.set_aside(elements)
        for t in found:
            e = elements[t.element]
            if t.drop or e.aside:
                continue
            if t.text is None:
                tags[e.in_article][t.name] += 1
            else:
                words[e.in_article][t.name] += len(t.text.split())
        for inside in (False, True):
            marks[inside].update({m for e in elements if e.in_article == inside and not e.holds and e.name not in HOLDERS for m in e.marks})
    if not words[True]:
        return PLAIN

    def odds(c: tuple[Counter, Counter], name: str, by: float = 0.5) -> float:
        return log((c[True][name] + by) / (c[False][name] + by))

    # bent to one side: what speaks against the sign of its kind counts little
    soft = lambda x: log1p(exp(min(x, 50.0)))
    return Weights(
        {n: min(MOST, soft(odds(words, n))) for n in words[True] | words[False]},
        {n: -min(MOST, soft(-odds(tags, n))) for n in tags[True] | tags[False]},
        {n: max(-MOST, min(MOST, odds(marks, n, 1.0))) for n in marks[True] | marks[False]},
    )


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run of greatest sum, the first and longest of equals; empty if none is above 0."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, begin = 0.0, i
        total += s
        if total > best or total == best and span[1] > 0 and begin == span[0]:
            best, span = total, (begin, i + 1)
    return span


def _region_text(elements: list[Element], found: list[Token], weights: Weights) -> str:
    begin, end = best_run([weights.of(t, elements) for t in found])
    blocks, own = [], []

    def flush() -> None:
        line = " ".join(unescape("".join(own)).split())
        own.clear()
        if line:
            blocks.append(line)

    for t in found[begin:end]:
        if t.text is not None:
            if not elements[t.element].aside:
                own.append(t.text)
        elif t.name in BLOCKS:
            flush()
        elif t.name in GAPS:
            own.append(" ")
    flush()
    return "\n".join(blocks)


def main_text(html: str | None, weights: Weights) -> str:
    """Blocks of the content region in page order, one a line; '' for null and where no words are.

    If nothing is left, words that are part of a class set nothing aside: they were part of a layout's name.
    """
    elements, found = parsed(html or "")
    weights.set_aside(elements)
    text = _region_text(elements, found, weights)
    if not text and elements[0].words:
        weights.set_aside(elements, by_parts=False)
        text = _region_text(elements, found, weights)
    return text


def extracted(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row. A null page is empty; repeated rows stay; columns beyond page_id, url
    and html are left out. Weights are fitted on at most ``sample`` pages and sent to every task."""
    ids = pages.where("html is not null and page_id is not null").select("page_id").distinct()
    # at most ``sample`` rows, so they may be sent to every task
    picked = F.broadcast(least_hashed(ids, F.xxhash64(F.lit("sample"), "page_id"), sample))
    rows = pages.select("page_id", "html").join(picked, "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    weights = fit([r.html for r in rows.orderBy("page_id").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                own = b.slice(lo, 256)
                text = [main_text(h.as_py(), weights) for h in own.column(2)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return extracted(pages)
