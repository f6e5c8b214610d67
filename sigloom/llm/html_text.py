"""Main text of web pages as the maximum-scoring subsequence of their words and tags.

A page is read as a sequence of words and tags.  Words score positive; tags score by weights learned from labelled
pages (pages that mark their article), mostly negative.  One linear scan finds the contiguous stretch with the highest
sum: the content region.  Inside it, elements that are no part of an article (menus, adverts, forms, comments and the
like) are left out, and the rest is joined block by block.

Such an element is known by its name or by a class, id or role that says nothing else: every word of it must be a
known one ("ad-slot", but not "ad-free" or "share-price"), or labelled pages must have it outside their articles only.
An element that holds the page's main article is none of them, nor is a form or an element with other names too that
outweighs the rest of the page, nor one known by its class that holds nearly all of it and is no list of links.  A menu or
advert whose end tag is missing ends where running text begins.

Every page is read in its own task, in time proportional to its length; only the weights, one number per tag, come from
a bounded sample of pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Pages that the weights are learned from at most, in expectation, and tags and classes that get a weight.
MOST_PAGES, MOST_KEYS = 2000, 10_000
#: Elements whose content is never text, elements that are no part of an article, and class or id words that say so.
SILENT = frozenset("script style noscript template svg math canvas iframe object video audio head title textarea select".split())
ASIDE = frozenset("nav footer aside form button dialog menu search".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comment comments disqus replies respond share sharing social related recommended widget pagination pager skip disclaimer copyright "
    "contentinfo complementary".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies disqus respond".split())
#: Words that say nothing beside one of those.
PLACE_WORDS = frozenset(
    "area bar block body bottom bottoms box button buttons close col column container content desktop footer form global group head header holder icon icons inner item items left link links list main "
    "mobile outer page panel post posts primary region right row secondary section site slot slots space strip text thread top unit wrap wrapper".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the same kind ends.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
_TAG = re.compile(r"</?[a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT}
_CAMEL, _APART = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[^a-z]+")
#: Elements of running text, and the words that mark them: others (a banner headline, a copyright line) don't.
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p blockquote figcaption pre".split())
RUNNING_WORDS = ASIDE_WORDS - frozenset("banner masthead notice notices copyright disclaimer menu nav navigation overlay toolbar topbar complementary contentinfo skip".split())
#: Elements that end an advert or a menu whose own end is missing.
RESUMES = frozenset("p h1 h2 h3 h4 h5 h6 article main section".split())
#: What an element's mark is: none, set by its name or class, the same where most of a page may be inside, comments, comments by one
#: name of several.
FREE, OFF, WRAPPER, COMMENTS, MAYBE_COMMENTS = range(5)
#: How many times the rest of the page an element must hold for its mark to be wrong; words from which it may be by class alone.
OUTWEIGHS, FAR_OUTWEIGHS, STORY_WORDS = 2, 10, 30


@dataclass
class Weights:
    """What a tag adds to the score (a word adds 1): ``other`` stands for tags that the labelled pages don't have, ``bound`` for the
    ends of a marked article.  What is inside elements that are no part of an article adds nothing, so that a long advert can't cut
    off the shorter side of a story.  ``classes`` holds class names with a word of such elements that labelled pages have, less than 0 for outside."""

    tags: dict[str, float] = field(default_factory=dict)
    other: float = -0.3
    bound: float = -10.0
    classes: dict[str, float] = field(default_factory=dict)

    def of(self, kind: str, value: str, aside: bool) -> float:
        if aside:
            return 0.0
        if kind == "text":
            return float(len(value.split()))
        return self.bound if value.lstrip("/") in ("article", "main") else self.tags.get(value, self.other)


def _names(tag: str) -> list[tuple[str, tuple[str, ...]]]:
    """Each class, id and role name of a tag (lower case) with its words."""
    out = []
    for m in _ROLE.finditer(tag):
        for name in (m[1] or m[2] or m[3] or "").split():
            name = _CAMEL.sub("-", name).lower()
            if words := tuple(w for w in _APART.split(name) if w):
                out.append((name, words))
    return out


def _mark(name: str, tag: str, classes: dict[str, float]) -> int:
    """Whether an element is no part of an article by its own name and classes."""
    names = _names(tag) if "=" in tag else []
    listed = RUNNING_WORDS if name in RUNNING else ASIDE_WORDS
    sure = [w for n, w in names if any(x in listed for x in w) and (all(x in ASIDE_WORDS or x in PLACE_WORDS for x in w) or classes.get(n, 0.0) <= -2.0)]
    alone = len(sure) == len(names)  # no other name says what the element is
    if any(x in COMMENT_WORDS for w in sure for x in w):
        return COMMENTS if alone else MAYBE_COMMENTS
    if name in ("html", "body", "main", "article"):
        return FREE
    if name in ASIDE:
        return WRAPPER if name == "form" else OFF
    if not sure:
        return FREE
    return OFF if alone else WRAPPER


def _pieces(page: str) -> Iterator[tuple[str, str]]:
    """The page cut into texts and tags, ``silent`` for the tag of an element whose content is left out, as are comments
    and declarations; each character is looked at a few times at most."""
    at, end, quotes, unclosed = 0, len(page), True, set()
    while at < end:
        lt = page.find("<", at)
        if lt != at:
            yield "text", page[at : lt if lt >= 0 else end]
            if lt < 0:
                return
            at = lt
        mark = page[at + 1 : at + 2]
        if mark in ("!", "?") and mark:
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 2)
                stop = end if stop < 0 else stop + 3
            elif page.startswith("<![CDATA[", at):
                stop = page.find("]]>", at)
                yield "text", page[at + 9 : end if stop < 0 else stop].replace("&", "&amp;")
                stop = end if stop < 0 else stop + 3
            else:
                stop = page.find(">", at)
                stop = end if stop < 0 else stop + 1
            at = stop
            continue
        if not (mark.isascii() and mark.isalpha()) and not (mark == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha()):
            yield "text", "<"
            at += 1
            continue
        m = _TAG.match(page, at) if quotes else None
        if m:
            stop = m.end()
        else:  # no end outside quotes: from here on quotes don't count, so that nothing is looked through twice
            quotes, stop = False, page.find(">", at) + 1
            if not stop:
                yield "text", page[at:]
                return
        raw, at = page[at:stop], stop
        name = _NAME.match(raw)[1].lower()
        if name not in SILENT or raw[1] == "/" or raw.endswith("/>") or name in unclosed:
            yield "tag", raw
            continue
        close = _CLOSE[name].search(page, at)
        if close or name in ("script", "style"):
            yield "silent", raw
            at = close.end() if close else end
        else:
            unclosed.add(name)
            yield "tag", raw


def tokens(page: str | None, classes: dict[str, float] | None = None) -> list[tuple[str, str, bool]]:
    """(kind, value, aside) in page order: kind ``text`` with raw text, or ``tag`` with its name.

    Comments and the content of silent elements give nothing.  ``aside`` tells whether the place is inside an element
    that is no part of an article; ``header`` is one unless it is inside an article.
    """
    page, classes = page or "", classes or {}
    parsed = _parsed(page, classes, frozenset())
    if early := frozenset(e for e in parsed.unclosed if parsed.marks[e] in (OFF, WRAPPER) and parsed.names[e] != "form"):
        parsed = _parsed(page, classes, early)
    return _judged(parsed)


@dataclass
class _Page:
    """The parts of a page with the element each is in, and of each element (in page order; the first is the page) its parent, mark,
    own words, words in links, and name; ``unclosed`` are those whose end tag is missing."""

    parts: list[tuple[str, str, int]] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])
    marks: list[int] = field(default_factory=lambda: [FREE])
    words: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    unclosed: list[int] = field(default_factory=list)


def _parsed(page: str, classes: dict[str, float], early: frozenset[int]) -> _Page:
    """The page's elements; those in ``early`` end where running text or a section begins, if not before."""
    p = _Page()
    open_, depth, waiting = [0], Counter(), 0

    def pop() -> int:
        nonlocal waiting
        e = open_.pop()
        depth[p.names[e]] -= 1
        waiting -= e in early
        return e

    for kind, raw in _pieces(page):
        if kind == "text":
            p.parts.append(("text", raw, open_[-1]))
            n = len(raw.split())
            p.words[open_[-1]] += n
            p.linked[open_[-1]] += n * (depth["a"] > 0)
            continue
        name = _NAME.match(raw)[1].lower()
        if kind == "silent":
            p.parts.append(("tag", name, open_[-1]))
            continue
        if raw[1] == "/":
            p.parts.append(("tag", "/" + name, open_[-1]))
            if depth[name]:
                while p.names[e := pop()] != name:
                    p.unclosed.append(e)
            continue
        if waiting and name in RESUMES:
            while waiting:
                pop()
        if name in SELF_ENDING and p.names[open_[-1]] == name:
            pop()
        mark = _mark(name, raw, classes)
        if mark == FREE and name == "header" and not depth["article"] and not depth["main"]:
            mark = OFF
        p.parent.append(open_[-1]), p.marks.append(mark), p.words.append(0), p.linked.append(0), p.names.append(name)
        p.parts.append(("tag", name, len(p.names) - 1))
        if name not in VOID and not raw.endswith("/>"):
            open_.append(len(p.names) - 1)
            depth[name] += 1
            waiting += len(p.names) - 1 in early
    p.unclosed += open_[1:]
    return p


def _judged(p: _Page) -> list[tuple[str, str, bool]]:
    """Parts with their element's verdict, marks lifted from elements around the page's main article or most of its words."""
    n, parent, marks, words, names = len(p.parent), p.parent, p.marks, p.words, p.names
    total, linked = list(words), list(p.linked)
    for e in range(n - 1, 0, -1):  # children come after their parents
        total[parent[e]] += total[e]
        linked[parent[e]] += linked[e]
    away, comments = [False] * n, [False] * n

    def judge() -> int:
        """Marks passed down; how many words are left."""
        left = words[0]
        for e in range(1, n):
            away[e] = marks[e] != FREE or away[parent[e]]
            comments[e] = marks[e] in (COMMENTS, MAYBE_COMMENTS) or comments[parent[e]]
            left += 0 if away[e] else words[e]
        return left

    left = judge()
    articles = [e for e in range(1, n) if names[e] in ("article", "main") and not comments[e]]
    main = max(articles, key=lambda e: (total[e], -e), default=0)
    lifted = False
    if main and away[main] and total[main] >= left:
        e = main
        while e:
            lifted, marks[e], e = True, FREE, parent[e]
    inner = [0] * n  # words of an element outside all marked elements within it
    for e in range(n - 1, 0, -1):
        inner[e] += words[e]
        if marks[e] == FREE:
            inner[parent[e]] += inner[e]
    told = bool(main) and not away[main] and inner[main] > 0  # the page marks its article, and it has text of its own
    for e in range(1, n):
        if marks[e] in (FREE, COMMENTS) or not inner[e] or told:
            continue
        by_name = names[e] in ASIDE and names[e] != "form"
        if marks[e] == WRAPPER:
            wrong = inner[e] >= OUTWEIGHS * left
        else:  # by class alone, or comments by one name of several: only where hardly anything else is there, and it is no list of links
            wrong = not by_name and inner[e] >= max(FAR_OUTWEIGHS * left, STORY_WORDS) and 2 * linked[e] < total[e]
        if wrong:
            lifted, marks[e] = True, FREE
    if lifted:
        judge()
    return [(kind, value, away[e]) for kind, value, e in p.parts]


def _scan(parts: list, weights: Weights) -> tuple[int, int]:
    """Bounds of the stretch of ``parts`` with the highest sum (one linear scan); the longest of equals, (0, 0) for none above 0."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for i, (kind, value, aside) in enumerate(parts):
        s = weights.of(kind, value, aside)
        if total <= 0 and s > 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and total > 0 and start == lo):
            best, lo, hi = total, start, i + 1
    return lo, hi


def extract(page: str | None, weights: Weights) -> str:
    """Main text of one page; empty for a null, empty or wordless one.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.
    """
    parts = tokens(page, weights.classes)
    lo, hi = _scan(parts, weights)
    blocks, block = [], []
    for kind, value, aside in parts[lo:hi]:
        if kind == "text":
            if not aside:
                block.append(value)
        elif value.lstrip("/").split(".")[0] not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(w for b in blocks if (w := " ".join(html.unescape(b).split())))


def counted(page: str | None) -> list[tuple[str, str, int, int]]:
    """(kind, key, inside, outside) of one page: how often it has a tag, or a class name with a word of ``ASIDE_WORDS``,
    inside its article and outside; nothing of a page without one ``article`` or ``main`` element that marks its main text.

    Tags inside menus and the like tell nothing about the same tags elsewhere and are left out.
    """
    depth, marks, rows = 0, 0, Counter()
    for kind, value, aside in tokens(page):
        if kind == "tag" and value in ("article", "main"):
            depth, marks = depth + 1, marks + (depth == 0)
        elif kind == "tag" and value in ("/article", "/main"):
            depth = max(0, depth - 1)
        elif kind == "tag" and not aside:
            rows["tag", value, depth > 0] += 1
    depth = 0
    for kind, raw in _pieces(page or ""):
        if kind == "tag":
            name = _NAME.match(raw)[1].lower()
            if name in ("article", "main"):
                depth = max(0, depth + (-1 if raw[1] == "/" else 1))
            elif raw[1] != "/" and "=" in raw:
                rows.update(("class", n, depth > 0) for n, w in _names(raw) if any(x in ASIDE_WORDS for x in w))
    return [(k, v, n if there else 0, 0 if there else n) for (k, v, there), n in rows.items()] if marks == 1 else []


def weighed(counts: Iterable[tuple[str, str, int, int]], smooth: float = 1.0) -> Weights:
    """Weights from sums of ``counted``: the logarithm of how often a key is met inside marked articles against outside.

    Tags get between -4 and -0.02, class names (met five times at least) between -4 and 4.
    """
    inside, outside = {"tag": Counter(), "class": Counter()}, {"tag": Counter(), "class": Counter()}
    for kind, key, there, elsewhere in counts:
        inside[kind][key] += there
        outside[kind][key] += elsewhere
    n_in, n_out = sum(inside["tag"].values()), sum(outside["tag"].values())
    odds = {kind: {t: math.log((inside[kind][t] + smooth) / (n_in + smooth)) - math.log((outside[kind][t] + smooth) / (n_out + smooth)) for t in inside[kind].keys() | outside[kind].keys()} for kind in inside}
    tags = {t: round(min(-0.02, max(-4.0, o)), 4) for t, o in sorted(odds["tag"].items())}
    classes = {t: round(min(4.0, max(-4.0, o)), 4) for t, o in sorted(odds["class"].items()) if inside["class"][t] + outside["class"][t] >= 5}
    return Weights(tags, classes=classes)


def learn(pages: list[str]) -> Weights:
    """Weights from pages that mark their main text by one ``article`` or ``main`` element; other pages teach nothing."""
    return weighed(row for page in pages for row in counted(page))


def fit(pages: DataFrame, most: int = MOST_PAGES) -> Weights:
    """Weights from about ``most`` pages, chosen by a hash of their content; copies of a page count once.

    Pages are counted in tasks; the sums of at most ``MOST_KEYS`` tags and classes, the most frequent, come to the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for page in batch["html"] for r in counted(page)], columns=["kind", "key", "inside", "outside"])

    n = max(pages.count(), 1)
    share = int(min(1.0, most / n) * (1 << 20) + 1)
    chosen = pages.select("html").where(F.col("html").isNotNull() & (F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < share)).distinct()
    sums = chosen.mapInPandas(count, "kind string, key string, inside long, outside long").groupBy("kind", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return weighed(map(tuple, sums.orderBy(F.desc(F.col("inside") + F.col("outside")), "kind", "key").limit(MOST_KEYS).collect()))


def main_text(weights: Weights, page: Column | str) -> Column:
    """Main text of each page; an empty string where there is none."""

    @pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p, weights) for p in pages], dtype=object)

    return of(page)


def extracted(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) for every row of ``pages``; other columns are not read.

    A null, empty or wordless page, and one with nothing but menus and the like, has an empty text; pages of any length
    are read whole; null ids and repeated rows come out like others; an empty table gives an empty result.
    """
    return pages.select("page_id", "url", main_text(weights, "html").alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
