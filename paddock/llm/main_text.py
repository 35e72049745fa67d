"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score the log-odds of lying in
the article given their element, their container, the length and the share of
links of their block, and whether a class name speaks against them; tags score
below zero. The weights are learned from labelled pages: a bounded, hash-ordered
sample of the pages that mark their article (``article``, ``main`` or
``itemprop=articleBody``), counted by a grouped aggregation. The marks are the
label and no feature. One linear scan finds the contiguous region with the
largest sum; it is widened to whole blocks, and blocks of menus, headers,
footers, sidebars, notices, adverts, forms and reader comments inside it are
left out.

What elements and roles say (``nav``, ``form``, ``role=banner``, ...) holds. A
class name alone deletes nothing: an element it speaks against is left out
where the page marks its article elsewhere, where the element's words score
below zero, or where it holds at most half of the page's words (nine tenths for
reader comments, which often are longer than the article). Outside a marked
article, neighbouring blocks of nothing but links, three or more, are a menu.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one newline; a line
break element ends a block. Defined results: null, empty or word-free html has
an empty text; html without tags is one block; unclosed or truncated markup is
read to its end; very long pages are read whole; repeated rows get equal
results; with equal sums the earlier region wins; other input columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.text import map_batches, pieces

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[a-zA-Z/][^>]*\Z|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(
    r"(class|id|role|itemprop|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template iframe textarea xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("div section article main nav aside header footer form details fieldset center".split())
LEFT_OUT = frozenset("nav footer aside form button select menu dialog object audio video canvas head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar "
                  "form".split())
MARKS = frozenset("nav navbar navigation menu menubar footer sidebar aside ad ads advert adverts advertisement "
                  "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal "
                  "overlay newsletter subscribe signup social share sharing related recommended breadcrumb breadcrumbs "
                  "pagination pager widget toolbar login searchform masthead skip adsbygoogle".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion feedback".split())


@dataclass(frozen=True)
class RegionModel:
    max_pages: int = 2_000  # bound of the labelled sample
    word_prior: float = 0.5
    limit: float = 4.0  # largest weight of a feature
    block_limit: float = 1.0  # of a block's length and links
    marked_share: float = 0.5  # an element with a mark is kept when it holds more of the page's words
    comment_share: float = 0.9
    menu_share: float = 0.8  # linked words of a menu's block
    menu_links: int = 3
    left_out: float = -0.2  # a word that is left out anyway
    left_out_total: float = -6.0  # at most per element


def is_marked(name: str) -> bool:
    """A class or id that begins or ends with a mark; ``has-sidebar`` tells of another element."""
    parts = re.split(r"[^a-z0-9]+", name)
    return parts[0] not in ("has", "with", "no") and (parts[0] in MARKS or parts[-1] in MARKS)


class Element:
    """An element with what it inherits: ``out`` (left out whatever it holds), ``inside`` a marked article, ``link``,
    and ``mark``, the nearest element, itself included, that a class name speaks against."""

    __slots__ = ("name", "block", "container", "out", "by_class", "comment", "inside", "link", "spent", "mark", "up", "level", "words", "score")

    def __init__(self, name: str, attrs: str, parent: Element | None):
        found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs else {}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        tokens = re.split(r"[^a-z0-9]+", names)
        self.name = name
        self.block = parent.block if parent and name in INLINE else name
        self.comment = name not in ("html", "body") and bool(COMMENTS.intersection(tokens))
        self.inside = parent is not None and parent.inside
        self.link = name == "a" or parent is not None and parent.link
        out = (name in LEFT_OUT or found.get("role") in ROLES or "hidden" in found
               or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
               or name == "header" and not self.inside)
        self.by_class = self.comment
        if name not in ("html", "body", *ARTICLE):
            self.by_class |= any(is_marked(n) for n in names.split()) or "header" in tokens and not self.inside
        if (name in ARTICLE or found.get("itemprop") == "articlebody") and not self.comment:
            self.inside = True
        self.out = out or parent is not None and parent.out
        first = next((t for t in found.get("class", "").split() if t), "")
        kept = name in SECTIONS and name not in ARTICLE and (first or name != "div")
        self.container = f"{name}.{first}".rstrip(".") if kept else parent.container if parent else ""
        self.spent = self.score = 0.0
        self.words = 0
        self.up = parent.mark if parent else None
        self.level = self.up.level + 1 if self.up else 0
        self.mark = self if self.by_class else self.up


def read(html: str) -> Iterator[tuple]:
    """(kind, ...) of a page in order: ("tag", name), ("break",) and ("text", string, element)."""
    root = Element("body", "", None)
    stack, at = [root], 0
    while at < len(html):
        m = _TOKEN.match(html, at)
        if m is None:  # cannot happen with the last alternative; guards the loop
            at += 1
            continue
        at = m.end()
        if m["text"] is not None or m["cdata"] is not None:
            yield ("text", m["text"] if m["cdata"] is None else m["cdata"], stack[-1])
            continue
        if m["name"] is None:
            continue
        name, block = m["name"].lower(), m["name"].lower() not in INLINE
        yield ("tag", name)
        if block:
            yield ("break",)
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID or m["attrs"].endswith("/"):
            continue
        if block:  # an open paragraph ends where a block begins
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name not in INLINE:
                    break
        if name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1].name == name:
            stack.pop()
        element = Element(name, m["attrs"], stack[-1])
        if element.inside and not stack[-1].inside:
            for e in stack:  # a wrapper around the article is no sidebar, whatever its class says
                e.by_class = False
        stack.append(element)


class Page:
    """Blocks of a page: texts with their elements, and the sequence of tokens."""

    def __init__(self, html: str):
        self.blocks: list[list[tuple[str, Element]]] = [[]]
        self.tokens: list[tuple] = []  # (feature, ) of a tag, (inner element, words, element, block) of a run of words
        self.words, self.linked, self.links = [0], [0], [0]  # per block
        self.marked = False  # the page marks an article that has words
        self.marks: dict[Element, None] = {}  # elements that a class name speaks against, in page order
        for kind, *rest in read(html):
            if kind == "tag":
                self.tokens.append(("t:" + rest[0],))
            elif kind == "break":
                if self.blocks[-1]:
                    self.blocks.append([])
                    for counts in (self.words, self.linked, self.links):
                        counts.append(0)
            else:
                text, element = rest
                if not element.out:
                    text = unescape(text) if "&" in text else text
                    self.blocks[-1].append((text, element))
                elif not self.blocks[-1]:
                    self.blocks[-1].append(("", element))  # a block of its own, for its length and links
                words = len(text.split())
                inner = "a" if element.link and element.block not in HEADINGS else element.block
                if words:
                    self.tokens.append((inner, words, element, len(self.blocks) - 1))
                    self.words[-1] += words
                    self.linked[-1] += words * element.link
                    self.links[-1] += element.link
                    self.marked |= element.inside and not element.out
                    mark = element.mark
                    while mark is not None and mark not in self.marks:
                        self.marks[mark] = None
                        mark = mark.up

    def features(self, inner: str, element: Element, block: int) -> tuple[str, ...]:
        long, links = min(self.words[block].bit_length(), 7), -(-3 * self.linked[block] // self.words[block])
        common = ("w:" + inner, "c:" + element.container, f"n:{long}", f"l:{links}")
        mark = element.mark
        while mark is not None and not mark.by_class:
            mark = mark.up
        return common if mark is None else (*common, "k:mark")

    def counts(self) -> tuple[Counter, Counter]:
        """Features of words and tags inside and outside the marked article."""
        inside, outside, now = Counter(), Counter(), False
        for token in self.tokens:
            if len(token) == 1:
                (inside if now else outside)[token[0]] += 1
            else:
                inner, words, element, block = token
                features = self.features(inner, element, block)
                marked = "k:mark" in features
                now = element.inside and not element.out and not marked
                for f in features[1:] if marked else features:  # the mark explains it, whatever the element's name
                    (inside if now else outside)[f] += words
        return inside, outside

    def left_out(self, scores: list[float], model: RegionModel) -> set[Element]:
        """The elements that a class name speaks against and that other evidence does not keep."""
        total = 0
        for token, score in zip(self.tokens, scores, strict=True):
            if len(token) > 1 and not token[2].out:
                total += token[1]
                if token[2].mark is not None:
                    token[2].mark.words += token[1]
                    token[2].mark.score += score
        inner_first = sorted(self.marks, key=lambda e: -e.level)
        for mark in inner_first:
            if mark.up is not None:
                mark.up.words += mark.words
                mark.up.score += mark.score
        out = set()
        for mark in reversed(inner_first):
            share = model.comment_share if mark.comment else model.marked_share
            kept = not self.marked and mark.score > 0 and mark.words > share * total
            if mark.by_class and not kept or mark.up in out:
                out.add(mark)
        return out

    def menus(self, out: set[Element], model: RegionModel) -> set[int]:
        """Blocks of runs of nothing but links outside a marked article."""
        found, run, links = set(), [], 0
        for b in range(len(self.blocks) + 1):
            own = [e for t, e in self.blocks[b] if t and not e.out and e.mark not in out] if b < len(self.blocks) else []
            if b < len(self.blocks) and not self.words[b]:
                continue
            if own and self.linked[b] >= model.menu_share * self.words[b] and not any(e.inside for e in own):
                run.append(b)
                links += self.links[b]
                continue
            if links >= model.menu_links:
                found.update(run)
            run, links = [], 0
        return found

    def text(self, weights: dict[str, float], model: RegionModel) -> str:
        """Text of the best region."""
        scores = [weights.get(t[0], -0.1) if len(t) == 1 else
                  t[1] * (model.word_prior + sum(weights.get(f, 0.0) for f in self.features(t[0], t[2], t[3])))
                  for t in self.tokens]
        out = self.left_out(scores, model)
        best, best_span, total, begin = 0.0, None, 0.0, None
        for token, score in zip(self.tokens, scores, strict=True):
            if len(token) == 1:
                total += score
            else:
                _, words, element, block = token
                if element.out or element.mark in out:
                    cost = max(model.left_out * words, model.left_out_total - element.spent)
                    element.spent += cost
                    total += min(cost, 0.0)
                else:
                    if total <= 0 or begin is None:
                        total, begin = 0.0, block
                    total += score
                    if total > best:
                        best, best_span = total, (begin, block)
            if total <= 0:
                total, begin = 0.0, None
        if best_span is None:  # no element that the labelled pages speak for: all blocks that are not left out
            best_span = (0, len(self.blocks) - 1)
        menus = self.menus(out, model)
        chosen = (self.blocks[b] for b in range(best_span[0], best_span[1] + 1) if b not in menus)
        lines = (" ".join("".join(t for t, e in b if e.mark not in out).split()) for b in chosen)
        return "\n".join(line for line in lines if line)


def learn_weights(pages: DataFrame, model: RegionModel) -> dict[str, float]:
    """Log-odds of words, and costs of tags, from the labelled sample of (id, html)."""
    labelled = pages.filter(F.lower("html").rlike(r"<(article|main)\b|itemprop=.?articlebody"))
    chosen = labelled.select(F.col("id").alias("chosen_id")).distinct().orderBy(
        F.xxhash64("chosen_id"), "chosen_id").limit(model.max_pages)
    sample = pages.join(F.broadcast(chosen), F.col("id") == F.col("chosen_id"), "left_semi").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for html in batch.column("html").to_pylist():
                a, b = Page(html or "").counts()
                inside.update(a)
                outside.update(b)
            names = sorted({*inside, *outside})
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()),
                 pa.array([outside[n] for n in names], pa.int64())], ["feature", "inside", "outside"])

    counts = map_batches(sample, run, "feature string, inside long, outside long").groupBy("feature").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = counts.orderBy("feature").collect()  # of at most max_pages pages
    weights = {}
    for kind in "wcnlkt":
        own = [r for r in rows if r.feature.startswith(kind + ":")]
        a, b = sum(r.inside for r in own) + 1, sum(r.outside for r in own) + 1
        for r in own:
            odds = math.log((r.inside + 0.5) / (a + 1)) - math.log((r.outside + 0.5) / (b + 1))
            limit = model.block_limit if kind in "nl" else model.limit
            odds = max(-limit, min(limit, odds))
            weights[r.feature] = odds if kind != "t" else min(-0.05, odds / model.limit - 0.1)
    return weights


def extract(pages: DataFrame, model: RegionModel = RegionModel(), *, id_col: str = "page_id",
            html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars``. A narrow map after the sample."""
    named = pages.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))
    weights = learn_weights(named.select("id", "html"), model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                texts = [Page(h).text(weights, model) if h else "" for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

    kind = named.schema["id"].dataType.simpleString()
    return map_batches(named, run, f"{id_col} {kind}, url string, text string, n_chars long")
