"""Main text of web pages by tag-path ratios.

A page is a sequence of text nodes, each below a root-to-leaf path of tags. Per path the number of text characters and of punctuation marks
is set against the number of nodes (links count against it); paths are smoothed over the paths before and after them by how alike
they are, both ratios are fused, and nodes on paths above a share of the page's own mean are content. What the markup itself says is part of
the path: text inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never
counts. Where a page marks an article, the share of the page's text inside of it is a weight on the fused ratio: the more of the text it holds, the
more counts a path inside and the less one outside. The threshold selects the paths on every page.

A page is one row and is worked on in its task; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav"
    " ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never content.
OUTSIDE = frozenset("head script style noscript template nav header footer aside form button select textarea input iframe object svg canvas audio video dialog menu label datalist title".split())
#: Words of class, id and role that mark an element as no content.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side aside widget related recommended"
    " footer header masthead topbar toolbar notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login share sharing social comment comments comment-list reply replies"
    " discussion disqus respond form search searchbox toc skip complementary contentinfo search disclaimer copyright legal".split()
)
#: Starts of such words.
STEMS = ("comment", "advert", "sidebar", "cookie", "newsletter", "sponsor", "breadcrumb", "pagination", "subscri")
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What holds an article's own text besides headings.
OWN = frozenset(("section", "p", "article", "main"))
#: Elements that an opening tag closes when it meets them open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "title", "legend"}
RAW = frozenset(("script", "style", "textarea", "title"))
#: Comment or declaration, end tag, start tag with attributes; last a tag with an open quote, and what is cut off at the end.
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|/([a-zA-Z][^\s/>]*)[^>]*>|([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|/?[a-zA-Z][^>]*(?:>|\Z)|[!?/][^>]*\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_ARTICLE = re.compile(r"""\b(?:role\s*=\s*["']?(?:main|article)|itemprop\s*=\s*["']?articleBody)\b""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PUNCT = re.compile(r"[.,;:!?。，；：！？、…]")
#: A path's ratio against the page's mean from which it is content, and the reach of the smoothing.
SHARE, REACH = 0.5, 2
#: What an article that holds all text adds to the weight of its paths.
FAVOUR = 3.0


@dataclass
class Block:
    path: tuple[str, ...]
    article: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def marked(tag: str, attrs: str, article: bool = False) -> bool:
    """Do class, id, role or style of a tag say that it holds no content?

    Ids are often made from the words of a heading, so they count as a whole only, and not on headings or on sections of an article. Parts
    of class names count, but not on headings or on what else holds an article's own text.
    """
    own = tag in HEADINGS or article and tag in OWN
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), unescape("".join(values))
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
            return True
        if name in ("class", "id", "role") and not (name == "id" and own):
            for word in _CAMEL.sub(r"\1-\2", value).lower().split():
                parts = re.split(r"[-_]+", word)
                if word in MARKS:
                    return True
                if name == "class" and not own and parts[0] not in ("has", "no", "with", "without") and (not MARKS.isdisjoint(parts) or any(x.startswith(STEMS) and not x.startswith("commentar") for x in parts)):
                    return True
    return False


class Page:
    """Blocks of a page in order. Tags may be left open or closed twice."""

    def __init__(self, html: str) -> None:
        #: Open elements: tag, outside of the content, inside of an article.
        self.open: list[tuple[str, bool, bool]] = []
        self.blocks: list[Block] = []
        self.fresh = True
        at = 0
        while m := _TAG.search(html, at):
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if m[1]:
                self.close(m[1].lower())
            elif m[2]:
                tag = m[2].lower()
                self.start(tag, m[3] or "")
                if tag in RAW:
                    end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                    at = end.start() if end else len(html)
        if at < len(html):
            self.text(html[at:])

    def start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P and any(t == "p" for t, _, _ in self.open):
            self.pop("p", CLOSES_P - {"p"})
        for other in CLOSES.get(tag, ()):
            self.pop(other, {"ul", "ol", "dl", "table", "select"})
        if tag == "br":
            self.text("\n")
        if tag in BLOCKS:
            self.fresh = True
        if tag in VOID:
            return
        outside, article = self.open[-1][1:] if self.open else (False, False)
        if tag in OUTSIDE or attrs and tag not in ("body", "html") and marked(tag, attrs, article):
            outside = True
        elif not outside and (tag in ARTICLE or attrs and _ARTICLE.search(attrs)):
            article = True
        self.open.append((tag, outside, article))

    def pop(self, tag: str, until: set[str] | frozenset[str] = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in until:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.fresh = True
            self.pop(tag)
        elif tag not in VOID:
            self.pop(tag, BLOCKS)

    def text(self, data: str) -> None:
        outside, article = self.open[-1][1:] if self.open else (False, False)
        if outside:
            return
        if self.fresh or not self.blocks:
            path = [t for t, _, _ in self.open]
            while path and path[-1] not in BLOCKS:
                path.pop()
            self.blocks.append(Block(tuple(path), article))
            self.fresh = False
        block = self.blocks[-1]
        block.parts.append(unescape(data) if "&" in data else data)
        if any(t == "a" for t, _, _ in self.open):
            block.linked += len(data.strip())


def alike(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of the longer path that both have from the root on."""
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return same / max(len(a), len(b), 1)


def content(blocks: list[Block]) -> list[str]:
    """Texts of the blocks on content paths."""
    found = [(b, t) for b in blocks if (t := b.text())]
    paths: dict[tuple[tuple[str, ...], bool], list[float]] = {}
    for b, t in found:
        sums = paths.setdefault((b.path, b.article), [0, 0, 0])
        sums[0] += max(0, len(t) - b.linked)
        sums[1] += len(_PUNCT.findall(t))
        sums[2] += 1
    if not paths:
        return []
    keys = list(paths)
    raw = np.array([(c / n, p / n) for c, p, n in paths.values()])
    smooth = np.empty_like(raw)
    for k, key in enumerate(keys):
        near = range(max(0, k - REACH), min(len(keys), k + REACH + 1))
        weight = np.array([alike(key[0], keys[i][0]) ** 2 * np.exp(-abs(i - k)) for i in near]) + 1e-9
        smooth[k] = weight @ raw[list(near)] / weight.sum()
    fused = np.sqrt(smooth[:, 0] * (1 + smooth[:, 1]))
    least = SHARE * fused.mean()
    inside = sum(paths[key][0] for key in keys if key[1]) / max(1, sum(c for c, _, _ in paths.values()))
    weight = [1 + FAVOUR * inside if key[1] else 1 - inside for key in keys]
    kept = {key for key, value, w in zip(keys, fused, weight, strict=True) if w * value >= least and paths[key][0] > 0}
    out: list[str] = []
    follows = False
    for b, t in reversed(found):  # a heading goes with what stands below it
        heads = bool(b.path) and b.path[-1] in HEADINGS and b.linked < len(t)
        follows = (b.path, b.article) in kept or heads and follows
        if follows:
            out.append(t)
    return out[::-1]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(content(Page(html).blocks))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, text (empty if there is none), n_chars (code points) of each row; a null or empty html has the empty text.

    Pages are read whole; repeated rows and null keys stay as they are; other columns aren't read; an empty table stays empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch.pop("html")]
            yield batch.assign(text=texts, n_chars=[len(t) for t in texts])

    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = small_batches(rows).mapInPandas(run, f"key {kinds[key]}, url string, text string, n_chars long")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
