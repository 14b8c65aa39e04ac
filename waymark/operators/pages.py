"""Page jobs: HTML to markdown, markdown to typed page rows.

A page is one row, so every job here works inside the row and needs no shuffle. Texts are taken
whole; ``window`` limits the infobox search for callers that want the article head only.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import article_title, drop_fragment, is_article, is_dull_title, strip, strip_chars
from waymark.functions.values import first_number, let
from waymark.operators.dims import texts

# --- HTML ----------------------------------------------------------------------------------


def _settle(pattern: str, tag: str):
    """Repeat a removal until nothing is left to remove.

    A removal may join the parts of another tag. Each pass removes an opening and a closing tag at least, which bounds
    the number of passes by the length of the text; those after the last removal do nothing.
    """

    def settle(r: Column) -> Column:
        most = (F.length(r) / (2 * len(tag) + 5)).cast("int") + 1

        def once(acc: Column, _i: Column) -> Column:
            more = F.rlike(acc["text"], F.lit(pattern))
            step = F.struct(F.when(more, F.regexp_replace(acc["text"], pattern, "")).otherwise(acc["text"]).alias("text"), (~more).alias("done"))
            return F.when(acc["done"], acc).otherwise(step)

        again = F.aggregate(F.sequence(F.lit(1), most), F.struct(r.alias("text"), F.lit(False).alias("done")), once, lambda acc: acc["text"])
        return F.when(F.rlike(r, F.lit(pattern)), again).otherwise(r)

    return settle


def sanitize_html(html: Column) -> Column:
    """Text-free elements with their content, void elements and comments removed.

    Each element is removed until none is left; one pass settles all but nested ones.
    """
    c = html
    for tag in fixed.DROPPED_ELEMENTS:
        pattern = rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"
        c = let(F.regexp_replace(c, pattern, ""), _settle(pattern, tag))
    for tag in fixed.VOID_ELEMENTS:
        c = F.regexp_replace(c, rf"(?i)<{tag}(?:\s[^>]*)?/?>", "")
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def sanitize_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", sanitize_html(F.col("html")))


#: Pages that cross to Python at a time.
PAGES_PER_BATCH = 500


class _Markdown(HTMLParser):
    """Headings, links, bold, lists, images and tables of one page as markdown text."""

    BLOCKS = {"p", "div", "article", "section", "header", "footer", "nav", "ul", "ol", "table", "blockquote"}
    HIDDEN = {"script", "style", "noscript", "head"}

    def __init__(self, images: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.images = images
        self.hidden = 0
        self.link: list[str | None] = []
        self.row: list[str] = []
        self.first_row = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.out.append("\n\n")
            self.first_row = tag == "table"
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag == "a":
            self.link.append(named.get("href"))
            self.out.append("[")
        elif tag == "tr":
            self.out.append("\n|")
            self.row = []
        elif tag in ("td", "th"):
            self.row.append(tag)
            self.out.append(" ")
        elif tag == "img" and self.images:
            self.out.append(f"![{named.get('alt') or ''}]({named.get('src') or ''})")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS or (tag[0] == "h" and tag[1:].isdigit()):
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a" and self.link:
            self.out.append(f"]({self.link.pop() or ''})")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag == "tr" and self.first_row:
            self.out.append("\n|" + " --- |" * len(self.row))
            self.first_row = False

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(" ".join(data.split("\n")))

    def text(self) -> str:
        lines = [line.strip() for line in "".join(self.out).split("\n")]
        kept = [x for i, x in enumerate(lines) if x or (i and lines[i - 1])]
        return "\n".join(kept).strip()


def _to_markdown(html: str | None, images: bool) -> str:
    parser = _Markdown(images)
    parser.feed(html or "")
    parser.close()
    return parser.text()


def pages_to_markdown(pages: DataFrame, header: bool = False, max_chars: int | None = None) -> DataFrame:
    """Adds ``markdown``. Needs a parser, so it runs as Arrow batches; filter rows before it.

    Plain form: sanitised HTML, images kept, a fixed text when nothing readable is left.
    ``header`` form: images dropped, and title and language-edition count of the row put in
    front. ``max_chars`` cuts a long text and marks the cut.
    """
    # whole pages cross to Python a few at a time, so that a worker's memory doesn't grow with the table
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAGES_PER_BATCH))
    source = pages if header else sanitize_pages(pages)
    carried = ["page_id", "title", "language_editions"] if header else ["page_id"]
    kinds = dict(pages.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in carried], "markdown string"])

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[carried].assign(markdown=[_to_markdown(h, images=not header) for h in b["html"]])

    md = source.select(*carried, "html").mapInPandas(convert, schema)
    text = F.col("markdown")
    if header:
        text = F.concat(
            F.lit("# "), F.col("title"), F.lit("\n\n**Language editions:** "),
            F.coalesce("language_editions", F.lit(0)).cast("string"), F.lit("\n\n"), text,
        )
    else:
        text = F.when(text == "", fixed.EMPTY_MARKDOWN).otherwise(text)
    if max_chars is not None:
        text = let(text, lambda t: F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit("\n\n... [truncated]"))).otherwise(t))
    return md.select("page_id", text.alias("markdown"))


# --- markdown ------------------------------------------------------------------------------


def article_body(markdown: Column) -> Column:
    """Text after the site marker, else from the first title heading, else everything."""
    at = F.locate(fixed.CHROME_END, markdown)
    after = F.substr(markdown, at + len(fixed.CHROME_END))
    first = F.regexp_substr(markdown, F.lit(r"(?md)^# .+$[\s\S]*"))
    return F.when(at > 0, after).otherwise(F.coalesce(first, markdown))


def _first_by_key(rows: Column, key: str) -> Column:
    """Rows of an array with the first occurrence (by position) of each key, in position order."""
    keyed = F.array_sort(F.transform(rows, lambda r, i: F.struct(r[key].alias("k"), i.alias("i"), r.alias("r"))))

    def keep_first(s: Column) -> Column:
        firsts = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"]))
        placed = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r"))))
        return F.transform(placed, lambda x: x["r"])

    return let(keyed, keep_first)


def _pairs(text: Column, pattern: str) -> Column:
    """Groups 1 and 2 of all matches, as an array of structs."""
    a, b = (F.regexp_extract_all(text, F.lit(pattern), g) for g in (1, 2))
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("key"), y.alias("value")))


def _fields(pairs: Column, strip_key) -> Column:
    """Trimmed, non-empty key-value pairs; coordinates hidden in the key become the value."""

    def clean(p: Column) -> Column:
        key, value = strip_key(p["key"]), strip(p["value"])
        hides = F.contains(key, F.lit("geohack.toolforge.org")) | F.rlike(key, F.lit(r"\d+°\d+[′']\d+[″\"]"))
        pair = r"(-?\d+\.\d+)[;,]\s*(-?\d+\.\d+)"
        moved = hides & F.rlike(key, F.lit(pair))
        coords = F.concat(F.regexp_extract(key, pair, 1), F.lit(", "), F.regexp_extract(key, pair, 2))
        label = strip(F.substring_index(key, ":", 1))
        return F.struct(
            F.when(moved, label).otherwise(key).alias("key"),
            F.when(moved, coords).otherwise(value).alias("value"),
            ((key != "") & (value != "")).alias("filled"),
        )

    def usable(f: Column) -> Column:
        return f["filled"] & (strip(strip_chars(strip(f["value"]), "|")) != "")

    return F.filter(F.transform(pairs, clean), usable)


def infobox(markdown: Column, window: int | None = None) -> Column:
    """Infobox fields as an array of (key, value, numeric_value).

    Table rows come before bold pairs; of equal lower-case keys the first one stays.
    """

    def read(article: Column) -> Column:
        text = article if window is None else F.substring(article, 1, window)
        table = F.filter(
            _fields(_pairs(text, fixed.TABLE_ROW), lambda k: strip(strip_chars(strip(k), "*"))),
            lambda f: ~F.startswith(f["key"], F.lit("---")),
        )
        bold = _fields(_pairs(text, fixed.BOLD_PAIR), strip)
        rows = F.transform(F.concat(table, bold), lambda f: F.struct(F.lower(f["key"]).alias("low"), f["key"].alias("key"), f["value"].alias("value")))
        return F.transform(
            _first_by_key(rows, "low"),
            lambda f: F.struct(f["key"].alias("key"), f["value"].alias("value"), first_number(f["value"]).alias("numeric_value")),
        )

    return let(article_body(markdown), read)


def links(markdown: Column) -> Column:
    """Article links as an array of (text, target_title, target_url, section), first one per URL."""
    parts = F.split(markdown, r"(?Umd)(?=^#{1,6}\s+.)")

    def of_part(p: Column) -> Column:
        section = F.nullif(strip(F.regexp_extract(p, r"(?Ud)\A#{1,6}\s+(.+)", 1)), F.lit(""))

        def row(m: Column) -> Column:
            url = drop_fragment(F.concat(F.lit(fixed.SITE), m["value"]))
            return F.struct(strip(m["key"]).alias("text"), url.alias("target_url"), section.alias("section"))

        return F.transform(_pairs(p, fixed.MARKDOWN_LINK), row)

    found = F.filter(F.flatten(F.transform(parts, of_part)), lambda l: is_article(l["target_url"]))
    titled = F.transform(
        _first_by_key(found, "target_url"),
        lambda l: F.struct(l["text"].alias("text"), article_title(l["target_url"]).alias("target_title"), l["target_url"].alias("target_url"), l["section"].alias("section")),
    )
    return F.filter(titled, lambda l: ~is_dull_title(l["target_title"]))


def sections(markdown: Column) -> Column:
    """Section headings in order."""
    return F.transform(F.regexp_extract_all(markdown, F.lit(fixed.HEADING), 1), strip)


def lead_paragraph(markdown: Column, max_chars: int = 2000) -> Column:
    """First substantial paragraph."""

    def skipped(line: Column) -> Column:
        parts = F.exists(texts(fixed.BOILERPLATE_PARTS), lambda p: F.contains(line, p))
        return (
            F.rlike(line, F.lit(r"^(#|\||!\[|---|\* \[|- \[)"))
            | F.lower(line).isin(fixed.BOILERPLATE_LINES)
            | parts
            | ((F.length(line) < 20) & ~F.startswith(line, F.lit("**")))
        )

    def from_start(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda l: ~skipped(l)), True)
        return F.when(start > 0, F.slice(lines, start.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))

    def to_end(lines: Column) -> Column:
        end = F.array_position(F.transform(lines, lambda l: (l == "") | F.startswith(l, F.lit("#"))), True)
        kept = F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)
        return F.substring(F.array_join(kept, " "), 1, max_chars)

    lines = F.transform(F.split(article_body(markdown), "\n"), strip)
    return let(let(lines, from_start), to_end)


def build_page_info(pages: DataFrame, pageviews: DataFrame | None = None, window: int | None = None) -> DataFrame:
    """Page rows from ``pages(url, markdown)`` and optional ``pageviews(title, pageviews)``."""
    md = F.col("markdown")
    info = pages.select(
        "url",
        article_title(F.col("url")).alias("title"),
        infobox(md, window).alias("infobox"),
        links(md).alias("outgoing_links"),
        sections(md).alias("sections"),
        lead_paragraph(md).alias("first_paragraph"),
        F.length(md).alias("page_length"),
        md.alias("raw_markdown"),
    )
    if pageviews is None:
        return info.withColumn("pageviews", F.lit(None).cast("bigint"))
    return info.join(pageviews.select("title", "pageviews"), "title", "left")


def link_table(page_info: DataFrame) -> DataFrame:
    """Edge list of page rows: (url, pos, text, target_title, target_url, section)."""
    # the outer form keeps Spark from working the array out a second time, for a filter on its size
    return page_info.select("url", F.posexplode_outer("outgoing_links").alias("pos", "l")).where("pos IS NOT NULL").select("url", "pos", "l.*")


def monthly_pageviews(daily: DataFrame, today: Column | None = None) -> DataFrame:
    """Views per title since the first of the month of ``today``: ``daily(title, day, views)``."""
    now = F.current_date() if today is None else today
    start = F.trunc(now, "month")
    recent = daily.where((F.col("day") >= start) & (F.col("day") <= now))
    return recent.groupBy("title").agg(F.sum("views").alias("pageviews"))
