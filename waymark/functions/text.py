"""Text and URL column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import fixed


def strip(c: Column) -> Column:
    """Cut all leading and trailing white space (``trim`` only cuts blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Cut the given characters from both ends."""
    return F.btrim(c, F.lit(chars))


def words(c: Column) -> Column:
    """Words of a text, split at any white space, without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def unquote(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and keeps undecodable text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def article_title(url: Column) -> Column:
    """Title of an article URL; other URLs are their own title."""
    path = url_path(url)
    name = F.substring(path, len("/wiki/") + 1, 2**30)
    return F.when(F.startswith(path, F.lit("/wiki/")), F.replace(unquote(name), F.lit("_"), F.lit(" "))).otherwise(url)


def tail_title(url: Column) -> Column:
    """Text after the last ``/wiki/``, for leak checks; empty when there is none."""
    raw = F.element_at(F.split(url, "/wiki/"), -1)
    return F.when(F.contains(url, F.lit("/wiki/")), unquote(F.replace(raw, F.lit("_"), F.lit(" ")))).otherwise(F.lit(""))


def drop_fragment(url: Column) -> Column:
    """URL up to the first ``#`` (an empty fragment is left as it is)."""
    return F.when(F.rlike(url, F.lit(r"#.")), F.regexp_replace(url, r"(?s)#.*$", "")).otherwise(url)


def is_article(url: Column) -> Column:
    """English article URL outside the administrative namespaces."""
    title = F.substring(url, len(fixed.ARTICLE_PREFIX) + 1, 2**30)
    namespace = F.rlike(title, F.lit("^(" + "|".join(fixed.EXCLUDED_NAMESPACES) + ")"))
    return F.startswith(url, F.lit(fixed.ARTICLE_PREFIX)) & ~namespace


def is_dull_title(title: Column) -> Column:
    """Years, centuries, list and index pages."""
    return F.rlike(F.replace(title, F.lit(" "), F.lit("_")), F.lit(fixed.DULL_TITLE))


def visit_url(url: Column) -> Column:
    """Form of a URL used to compare visited pages: final slashes, mobile host, query, fragment."""
    u = F.regexp_replace(url, "/+$", "")
    u = F.replace(u, F.lit("://en.m.wikipedia"), F.lit("://en.wikipedia"))
    return F.regexp_extract(u, r"(?s)^([^?#]*)", 1)


def clean_markdown(c: Column) -> Column:
    """Citation links and marks out, links to their text, no leading bullet or outer pipes."""
    c = F.regexp_replace(c, r"\[\[\d+\]\]\(#cite_note[^)]*\)", "")
    c = F.regexp_replace(c, r"\[(?:\d+|note \d+)\]", "")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(?U)^\s*[*\-•]\s+", "")
    return strip(strip_chars(strip(c), "|"))


def drop_citations(c: Column) -> Column:
    """Citation marks out of a value or argument."""
    c = F.regexp_replace(c, r"\[\[\d+\]\]\(#cite_note[^)]*\)", "")
    return strip(F.regexp_replace(c, r"\[(?:\d+|note \d+)\]", ""))


def has_citation(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"\[\[\d+\]\]\(#cite_note|\[\d+\]|\[note \d+\]")), F.lit(False))


def drop_final_parenthesis(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s*\([^)]+\)\s*$", ""))


def is_specific_title(title: Column) -> Column:
    """At least six characters and not made of common words only."""
    common = F.array(*[F.lit(w) for w in fixed.COMMON_WORDS])
    return (F.length(title) >= 6) & (F.size(F.array_except(words(F.lower(title)), common)) > 0)


def unfence(c: Column) -> Column:
    """Text of a model reply without code-fence lines."""
    def lines(t: Column) -> Column:
        kept = F.array_join(F.filter(F.split(t, "\n"), lambda l: ~F.rlike(l, F.lit(r"(?U)^\s*```"))), "\n")
        return F.when(F.startswith(t, F.lit("```")), kept).otherwise(t)

    # stripped once
    return F.get(F.transform(F.array(strip(c)), lines), 0)
