"""Jobs over the page link graph: ``links(url, pos, text, target_url, section)`` and ``pages(url, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.skew import first_per_key, shuffled
from waymark.functions.text import article_title, drop_fragment, is_article, is_dull_title
from waymark.session import written


def normalize_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URL, article title and whether it is an article."""
    canonical = drop_fragment(F.col(url))
    return df.withColumn("canonical", canonical).withColumn("title", article_title(canonical)).withColumn("is_article", is_article(canonical))


def followable(links: DataFrame) -> DataFrame:
    """Links a crawl follows: articles outside navigation sections, no generic or dull titles."""
    url = drop_fragment(F.col("target_url"))
    title = article_title(url)
    section = F.lower(F.coalesce("section", F.lit("")))
    keep = is_article(url) & ~section.isin(fixed.NAVIGATION_SECTIONS) & ~title.isin(fixed.GENERIC_TITLES) & ~is_dull_title(title)
    return links.withColumn("target_url", url).where(keep).select("url", "pos", "target_url")


def crawl(links: DataFrame, pages: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int = 50) -> DataFrame:
    """Breadth-first crawl of many seeds at once: ``seeds(graph_id, url)``.

    ``pages(url, cached)`` lists the pages that can be read; only pages that are not cached count
    against ``max_pages``, and a missing page costs nothing. Visit order is first-in first-out, which
    is the order of (level, path), where the path holds the link positions from the seed; so no
    global numbering is needed. One loop round per level, cut by a write to the shared folder.

    Returns (graph_id, url, depth, path, fetched).
    """
    # read on every level: worked out once
    edges = written(followable(links), "edges")
    pages = written(pages.select("url", "cached"), "pages")
    seed = seeds.select("graph_id", drop_fragment(F.col("url")).alias("url"), F.array(F.lit(0)).alias("path"))
    frontier = written(first_per_key(seed, ["graph_id", "url"], [F.col("path")]), "frontier")
    visited = frontier.select("graph_id", "url")
    budget = frontier.select("graph_id").distinct().withColumn("left", F.lit(max_pages))
    done: list[DataFrame] = []
    for depth in range(max_depth + 1):
        known = frontier.join(shuffled(pages), "url")
        fresh = first_per_key(known.where("NOT cached"), ["graph_id"], [F.col("path")], max_pages)
        # the last page the budget pays for closes the level; paths after it are not reached
        spent = (
            fresh.join(shuffled(budget), "graph_id")
            .groupBy("graph_id", "left")
            .agg(F.array_sort(F.collect_list("path")).alias("paths"))
            .select("graph_id", F.get("paths", F.col("left") - 1).alias("last"), F.least(F.size("paths"), "left").alias("used"))
        )
        reached = known.join(shuffled(budget), "graph_id").where("left > 0").join(shuffled(spent), "graph_id", "left")
        level = reached.where(F.col("last").isNull() | (F.col("path") <= F.col("last"))).select(
            "graph_id", "url", F.lit(depth).alias("depth"), "path", (~F.col("cached")).alias("fetched")
        )
        level = written(level, "level")
        done.append(level)
        if depth == max_depth:
            break
        left = (F.col("left") - F.coalesce("used", F.lit(0))).cast("int").alias("left")
        budget = written(budget.join(shuffled(spent), "graph_id", "left").select("graph_id", left), "budget")
        sighted = (
            level.select("graph_id", "url", "path")
            .join(shuffled(edges), "url")
            .groupBy("graph_id", F.col("target_url").alias("url"))
            .agg(F.min(F.array_append("path", F.col("pos").cast("int"))).alias("path"))
        )
        frontier = written(sighted.join(shuffled(visited), ["graph_id", "url"], "left_anti").select("graph_id", "url", "path"), "frontier")
        visited = visited.unionByName(frontier.select("graph_id", "url"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def neighbors(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose target is a known page, in link order."""
    return links.join(pages.select(F.col("url").alias("target_url")), "target_url", "left_semi").select("url", "pos", "target_url")


def obscurity(pageviews: Column, page_length: Column) -> Column:
    """0 = very famous, 1 = very obscure; by page views, else by page length."""

    def scaled(x: Column, top: float) -> Column:
        score = 1.0 - F.least(F.lit(1.0), F.log10(F.greatest(x, F.lit(1))) / top)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))

    by_views = F.when(pageviews <= 0, 1.0).otherwise(scaled(pageviews, 6.0))
    by_length = F.when(page_length > 0, scaled(page_length, 5.5)).otherwise(0.5)
    return F.when(pageviews.isNotNull(), by_views).otherwise(by_length)


def with_obscurity(pages: DataFrame) -> DataFrame:
    return pages.withColumn("obscurity", obscurity(F.col("pageviews"), F.col("page_length")))


def with_infobox_only(pages: DataFrame) -> DataFrame:
    return pages.where(F.size("infobox") > 0)


def link_texts(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Anchor text of the first link between two pages: ``pairs(src, dst)``."""
    first = links.groupBy(F.col("url").alias("src"), F.col("target_url").alias("dst")).agg(F.min_by("text", "pos").alias("link_text"))
    return pairs.join(shuffled(first), ["src", "dst"], "left")


def page_summaries(pages: DataFrame, chars: int = 300) -> DataFrame:
    return pages.select("url", "title", F.substring("first_paragraph", 1, chars).alias("summary"))


def top_pages(pages: DataFrame, used: DataFrame, k: int = 200) -> DataFrame:
    """First ``k`` unused pages by (has an infobox, number of links), ties by position ``pos``.

    A report over the whole table; the limit is a distributed top-k.
    """
    rank = [F.col("has_infobox").desc(), F.col("n_links").desc(), F.col("pos")]
    return pages.join(used.select("url").distinct(), "url", "left_anti").orderBy(*rank).limit(k)


def used_pages(stops: DataFrame) -> DataFrame:
    return stops.where("page_url <> ''").select(F.col("page_url").alias("url")).distinct()


def links_in_values(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Links of a page whose anchor text occurs in a fact's value, any case.

    The join is on the page; a fact keeps its links as rows.
    """
    l = links.select("url", "pos", "target_url", F.lower("text").alias("low"))
    return facts.join(shuffled(l), "url").where(F.contains(F.lower("value"), F.col("low"))).drop("low")
