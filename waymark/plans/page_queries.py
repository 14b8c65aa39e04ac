"""Queries over pages, link graphs, gates and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.skew import join_counted, spread
from waymark.operators import facts, graph, pages, quality
from waymark.plans import views
from waymark.plans.registry import query
from waymark.session import written

P = "https://en.wikipedia.org/wiki/"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _strip_tags(expr: str) -> str:
    for _ in range(2):
        for t in fixed.DROPPED_ELEMENTS:
            expr = f"regexp_replace({expr}, '<{t}(?:\\s[^>]*)?>.*?</{t}\\s*>', '', 'gis')"
    for t in fixed.VOID_ELEMENTS:
        expr = f"regexp_replace({expr}, '<{t}(?:\\s[^>]*)?/?>', '', 'gi')"
    return f"regexp_replace({expr}, '<!--.*?-->', '', 'gs')"


@query("clean_html", f"SELECT page_id, md5({_strip_tags('html')}) AS html_md5, length({_strip_tags('html')}) AS n_chars FROM pages")
def clean_html(spark, sf):
    cleaned = pages.sanitize_pages(views.load(spark, sf, "pages"))
    return cleaned.select("page_id", F.md5("html").alias("html_md5"), F.length("html").cast("bigint").alias("n_chars"))


@query("page_markdown")
def page_markdown(spark, sf):
    md = pages.pages_to_markdown(views.load(spark, sf, "pages"))
    return md.select("page_id", "markdown", F.size(pages.sections(F.col("markdown"))).alias("n_sections"), pages.lead_paragraph(F.col("markdown")).alias("lead"))


@query("page_markdown_header")
def page_markdown_header(spark, sf):
    p = views.load(spark, sf, "pages").withColumn("title", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).withColumn("language_editions", F.lit(0))
    md = pages.pages_to_markdown(p, header=True, max_chars=100_000)
    return md.select("page_id", "markdown")


def _known_pages(spark, sf):
    """Pages whose markdown is known: headings, paragraphs, links, lists, tables, images, entities, hidden parts."""
    p = spread(views.load(spark, sf, "part"), "p_partkey")
    k = F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit("<html><head><title>x</title></head><body><script>var a = 1;</script><h1>Part "), k, F.lit("</h1><p>A <b>"), F.col("p_name"), F.lit("</b> &amp; more,<br>by <a href=\"/wiki/Part_"), k,
        F.lit("\">Part "), k, F.lit("</a>.</p><h2>List</h2><ul><li>one</li><li>two "), k, F.lit("</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>"), F.col("p_brand"),
        F.lit("</td></tr></table><!-- gone --><p>End <img src=\"i.png\" alt=\"pic\"></p></body></html>"),
    )
    return p.select(F.col("p_partkey").alias("page_id"), html.alias("html"), F.concat(F.lit("Part "), k).alias("title"), (F.col("p_partkey") % 5).alias("language_editions"))


_KNOWN_BODY = """concat('# Part ', k, chr(10), chr(10), 'A **', p_name, '** & more,', chr(10), 'by [Part ', k, '](/wiki/Part_', k, ').', chr(10), chr(10), '## List', chr(10), chr(10), '* one', chr(10), '* two ', k,
  chr(10), chr(10), '| a | b |', chr(10), '| --- | --- |', chr(10), '| 1 | ', p_brand, ' |', chr(10), chr(10), 'End{0}')"""


@query("markdown_known", f"WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k FROM part) SELECT p_partkey AS page_id, {_KNOWN_BODY.format(' ![pic](i.png)')} AS markdown FROM p")
def markdown_known(spark, sf):
    return pages.pages_to_markdown(_known_pages(spark, sf))


@query("markdown_header_known", f"""WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k FROM part)
SELECT p_partkey AS page_id, concat('# Part ', k, chr(10), chr(10), '**Language editions:** ', p_partkey % 5, chr(10), chr(10), {_KNOWN_BODY.format('')}) AS markdown FROM p""")
def markdown_header_known(spark, sf):
    return pages.pages_to_markdown(_known_pages(spark, sf), header=True)


@query("normal_urls", """SELECT page_id, CASE WHEN contains(url, '#') THEN split_part(url, '#', 1) ELSE url END AS canonical,
  CASE WHEN contains(url, '#') THEN split_part(url, '#', 1) ELSE url END AS title, starts_with(url, 'https://en.wikipedia.org/wiki/') AS is_article FROM pages""")
def normal_urls(spark, sf):
    return graph.normalize_urls(views.load(spark, sf, "pages")).select("page_id", "canonical", "title", "is_article")


@query("article_titles", """SELECT k, 'https://en.wikipedia.org/wiki/Caf%C3%A9_' || k || '+_(x)' AS canonical, 'Café ' || k || '+ (x)' AS title, true AS is_article FROM wiki_v
UNION ALL SELECT k, 'https://en.wikipedia.org/wiki/File:' || k, 'File:' || k, false FROM wiki_v""")
def article_titles(spark, sf):
    k = F.col("k").cast("string")
    urls = F.array(F.concat(F.lit(P + "Caf%C3%A9_"), k, F.lit("+_(x)#part")), F.concat(F.lit(P + "File:"), k))
    w = views.wiki(spark, sf).select("k", F.explode(urls).alias("url"))
    return graph.normalize_urls(w).select("k", "canonical", "title", "is_article")


_INFO = """
box_q AS (
  SELECT k, 0 AS pos, 'Country' AS key, concat('[Nation ', k % 25, '](/wiki/Nation_', k % 25, ')') AS val, (k % 25)::DOUBLE AS num FROM wiki_v
  UNION ALL SELECT k, 1, 'Population', concat(p_size, ',', 100 + k % 900, ' people'), (p_size * 1000 + 100 + k % 900)::DOUBLE FROM wiki_v JOIN part ON p_partkey = k
  UNION ALL SELECT k, 2, 'Coordinates', '12.5, -3.25', 12.5 FROM wiki_v
  UNION ALL SELECT k, 3, 'Traded as', concat('NYSE: AB', chr((65 + k % 26)::INT)), NULL FROM wiki_v WHERE k % 4 = 0
  UNION ALL SELECT k, 3, 'Location', concat('Old Harbour ', k % 7, ', Far Land'), (k % 7)::DOUBLE FROM wiki_v WHERE k % 4 = 1
  UNION ALL SELECT k, 4, 'Founded', CAST(1800 + k % 230 AS VARCHAR), (1800 + k % 230)::DOUBLE FROM wiki_v
  UNION ALL SELECT k, 5, concat('part ', k), concat('is a ', p_name, ' near [Part ', k // 3, '](/wiki/Part_', k // 3, ') and [Part b (tool)](/wiki/Part_b_(tool)).'), (k // 3)::DOUBLE
    FROM wiki_v JOIN part ON p_partkey = k),
raw_links_q AS (
  SELECT k, 0 AS pos, concat('Nation ', k % 25) AS text, concat('Nation_', k % 25) AS name, concat('Part ', k) AS section FROM wiki_v
  UNION ALL SELECT k, 1, concat('Part ', k // 3), concat('Part_', k // 3), 'Overview' FROM wiki_v
  UNION ALL SELECT k, 2, 'Part b (tool)', 'Part_b_(tool)', 'Overview' FROM wiki_v
  UNION ALL SELECT k, 3, 'next', concat('Part_', k + 1), 'Overview' FROM wiki_v
  UNION ALL SELECT k, 4, 'Part c', concat('Part_', k // 5), 'See also' FROM wiki_v),
wlinks_q AS (SELECT k, concat('https://en.wikipedia.org/wiki/Part_', k) AS url, concat('https://en.wikipedia.org/wiki/', name) AS target_url, replace(name, '_', ' ') AS target_title, text, section,
  row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS pos FROM (SELECT * FROM raw_links_q QUALIFY row_number() OVER (PARTITION BY k, name ORDER BY pos) = 1))"""


@query("infobox_fields", f"WITH {_INFO} SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS pos, key, val AS value, num AS numeric_value FROM box_q")
def infobox_fields(spark, sf):
    w = views.wiki(spark, sf).select("k", F.posexplode_outer(pages.infobox(F.col("markdown"))).alias("pos", "f")).where("pos IS NOT NULL")
    return w.select("k", F.col("pos").cast("bigint").alias("pos"), "f.*")


def _links(spark, sf):
    return pages.link_table(views.wiki(spark, sf).select("url", pages.links(F.col("markdown")).alias("outgoing_links")))


@query("page_links", f"WITH {_INFO} SELECT url, pos, target_url, target_title, text, section FROM wlinks_q")
def page_links(spark, sf):
    return _links(spark, sf).withColumn("pos", F.col("pos").cast("bigint"))


@query("page_sections", "SELECT k, concat('Part ', k, '/Overview/See also') AS headings FROM wiki_v")
def page_sections(spark, sf):
    return views.wiki(spark, sf).select("k", F.array_join(pages.sections(F.col("markdown")), "/").alias("headings"))


@query("page_leads", "SELECT k, concat('**Founded**: ', 1800 + k % 230, ' **Country**: Elsewhere') AS lead FROM wiki_v")
def page_leads(spark, sf):
    return views.wiki(spark, sf).select("k", pages.lead_paragraph(F.col("markdown")).alias("lead"))


@query("article_bodies", "SELECT k, md5(split_part(markdown, 'From Wikipedia, the free encyclopedia', 2)) AS body_md5, md5(substr(split_part(markdown, 'encyclopedia', 2), 2)) AS fallback_md5 FROM wiki_v")
def article_bodies(spark, sf):
    md = F.col("markdown")
    no_chrome = F.replace(md, F.lit(fixed.CHROME_END), F.lit("Some site"))
    return views.wiki(spark, sf).select(
        "k", F.md5(pages.article_body(md)).alias("body_md5"), F.md5(pages.article_body(no_chrome)).alias("fallback_md5")
    )


@query("page_info", f"""WITH {_INFO}, v AS (SELECT part_id AS k, count(*) AS views FROM (SELECT event_id % (SELECT count(*) FROM part) AS part_id FROM events) GROUP BY 1)
SELECT w.url, concat('Part ', w.k) AS title, (SELECT count(*) FROM box_q b WHERE b.k = w.k) AS n_fields, (SELECT count(*) FROM wlinks_q l WHERE l.k = w.k) AS n_links,
  3::BIGINT AS n_sections, length(w.markdown) AS page_length, v.views AS pageviews FROM wiki_v w LEFT JOIN v ON v.k = w.k""")
def page_info(spark, sf):
    n = views.load(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"))
    e = views.load(spark, sf, "events").join(F.broadcast(n)).select(F.concat(F.lit("Part "), F.pmod("event_id", "n").cast("string")).alias("title"))
    v = e.groupBy("title").agg(F.count(F.lit(1)).alias("pageviews"))
    info = pages.build_page_info(views.wiki(spark, sf), v)
    return info.select(
        "url", "title", F.size("infobox").cast("bigint").alias("n_fields"), F.size("outgoing_links").cast("bigint").alias("n_links"),
        F.size("sections").cast("bigint").alias("n_sections"), F.col("page_length").cast("bigint").alias("page_length"), "pageviews",
    )


@query("monthly_views", """SELECT CAST(user_id % 20 AS VARCHAR) AS title, count(*) AS pageviews FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND CAST(ts AS DATE) <= DATE '2024-01-20' GROUP BY 1""")
def monthly_views(spark, sf):
    e = views.load(spark, sf, "events").select(
        F.pmod("user_id", F.lit(20)).cast("string").alias("title"), F.col("ts").cast("date").alias("day"), F.lit(1).alias("views")
    )
    return pages.monthly_pageviews(e, F.lit("2024-01-20").cast("date"))


# --- graph ---------------------------------------------------------------------------------


def _seeds(spark, sf):
    """Every page is the seed of its own graph."""
    return views.wiki(spark, sf).select(F.col("k").alias("graph_id"), "url")


_CRAWL = f"""WITH RECURSIVE {_INFO},
edge_q AS (SELECT l.k, l.pos, replace(replace(target_url, 'https://en.wikipedia.org/wiki/Part_', ''), 'https://en.wikipedia.org/wiki/', '') AS t FROM wlinks_q l WHERE section <> 'See also'),
e_q AS (SELECT k, TRY_CAST(t AS BIGINT) AS t FROM edge_q WHERE TRY_CAST(t AS BIGINT) IS NOT NULL AND TRY_CAST(t AS BIGINT) IN (SELECT k FROM wiki_v)),
crawl_q AS (SELECT k AS graph_id, k, 0 AS depth FROM wiki_v UNION SELECT c.graph_id, e.t, c.depth + 1 FROM crawl_q c JOIN e_q e ON e.k = c.k WHERE c.depth < 3),
level_q AS (SELECT graph_id, k, min(depth) AS depth FROM crawl_q GROUP BY 1, 2)"""


@query("bfs_levels", _CRAWL + " SELECT graph_id, concat('https://en.wikipedia.org/wiki/Part_', k) AS url, depth FROM level_q")
def bfs_levels(spark, sf):
    known = views.wiki(spark, sf).select("url", F.lit(True).alias("cached"))
    return graph.crawl(_links(spark, sf), known, _seeds(spark, sf), max_depth=3).select("graph_id", "url", "depth")


def _budget_sql(depths: int, pages_paid: int) -> str:
    """The crawl level by level: frontier f, budget b, paid paths s, level l, visited v."""
    head = _CRAWL[: _CRAWL.index("\ne_q AS")].replace("WITH RECURSIVE", "WITH")
    parts = [
        "e2_q AS (SELECT k, CAST(pos AS INTEGER) AS pos, TRY_CAST(t AS BIGINT) AS t FROM edge_q WHERE TRY_CAST(t AS BIGINT) IN (SELECT k FROM wiki_v))",
        "f0 AS (SELECT k AS graph_id, k, [0] AS path FROM wiki_v)", "v0 AS (SELECT graph_id, k FROM f0)", f"b0 AS (SELECT k AS graph_id, {pages_paid} AS rest FROM wiki_v)",
    ]
    for d in range(depths + 1):
        parts += [
            f"s{d} AS (SELECT graph_id, list_sort(list(path)) AS paths FROM f{d} WHERE k % 2 <> 0 GROUP BY 1)",
            f"""l{d} AS (SELECT f.graph_id, f.k, {d} AS depth, f.path, f.k % 2 <> 0 AS fetched FROM f{d} f JOIN b{d} b ON b.graph_id = f.graph_id LEFT JOIN s{d} s ON s.graph_id = f.graph_id
              WHERE rest > 0 AND (paths IS NULL OR len(paths) < rest OR f.path <= paths[rest]))""",
            f"b{d + 1} AS (SELECT b.graph_id, rest - least(coalesce(len(paths), 0), rest) AS rest FROM b{d} b LEFT JOIN s{d} s ON s.graph_id = b.graph_id)",
            f"g{d} AS (SELECT l.graph_id, e.t AS k, min(list_append(l.path, e.pos)) AS path FROM l{d} l JOIN e2_q e ON e.k = l.k GROUP BY 1, 2)",
            f"f{d + 1} AS (SELECT g.* FROM g{d} g ANTI JOIN v{d} v ON v.graph_id = g.graph_id AND v.k = g.k)", f"v{d + 1} AS (SELECT * FROM v{d} UNION ALL SELECT graph_id, k FROM f{d + 1})",
        ]
    rows = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depths + 1))
    return f"{head}{', '.join(parts)} SELECT a.graph_id, w.url, a.depth, a.fetched FROM ({rows}) a JOIN wiki_v w ON w.k = a.k"


@query("crawl_budget", _budget_sql(3, 5))
def crawl_budget(spark, sf):
    """Crawl that may read five uncached pages per graph."""
    known = views.wiki(spark, sf).select("url", (F.col("k") % 2 == 0).alias("cached"))
    out = graph.crawl(_links(spark, sf), known, _seeds(spark, sf), max_depth=3, max_pages=5)
    return out.select("graph_id", "url", "depth", "fetched")


@query("neighbors", f"WITH {_INFO} SELECT url, pos, target_url FROM wlinks_q WHERE target_url IN (SELECT url FROM wiki_v)")
def neighbors(spark, sf):
    return graph.neighbors(_links(spark, sf), views.wiki(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


@query("obscurity", """SELECT c_custkey, round(CASE WHEN v IS NOT NULL THEN CASE WHEN v <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - least(1.0, log10(greatest(1, v)) / 6.0))) END
  WHEN len <= 0 THEN 0.5 ELSE greatest(0.0, least(1.0, 1.0 - least(1.0, log10(greatest(1, len)) / 5.5))) END, 9)::DOUBLE AS obscurity
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN CAST(trunc(c_acctbal) AS BIGINT) END AS v, c_custkey % 5000 AS len FROM customer)""")
def obscurity(spark, sf):
    c = views.load(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal").cast("bigint")).alias("pageviews"), (F.col("c_custkey") % 5000).alias("page_length")
    )
    return graph.with_obscurity(c).select("c_custkey", F.round("obscurity", 9).alias("obscurity"))


@query("infobox_pages", "SELECT k FROM wiki_v")
def infobox_pages(spark, sf):
    return graph.with_infobox_only(views.wiki(spark, sf).withColumn("infobox", pages.infobox(F.col("markdown")))).select("k")


@query("link_texts", f"WITH {_INFO} SELECT w.url AS src, concat('https://en.wikipedia.org/wiki/Part_', w.k + 1) AS dst, (SELECT arg_min(text, pos) FROM wlinks_q l WHERE l.k = w.k AND l.target_url = concat('https://en.wikipedia.org/wiki/Part_', w.k + 1)) AS link_text FROM wiki_v w")
def link_texts(spark, sf):
    pairs = views.wiki(spark, sf).select(F.col("url").alias("src"), F.concat(F.lit(P + "Part_"), (F.col("k") + 1).cast("string")).alias("dst"))
    return graph.link_texts(pairs, _links(spark, sf))


@query("page_summaries", "SELECT doc_id AS url, source AS title, substring(text, 1, 300) AS summary FROM documents")
def page_summaries(spark, sf):
    d = views.load(spark, sf, "documents").select(F.col("doc_id").alias("url"), F.col("source").alias("title"), F.col("text").alias("first_paragraph"))
    return graph.page_summaries(d)


_USED = "(SELECT DISTINCT page_url FROM stops_v WHERE page_url IS NOT NULL)"


@query("top_pages", f"""WITH {_INFO} SELECT w.url, n_links, has_infobox, k AS pos FROM (SELECT w.url, w.k, w.k % 3 <> 0 AS has_infobox, (SELECT count(*) FROM wlinks_q l WHERE l.k = w.k) AS n_links FROM wiki_v w) w
WHERE w.url NOT IN (SELECT page_url FROM {_USED}) ORDER BY has_infobox DESC, n_links DESC, k LIMIT 200""")
def top_pages(spark, sf):
    p = views.wiki(spark, sf).select(
        "url", F.size(pages.links(F.col("markdown"))).cast("bigint").alias("n_links"), (F.col("k") % 3 != 0).alias("has_infobox"), F.col("k").alias("pos")
    )
    return graph.top_pages(p, graph.used_pages(views.stops(spark, sf)))


@query("used_pages", f"SELECT page_url AS url FROM {_USED}")
def used_pages(spark, sf):
    return graph.used_pages(views.stops(spark, sf))


@query("links_in_values", f"""WITH {_INFO} SELECT b.k, b.key, l.pos, l.target_url FROM box_q b JOIN wlinks_q l ON l.k = b.k WHERE contains(lower(b.val), lower(l.text))""")
def links_in_values(spark, sf):
    box = views.wiki(spark, sf).select("k", "url", F.posexplode_outer(pages.infobox(F.col("markdown"))).alias("i", "f")).where("i IS NOT NULL").select("k", "url", F.col("f.key").alias("key"), F.col("f.value").alias("value"))
    return graph.links_in_values(box, _links(spark, sf)).select("k", "key", F.col("pos").cast("bigint").alias("pos"), "target_url")


# --- gates ---------------------------------------------------------------------------------

_TITLES = ["Lake 5", "List of x", "1987", "Song (album)", "ab", "ISO 9001", "Foo (TV series)", "History of it", "12", "Draft:x", "My list of x", "Quiet Town"]
_BAD = [False, True, True, True, True, True, True, True, True, True, False, False]


def _pick(values, col):
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(col, F.lit(len(values))).cast("int"))


@query("bad_titles", f"SELECT doc_id, {sql_list(_TITLES)}[doc_id % 12 + 1] AS title, [{', '.join(map(str, _BAD)).lower()}][doc_id % 12 + 1] AS bad FROM documents")
def bad_titles(spark, sf):
    d = views.load(spark, sf, "documents").select("doc_id", _pick(_TITLES, F.col("doc_id")).alias("title"))
    return d.withColumn("bad", quality.is_bad_title(F.col("title")))


_ENGLISH = "(CASE WHEN length({0}) < 50 THEN true ELSE length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')) / length({0}) >= 0.7 END)"


@query("english_test", f"SELECT doc_id, {_ENGLISH.format('text')} AS english FROM documents")
def english_test(spark, sf):
    return views.load(spark, sf, "documents").select("doc_id", quality.is_english(F.col("text"), F.lit("")).alias("english"))


@query("taxonomy_pages", """WITH b AS (SELECT doc_id, n_chars % 7 AS tax, n_chars % 11 AS rest FROM documents)
SELECT doc_id, coalesce(tax >= 4 AND tax / nullif(tax + rest, 0) >= 0.4, false) AS taxonomy, rest > 5 OR (rest > 0 AND doc_id % 2 = 0) AS numeric FROM b""")
def taxonomy_pages(spark, sf):
    tax, rest = F.col("n_chars") % 7, F.col("n_chars") % 11

    def field(key, value):
        return F.struct(key.alias("key"), value.alias("value"), F.lit(None).cast("double").alias("numeric_value"))

    def some(n, f):
        return F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), n), f)).otherwise(F.array().cast("array<struct<key:string,value:string,numeric_value:double>>"))

    names = F.array(*[F.lit(k.title() + ":") for k in fixed.TAXONOMY_KEYS])
    boxes = F.concat(
        some(tax, lambda i: field(F.get(names, i.cast("int")), F.lit("none"))),
        some(rest, lambda i: field(F.lit("Size"), F.when((i > 5) | (F.col("doc_id") % 2 == 0), "4 m").otherwise("wide"))),
    )
    d = views.load(spark, sf, "documents").withColumn("infobox", boxes)
    return d.select("doc_id", F.coalesce(quality.is_taxonomy(F.col("infobox")), F.lit(False)).alias("taxonomy"), quality.has_number(F.col("infobox")).alias("numeric"))


_GATE = f"""WITH g AS (SELECT doc_id AS ord, text, length(text) AS page_length, doc_id % 40 AS n_links, doc_id % 9 AS n_sections, (doc_id // 9) % 6 AS n_fields, [{', '.join(map(str, _BAD)).lower()}][(doc_id // 7) % 12 + 1] AS bad,
  {sql_list(_TITLES)}[(doc_id // 7) % 12 + 1] AS title FROM documents),
gate_q AS (SELECT ord, title, CASE WHEN bad THEN 'bad_title' WHEN page_length < 300 THEN 'too_short' WHEN n_links < 15 THEN 'few_links' WHEN n_sections < 4 THEN 'few_sections'
  WHEN NOT {_ENGLISH.format('text')} THEN 'not_english' WHEN n_fields < 3 THEN 'few_fields' WHEN n_fields = 3 THEN 'no_number' END AS reject_reason,
  page_length + 100 * n_links + 50 * n_sections AS raw_score FROM g)"""


def _gated(spark, sf):
    i = F.col("doc_id")
    n = F.floor(i / 9) % 6
    field = F.struct(F.lit("Size").alias("key"), F.when(n > 3, "4 m").otherwise("wide").alias("value"), F.lit(None).cast("double").alias("numeric_value"))
    d = views.load(spark, sf, "documents").select(
        i.alias("ord"), _pick(_TITLES, F.floor(i / 7)).alias("title"), F.length("text").cast("bigint").alias("page_length"), (i % 40).alias("n_links"), (i % 9).alias("n_sections"),
        F.array_repeat(field, n.cast("int")).alias("infobox"), F.col("text").alias("first_paragraph"), F.lit("").alias("raw_markdown"),
    )
    return quality.seed_gate(d, min_length=300)


@query("seed_gate", f"{_GATE} SELECT ord, title, reject_reason, CASE WHEN reject_reason IN ('few_fields', 'no_number') THEN raw_score END AS score FROM gate_q")
def seed_gate(spark, sf):
    return _gated(spark, sf).select("ord", "title", "reject_reason", "score")


@query("seed_choice", f"""{_GATE} SELECT ord, title, false AS is_fallback FROM gate_q WHERE ord = (SELECT coalesce(min(ord) FILTER (reject_reason IS NULL),
  (SELECT ord FROM gate_q WHERE reject_reason IN ('few_fields', 'no_number') ORDER BY raw_score DESC, ord LIMIT 1)) FROM gate_q)""")
def seed_choice(spark, sf):
    return quality.choose_seed(_gated(spark, sf))


@query("seed_fallback", f"""{_GATE} SELECT ord, title, true AS is_fallback FROM gate_q WHERE reject_reason IN ('few_fields', 'no_number') ORDER BY raw_score DESC, ord LIMIT 1""")
def seed_fallback(spark, sf):
    """The choice when no page passes all tests."""
    return quality.choose_seed(_gated(spark, sf).where("reject_reason IS NOT NULL"))


@query("reject_counts", f"{_GATE} SELECT coalesce(reject_reason, 'passed') AS outcome, count(*) AS pages FROM gate_q GROUP BY 1")
def reject_counts(spark, sf):
    return quality.reject_counts(_gated(spark, sf))


@query("graph_gate", """WITH p AS (SELECT s_nationkey AS graph_id, s_suppkey % 3 <> 0 AS boxed, s_suppkey % 4 <> 0 AS numeric, CASE WHEN s_suppkey % 5 = 0 THEN 'old town' ELSE concat('new ', s_nationkey % 3) END AS prefix FROM supplier
  UNION ALL SELECT c_nationkey, c_custkey % 2 = 0, c_custkey % 4 <> 0, CASE WHEN c_nationkey % 4 = 0 THEN 'old town' ELSE concat('b', c_custkey % 7, ' x') END FROM customer),
g AS (SELECT graph_id, count(*) AS n, count(*) FILTER (boxed) AS boxed, count(*) FILTER (boxed AND numeric) AS numeric FROM p GROUP BY 1),
t AS (SELECT graph_id, max(n) AS top FROM (SELECT graph_id, prefix, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT CAST(n_nationkey AS INTEGER) AS graph_id, ['easy', 'medium', 'hard', 'extreme'][n_nationkey % 4 + 1] AS level, [3, 7, 13, 17][n_nationkey % 4 + 1] AS low FROM nation)
SELECT graph_id, level, CASE WHEN coalesce(n, 0) < low THEN 'few_pages' WHEN boxed < greatest(3, low // 2) THEN 'few_infobox_pages' WHEN n >= 8 AND top / n > 0.5 THEN 'narrow_topic'
  WHEN numeric < 2 THEN 'few_numeric_pages' END AS reject_reason FROM l LEFT JOIN g USING (graph_id) LEFT JOIN t USING (graph_id)""")
def graph_gate(spark, sf):
    def box(boxed, numeric):
        f = F.struct(F.lit("Size").alias("key"), F.when(numeric, "4").otherwise("wide").alias("value"), F.lit(None).cast("double").alias("numeric_value"))
        return F.when(boxed, F.array(f)).otherwise(F.array().cast("array<struct<key:string,value:string,numeric_value:double>>"))

    s, n, c = F.col("s_suppkey"), F.col("s_nationkey"), F.col("c_custkey")
    a = views.load(spark, sf, "supplier").select(
        n.alias("graph_id"), F.when(s % 5 == 0, "Old town hall").otherwise(F.concat_ws(" ", F.lit("New"), (n % 3).cast("string"), F.lit("x"))).alias("title"), box(s % 3 != 0, s % 4 != 0).alias("infobox")
    )
    b = views.load(spark, sf, "customer").select(
        F.col("c_nationkey").alias("graph_id"), F.when(F.col("c_nationkey") % 4 == 0, "old  town").otherwise(F.concat(F.lit("b"), (c % 7).cast("string"), F.lit(" x"))).alias("title"), box(c % 2 == 0, c % 4 != 0).alias("infobox")
    )
    g = views.load(spark, sf, "nation").select(F.col("n_nationkey").alias("graph_id"), _pick(fixed.LEVELS, F.col("n_nationkey")).alias("level"))
    return quality.graph_gate(a.unionByName(b), g)


# --- facts ---------------------------------------------------------------------------------


def _info(spark, sf):
    return pages.build_page_info(views.wiki(spark, sf)).drop("pageviews", "raw_markdown")


def info_of(spark, sf, named):
    """Page rows of the pages that ``named(url)`` has, dates and facts of the others not being asked for."""
    return pages.build_page_info(join_counted(views.wiki(spark, sf), named.distinct(), ["url"], "left_semi")).drop("pageviews", "raw_markdown")


_FACTS = """
fact_q AS (SELECT k, concat('https://en.wikipedia.org/wiki/Part_', k) AS url, pos, key, val, num,
  CASE key WHEN 'Country' THEN 'text' WHEN 'Coordinates' THEN 'coords' WHEN 'Location' THEN 'text' ELSE 'number' END AS value_type,
  concat(CASE key WHEN 'Country' THEN 'the country listed in the infobox' WHEN 'Coordinates' THEN 'the coordinates listed in the infobox' WHEN 'Location' THEN 'the location listed in the infobox'
    WHEN 'Population' THEN 'the population listed in the infobox' ELSE 'the founding/establishment year in the infobox' END, ' (field: ''', key, ''')') AS description,
  CASE WHEN key IN ('Population', 'Founded') THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE val END AS value
 FROM box_q WHERE key IN ('Country', 'Population', 'Coordinates', 'Location', 'Founded'))"""


@query("infobox_facts", f"WITH {_INFO}, {_FACTS} SELECT url, description, value, value_type, 1.0::DOUBLE AS confidence FROM fact_q")
def infobox_facts(spark, sf):
    return facts.infobox_facts(_info(spark, sf)).select("url", "description", "value", "value_type", "confidence")


def _replies(spark, sf):
    """Model replies: every third one fenced, every seventh broken, items of several types."""
    k = F.col("k")

    def item(description, section, value, kind):
        values = (F.lit(description), F.lit(section).cast("string"), value, F.lit(kind))
        return F.struct(*[v.alias(n) for v, n in zip(values, ("description", "section", "value", "value_type"))])

    none = F.lit(None).cast("string")
    items = F.array(
        item("the size", "Overview", k.cast("string"), "number"), item("the name", None, F.lit("part"), "word"), item("", None, F.lit("x"), "text"),
        item("the day", None, F.lit("2020-01-02"), "date"), item("nothing", None, none, "date"),
    )
    js = F.to_json(items)
    text = F.when(k % 7 == 0, F.lit("no facts found")).when(k % 3 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js)
    return views.wiki(spark, sf).select("url", text.alias("reply"))


@query("prose_facts", f"""WITH r AS (SELECT url, k FROM wiki_v WHERE k % 7 <> 0)
SELECT url, 0 AS pos, 'the size' AS description, 'Overview' AS section, CAST(k AS VARCHAR) AS value, 'number' AS value_type, 0.8::DOUBLE AS confidence FROM r
UNION ALL SELECT url, 1, 'the name', NULL, 'part', 'text', 0.6::DOUBLE FROM r UNION ALL SELECT url, 3, 'the day', NULL, '2020-01-02', 'date', 0.75::DOUBLE FROM r""")
def prose_facts(spark, sf):
    return facts.parse_replies(_replies(spark, sf)).drop("source_tier")


@query("ranked_facts", f"""WITH {_INFO}, {_FACTS}, n AS (SELECT url, count(*) AS boxed FROM fact_q GROUP BY 1),
p AS (SELECT w.url, x.pos, x.description, x.value_type, x.confidence FROM wiki_v w JOIN n USING (url),
  LATERAL (VALUES (0, 'the size', 'number', 0.8), (1, 'the name', 'text', 0.6), (3, 'the day', 'date', 0.75)) x(pos, description, value_type, confidence) WHERE w.k % 7 <> 0 AND x.pos < 6 - n.boxed),
u AS (SELECT url, description, value_type, 1.0 AS confidence, 0 AS tier, pos FROM fact_q UNION ALL SELECT url, description, value_type, confidence, 1, pos FROM p)
SELECT url, description, value_type, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, (value_type = 'number') DESC, tier, pos) AS rk FROM u) WHERE rk <= 6""")
def ranked_facts(spark, sf):
    r = facts.rank_facts(facts.infobox_facts(_info(spark, sf)), facts.parse_replies(_replies(spark, sf)), max_facts=6)
    return r.select("url", "description", "value_type", "rank")


@query("fact_agreement", """SELECT url, 0 AS pos, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END / 3 AS agreement FROM wiki_v WHERE k % 7 <> 0
UNION ALL SELECT url, 1, 1.0 FROM wiki_v WHERE k % 7 <> 0 UNION ALL SELECT url, 3, 0.0 FROM wiki_v WHERE k % 7 <> 0""")
def fact_agreement(spark, sf):
    w = views.wiki(spark, sf)
    f = facts.parse_replies(_replies(spark, sf))
    k = F.col("k")
    tries = F.array(*[
        F.struct(F.lit(0).alias("pos"), F.when(F.lit(i) < 3 - k % 4, F.concat(F.lit("about "), F.format_number(k * 1.001, 2))).otherwise(F.lit("none")).alias("extracted")) for i in range(3)
    ], *[F.struct(F.lit(1).alias("pos"), F.lit(" PART ").alias("extracted"))] * 3)
    return facts.agreement(f, w.select("url", F.inline(tries)))


@query("best_facts", f"""WITH {_INFO}, {_FACTS} SELECT k, CASE WHEN k % 3 = 0 THEN concat('the country listed in the infobox (field: ''Country'')') WHEN k % 3 = 1 THEN concat('the population listed in the infobox (field: ''Population'')')
  ELSE concat('the population listed in the infobox (field: ''Population'')') END AS description FROM wiki_v WHERE k % 5 <> 0""")
def best_facts(spark, sf):
    k = F.col("k")
    hint = F.when(k % 5 == 0, "").when(k % 3 == 0, "COUNTRY of it (field: 'country')").when(k % 3 == 1, "its population").otherwise("the listed thing")
    hints = views.wiki(spark, sf).select(k.alias("hint_id"), "url", hint.alias("hint"))
    return facts.best_facts(hints, facts.infobox_facts(_info(spark, sf))).select(F.col("hint_id").alias("k"), "description")


@query("chosen_facts", f"""WITH {_INFO}, {_FACTS}, c AS (SELECT w.k, w.k // 4 AS trail_id, CASE w.k % 3 WHEN 1 THEN 'Population' WHEN 2 THEN 'Founded' ELSE 'Country' END AS key FROM wiki_v w WHERE w.k // 4 NOT IN (SELECT x.k // 4 FROM wiki_v x WHERE x.k % 37 = 0))
SELECT c.k, c.trail_id, CASE WHEN c.key = 'Country' THEN concat('Nation ', c.k % 25) ELSE f.value END AS value, f.value_type FROM c JOIN fact_q f ON f.k = c.k AND f.key = c.key""")
def chosen_facts(spark, sf):
    """Facts of all kinds for three kinds of hints (none, a number, a year); some pages have no facts, some values are blank."""
    k = F.col("k")
    hint = F.when(k % 3 == 0, F.when(k % 2 == 0, "").otherwise("the country")).when(k % 3 == 1, "the population").otherwise("the founding/establishment year")
    hints = views.wiki(spark, sf).select(F.floor(k / 4).alias("trail_id"), k.alias("hint_id"), "url", hint.alias("hint"))
    f = facts.infobox_facts(_info(spark, sf)).where("NOT (try_cast(split_part(url, '_', 2) AS BIGINT) % 37 = 0)")
    f = f.withColumn("value", F.when(F.contains("description", F.lit("location")), F.lit("[1]")).otherwise(F.col("value")))
    return facts.choose_facts(hints, f).select(F.col("hint_id").alias("k"), "trail_id", "value", "value_type")


@query("verified_values", """WITH n AS (SELECT k, CAST(CAST(list_filter(list_transform(regexp_extract_all(replace(markdown, '12.5; -3.25', '12.5, -3.25'), '[-+]?[0-9,]+\\.?[0-9]*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)),
  lambda x: abs(x - (1800 + k % 230)) / (1800 + k % 230) < 0.01)[1] AS BIGINT) AS VARCHAR) AS number FROM wiki_v),
s AS (SELECT k, x.i, x.value_type, x.v, x.found FROM wiki_v, LATERAL (VALUES
  (0, 'number', CAST(1800 + k % 230 AS VARCHAR), CAST(1800 + k % 230 AS VARCHAR)), (1, 'text', ' ELSEWHERE ', 'ELSEWHERE'), (2, 'text', 'not there', NULL),
  (3, 'url', concat('https://en.wikipedia.org/wiki/Part_', k + 1), concat('https://en.wikipedia.org/wiki/Part_', k + 1)), (4, 'date', concat(1800 + k % 230, '-05-05'), concat(1800 + k % 230, '-05-05')),
  (5, 'date', 'in 3999', CASE WHEN contains(markdown, '3999') THEN 'in 3999' END), (6, 'coords', '[12.5, -3.25]', '[12.5, -3.25]'), (7, 'coords', '[99.0, 1.0]', NULL), (8, 'number', '87654321', NULL)) x(i, value_type, v, found))
SELECT k AS trail_id, i AS stop_index, value_type, v AS value_str, CASE WHEN i = 0 THEN number ELSE found END AS found FROM s JOIN n USING (k)""")
def verified_values(spark, sf):
    k = F.col("k")
    year = (1800 + k % 230).cast("string")
    nxt = F.concat(F.lit(P + "Part_"), (k + 1).cast("string"))
    cases = [
        ("number", year), ("text", F.lit(" ELSEWHERE ")), ("text", F.lit("not there")), ("url", nxt), ("date", F.concat(year, F.lit("-05-05"))), ("date", F.lit("in 3999")),
        ("coords", F.lit("[12.5, -3.25]")), ("coords", F.lit("[99.0, 1.0]")), ("number", F.lit("87654321")),
    ]
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("stop_index"), F.lit(t).alias("value_type"), v.alias("value_str")) for i, (t, v) in enumerate(cases)]))
    w = views.wiki(spark, sf)
    stops = w.select(k.alias("trail_id"), F.col("url").alias("page_url"), rows)
    md = w.select("url", F.replace("markdown", F.lit("12.5; -3.25"), F.lit("12.5, -3.25")).alias("markdown"))
    return facts.verify_values(stops, md)


@query("section_values", """SELECT k AS trail_id, 0 AS stop_index, 'Part c' AS value_str, 'Part c' AS found FROM wiki_v UNION ALL SELECT k, 1, 'Elsewhere', NULL FROM wiki_v
UNION ALL SELECT k, 2, 'Elsewhere', 'Elsewhere' FROM wiki_v""")
def section_values(spark, sf):
    """Strict look-up: only the named section is searched, everything when it does not exist."""
    cases = [("see ALSO", "Part c"), ("Overview", "Elsewhere"), ("Missing", "Elsewhere")]
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("stop_index"), F.lit(s).alias("extraction_section"), F.lit(v).alias("value_str"), F.lit("text").alias("value_type")) for i, (s, v) in enumerate(cases)]))
    w = views.wiki(spark, sf)
    stops = w.select(F.col("k").alias("trail_id"), F.col("url").alias("page_url"), rows)
    return facts.verify_values(stops, w, strict=True).drop("value_type")


@query("page_entities", """SELECT url, CASE WHEN k % 4 = 1 THEN concat('Old Harbour ', k % 7) END AS location, concat('Nation ', k % 25) AS country,
  CASE WHEN k % 4 = 0 THEN concat('AB', chr((65 + k % 26)::INT)) END AS ticker, CASE WHEN k % 10 = 0 THEN 'LTCUSDT' END AS coin FROM wiki_v""")
def page_entities(spark, sf):
    info = _info(spark, sf)
    coin = F.array(F.struct(F.lit("[Symbol](/wiki/Symbol)").alias("key"), F.lit("LTC").alias("value"), F.lit(None).cast("double").alias("numeric_value")))
    is_tenth = F.rlike("url", F.lit("0$"))
    info = info.withColumn("infobox", F.when(is_tenth, F.concat("infobox", coin)).otherwise(F.col("infobox"))).withColumn(
        "infobox", F.filter("infobox", lambda f: f["key"] != "Coordinates")
    )
    return facts.page_entities(info)


_PLACES = ["Old Harbour", "John Smith", "National Team", "lower case", "San Marino", "X", "Paris", "Ann, Bell", "United Kingdom", "Georgia", "Stade Olympique", "Mount Doom University"]
_IS_PLACE = [True, False, False, True, True, False, True, True, False, True, False, True]


@query("geocodable_names", f"SELECT p_partkey, {sql_list(_PLACES)}[p_partkey % 12 + 1] AS name, [{', '.join(map(str, _IS_PLACE)).lower()}][p_partkey % 12 + 1] AS is_place FROM part")
def geocodable_names(spark, sf):
    p = views.load(spark, sf, "part").select("p_partkey", _pick(_PLACES, F.col("p_partkey")).alias("name"))
    return p.withColumn("is_place", facts.is_geocodable(F.col("name")))


_COUNTRY = f"{sql_list(fixed.KNOWN_COUNTRIES)}"


@query("stop_places", f"""WITH s AS (SELECT trail_id, stop_index, CASE l_partkey % 3 WHEN 0 THEN {_COUNTRY}[l_partkey % 152 + 1] WHEN 1 THEN 'National Team' ELSE 'Lake (north)' END AS title,
  CASE WHEN l_partkey % 5 = 0 THEN {_COUNTRY}[l_suppkey % 152 + 1] END AS v FROM stops_v)
SELECT trail_id, stop_index, CASE WHEN v IS NOT NULL AND v <> 'United Kingdom' AND (array_length(string_split(v, ' ')) < 2 OR regexp_matches(lower(v), 'city|bay|mount|new|san|los|el|la|fort|st\\.|saint|state|port|town')
    OR NOT list_bool_and(list_transform(string_split(v, ' '), lambda w: regexp_matches(w, '^[A-Z]')))) THEN v WHEN title = 'Lake (north)' THEN 'Lake' ELSE title END AS location,
  CASE WHEN list_contains({_COUNTRY}, title) THEN title WHEN v IS NOT NULL THEN v END AS country FROM s""")
def stop_places(spark, sf):
    part = F.col("l_partkey")
    s = views.stops(spark, sf)
    title = F.when(part % 3 == 0, _pick(fixed.KNOWN_COUNTRIES, part)).when(part % 3 == 1, "National_Team").otherwise("Lake_(north)")
    s = s.withColumn("page_url", F.concat(F.lit(P), F.replace(title, F.lit(" "), F.lit("_")))).withColumn(
        "value_str", F.when(part % 5 == 0, _pick(fixed.KNOWN_COUNTRIES, F.col("l_suppkey")))
    ).withColumn("value_type", F.lit("text"))
    return facts.stop_places(s).select("trail_id", "stop_index", "location", "country")


@query("clean_markdown", "SELECT k, concat('Nation ', k % 25, ' is old') AS cleaned FROM wiki_v")
def clean_markdown(spark, sf):
    from waymark.functions.text import clean_markdown as clean

    n = (F.col("k") % 25).cast("string")
    raw = F.concat(F.lit(" * [Nation "), n, F.lit("](/wiki/Nation_"), n, F.lit(' "tip")[[1]](#cite_note-1) is old[2][note 3] |'))
    return views.wiki(spark, sf).select("k", clean(raw).alias("cleaned"))


@query("tool_dates", """WITH RECURSIVE s AS (SELECT trail_id, stop_index, l_partkey % 40 AS k FROM stops_v WHERE stop_type = 'page'),
d AS (SELECT trail_id, stop_index, ship_day AS day, row_number() OVER (PARTITION BY trail_id ORDER BY stop_index) - 1 AS o FROM stops_v WHERE l_partkey % 6 = 0),
t(template, boxed, suffix, lo, fallback) AS (VALUES ('geocode_weather_historical', true, '-07-01', 1800, NULL), ('geocode_weather_precipitation', true, '-07-01', 1800, NULL), ('historical_snowfall', true, '-01-15', 1800, NULL),
  ('historical_sunshine', true, '-06-21', 1800, NULL), ('date_computation', true, NULL, 9999, NULL), ('stock_price', true, '-06-15', 2000, '2024-06-15'), ('stock_volume', true, '-06-15', 2000, '2024-06-15'),
  ('crypto_price', false, '-06-15', 2010, '2024-06-15'), ('crypto_volume', false, '-06-15', 2010, '2024-06-15')),
c AS (SELECT s.*, t.*, 1800 + k % 230 AS y, (SELECT count(*) FROM d WHERE d.trail_id = s.trail_id AND d.stop_index < s.stop_index) AS nb FROM s, t),
n AS (SELECT *, boxed::INT AS nf, (suffix IS NOT NULL AND y >= lo)::INT AS ny, nb + boxed::INT + (suffix IS NOT NULL AND y >= lo)::INT AS n FROM c),
p AS (SELECT *, CASE WHEN n > 0 THEN CAST('0x' || substr(md5(concat('0|', trail_id, '|', stop_index, '|', template, '|date')), 1, 8) AS BIGINT) % n END AS pick FROM n)
SELECT p.trail_id, p.stop_index, template, n AS candidates, CASE WHEN n = 0 THEN CAST(fallback AS DATE) WHEN pick < nb THEN d.day WHEN pick - nb < nf THEN make_date(y, 1, 1) ELSE CAST(concat(y, suffix) AS DATE) END AS day
FROM p LEFT JOIN d ON d.trail_id = p.trail_id AND d.o = p.pick WHERE n > 0 OR fallback IS NOT NULL""")
def tool_dates(spark, sf):
    s = views.stops(spark, sf).where("stop_type = 'page' OR l_partkey % 6 = 0")
    s = written(s.select("trail_id", "stop_index", "stop_type", "l_partkey", "ship_day", F.col("page_url").alias("url")), "dated-stops")
    paged = s.where("stop_type = 'page'").select("trail_id", "stop_index", "url")
    earlier = s.where("l_partkey % 6 = 0").select("trail_id", "stop_index", F.col("ship_day").alias("day"))
    return facts.tool_dates(paged, info_of(spark, sf, paged.select("url")).select("url", "infobox", "first_paragraph"), earlier)
