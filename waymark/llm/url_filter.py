"""URL filter: rules first, a path-template tree per host for the rest.

The paths of a host are a tree of segments. Segments that vary become wildcards: numbers and long hex strings by their look, others where a
node has many children with few urls each. Branches of a node whose share of blocked labels doesn't differ statistically are merged. A path's
template is then the way it takes through the tree, and a template is rejected when the smoothed share of good labels under it is too
low. Labels are the urls that a rule judges, or a column of the caller's.

Urls are counted per host and look of the path before anything is shuffled, so a host that holds a third of all urls travels as few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import heavy_keys, lower_ascii, salted_join, staged

#: verdict, host, path.
Rule = tuple[str, str, str]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(url, _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits a host or one above it and starts the path; null if none does. Of equally long ones, block wins."""
    found: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block", r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def look(path: Column) -> Column:
    """Segments of a path with what varies by its look replaced."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    hexes = r"(?i)\b(?=[a-f]*[0-9])[0-9a-f]{8,}\b|[0-9a-f]{8}-[0-9a-f-]{27}"
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, hexes, "<hex>"), "[0-9]+", "<n>"))


def _by_node(rows: DataFrame, side: DataFrame, node: str = "node") -> DataFrame:
    """Join one row per ``node`` to rows, of which a single node may hold a large share."""
    counts = rows.groupBy(node).count()
    heavy = heavy_keys(counts, node, "count", counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    return salted_join(rows, side, node, heavy, F.struct(*[c for c in rows.columns if c != node]))


def templates(shapes: DataFrame, many: int, few: int, z: float) -> DataFrame:
    """host, shape, n, good, bad and the template of each shape, from counts per (host, shape); one round per level, until each node has one path.

    A node with one path has nothing left to generalise or merge: its template ends as the path does. No window or join gathers the children of a node: they are counted in two steps, and what holds for a node is joined back to them with
    large nodes dealt over tasks. Only the different shares of bad labels of a node are put in order.
    """
    tree = shapes.withColumn("template", F.lit(""))
    kept, done, level = tree.columns, tree.limit(0), 0
    while True:
        level += 1
        tree = tree.withColumn("node", F.concat_ws("\n", "host", "template"))
        paths = tree.groupBy("node").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1")
        tree = staged(_by_node(tree, paths), "nodes")
        going = F.col("paths").isNotNull() & (F.size("shape") >= level)
        rest = F.transform(F.slice("shape", level, F.greatest(F.size("shape") - level + 1, F.lit(0))), lambda s: F.concat(F.lit("/"), s))
        done = done.unionByName(tree.where(~going).withColumn("template", F.concat("template", F.array_join(rest, ""))).select(*kept))
        tree = tree.where(going).drop("paths").withColumn("token", F.element_at("shape", level))
        if tree.isEmpty():
            return done
        seen = F.col("good") + F.col("bad")
        children = staged(tree.groupBy("node", "token").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")), "children")
        sizes = children.groupBy("node").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("urls"))
        # many children with few urls each: a variable; its tokens are one branch
        variable = (F.col("children") >= many) & (F.col("urls") < few * F.col("children")) & (F.col("n") < few)
        wide = sizes.where((F.col("children") >= many) & (F.col("urls") < few * F.col("children")))
        branch = staged(_by_node(children, wide).withColumn("branch", F.when(F.coalesce(variable, F.lit(False)), "*").otherwise(F.col("token"))).drop("children", "urls"), "branches")
        # neighbours by their share of bad labels are one branch unless a test of two proportions tells them apart
        labelled = branch.where((seen > 0) & (F.col("branch") != "*")).withColumns({"seen": seen, "share": F.col("bad") / seen})
        shares = labelled.groupBy("node", "share").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"), F.min("branch").alias("first"), F.count(F.lit(1)).alias("branches"))
        order = Window.partitionBy("node").orderBy("share")
        pooled = (F.col("bad") + F.lag("bad").over(order)) / (F.col("seen") + F.lag("seen").over(order))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("seen") + 1 / F.lag("seen").over(order)))
        apart = F.coalesce(F.col("share") - F.lag("share").over(order) > z * error, F.lit(True))
        cluster = shares.withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        alike = Window.partitionBy("node", "cluster")
        name = F.when(F.sum("branches").over(alike) > 1, F.concat(F.lit("{"), F.min("first").over(alike), F.lit(",..}"))).otherwise(F.col("first"))
        named = cluster.select(F.struct("node", "share").alias("at"), name.alias("name"))
        step = _by_node(branch.withColumn("at", F.when((seen > 0) & (F.col("branch") != "*"), F.struct("node", (F.col("bad") / seen).alias("share")))), named, "at")
        step = staged(step.select(F.struct("node", "token").alias("at"), F.coalesce("name", "branch").alias("name")), "steps")
        tree = _by_node(tree.withColumn("at", F.struct("node", "token")), step, "at").withColumn("template", F.concat("template", F.lit("/"), F.col("name"))).select(*kept)


def judge(
    pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", label: Column | None = None, least: float = 0.5, weight: float = 2.0, many: int = 12,
    few: int = 4, z: float = 1.96,
) -> DataFrame:
    """``key``, host, path, rule, verdict, template, purity for each row.

    ``label`` (true good, false bad, null unknown) defaults to the verdicts of the rules. A template without a rule is blocked when
    (good + ``weight`` / 2) / (good + bad + ``weight``) is below ``least``, so templates without labels are allowed. A null url or one without ://
    has an empty host and path. Repeated rows and null keys stay; urls are read whole; an empty table stays empty.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), *([] if label is None else [label.alias("label")]))
    rows = rows.withColumns({"found": rule_for(F.col("host"), F.col("path"), rules), "shape": look(F.col("path"))})
    rows = rows.withColumn("good", (F.col("found.verdict") == "allow") if label is None else F.col("label"))
    rows = rows.withColumn("place", F.concat_ws("/", "host", F.concat_ws("/", "shape")))
    shapes = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    shapes = staged(shapes, "shapes")
    tree = staged(templates(shapes, many, few, z).withColumn("node", F.struct("host", "template")), "paths")
    pure = tree.groupBy("node").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    pure = pure.withColumn("purity", (F.col("g") + weight / 2) / (F.col("g") + F.col("b") + weight)).drop("g", "b")
    side = staged(_by_node(tree, pure).select(F.concat_ws("/", "host", F.concat_ws("/", "shape")).alias("place"), "n", "template", "purity"), "templates")
    total = side.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    flat = rows.select("key", "host", "path", "found", "place")
    out = salted_join(flat, side.drop("n"), "place", heavy_keys(side, "place", "n", total), F.struct("key", "path"))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("purity") < least, "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
