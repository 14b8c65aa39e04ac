"""Views that shape the given tables like trails, stops, links and tool logs.

Each view exists twice: as a DataFrame for the jobs and as SQL text for the checks. Scalar
expressions that read the same in both dialects are shared; everything that moves rows is written
separately (the DataFrame side must not put a hot order in one task).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.skew import kept_here, numbered, spread


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet")


# --- shared scalar expressions -------------------------------------------------------------

_LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]

_TRAIL = """
o_orderkey AS trail_id,
CASE o_orderpriority WHEN '1-URGENT' THEN 'extreme' WHEN '2-HIGH' THEN 'hard'
     WHEN '3-MEDIUM' THEN 'medium' ELSE 'easy' END AS level,
CAST(CASE WHEN o_orderkey % 101 = 0 THEN 12 WHEN o_orderkey % 7 = 0 THEN (o_orderkey + 1) % 10
     ELSE o_orderkey % 10 END AS BIGINT) AS passcode,
concat('https://en.wikipedia.org/wiki/Part_', CAST(o_custkey % 40 AS VARCHAR(20))) AS seed_url,
concat('Part ', CAST(o_custkey % 40 AS VARCHAR(20))) AS seed_title
"""

# first layer over numbered lineitem rows (rn is 1-based, n the number of rows of the order)
_STOP_1 = """
l_orderkey AS trail_id, CAST(rn - 1 AS BIGINT) AS stop_index, l_partkey, l_suppkey,
CASE WHEN rn = n AND l_orderkey % 11 <> 0 THEN 'compute' WHEN l_returnflag = 'R' THEN 'page'
     WHEN l_returnflag = 'A' THEN 'tool' ELSE 'reason' END AS stop_type,
CAST(floor(l_extendedprice) AS BIGINT) AS price, CAST(l_shipdate AS DATE) AS ship_day
"""

_STOP_2 = """
trail_id, stop_index, stop_type, l_partkey, l_suppkey, ship_day,
CASE WHEN stop_type IN ('page', 'tool')
     THEN concat('https://en.wikipedia.org/wiki/Part_', CAST(l_partkey % 40 AS VARCHAR(20))) END AS page_url,
CASE WHEN stop_type = 'compute' THEN trail_id % 10 WHEN l_partkey % 211 = 0 THEN 0
     WHEN l_partkey % 17 = 0 THEN 10000 + l_partkey % 10 ELSE price END AS extracted_value,
CASE WHEN stop_type = 'tool' THEN
     CASE l_suppkey % 6 WHEN 0 THEN 'maps_geocode' WHEN 1 THEN 'maps_elevation'
          WHEN 2 THEN 'countries_population' WHEN 3 THEN 'python_execute_code'
          WHEN 4 THEN 'stock_historical_price' ELSE 'maps_lookup' END END AS tool_name,
CASE WHEN stop_type = 'tool' THEN ship_day END AS tool_date,
CASE WHEN stop_type = 'compute' THEN 'int' WHEN l_partkey % 53 = 0 THEN 'null'
     WHEN l_partkey % 29 = 0 THEN 'string' WHEN l_partkey % 31 = 0 THEN 'float' ELSE 'int' END AS value_kind,
CASE WHEN l_suppkey % 37 = 0 THEN 'amount' WHEN l_partkey % 3 = 0 THEN 'text' ELSE 'number' END AS value_type,
CASE WHEN l_suppkey % 41 = 0 THEN 'jump' WHEN stop_type = 'compute' THEN 'compute'
     WHEN stop_type = 'tool' THEN 'tool_call' WHEN l_partkey % 2 = 0 THEN 'link_follow'
     ELSE 'search_query' END AS bridge_type,
CASE WHEN l_partkey % 61 = 0 THEN stop_index + 1 ELSE stop_index END AS stored_index,
CASE WHEN stop_type = 'reason' THEN CASE WHEN l_partkey % 10 = 0 THEN stop_index + 1 ELSE stop_index - 1 END
     END AS reason_source_stop
"""

_STOP_3 = """
trail_id, stop_index, stop_type, page_url, extracted_value, tool_name, tool_date, value_kind, value_type,
bridge_type, stored_index, reason_source_stop, l_partkey, l_suppkey, ship_day,
CASE value_kind WHEN 'null' THEN NULL WHEN 'float' THEN concat(CAST(extracted_value AS VARCHAR(20)), '.5')
     WHEN 'string' THEN
          CASE l_suppkey % 6 WHEN 0 THEN concat(CAST(extracted_value AS VARCHAR(20)), ' km [1]')
               WHEN 1 THEN concat('about ', CAST(extracted_value AS VARCHAR(20)))
               WHEN 2 THEN concat('$', CAST(extracted_value AS VARCHAR(20)), ' million')
               WHEN 3 THEN 'Old Harbour' WHEN 4 THEN concat(CAST(extracted_value AS VARCHAR(20)), '[note 2]')
               ELSE CAST(extracted_value AS VARCHAR(20)) END
     ELSE CAST(extracted_value AS VARCHAR(20)) END AS value_str,
CASE value_kind WHEN 'int' THEN CAST(extracted_value AS DOUBLE)
     WHEN 'float' THEN CAST(extracted_value AS DOUBLE) + 0.5 END AS value_num,
CASE WHEN bridge_type = 'link_follow' AND l_partkey % 5 <> 0
     THEN concat('https://en.wikipedia.org/wiki/Part_', CAST((l_partkey + 1) % 40 AS VARCHAR(20))) END AS target_url,
CASE WHEN bridge_type = 'search_query' AND l_partkey % 5 <> 0
     THEN concat('Part ', CAST(l_partkey % 40 AS VARCHAR(20))) END AS search_query,
CASE WHEN stop_type = 'compute' AND trail_id % 9 <> 0
     THEN concat('(', CAST(trail_id AS VARCHAR(20)), ' + 10) % 10') END AS expression,
CASE WHEN l_partkey % 23 = 0 THEN concat('Place[2] ', CAST(l_partkey % 40 AS VARCHAR(20)))
     ELSE concat('Place ', CAST(l_partkey % 40 AS VARCHAR(20))) END AS address
"""

_LOG = """
user_id AS trial_id, event_id AS seq, ts,
CASE event_type WHEN 'view' THEN 'fetch_webpage' WHEN 'click' THEN 'maps_geocode'
     WHEN 'purchase' THEN 'maps_elevation' WHEN 'signup' THEN 'countries_population'
     ELSE 'python_execute_code' END AS tool,
event_type <> 'error' AS success,
CASE WHEN event_type = 'view' THEN concat(
     CASE WHEN event_id % 3 = 0 THEN 'https://en.m.wikipedia.org/wiki/Part_'
          ELSE 'https://en.wikipedia.org/wiki/Part_' END,
     CAST(event_id % 40 AS VARCHAR(20)),
     CASE event_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '#top' WHEN 2 THEN '?x=1' ELSE '' END) END AS url,
concat('place ', CAST(event_id % 40 AS VARCHAR(20))) AS address,
CAST(CAST(floor(value * 97) AS BIGINT) AS VARCHAR(20)) AS result_preview
"""

_ANSWER = """
trail_id AS trial_id,
CASE trail_id % 6 WHEN 0 THEN CAST(NULL AS VARCHAR(20)) WHEN 1 THEN '' WHEN 2 THEN '12'
     WHEN 3 THEN CAST((passcode + 1) % 10 AS VARCHAR(20)) ELSE CAST(passcode AS VARCHAR(20)) END AS answer
"""

# article texts: site chrome, infobox rows (one hidden coordinate pair, one repeated key), links of all kinds
_WIKI = """
p_partkey AS k, concat('https://en.wikipedia.org/wiki/Part_', CAST(p_partkey AS VARCHAR(20))) AS url,
concat('Main menu', chr(10), 'From Wikipedia, the free encyclopedia', chr(10), '# Part ', CAST(p_partkey AS VARCHAR(20)), chr(10), chr(10),
 '| Country | [Nation ', CAST(p_partkey % 25 AS VARCHAR(20)), '](/wiki/Nation_', CAST(p_partkey % 25 AS VARCHAR(20)), ') |', chr(10), '| --- | --- |', chr(10),
 '| **Population** | ', CAST(p_size AS VARCHAR(20)), ',', CAST(100 + p_partkey % 900 AS VARCHAR(20)), ' people |', chr(10),
 '| Coordinates: [x](https://geohack.toolforge.org/x) 12.5; -3.25 | north |', chr(10),
 CASE p_partkey % 4 WHEN 0 THEN concat('| Traded as | NYSE: AB', chr(CAST(65 + p_partkey % 26 AS INT)), ' |', chr(10))
      WHEN 1 THEN concat('| Location | Old Harbour ', CAST(p_partkey % 7 AS VARCHAR(20)), ', Far Land |', chr(10)) ELSE '' END,
 chr(10), '**Founded**: ', CAST(1800 + p_partkey % 230 AS VARCHAR(20)), chr(10), '**Country**: Elsewhere', chr(10), chr(10),
 '## Overview', chr(10), 'The **part ', CAST(p_partkey AS VARCHAR(20)), '** is a ', p_name, ' near [Part ', CAST(p_partkey DIV 3 AS VARCHAR(20)), '](/wiki/Part_', CAST(p_partkey DIV 3 AS VARCHAR(20)),
 ') and [Part b (tool)](/wiki/Part_b_(tool)).', chr(10), 'See [File](/wiki/File:X.png), [1987](/wiki/1987), [List](/wiki/List_of_parts) and [next](/wiki/Part_',
 CAST(p_partkey + 1 AS VARCHAR(20)), '#top).', chr(10), chr(10), '## See also', chr(10), '* [Part c](/wiki/Part_', CAST(p_partkey DIV 5 AS VARCHAR(20)), ')', chr(10)) AS markdown
"""

# --- SQL side ------------------------------------------------------------------------------

_VIEW_SQL = {
    "trails_v": f"SELECT {_TRAIL} FROM orders",
    "lines_v": f"""SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS rn,
        count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem""",
    "stops1_v": f"SELECT {_STOP_1} FROM lines_v",
    "stops2_v": f"SELECT {_STOP_2} FROM stops1_v",
    "stops_v": f"SELECT {_STOP_3} FROM stops2_v",
    "chain_v": """SELECT trail_id, stop_index, 0 AS step,
          CASE WHEN tool_name = 'maps_elevation' THEN 'maps_geocode' ELSE tool_name END AS tool_name,
          CASE WHEN tool_name = 'stock_historical_price' THEN CAST(tool_date AS VARCHAR(20)) END AS arg_date,
          CASE WHEN tool_name NOT IN ('stock_historical_price', 'python_execute_code') THEN address END AS arg_address,
          CASE WHEN tool_name = 'python_execute_code'
               THEN concat('result = int(', CAST(extracted_value - 4 AS VARCHAR), ') + int(', CASE WHEN l_partkey % 3 = 0 THEN '5' ELSE '4' END, ')') END AS arg_code
        FROM stops_v WHERE stop_type = 'tool' AND l_suppkey % 19 <> 0
        UNION ALL
        SELECT trail_id, stop_index, 1, tool_name, NULL, NULL, NULL
        FROM stops_v WHERE stop_type = 'tool' AND l_suppkey % 19 <> 0 AND tool_name = 'maps_elevation'""",
    "deps_v": """SELECT trail_id, stop_index, stop_index - 1 AS dep FROM stops_v
          WHERE stop_index >= 1 AND extracted_value % 13 <> 0 AND extracted_value % 17 <> 0
        UNION ALL
        SELECT trail_id, stop_index, stop_index - 2 FROM stops_v WHERE stop_index >= 2 AND extracted_value % 3 = 0
        UNION ALL
        SELECT trail_id, stop_index, stop_index + 1 FROM stops_v WHERE extracted_value % 17 = 0""",
    "tool_log_v": f"SELECT {_LOG} FROM events",
    "answers_v": f"SELECT {_ANSWER} FROM trails_v",
    "links_v": """SELECT a.page_url AS src, b.page_url AS dst, min(b.stop_index) AS pos
        FROM stops_v a JOIN stops_v b ON a.trail_id = b.trail_id AND b.stop_index = a.stop_index + 1
        WHERE a.page_url IS NOT NULL AND b.page_url IS NOT NULL AND a.page_url <> b.page_url
        GROUP BY ALL""",
    "wiki_v": f"SELECT {_WIKI.replace(' DIV ', ' // ')} FROM part",
    "riddles_v": """SELECT doc_id AS trail_id,
          CASE doc_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'extreme' END AS level,
          concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)) AS seed_title,
          CASE WHEN doc_id % 5 = 0 THEN concat('1. ', text, chr(10), '2. Then go on.', chr(10), ' 3. End.') ELSE text END AS riddle
        FROM documents""",
}


def with_views(sql: str) -> str:
    """Put the views a statement uses, and the ones they use, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _VIEW_SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(_VIEW_SQL[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({_VIEW_SQL[name]})" for name in needed)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            return f"WITH RECURSIVE {head},\n{rest[9:]}"
        return f"WITH {head},\n{rest}"
    return f"WITH {head}\n{body}"


# --- DataFrame side ------------------------------------------------------------------------


def _exprs(text: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, quoted, cur = [], 0, False, ""
    words = re.split(r"(\bCASE\b|\bEND\b|[(),'])", text)
    for w in words:
        if w == "'":
            quoted = not quoted
        elif not quoted:
            if w in ("(", "CASE"):
                depth += 1
            elif w in (")", "END"):
                depth -= 1
            elif w == "," and depth == 0:
                out.append(cur.strip())
                cur = ""
                continue
        cur += w
    return [*out, cur.strip()]


def trails(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(*_exprs(_TRAIL))


def stops(spark: SparkSession, sf: str) -> DataFrame:
    # an order's lines by line number; the buckets serve orders that hold a large share of all lines
    lines = numbered(
        load(spark, sf, "lineitem"), ["l_orderkey"], [F.col(c) for c in _LINE_ORDER], F.struct("l_linenumber", F.floor(F.col("l_partkey") / 256)), "rn0", "n"
    ).withColumn("rn", F.col("rn0") + 1)
    return lines.selectExpr(*_exprs(_STOP_1)).selectExpr(*_exprs(_STOP_2)).selectExpr(*_exprs(_STOP_3))


def chain(stops_df: DataFrame) -> DataFrame:
    """Tool-chain steps with their arguments as a map of texts."""
    tool = stops_df.where("stop_type = 'tool' AND l_suppkey % 19 <> 0")
    args = F.when(
        F.col("tool_name") == "stock_historical_price",
        F.create_map(F.lit("ticker"), F.lit("ABC"), F.lit("date"), F.col("tool_date").cast("string")),
    ).when(
        F.col("tool_name") == "python_execute_code",
        F.create_map(
            F.lit("code"),
            F.concat(
                F.lit("result = int("), (F.col("extracted_value") - 4).cast("string"), F.lit(") + int("),
                F.when(F.col("l_partkey") % 3 == 0, "5").otherwise("4"), F.lit(")"),
            ),
        ),
    ).otherwise(F.create_map(F.lit("address"), F.col("address")))
    chained = F.create_map(F.lit("__from_previous_as_locations"), F.lit("coords"))

    def step(pos: int, name, arguments):
        return F.struct(F.lit(pos).alias("step"), name.alias("tool_name"), arguments.alias("args"))

    geocode = F.lit("maps_geocode")
    steps = F.when(
        F.col("tool_name") == "maps_elevation",
        F.array(step(0, geocode, args), step(1, F.col("tool_name"), chained)),
    ).otherwise(F.array(step(0, F.col("tool_name"), args)))
    return tool.select("trail_id", "stop_index", F.inline(steps))


def deps(stops_df: DataFrame) -> DataFrame:
    """Dependency edges; one row per stop and dependency."""
    v, i = F.col("extracted_value"), F.col("stop_index")
    edges = F.array(
        F.when((i >= 1) & (v % 13 != 0) & (v % 17 != 0), i - 1),
        F.when((i >= 2) & (v % 3 == 0), i - 2),
        F.when(v % 17 == 0, i + 1),
    )
    return stops_df.select("trail_id", "stop_index", F.explode(F.array_compact(edges)).alias("dep"))


def tool_log(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").selectExpr(*_exprs(_LOG))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return trails(spark, sf).selectExpr(*_exprs(_ANSWER))


def links(stops_df: DataFrame) -> DataFrame:
    """Edges between pages of neighbouring stops."""
    paged = stops_df.where("page_url IS NOT NULL")
    a = paged.select("trail_id", F.col("stop_index").alias("i"), F.col("page_url").alias("src"))
    b = paged.select("trail_id", (F.col("stop_index") - 1).alias("i"), F.col("page_url").alias("dst"))
    pairs = a.join(b, ["trail_id", "i"]).where("src <> dst")
    return pairs.groupBy("src", "dst").agg((F.min("i") + 1).alias("pos"))


def wiki(spark: SparkSession, sf: str) -> DataFrame:
    """Article pages: (k, url, markdown)."""
    return spread(load(spark, sf, "part"), "p_partkey").selectExpr(*_exprs(_WIKI)).withColumn("markdown", kept_here(F.col("markdown")))


def riddles(spark: SparkSession, sf: str) -> DataFrame:
    text, doc = F.col("text"), F.col("doc_id")
    levels = F.array(*[F.lit(x) for x in ("easy", "medium", "hard", "extreme")])
    return load(spark, sf, "documents").select(
        doc.alias("trail_id"),
        F.get(levels, (doc % 4).cast("int")).alias("level"),
        F.concat(F.split_part(text, F.lit(" "), F.lit(2)), F.lit(" "), F.split_part(text, F.lit(" "), F.lit(3))).alias("seed_title"),
        F.when(doc % 5 == 0, F.concat(F.lit("1. "), text, F.lit("\n2. Then go on.\n 3. End."))).otherwise(text).alias("riddle"),
    )
