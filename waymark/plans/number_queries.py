"""Queries over number, text and date transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import numbers as nums
from waymark.functions import values as vals
from waymark.operators import transforms
from waymark.plans import views
from waymark.plans.registry import query

# primes up to the square of 1,100, enough for every whole price of the tables
_PRIMES = """
primes_q AS (SELECT n AS p FROM range(2, 1200000) t(n) WHERE n < 120000 AND NOT EXISTS (SELECT 1 FROM range(2, 347) d(k) WHERE k * k <= n AND n % k = 0)),
vals_q AS (SELECT DISTINCT CAST(abs(trunc(TRY_CAST(value_str AS DOUBLE))) AS BIGINT) AS n FROM stops_v WHERE value_type = 'number' AND TRY_CAST(value_str AS DOUBLE) IS NOT NULL)"""

_DIGITS = "list_sum(list_transform(string_split(CAST(n AS VARCHAR), ''), lambda d: CAST(d AS BIGINT)))"


@query("int_transforms", f"""WITH v AS (SELECT trail_id, stop_index, CAST(abs(trunc(TRY_CAST(value_str AS DOUBLE))) AS BIGINT) AS n FROM stops_v
  WHERE value_type = 'number' AND TRY_CAST(value_str AS DOUBLE) IS NOT NULL),
y AS (SELECT *, n % 518 + 1583 AS y FROM v)
SELECT trail_id, stop_index, n,
  bit_count(n)::BIGINT AS ones, CAST(reverse(CAST(n AS VARCHAR)) AS BIGINT) AS reversed, CASE WHEN n = 0 THEN 0 ELSE (n - 1) % 9 + 1 END AS root,
  CAST({_DIGITS} AS BIGINT) AS digits, CAST(isodow(make_date(y, 1, 1)) AS BIGINT) AS new_year,
  (SELECT count(*) FROM range(least(y, 2000), greatest(y, 2000) + 1) r(k) WHERE (k % 4 = 0 AND k % 100 <> 0) OR k % 400 = 0) AS leaps,
  CAST(length(regexp_replace(CAST(n % 3999 + 1 AS VARCHAR), '.', '', 'g')) + (n % 3999 + 1) // 1000
    + [0,1,2,3,2,1,2,3,4,2][(n % 3999 + 1) // 100 % 10 + 1] + [0,1,2,3,2,1,2,3,4,2][(n % 3999 + 1) // 10 % 10 + 1] + [0,1,2,3,2,1,2,3,4,2][(n % 3999 + 1) % 10 + 1] AS BIGINT) AS roman
FROM y""")
def int_transforms(spark, sf):
    s = views.stops(spark, sf).where("value_type = 'number'")
    s = s.withColumn("n", transforms.number_input(s)).where("n IS NOT NULL").withColumn("y", F.col("n") % 518 + 1583)
    n, y = F.col("n"), F.col("y")
    return s.select(
        "trail_id", "stop_index", "n", nums.one_bits(n).alias("ones"), nums.reverse_digits(n).alias("reversed"),
        nums.digital_root(n).alias("root"), nums.digit_sum(n).alias("digits"), nums.new_year_weekday(y).alias("new_year"),
        nums.leap_years_to_2000(y).alias("leaps"), nums.roman_length(n % 3999 + 1).alias("roman"),
    )


@query("prime_transforms", f"""WITH {_PRIMES},
factor_q AS (SELECT n, p, n % (p * p) = 0 AS repeated FROM vals_q JOIN primes_q ON n > 0 AND n % p = 0 AND p <= n),
fact_q AS (SELECT n, CAST(sum(p) AS BIGINT) AS prime_sum, max(p) AS top, arg_max(repeated, p) AS top_repeated FROM factor_q GROUP BY 1)
SELECT v.n, CASE WHEN v.n < 2 THEN 2 ELSE (SELECT min(p) FROM primes_q WHERE p > v.n) END AS next_prime,
  coalesce(f.prime_sum, 0) AS prime_sum, CASE WHEN v.n <= 1 THEN v.n WHEN top_repeated THEN 1 ELSE top END AS largest_prime,
  CASE WHEN v.n <= 1 THEN v.n ELSE top END AS largest_prime_strict,
  (SELECT count(*) FROM range(1, CAST(floor(sqrt(v.n)) AS BIGINT) + 1) r(k) WHERE v.n % k = 0) * 2
   - CASE WHEN v.n > 0 AND CAST(floor(sqrt(v.n)) AS BIGINT) ** 2 = v.n THEN 1 ELSE 0 END AS divisors
FROM vals_q v LEFT JOIN fact_q f ON f.n = v.n""")
def prime_transforms(spark, sf):
    s = views.stops(spark, sf).where("value_type = 'number'")
    d = s.select(transforms.number_input(s).alias("n")).where("n IS NOT NULL").distinct()
    n = F.col("n")
    return d.select(
        "n", nums.next_prime(n).alias("next_prime"), nums.sum_prime_factors(n).alias("prime_sum"),
        nums.largest_prime_factor(n).alias("largest_prime"), nums.largest_prime_factor(n, strict=True).alias("largest_prime_strict"),
        nums.num_divisors(n).alias("divisors"),
    )


@query("text_transforms", """SELECT p_partkey, CAST(length(regexp_replace(lower(p_name), '[^aeiou]', '', 'g')) AS BIGINT) AS vowels,
  CAST(ascii(upper(substr(p_name, 1, 1))) - 64 AS BIGINT) AS first_letter,
  CAST(coalesce(list_sum(list_transform(string_split(upper(p_name), ''), lambda c: CASE
    WHEN c IN ('A','E','I','L','N','O','R','S','T','U') THEN 1 WHEN c IN ('D','G') THEN 2 WHEN c IN ('B','C','M','P') THEN 3
    WHEN c IN ('F','H','V','W','Y') THEN 4 WHEN c = 'K' THEN 5 WHEN c IN ('J','X') THEN 8 WHEN c IN ('Q','Z') THEN 10 ELSE 0 END)), 0) AS BIGINT) AS letter_score
FROM part""")
def text_transforms(spark, sf):
    name = F.col("p_name")
    return views.load(spark, sf, "part").select(
        "p_partkey", nums.vowel_count(name).alias("vowels"), nums.first_letter_position(name).alias("first_letter"),
        nums.scrabble_score(name).alias("letter_score"),
    )


TRANSFORM_SQL = f"""{_PRIMES},
factor_q AS (SELECT n, p, n % (p * p) = 0 AS repeated FROM vals_q JOIN primes_q ON n > 0 AND n % p = 0 AND p <= n),
fact_q AS (SELECT n, CAST(sum(p) AS BIGINT) AS prime_sum, max(p) AS top, arg_max(repeated, p) AS top_repeated FROM factor_q GROUP BY 1),
prime_q AS (SELECT v.n, (SELECT min(p) FROM primes_q WHERE p > v.n) AS next_prime, prime_sum, CASE WHEN top_repeated THEN 1 ELSE top END AS largest,
  (SELECT count(*) FROM range(1, CAST(floor(sqrt(v.n)) AS BIGINT) + 1) r(k) WHERE v.n % k = 0) * 2 - CASE WHEN CAST(floor(sqrt(v.n)) AS BIGINT) ** 2 = v.n THEN 1 ELSE 0 END AS divisors
  FROM vals_q v JOIN fact_q f ON f.n = v.n),
tv_q AS (SELECT trail_id, stop_index, stop_type, value_str AS s, value_type = 'text' AND length(trim(value_str)) >= 2 AS is_text,
  CASE WHEN value_type = 'number' THEN CAST(abs(trunc(TRY_CAST(value_str AS DOUBLE))) AS BIGINT) END AS n FROM stops_v),
transforms_q AS (SELECT trail_id, stop_index, stop_type, t.transform, t.result::BIGINT AS result FROM tv_q v LEFT JOIN prime_q p ON p.n = v.n, LATERAL (VALUES
  ('next_prime', CASE WHEN v.n >= 2 THEN next_prime END), ('num_divisors', CASE WHEN v.n >= 4 THEN divisors END), ('sum_prime_factors', CASE WHEN v.n >= 4 THEN prime_sum END),
  ('largest_prime_factor', CASE WHEN v.n >= 4 THEN largest END),
  ('roman_numeral_letter_count', CASE WHEN v.n BETWEEN 1 AND 3999 THEN v.n // 1000 + [0,1,2,3,2,1,2,3,4,2][v.n // 100 % 10 + 1] + [0,1,2,3,2,1,2,3,4,2][v.n // 10 % 10 + 1] + [0,1,2,3,2,1,2,3,4,2][v.n % 10 + 1] END),
  ('binary_1bit_count', CASE WHEN v.n >= 2 THEN bit_count(v.n) END), ('digit_reversal', CASE WHEN v.n >= 10 THEN CAST(reverse(CAST(v.n AS VARCHAR)) AS BIGINT) END),
  ('digital_root', CASE WHEN v.n >= 10 THEN (v.n - 1) % 9 + 1 END), ('digit_sum', CASE WHEN v.n >= 10 THEN {_DIGITS.replace('(n ', '(v.n ')} END),
  ('day_of_week', CASE WHEN v.n BETWEEN 1583 AND 2100 THEN isodow(make_date(v.n, 1, 1)) END),
  ('leap_years_to_2000', CASE WHEN v.n BETWEEN 1583 AND 2100 THEN (SELECT count(*) FROM range(least(v.n, 2000), greatest(v.n, 2000) + 1) r(k) WHERE (k % 4 = 0 AND k % 100 <> 0) OR k % 400 = 0) END),
  ('vowel_count', CASE WHEN is_text THEN length(regexp_replace(lower(s), '[^aeiou]', '', 'g')) END),
  ('alpha_position_first_letter', CASE WHEN is_text AND regexp_matches(s, '^[A-Za-z]') THEN ascii(upper(substr(s, 1, 1))) - 64 END)) t(transform, result)
  WHERE t.result IS NOT NULL)"""


@query("transform_rows", f"WITH {TRANSFORM_SQL} SELECT trail_id, stop_index, transform, result FROM transforms_q")
def transform_rows(spark, sf):
    return transforms.apply_transforms(views.stops(spark, sf))


@query("date_gap", """SELECT o_orderkey, abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01')) AS days,
  CAST(CAST(o_orderdate AS DATE) - greatest(CAST(isodow(o_orderdate) AS INTEGER) - 5, 0) AS DATE) AS trading_day FROM orders""")
def date_gap(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return views.load(spark, sf, "orders").select(
        "o_orderkey", nums.days_between(day, F.lit("1998-01-01").cast("date")).alias("days"), vals.trading_day(day).alias("trading_day")
    )


@query("unit_conversion", """SELECT p_partkey, from_unit, to_unit, CAST(trunc(p_retailprice * factor) AS BIGINT) AS converted FROM part,
  (VALUES ('meters', 'feet', 3.28084::DOUBLE), ('km', 'miles', 0.621371::DOUBLE), ('meters', 'yards', 1.09361::DOUBLE), ('celsius', 'fahrenheit_offset', 1.8::DOUBLE)) u(from_unit, to_unit, factor)""")
def unit_conversion(spark, sf):
    values = views.load(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("value"))
    return transforms.unit_conversions(values).drop("value")


@query("merge_values", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS a, l_tax * l_quantity AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'add' AS operation, CAST(trunc(a) AS BIGINT) + CAST(trunc(b) AS BIGINT) AS merged FROM p WHERE trunc(a) + trunc(b) <> 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'abs_diff', abs(CAST(trunc(a) AS BIGINT) - CAST(trunc(b) AS BIGINT)) FROM p WHERE trunc(a) - trunc(b) <> 0""")
def merge_values(spark, sf):
    p = views.load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("a"), (F.col("l_tax") * F.col("l_quantity")).alias("b")
    )
    return transforms.merge_values(p)


@query("closed_forms", """WITH v AS (SELECT trail_id, stop_index, extracted_value AS a, l_suppkey - 50 AS b FROM stops_v)
SELECT trail_id, stop_index, CASE WHEN abs(a + b) = 0 THEN 0 ELSE (abs(a + b) - 1) % 9 + 1 END AS root, ((a + b) % 10 + 10) % 10 AS sum10,
  abs(a - (b + 50)) % 10 AS diff10, ((a * (b + 50)) % 10 + 10) % 10 AS product10, a + b AS added, abs(a - (b + 50)) AS diff, NULL::BIGINT AS other FROM v""")
def closed_forms(spark, sf):
    a, b = F.col("extracted_value"), F.col("l_suppkey") - 50

    def text(*parts):
        return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])

    up = b + 50
    forms = {
        "root": text("digital_root(", a, " + ", b, ")"), "sum10": text("(", a, " + ", b, ") % 10"), "diff10": text("abs(", a, " - ", up, ") % 10"),
        "product10": text("(", a, " * ", up, ") % 10"), "added": text("int(", a, ") + int(", b, ")"),
        "diff": text("abs(int(", a, ") - int(", up, "))"), "other": text("len(", a, ")"),
    }
    s = views.stops(spark, sf)
    return s.select("trail_id", "stop_index", *[nums.recompute(e).alias(name) for name, e in forms.items()])


@query("digit_forms", """SELECT trail_id, stop_index, CASE WHEN abs(a + b) = 0 THEN 0 ELSE (abs(a + b) - 1) % 9 + 1 END AS root,
  ((a + b) % 10 + 10) % 10 AS sum10, abs(a - b) % 10 AS diff10, ((a * b) % 10 + 10) % 10 AS product10
FROM (SELECT trail_id, stop_index, extracted_value AS a, l_suppkey - 5000 AS b FROM stops_v)""")
def digit_forms(spark, sf):
    pair = F.array(F.col("extracted_value"), F.col("l_suppkey") - 5000)
    return views.stops(spark, sf).select(
        "trail_id", "stop_index", nums.digit_digital_root(pair).alias("root"), nums.digit_mod10(pair).alias("sum10"),
        nums.digit_abs_diff(pair).alias("diff10"), nums.digit_product(pair).alias("product10"),
    )


@query("messy_numbers", """WITH v AS (SELECT trail_id, stop_index, extracted_value AS n, l_suppkey % 14 AS k FROM stops_v)
SELECT trail_id, stop_index, CASE WHEN k IN (0, 1, 2, 3, 4, 5, 8, 10) THEN n::DOUBLE WHEN k = 6 THEN n * 1000000.0 WHEN k = 7 THEN n / 12.0 WHEN k = 9 THEN n + 0.5
  WHEN k = 11 THEN 12.0 WHEN k = 12 THEN NULL ELSE n + 0.25 END::DOUBLE AS number FROM v""")
def messy_numbers(spark, sf):
    n, k = F.col("extracted_value").cast("string"), F.col("l_suppkey") % 14
    grouped = F.format_number(F.col("extracted_value"), 0)
    texts = [
        F.concat(F.lit("about "), grouped), F.concat(F.lit("$"), n), F.concat(n, F.lit(" km")), F.concat(grouped, F.lit("+")),
        F.concat(grouped, F.lit(" lb (1,810 kg)")), F.concat(F.lit("c. "), n), F.concat(n, F.lit(" million")), F.concat(n, F.lit("/12")),
        F.concat(n, F.lit("–999999 acres")), F.concat(n, F.lit("½")), F.concat(n, F.lit(" people in all")), F.lit(" Twelve "), F.lit("Old Harbour"),
        F.concat(F.lit("over "), n, F.lit(".25%")),
    ]
    s = views.stops(spark, sf)
    text = F.coalesce(*[F.when(k == i, t) for i, t in enumerate(texts)])
    return s.select("trail_id", "stop_index", text.alias("text")).select("trail_id", "stop_index", vals.parse_number(F.col("text")).alias("number"))


@query("free_dates", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_custkey % 9 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1, 2, 3) THEN d WHEN k = 4 THEN make_date(year(d), 1, 1) ELSE NULL END AS day FROM o""")
def free_dates(spark, sf):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_custkey") % 9
    year = F.year(d).cast("string")
    texts = [
        F.concat(F.lit("on "), d.cast("string"), F.lit(" at noon")), F.date_format(d, "d MMMM yyyy"), F.date_format(d, "MMMM d, yyyy"),
        F.concat(F.lit("["), F.date_format(d, "MMMM d yyyy"), F.lit("](/wiki/Day)")), F.concat(F.lit("in "), year), F.concat(year, F.lit("–2010")),
        F.concat(year, F.lit("s")), F.concat(year, F.lit(" BC")), F.lit("long ago"),
    ]
    text = F.coalesce(*[F.when(k == i, t) for i, t in enumerate(texts)])
    return views.load(spark, sf, "orders").select("o_orderkey", vals.parse_date(text).alias("day"))


@query("integer_views", """SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(trunc(p_retailprice * 1000) AS BIGINT) AS grouped, NULL::BIGINT AS none FROM part""")
def integer_views(spark, sf):
    price = F.col("p_retailprice")
    return views.load(spark, sf, "part").select(
        "p_partkey", vals.int_view(price.cast("string")).alias("whole"),
        vals.int_view(F.format_number(price * 1000, 3)).alias("grouped"), vals.int_view(F.col("p_name")).alias("none"),
    )


@query("value_compare", """WITH v AS (SELECT trail_id, stop_index, extracted_value AS n, l_suppkey % 6 AS k FROM stops_v)
SELECT trail_id, stop_index, CASE k WHEN 0 THEN true WHEN 1 THEN n = 0 OR n * 0.005 / greatest(n, 1) < 0.01 WHEN 2 THEN CASE WHEN n = 0 THEN true ELSE abs(n * 1.02 - n) / greatest(n, 1) < 0.01 END
  WHEN 3 THEN true WHEN 4 THEN false ELSE true END AS near FROM v""")
def value_compare(spark, sf):
    n, k = F.col("extracted_value"), F.col("l_suppkey") % 6
    s = n.cast("string")
    a = F.when(k == 0, s).when(k == 1, (n * 1.005).cast("string")).when(k == 2, (n * 1.02).cast("string")).when(k == 3, F.lit(" Bay ")).when(k == 4, F.lit(None))
    b = F.when(k == 3, F.lit("Bay")).when(k == 5, F.lit(None)).otherwise(s)
    pairs = views.stops(spark, sf).select("trail_id", "stop_index", a.alias("a"), b.alias("b"))
    return pairs.select("trail_id", "stop_index", vals.close(F.col("a"), F.col("b")).alias("near"))
