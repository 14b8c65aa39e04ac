"""Integer and text transforms of the reason, tool and compute stops."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from waymark import fixed
from waymark.functions.values import let

_WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
_MOST = 2**63 - 1


def _is_prime(n: int) -> bool:
    """Strong-probable-prime tests to the first twelve prime bases, which decide every 64-bit integer."""
    if n < 2:
        return False
    for p in _WITNESSES:
        if n % p == 0:
            return n == p
    s = ((n - 1) & -(n - 1)).bit_length() - 1
    for a in _WITNESSES:
        x = pow(a, (n - 1) >> s, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _split(n: int) -> int:
    """A proper divisor of an odd composite n, by Pollard's rho with differences gathered before each gcd."""
    for c in range(1, n):
        x = y = 2
        q, divisor = 1, 1
        while divisor == 1:
            start = x, y
            for _ in range(128):
                x = (x * x + c) % n
                y = (y * y + c) % n
                y = (y * y + c) % n
                q = q * abs(x - y) % n
            divisor = math.gcd(q, n)
        if divisor == n:  # too many at once: again one by one
            x, y = start
            divisor = 1
            while divisor == 1:
                x = (x * x + c) % n
                y = (y * y + c) % n
                y = (y * y + c) % n
                divisor = math.gcd(abs(x - y), n)
        if divisor != n:
            return divisor
    raise ValueError(n)


def _factors(n: int) -> list[int]:
    """Prime factors with repeats, ascending; none below 2."""
    out = []
    for p in _SMALL:
        while n % p == 0 and n > 1:
            out.append(p)
            n //= p
        if p * p > n:
            break
    rest = [n] if n > 1 else []
    while rest:
        m = rest.pop()
        if _is_prime(m):
            out.append(m)
        else:
            d = _split(m)
            rest += [d, m // d]
    return sorted(out)


_SMALL = [p for p in range(2, 1000) if all(p % d for d in range(2, int(p**0.5) + 1))]


def _each(f: Callable[[int], object], values: pd.Series) -> pd.Series:
    """``f`` once per distinct value; null stays null."""
    known = {v: f(int(v)) for v in values.dropna().unique()}
    return pd.Series([None if pd.isna(v) else known[v] for v in values], dtype=object)


def _next(n: int) -> int | None:
    c = max(2, n + 1)
    while c <= _MOST and not _is_prime(c):
        c += 1 + (c > 2 and c % 2)
    return c if c <= _MOST else None


@F.pandas_udf(LongType())
def _next_prime(n: pd.Series) -> pd.Series:
    return _each(_next, n.astype("Int64"))


_FACTS = ("divisors", "prime_sum", "largest", "largest_once")


def _facts_of(n: int) -> tuple[int | None, ...]:
    if n < 1:
        return (0 if n == 0 else None, 0, n, n)
    found = Counter(_factors(n))
    top = max(found, default=n)
    return math.prod(k + 1 for k in found.values()), sum(found), top, 1 if found[top] > 1 else top


@F.pandas_udf(StructType([StructField(name, LongType()) for name in _FACTS]))
def _factor_facts(n: pd.Series) -> pd.DataFrame:
    rows = _each(_facts_of, n.astype("Int64"))
    return pd.DataFrame({name: pd.array([None if r is None else r[i] for r in rows], dtype="Int64") for i, name in enumerate(_FACTS)})


def next_prime(n: Column) -> Column:
    """Smallest prime above n; 2 for n < 2; null above the last prime that fits a bigint."""
    return _next_prime(n.cast("bigint"))


def num_divisors(n: Column) -> Column:
    """0 for 0, null below."""
    return _factor_facts(n.cast("bigint"))["divisors"]


def sum_prime_factors(n: Column) -> Column:
    """Sum of the distinct prime factors."""
    return _factor_facts(n.cast("bigint"))["prime_sum"]


def largest_prime_factor(n: Column, strict: bool = False) -> Column:
    """Largest prime factor; n itself up to 1.

    By default a repeated largest factor (4, 9, 18) gives 1, which later steps reject as
    trivial; ``strict`` gives the factor itself.
    """
    return _factor_facts(n.cast("bigint"))["largest" if strict else "largest_once"]


def roman_length(n: Column) -> Column:
    """Length of the Roman numeral."""
    lengths = F.array(*[F.lit(x) for x in fixed.ROMAN_DIGIT_LENGTHS])

    def digit(power: int) -> Column:
        return F.get(lengths, F.pmod(F.floor(n / power), F.lit(10)).cast("int"))

    return (F.floor(n / 1000) + digit(100) + digit(10) + digit(1)).cast("bigint")


def one_bits(n: Column) -> Column:
    return F.bit_count(n).cast("bigint")


def reverse_digits(n: Column) -> Column:
    return F.reverse(n.cast("string")).try_cast("bigint")


def digital_root(n: Column) -> Column:
    return F.when(n == 0, F.lit(0)).otherwise(F.pmod(n - 1, F.lit(9)) + 1).cast("bigint")


def digit_sum(n: Column) -> Column:
    digits = F.regexp_extract_all(n.cast("string"), F.lit(r"\d"), 0)
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a + d.cast("bigint"))


def new_year_weekday(year: Column) -> Column:
    """ISO day of the week (1..7) of January 1st."""
    return (F.weekday(F.make_date(year.cast("int"), F.lit(1), F.lit(1))) + 1).cast("bigint")


def leap_years_to_2000(year: Column) -> Column:
    """Leap years between the year and 2000, both ends included."""

    def leaps(y: Column) -> Column:
        return F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)

    lo, hi = F.least(year, F.lit(2000)), F.greatest(year, F.lit(2000))
    return (leaps(hi) - leaps(lo - 1)).cast("bigint")


def scrabble_score(s: Column) -> Column:
    letters = F.upper(s)
    total = F.lit(0)
    for points, group in fixed.LETTER_POINTS.items():
        total = total + points * F.length(F.regexp_replace(letters, f"[^{group}]", ""))
    return total.cast("bigint")


def vowel_count(s: Column) -> Column:
    return F.length(F.regexp_replace(F.lower(s), "[^aeiou]", "")).cast("bigint")


def first_letter_position(s: Column) -> Column:
    """A = 1 ... Z = 26; other alphabets by code point distance; 0 for non-letters."""
    first = F.upper(F.substring(s, 1, 1))
    return F.when(F.rlike(first, F.lit(r"(?U)^\p{L}")), F.ascii(first) - 64).otherwise(F.lit(0)).cast("bigint")


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b)).cast("bigint")


def convert_unit(value: Column, factor: Column) -> Column:
    """value x factor, cut to an integer."""
    return (value * factor).cast("bigint")


def digit_digital_root(values: Column) -> Column:
    return digital_root(F.abs(F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)))


def digit_mod10(values: Column) -> Column:
    return F.pmod(F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v), F.lit(10))


def digit_abs_diff(values: Column) -> Column:
    return F.pmod(F.abs(F.get(values, 0) - F.get(values, 1)), F.lit(10))


def digit_product(values: Column) -> Column:
    return F.pmod(F.get(values, 0) * F.get(values, 1), F.lit(10))


def recompute(expression: Column) -> Column:
    """Value of a stored closed form, without running code; null for anything else.

    Forms: ``digital_root(a + b ...)``, ``(a + b ...) % 10``, ``abs(a - b) % 10``,
    ``(a * b) % 10``, ``int(x) + int(y)``, ``abs(int(x) - int(y))``.
    """
    e = F.regexp_replace(expression, r"\s+", "")
    num = r"-?\d+(?:\.\d+)?"
    plus = rf"{num}(?:\+{num})+"

    def read(e: Column) -> Column:
        def ints(text: Column) -> Column:
            found = F.regexp_extract_all(text, F.lit(rf"({num})"), 1)
            return F.transform(found, lambda x: x.try_cast("double").cast("bigint"))

        def form(pattern: str) -> Column:
            return F.rlike(e, F.lit(f"^{pattern}$"))

        inner = F.regexp_replace(e, r"%10$", "")
        # a minus sign between two numbers is an operator here, not part of the second number
        pair = ints(F.regexp_replace(inner, r"(?<=[\d)])-", " "))
        total = F.aggregate(ints(inner), F.lit(0).cast("bigint"), lambda a, v: a + v)
        return (
            F.when(form(rf"digital_root\({plus}\)"), digital_root(F.abs(total)))
            .when(form(rf"\({plus}\)%10"), F.pmod(total, F.lit(10)))
            .when(form(rf"abs\({num}-{num}\)%10"), F.pmod(F.abs(F.get(pair, 0) - F.get(pair, 1)), F.lit(10)))
            .when(form(rf"\({num}\*{num}\)%10"), F.pmod(F.get(ints(inner), 0) * F.get(ints(inner), 1), F.lit(10)))
            .when(form(rf"int\({num}\)\+int\({num}\)"), total)
            .when(form(rf"abs\(int\({num}\)-int\({num}\)\)"), F.abs(F.get(pair, 0) - F.get(pair, 1)))
        )

    return let(e, read)
