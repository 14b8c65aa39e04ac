"""Number and value semantics: lenient parsing, tolerance compare, half-even rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import strip

INT = r"^[+-]?\d+(_\d+)*$"
FLOAT = r"^[+-]?(\d+(_\d+)*(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate value, so that using it several times does not copy its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def to_float(text: Column) -> Column:
    """Text to DOUBLE the way a float constructor reads it; null when it is no number."""

    def read(t: Column) -> Column:
        plain = F.when(F.rlike(t, F.lit(FLOAT)), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
        low = F.lower(t)
        special = F.when(
            F.rlike(t, F.lit(SPECIAL)),
            F.when(F.contains(low, F.lit("nan")), F.lit(float("nan")))
            .when(F.startswith(low, F.lit("-")), F.lit(float("-inf")))
            .otherwise(F.lit(float("inf"))),
        )
        return F.coalesce(plain, special)

    return let(strip(text), read)


def to_int(text: Column) -> Column:
    """Text to BIGINT the way an int constructor reads it."""
    return let(
        strip(text),
        lambda t: F.when(F.rlike(t, F.lit(INT)), F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint")),
    )


def whole(x: Column) -> Column:
    """DOUBLE to BIGINT, cut towards zero; null for NaN and infinities."""
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(9.2e18))
    return F.when(finite, x.cast("bigint"))


def int_view(value: Column) -> Column:
    """Integer view of a text value: commas out, float, cut to an integer."""
    return whole(to_float(F.replace(value, F.lit(","), F.lit(""))))


def round_even(x: Column, digits: int) -> Column:
    """Round half to even on the exact binary value."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double")


def fixed_point(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, no grouping."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def share(part: Column, total: Column, digits: int = 3) -> Column:
    """Rounded part / total; null when the total is zero."""
    return F.when(total > 0, round_even(part / total, digits))


def number_text(x: Column) -> Column:
    """Text of a number, without a decimal part where it is whole."""
    return F.when(x == whole(x).cast("double"), whole(x).cast("string")).otherwise(x.cast("string"))


def close(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Tolerance compare of two text values; two nulls are close, one null is not.

    Numbers: ``|a-b| / max(|b|, 1) < tolerance`` (b = 0 needs a = 0). Others: equal when stripped.
    """
    fa, fb = to_float(a), to_float(b)

    def judge(p: Column) -> Column:
        x, y = p["x"], p["y"]
        numeric = F.when(y == 0, x == 0).otherwise(F.abs(x - y) / F.greatest(F.abs(y), F.lit(1.0)) < tolerance)
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(
            x.isNotNull() & y.isNotNull(), numeric & ~F.isnan(x) & ~F.isnan(y)
        ).otherwise(strip(a) == strip(b))

    return let(F.struct(fa.alias("x"), fb.alias("y")), judge)


_QUALIFIER = r"(?Ui)^(about|approximately|around|over|nearly|more than|no more than|at least|up to|~|>|<|≈)\s*"
_UNIT = (
    r"(?Ui)\s*(mm|cm|km|m|kg|lb|lbs|rpm|mph|kph|ft|in|oz|acres?|mi|°[CF]?|%|speakers?|languages?"
    r"|minutes?|hours?|days?|years?|g/m2|g·mol−1|mol|g|ha|km²|m²|sq\s*mi|sq\s*km)\s*$"
)
_SPAN = r"(?Us)^([0-9,.]+)\s*[–\-]\s*[0-9,.]+.*$"
_MAGNITUDE = r"(?Ui)^([0-9,.]+)\s+(thousand|million|billion|trillion)"


def parse_number(text: Column) -> Column:
    """Number in a messy text as DOUBLE, else null.

    The order of the attempts is the meaning: fraction signs, simple fraction, first end of a
    span, magnitude word, plain number, leading number, number word.
    """
    s = F.regexp_replace(strip(text), _QUALIFIER, "")
    s = F.regexp_replace(s, r"(?U)^ca?\.[\s ]*", "")
    s = F.translate(s, "  ", "  ")
    s = F.regexp_replace(s, r"^[$£€¥₹₩]", "")
    s = F.regexp_replace(s, r"(?U)\+\s*$", "")
    s = F.regexp_replace(s, r"(?Us)^\s*([^(]*?)\s*\(.*$", "$1")

    def after_unit(t: Column) -> Column:
        r = F.regexp_replace(t, _UNIT, "")
        return F.when(r != "", r).otherwise(t)

    def attempts(t: Column) -> Column:
        fractions = []
        for sign, part in fixed.FRACTIONS.items():
            head = F.substring_index(t, sign, 1)
            base = F.when(strip(head) == "", F.lit(0.0)).otherwise(to_float(head))
            fractions.append(F.when(F.contains(t, F.lit(sign)), base + F.lit(part)))
        ratio = r"(?U)^\s*([0-9]+)\s*/\s*([0-9]+)\s*$"
        num = F.regexp_extract(t, ratio, 1).try_cast("double")
        den = F.regexp_extract(t, ratio, 2).try_cast("double")
        simple = F.when(F.rlike(t, F.lit(ratio)) & (den != 0), num / den)
        return F.coalesce(*fractions, simple, let(F.regexp_replace(t, _SPAN, "$1"), tail))

    def tail(t: Column) -> Column:
        base = to_float(F.replace(F.regexp_extract(t, _MAGNITUDE, 1), F.lit(","), F.lit("")))
        word = F.lower(F.regexp_extract(t, _MAGNITUDE, 2))
        factor = F.coalesce(*[F.when(word == w, F.lit(float(m))) for w, m in fixed.MAGNITUDES.items()])
        return F.coalesce(base * factor, let(F.replace(t, F.lit(","), F.lit("")), plain))

    def plain(t: Column) -> Column:
        lead = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*)", 1)
        return F.coalesce(
            F.when(F.contains(t, F.lit(".")), to_float(t)).otherwise(
                F.when(F.rlike(strip(t), F.lit(INT)), to_float(t))
            ),
            to_float(lead),
        )

    low = F.lower(strip(text))
    word = F.coalesce(*[F.when(low == w, F.lit(float(v))) for w, v in fixed.NUMBER_WORDS.items()])
    return F.coalesce(let(let(s, after_unit), attempts), word)


def first_number(text: Column) -> Column:
    """First number in a text after unwrapping links; null when it has no digit."""
    unlinked = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    hit = F.regexp_extract(unlinked, r"[-+]?[\d,]+\.?\d*", 0)
    return F.when(hit != "", to_float(F.replace(hit, F.lit(","), F.lit(""))))


def parse_date(text: Column) -> Column:
    """DATE in a free text; null for eras, spans of years and decades."""
    t = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    month = "(" + "|".join(fixed.MONTHS) + ")"

    def read(t: Column) -> Column:
        unusable = (
            F.rlike(t, F.lit(r"(?i)\b(BC|BCE|AD|CE|century|centuries|era)\b"))
            | F.rlike(t, F.lit(r"\d{4}\s*[–—-]\s*\d{4}"))
            | F.rlike(t, F.lit(r"\d{4}s\b"))
        )
        iso = F.try_to_date(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
        dmy = rf"(\d{{1,2}})\s+{month}\s+(\d{{4}})"
        mdy = rf"{month}\s+(\d{{1,2}}),?\s+(\d{{4}})"

        def on_day(p: str, d: int, m: int) -> Column:
            parts = [F.regexp_extract(t, p, g) for g in (d, m, 3)]
            return F.when(F.rlike(t, F.lit(p)), F.try_to_date(F.concat_ws(" ", *parts), "d MMMM yyyy"))

        spelled = F.when(F.rlike(t, F.lit(dmy)), on_day(dmy, 1, 2)).otherwise(on_day(mdy, 2, 1))
        year = F.try_to_date(F.regexp_extract(t, r"\b(1[89]\d{2}|20[0-2]\d)\b", 1), "yyyy")
        return F.when(~unusable, F.coalesce(iso, spelled, year))

    return let(t, read)


def iso_date(text: Column) -> Column:
    """DATE of a text that is exactly ``YYYY-MM-DD``."""
    return F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(text, "yyyy-MM-dd"))


def trading_day(day: Column) -> Column:
    """Saturday and Sunday become the Friday before."""
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def is_weekend(day: Column) -> Column:
    return F.coalesce(F.weekday(day) >= 5, F.lit(False))
