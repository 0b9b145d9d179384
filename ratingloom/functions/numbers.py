"""Numbers in text, ratings and identifiers, over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def rating_hundredths(total_hundredths: Column, n: Column, scale: int) -> Column:
    """Mean of n values on 0..scale as hundredths of 0..5, half up; exact, as everything is a whole number."""
    return F.least(F.lit(500), F.greatest(F.lit(0), F.expr("0") + ((total_hundredths * 10 + n * scale) / (n * 2 * scale)).cast("long")))


def rating_to_five(value: Column, scale: Column) -> Column:
    """One value on 0..scale as 0..5 with two places, half up; null unless the scale is positive and both are finite."""
    ok = (scale > 0) & ~F.isnan(value) & (F.abs(value) < F.lit(1e12)) & (F.abs(scale) < F.lit(1e12))
    exact = (value.cast("decimal(20,6)") * 5 / scale.cast("decimal(20,6)")).cast("decimal(30,12)")
    return F.when(ok, F.round(F.greatest(F.lit(0), F.least(F.lit(5), exact)), 2).cast("decimal(3,2)"))


def rating_text(value: Column) -> Column:
    """As many places as the value has, at most two, with a comma; a dash for null."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value.cast("double")), "0+$", ""), r"\.$", "")
    return F.when(value.isNull(), "—").otherwise(F.replace(text, F.lit("."), F.lit(",")))


def plain_number(text: Column) -> Column:
    """A number that fills the text: spaces group digits, comma or point parts decimals; else null."""
    squeezed = F.replace(F.regexp_replace(text, r"[\s ]+", ""), F.lit(","), F.lit("."))
    return let(squeezed, lambda t: F.when(t.rlike(r"^-?\d+([.]\d+)?$"), t.cast("double")))


def number_in(text: Column) -> Column:
    """The first number in the text."""
    found = F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(".")).cast("double"))


def strict_count(text: Column) -> Column:
    """A count written as digits alone."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^\d{1,9}$"), trimmed.cast("int"))


def strict_rating(text: Column) -> Column:
    return let(plain_number(text), lambda value: F.when(value.between(0, 5), value))


def compact_count(text: Column) -> Column:
    """'1,2 тыс', '3k', '2 млн' as whole numbers."""
    number = lambda lower: F.replace(F.regexp_extract(lower, r"^(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit("."))
    unit = lambda lower: F.regexp_extract(lower, r"^\d+(?:[.,]\d+)?\s*([a-zа-я]*)", 1)
    times = lambda u: F.when(u.isin("тыс", "k", "к"), 1000).when(u.isin("млн", "m", "м"), 1_000_000).when(u == "", 1)
    value = lambda lower: let(number(lower), lambda n: F.when(n != "", F.round(n.cast("decimal(18,6)") * let(unit(lower), times), 0).cast("long")))
    return let(F.lower(F.trim(text)), value)


def score_and_count(text: Column) -> Column:
    """'4,8 • 123 отзыва' as (rating, count)."""
    rating = F.replace(F.regexp_extract(text, r"^\s*(\d(?:[.,]\d{1,2})?)\s*[•·]", 1), F.lit(","), F.lit("."))
    count = F.regexp_replace(F.regexp_extract(text, r"[•·]\s*(\d[\d\s ]*)", 1), r"[\s ]+", "")
    return F.struct(F.when(rating != "", rating.cast("decimal(3,2)")).alias("rating"), F.when(count != "", count.cast("long")).alias("count"))


def sku(text: Column) -> Column:
    """Digits without spaces and leading zeros; null for anything else and for zero."""
    digits = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "^0+", "")
    return F.when(digits.rlike(r"^\d{1,18}$"), digits)


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Place among ascending upper bounds, from 1; one more than their number beyond the last."""
    out = F.lit(len(bounds) + 1)
    for i, bound in reversed(list(enumerate(bounds, 1))):
        out = F.when(value <= bound, i).otherwise(out)
    return out


#: Milligrams in a unit of mass.
UNITS = {"мкг": 0.001, "мг": 1.0, "г": 1000.0, "гр": 1000.0}


def micrograms(number: Column, unit: Column) -> Column:
    factor = F.when(unit == "мкг", 1).when(unit == "мг", 1000).when(unit.isin("г", "гр"), 1_000_000)
    return (number.cast("decimal(18,4)") * factor).cast("long")


def mass_text(ug: Column) -> Column:
    """Milligrams, micrograms below one, without trailing zeros."""
    mg = F.regexp_replace(F.regexp_replace(F.format_string("%d.%03d", (ug / 1000).cast("long"), F.pmod(ug, F.lit(1000))), "0+$", ""), r"\.$", "")
    return F.when(ug < 1000, F.concat(ug.cast("string"), F.lit(" мкг"))).otherwise(F.concat(F.replace(mg, F.lit("."), F.lit(",")), F.lit(" мг")))


def backoff(attempt: Column, base: int, cap: int) -> Column:
    """Delay before an attempt: base times three to the power of those before, at most cap."""
    return F.least(F.lit(cap), (F.lit(base) * F.pow(F.lit(3), F.least(attempt - 1, F.lit(20)))).cast("long"))


def percent(part: Column, total: Column) -> Column:
    """Whole percent, half up; an empty total counts as one."""
    whole = F.greatest(total, F.lit(1))
    return ((part * 200 + whole) / (whole * 2)).cast("long")
