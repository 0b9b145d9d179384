"""Months and instants over columns. A month is text, yyyy-MM, so it sorts and compares as it stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the months in the report.
MONTHS = ["Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь"]


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_label(month: Column) -> Column:
    names = F.array(*map(F.lit, MONTHS))
    return F.concat(F.element_at(names, F.substring(month, 6, 2).cast("int")), F.lit(" "), F.substring(month, 1, 4))


def month_of_label(label: Column, fallback_year: int) -> Column:
    """The month of 'Июль 2026', or of 'Июль' in the year given."""
    lower = F.lower(F.trim(label))
    place = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.regexp_extract(lower, r"^([^ 0-9]+)", 1))
    year = F.regexp_extract(lower, r"(\d{4})$", 1)
    return F.when((place > 0) & lower.rlike(r"^[^ 0-9]+( +\d{4})?$"), F.concat(F.when(year == "", str(fallback_year)).otherwise(year), F.lit("-"), F.lpad(place.cast("string"), 2, "0")))


def next_month(month: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), 1), "yyyy-MM")


def instant(text: Column) -> Column:
    """An ISO instant, or null."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))
