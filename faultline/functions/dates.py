"""Column expressions over partial dates: a date with the precision to which it is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_or_null

PRECISIONS = ("day", "month", "year", "unknown")


def month_year_date(c: Column) -> Column:
    """The first day of the month that ``MON-YYYY`` names; null for other texts."""
    v = trim_or_null(c)
    shaped = F.regexp_like(v, F.lit(r"^[A-Za-z]{3}-[0-9]{4}$"))
    return F.when(shaped, F.try_to_date(F.concat(F.lit("01-"), v), "dd-MMM-yyyy"))


def parse_month_year(c: Column, date: Column | None = None) -> Column:
    """struct(date, precision, malformed) of ``MON-YYYY``: the month's first day, or unknown, flagged if not blank.

    ``date`` is :func:`month_year_date` of the text where a column holds it; otherwise it is parsed for each part that is asked for.
    """
    date = month_year_date(c) if date is None else date
    return F.struct(
        date.alias("date"),
        F.when(date.isNull(), "unknown").otherwise("month").alias("precision"),
        (trim_or_null(c).isNotNull() & date.isNull()).alias("malformed"),
    )


def legal_pair(date: Column, precision: Column) -> Column:
    """Whether date and precision fit: no date exactly when the precision is unknown."""
    return F.coalesce(precision.isin(*PRECISIONS) & (date.isNull() == (precision == "unknown")), F.lit(False))


def partial_date(date: Column, precision: Column) -> Column:
    """ISO text of a date to its precision; null when unknown."""
    return (
        F.when(precision == "day", F.date_format(date, "yyyy-MM-dd"))
        .when(precision == "month", F.date_format(date, "yyyy-MM"))
        .when(precision == "year", F.date_format(date, "yyyy"))
    )


def pin_to_period(date: Column, precision: Column) -> Column:
    """The first day of the period that a date stands for."""
    return (
        F.when(precision == "year", F.trunc(date, "year"))
        .when(precision == "month", F.trunc(date, "month"))
        .when(precision == "day", date)
    )


def partial_date_sort_key(date: Column, precision: Column) -> Column:
    """Start of the period as text; empty when unknown, so it comes last in descending order."""
    return F.coalesce(F.date_format(pin_to_period(date, precision), "yyyy-MM-dd"), F.lit(""))


def format_iso_date(c: Column) -> Column:
    """``17 May 2024`` of an ISO text; a text that is no ISO date stays as it is."""
    date = F.when(F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(c, "yyyy-MM-dd"))
    return F.coalesce(F.date_format(date, "d MMMM yyyy"), c)


def format_partial_date(date: Column, precision: Column, unknown: str | None = "Date unknown") -> Column:
    """``17 May 2024``, ``May 2024``, ``2024``, or the text for unknown."""
    return F.coalesce(
        F.when(precision == "day", F.date_format(date, "d MMMM yyyy"))
        .when(precision == "month", F.date_format(date, "MMMM yyyy"))
        .when(precision == "year", F.date_format(date, "yyyy")),
        F.lit(unknown),
    )
