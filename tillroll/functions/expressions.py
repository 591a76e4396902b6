"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip removes (Unicode white space and the four
# ASCII separators); Spark's one-argument trim removes blanks only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


# Fixed value: names of the days in calendar order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def strip(col: Column | str) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.btrim(col, F.lit(WHITESPACE))


def holds(predicate: Column) -> Column:
    """Predicate as a two-valued flag: unknown counts as false."""
    return F.coalesce(predicate, F.lit(False))


def month_of(col: Column | str) -> Column:
    """First day of the month, as a date."""
    return F.trunc(col, "MM")


def iso_weekday(col: Column | str) -> Column:
    """Monday is 1, Sunday is 7."""
    return (F.weekday(col) + 1).cast("int")


def weekday_name(col: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in WEEKDAYS]), F.weekday(col) + 1)


def minutes_between(earlier: Column | str, later: Column | str) -> Column:
    """Difference of two times in minutes, free of the session's time zone."""
    gap = (F.col(later) if isinstance(later, str) else later) - (
        F.col(earlier) if isinstance(earlier, str) else earlier
    )
    part = lambda unit: F.extract(F.lit(unit), gap).cast("double")
    return part("DAY") * 1440 + part("HOUR") * 60 + part("MINUTE") + part("SECOND") / 60


def money(col: Column, digits: int = 2) -> Column:
    """Exact decimal amount rounded half up."""
    return F.round(col.cast("decimal(38,4)"), digits)


def quotient(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """Rounded ratio; a zero denominator gives NULL.

    The ratio is a double brought to ten decimals before it is rounded, so that ties
    such as 5.005 round up as in exact decimal arithmetic.
    """
    ratio = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.round(ratio.cast("decimal(38,10)"), digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return quotient(part.cast("double") * 100, whole, digits)
