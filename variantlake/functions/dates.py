"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyyMMdd", "MMM d HH:mm:ss yyyy")


def parse_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A timestamp from the first format that fits, a name of a weekday before it ignored; NULL if none does."""
    text = F.regexp_replace(F.trim(c), "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? ", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def iso_date(c: Column) -> Column:
    """``yyyy-MM-dd`` where a date can be read, else the text as it is."""
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), c)


def display_date(c: Column) -> Column:
    """``02 March 2024``, else the text as it is."""
    return F.coalesce(F.date_format(parse_date(c), "dd MMMM yyyy"), c)


def release_date(c: Column) -> Column:
    return F.date_format(parse_date(c), "MMMM yyyy")


def hide_before(value: Column, source: Column, date: Column, cutoffs: dict[str, str]) -> Column:
    """NULL for values of a source dated before the source's cut-off."""
    early = [(source == s) & (date < F.lit(d).cast("timestamp")) for s, d in cutoffs.items()]
    hidden = early[0]
    for e in early[1:]:
        hidden = hidden | e
    return F.when(~F.coalesce(hidden, F.lit(False)), value)


def since(date: Column, floor: str) -> Column:
    """Whether a date is on or after ``floor``; rows without a date are not."""
    return F.coalesce(date >= F.lit(floor).cast("timestamp"), F.lit(False))


def year_or_unknown(c: Column) -> Column:
    return F.when(c.try_cast("int") == 0, "Unknown").otherwise(c)


def days_of_ages(df: DataFrame, youngest: Column, oldest: Column, today: Column, unit: str = "day") -> DataFrame:
    """One row per day (or year) of birth that people of these ages can have, as ``born``."""
    first, last = F.add_months(today, -12 * (oldest + 1)), F.add_months(today, -12 * youngest)
    step = F.expr(f"interval 1 {unit}")
    return df.withColumn("born", F.explode(F.sequence(F.date_add(first, 1), last, step)))
