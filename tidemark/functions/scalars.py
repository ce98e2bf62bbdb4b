"""Scalar helpers: times as text, indicators and typed views of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(time: str | Column) -> Column:
    return F.date_format(time, STAMP)


def day_of(text: Column) -> Column:
    """The date of a ``yyyy-MM-dd HH:mm:ss`` text, as text; null where it is no time."""
    return F.date_format(F.try_to_timestamp(text, F.lit(STAMP)), "yyyy-MM-dd")


def date_part(text: Column) -> Column:
    """What stands before the first space."""
    return F.split(text, " ")[0]


def time_of(text: Column) -> Column:
    """A time without zone from text; null where it is none."""
    return F.try_to_timestamp(text, F.lit(STAMP)).cast("timestamp_ntz")


def seconds_time(ms: Column) -> Column:
    """Whole seconds of a count of milliseconds, as a time."""
    return F.timestamp_seconds(F.floor(ms / 1000))


def to_millis(text: Column) -> Column:
    """Milliseconds since 1970 of a time or a date in text, in the session's zone."""
    return F.unix_millis(F.coalesce(F.try_to_timestamp(text, F.lit(STAMP)), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def day_number(time: Column) -> Column:
    """yyyyMMdd as an integer."""
    return F.date_format(time, "yyyyMMdd").cast("int")


def money(text: str | Column) -> Column:
    """An amount in text as a decimal, 0 where there is none."""
    return F.coalesce(F.expr(f"try_cast({text} AS DECIMAL(18,2))") if isinstance(text, str) else text.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def total(amount: Column) -> Column:
    """A sum of decimals as a double."""
    return F.sum(amount).cast("double")


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("long")


def instant(text: Column) -> Column:
    """A time of text with any number of fraction digits; what is no time comes before all others."""
    return F.coalesce(F.try_to_timestamp(text), F.lit("0001-01-01").cast("timestamp"))


def latest_of(a: Column, b: Column) -> Column:
    """The later of two times in text, compared as times whatever their fraction digits."""
    return F.when(instant(a) >= instant(b), a).otherwise(b)


def snake_to_camel(name: str) -> str:
    first, *rest = name.lower().split("_")
    return first + "".join(w.capitalize() for w in rest)


def as_beans(rows: DataFrame) -> DataFrame:
    """The same rows with names in camel case, as services want them."""
    return rows.toDF(*[snake_to_camel(c) for c in rows.columns])


def stamped(rows: DataFrame, as_of_ms: int) -> DataFrame:
    """Rows with ``ts``, the wall clock in ms at which they were made; it is a parameter, so that a run can be repeated."""
    return rows.withColumn("ts", F.lit(as_of_ms).cast("long"))
