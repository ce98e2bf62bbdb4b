"""Batch closed forms of the keyed state machines: each is a window over (key, time, sequence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flag


def repair_new_visitors(pages: DataFrame) -> DataFrame:
    """``is_new`` = 1 only on the first day of a visitor: the first row fixes the day, or the day before if it isn't new."""
    first = Window.partitionBy("mid").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    day = F.to_date("rt")
    since = F.first(F.when(F.col("is_new") == "1", day).otherwise(F.date_sub(day, 1))).over(first)
    return pages.withColumn("is_new", F.when((F.col("is_new") == "1") & (day != since), "0").otherwise(F.col("is_new")))


def first_days(pages: DataFrame) -> DataFrame:
    """(mid, since): the day since when each visitor is known, by a minimum that is combined before the shuffle."""
    first = F.min(F.struct("ts", "seq", "is_new", F.to_date("rt").alias("day")))
    return pages.groupBy("mid").agg(first.alias("f")).select("mid", F.when(F.col("f.is_new") == "1", F.col("f.day")).otherwise(F.date_sub("f.day", 1)).alias("since"))


def repair_by(pages: DataFrame, known: DataFrame) -> DataFrame:
    """As :func:`repair_new_visitors`, by a join with ``known`` (see :func:`first_days`), which a warehouse keeps as a table.

    No visitor's rows meet in one task: Spark broadcasts the days where they are few and splits a busy visitor otherwise. With
    days made of the same pages they are read twice, so the window form is the shorter way where no visitor is that busy.
    """
    since = known.select(F.col("mid").alias("_mid"), F.col("since").alias("_since"))
    told = pages.join(since, F.col("mid").eqNullSafe(F.col("_mid")), "left")
    repaired = F.when((F.col("is_new") == "1") & (F.to_date("rt") != F.col("_since")), "0").otherwise(F.col("is_new"))
    return told.withColumn("is_new", repaired).drop("_mid", "_since")


def first_of(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key. Spark limits the groups before the shuffle, so a hot key sends few rows."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_of_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``, which names descending columns; ties go to what they leave first."""
    return first_of(rows, keys, order)


def entries(pages: DataFrame) -> DataFrame:
    return pages.where("last_page_id IS NULL")


def unique_visitors(pages: DataFrame) -> DataFrame:
    """The first entry page of each visitor on each day."""
    return first_of(entries(pages), ["mid", F.to_date("rt")], ["ts", "seq"])


def bounces(pages: DataFrame, within_seconds: int = 10) -> DataFrame:
    """Entry pages that no other page follows in time: the next page is missing, is an entry too, or is too late."""
    by = Window.partitionBy("mid").orderBy("ts", "seq")
    next_ts, next_last = F.lead("ts").over(by), F.lead(F.struct("last_page_id")).over(by)
    alone = next_ts.isNull() | next_last["last_page_id"].isNull() | (next_ts - F.col("ts") >= within_seconds * 1000)
    return pages.withColumn("_alone", alone).where("last_page_id IS NULL AND _alone").drop("_alone")


def visit_flags(pages: DataFrame, within_seconds: int = 10) -> DataFrame:
    """Every page view with what it is: a visitor's first entry of the day (uv), an entry (sv), a bounce (uj).

    The rows of :func:`unique_visitors` and :func:`bounces`, but all windows are over the visitor, so one shuffle serves them.
    """
    entry = F.col("last_page_id").isNull()
    by = Window.partitionBy("mid").orderBy("ts", "seq")
    nth = F.row_number().over(Window.partitionBy("mid", F.to_date("rt"), entry).orderBy("ts", "seq"))
    next_ts, next_last = F.lead("ts").over(by), F.lead(F.struct("last_page_id")).over(by)
    alone = next_ts.isNull() | next_last["last_page_id"].isNull() | (next_ts - F.col("ts") >= within_seconds * 1000)
    return pages.withColumns({"uv": flag(entry & (nth == 1)), "sv": flag(entry), "uj": flag(entry & alone)})


def home_detail_flags(pages: DataFrame) -> DataFrame:
    """Rows that are a visitor's first of the day on the home page or on a detail page, with a flag for each."""
    firsts = first_of(pages.where(F.col("page_id").isin("home", "good_detail")), ["mid", "page_id", F.to_date("rt")], ["ts", "seq"])
    return firsts.withColumns({"home_uv": flag(F.col("page_id") == "home"), "detail_uv": flag(F.col("page_id") == "good_detail")})


def logins(pages: DataFrame, away_days: int = 8) -> DataFrame:
    """A user's first login of each day, and whether they come back after ``away_days`` or more."""
    logged = pages.where("uid IS NOT NULL AND (last_page_id IS NULL OR last_page_id = 'login')")
    firsts = first_of(logged, ["uid", F.to_date("rt")], ["ts", "seq"])
    gap = F.datediff(F.to_date("rt"), F.lag(F.to_date("rt")).over(Window.partitionBy("uid").orderBy("ts", "seq")))
    return firsts.withColumn("back", flag(gap >= away_days))


#: Parts over which the rows of a user that are no day's first are spread while first days are looked for.
SALTS = 1024


def unique_and_new(rows: DataFrame, user: str, day: Column, order: list[str | Column]) -> DataFrame:
    """Flags on every row: the user's first of the day, and the first ever.

    First come the firsts of (user, day), so a busy user spreads over their days; then only these, a row for each day, meet by user, while
    all other rows go anywhere.
    """
    daily = F.row_number().over(Window.partitionBy(user, "_day").orderBy(*order))
    told = rows.withColumn("_day", day).withColumn("_daily", daily)
    told = told.withColumn("_salt", F.when(F.col("_daily") == 1, 0).otherwise(1 + F.pmod(F.xxhash64("_day", "_daily"), F.lit(SALTS))))
    ever = F.row_number().over(Window.partitionBy(user, "_salt").orderBy("_day"))
    return told.withColumns({"unique_user": flag(F.col("_daily") == 1), "new_user": flag((F.col("_salt") == 0) & (ever == 1))}).drop("_day", "_daily", "_salt")
