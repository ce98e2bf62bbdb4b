"""Traffic and user plans over page views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import keywords
from ..operators import state
from ..operators.windows import tumble

CHANNEL = ["vc", "ch", "ar", "is_new"]


def page_view_window(pages: DataFrame, size: str = "10 seconds", bounce_seconds: int = 10, legacy_sv: bool = False) -> DataFrame:
    """Visitors, sessions, views, time on page and bounces by version, channel, area and newness.

    A bounce or a first visit counts where its page view does, however late it is known.
    ``legacy_sv`` counts a session for every view, as jobs did that looked for the last page in the wrong place.
    """
    rows = state.visit_flags(pages, bounce_seconds)
    rows = rows.withColumn("sv", F.lit(1).cast("long")) if legacy_sv else rows
    sums = [F.sum(a).cast("long").alias(b) for a, b in (("uv", "uv_ct"), ("sv", "sv_ct"), (F.lit(1), "pv_ct"), ("during_time", "dur_sum"), ("uj", "uj_ct"))]
    return tumble(rows, "rt", CHANNEL, sums, size)


def home_detail_window(pages: DataFrame, size: str = "10 seconds") -> DataFrame:
    sums = [F.sum("home_uv").alias("home_uv_ct"), F.sum("detail_uv").alias("good_detail_uv_ct")]
    return tumble(state.home_detail_flags(pages), "rt", [], sums, size)


def login_window(pages: DataFrame, size: str = "10 seconds") -> DataFrame:
    return tumble(state.logins(pages), "rt", [], [F.sum("back").alias("back_ct"), F.count(F.lit(1)).alias("uu_ct")], size)


def keyword_rows(pages: DataFrame) -> DataFrame:
    """Search words with their time. The words of an item are an exploded array: rows without words go."""
    searched = pages.where("item IS NOT NULL AND last_page_id = 'search' AND item_type = 'keyword'")
    return searched.select("rt", F.explode(keywords(F.col("item"))).alias("keyword"))


def keyword_window(pages: DataFrame, size: str = "10 seconds") -> DataFrame:
    """Search words by window."""
    out = tumble(keyword_rows(pages), "rt", ["keyword"], [F.count(F.lit(1)).alias("keyword_count")], size)
    return out.select("stt", "edt", F.lit("search").alias("source"), "keyword", "keyword_count")


def register_window(registered: DataFrame, size: str = "10 seconds") -> DataFrame:
    from ..functions.scalars import time_of

    rows = registered.withColumn("rt", time_of(F.col("create_time")))
    return tumble(rows, "rt", [], [F.count(F.lit(1)).alias("register_ct")], size)
