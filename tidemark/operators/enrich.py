"""Lookups: dictionary joins that drop, dimension joins that keep.

No hint here: Spark broadcasts a side whose size in bytes it knows to be under its threshold, when it plans or when
adaptive execution has seen it, and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, dictionary: DataFrame, code: str | Column, name: str) -> DataFrame:
    """Adds the name of a code; rows whose code the dictionary lacks go, as in an inner lookup join."""
    code = F.col(code) if isinstance(code, str) else code
    named = dictionary.select(F.col("dic_code").alias("_code"), F.col("dic_name").alias(name))
    return rows.join(named, code == F.col("_code"), "inner").drop("_code")


def enrich(rows: DataFrame, dimension: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Adds ``columns`` (name in the dimension -> new name) by ``key``; rows without a match stay, with nulls."""
    side = dimension.select(F.col("id").alias("_id"), *[F.col(a).alias(b) for a, b in columns.items()])
    return rows.join(side, F.col(key) == F.col("_id"), "left").drop("_id")

