"""Keyword splitting: built-in functions by default, a table function for any other tokenizer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORDS = r"[^\W_]+"


def keywords(text: Column) -> Column:
    """The lower-case words of a text as an array, in the JVM; an exploded empty array drops the row."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def simple_tokenizer(text: str) -> list[str]:
    return [w.lower() for w in re.findall(WORDS, text)]


def register_splitter(spark: SparkSession, name: str = "split_words", tokenizer: Callable[[str], list[str]] = simple_tokenizer) -> None:
    """Registers ``SELECT … FROM t, LATERAL name(t.text)``, a row (word) for each token.

    A tokenizer that fails on a text gives the whole text as one word; null gives no rows.
    """

    class Split:
        def eval(self, text: str | None) -> Iterator[tuple[str]]:
            if text is None:
                return
            try:
                words = tokenizer(text)
            except OSError:
                words = [text]
            for word in words:
                yield (word,)

    spark.udtf.register(name, F.udtf(Split, returnType="word string"))
