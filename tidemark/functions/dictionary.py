"""Words of a dictionary inside texts, overlapping ones included: an automaton where the dictionary is small, a join where it isn't."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of dictionary up to which every executor gets the automaton.
SENT_BYTES = 16_000_000
WORDS = "array<struct<word:string,start:int>>"


class Automaton:
    """A trie whose nodes know the longest other way to stand where they stand, so that a text is read once for all words."""

    def __init__(self, words: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for word in words:
            at = 0
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({}), self.word.append(None)
                at = self.next[at][c]
            if word:
                self.word[at] = word
        self.back, self.shorter = [0] * len(self.next), [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            at = waiting.popleft()
            for c, child in self.next[at].items():
                self.back[child] = self._step(self.back[at], c)
                waiting.append(child)
            behind = self.back[at]
            self.shorter[at] = behind if self.word[behind] is not None else self.shorter[behind]

    def _step(self, at: int, c: str) -> int:
        while at and c not in self.next[at]:
            at = self.back[at]
        return self.next[at].get(c, 0)

    def find(self, text: str | None) -> list[tuple[str, int]]:
        """Every occurrence of every word, as (word, start), by its end and then the longest first."""
        out, at = [], 0
        for i, c in enumerate(text or ""):
            at = self._step(at, c)
            node = at if self.word[at] is not None else self.shorter[at]
            while node:
                out.append((self.word[node], i + 1 - len(self.word[node])))
                node = self.shorter[node]
        return out


def dictionary_words(rows: DataFrame, dictionary: DataFrame, text: str, word: str = "word", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows once for each dictionary word in their text, with ``word`` and ``start`` (from 0, in code points).

    Rows without any, and null texts, go. The dictionary's bytes are summed up first: up to ``sent_bytes`` it goes to the
    executors as an :class:`Automaton`; beyond that the texts' substrings of the lengths that its words have are joined with it, which is
    shuffled work, but of any size. Both give the same rows.
    """
    words = dictionary.select(F.col(word).alias("word")).where("word <> ''").distinct()
    if (words.agg(F.sum(F.octet_length("word"))).first()[0] or 0) <= sent_bytes:
        sent = rows.sparkSession.sparkContext.broadcast(Automaton([r.word for r in words.collect()]))

        @F.pandas_udf(WORDS)
        def find(texts: pd.Series) -> pd.Series:
            return pd.Series([[{"word": w, "start": s} for w, s in sent.value.find(t)] for t in texts], dtype=object)

        found = rows.withColumn("_w", F.explode(find(text)))
        return found.select(*rows.columns, F.col("_w.word").alias("word"), F.col("_w.start").alias("start"))
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())  # as many as there are lengths of words
    place = F.explode(F.sequence(F.lit(1), F.length(text)))
    parts = rows.where(F.length(text) > 0).withColumn("_p", place).withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths])))
    parts = parts.where(F.col("_p") + F.col("_n") - 1 <= F.length(text)).withColumn("_w", F.substring(F.col(text), F.col("_p"), F.col("_n")))
    return parts.join(words, F.col("_w") == F.col("word")).select(*rows.columns, "word", (F.col("_p") - 1).cast("int").alias("start"))
