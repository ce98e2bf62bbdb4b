"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct words a worker remembers, and the longest word it does so for.
CACHE_WORDS, CACHE_CHARS = 800_000, 48


class Ranks:
    """The merge ranks of a sentencepiece BPE model with byte fallback, and what each text costs.

    A piece holds the space mark only at its front, so no merge crosses from a word into the space
    before the next; a word's count then depends on nothing else and is remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        long = [p for p in self.rank if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            raise ValueError("pieces with a space mark inside need a split that this counter does not make")
        self.lines_apart = not any("\n" in p for p in long)
        self.marked: dict[str, int] = {}
        self.bare: dict[str, int] = {}

    def merge(self, symbols: str) -> int:
        """Tokens of one chunk: its symbols less the merges made, and more where a symbol falls back to bytes."""
        rank, n = self.rank, len(symbols)
        count = n
        for c in symbols:
            if c not in rank:
                count += len(c.encode()) - 1
        part: list[str] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank.get(symbols[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, left, right, size = heappop(heap)
            a, b = part[left], part[right]
            if not a or not b or len(a) + len(b) != size or after[left] != right:
                continue
            count -= 1
            part[left], part[right] = (whole := a + b), ""
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (r := rank.get(whole + part[nxt])) is not None:
                    heappush(heap, (r, left, nxt, size + len(part[nxt])))
            if (prv := before[left]) >= 0 and (r := rank.get(part[prv] + whole)) is not None:
                heappush(heap, (r, prv, left, size + len(part[prv])))
        return count

    def word(self, word: str, mark: str, cache: dict[str, int]) -> int:
        if self.lines_apart and "\n" in word:
            first, *rest = word.split("\n")
            n = (self.of(first, mark, cache) if first or mark else 0) + len(rest) * self.merge("\n")
            return n + sum(self.of(x, "", self.bare) for x in rest if x)
        n = self.merge(mark + word)
        if len(word) <= CACHE_CHARS:
            cache[word] = n
        return n

    def of(self, word: str, mark: str, cache: dict[str, int]) -> int:
        return n if (n := cache.get(word)) is not None else self.word(word, mark, cache)

    def count(self, text: str | None) -> int:
        """As many tokens as the library returns for the whole text."""
        if not text:
            return 0
        words, total, marked = text.replace(SPACE, " ").split(" "), 0, self.marked  # the model reads both as the mark
        if "" not in words:
            for w in words:
                n = marked.get(w)
                total += self.word(w, SPACE, marked) if n is None else n
        else:
            run = 1
            for w in words:
                if not w:
                    run += 1
                    continue
                total += self.of(w, SPACE, marked) if run == 1 else self.word(w, SPACE * run, {})
                run = 1
            if run > 1:
                total += self.merge(SPACE * (run - 1))
        if len(marked) + len(self.bare) > CACHE_WORDS:
            marked.clear()
            self.bare.clear()
        return total


_loaded: dict[str, Ranks] = {}


def _ranks(path: str) -> Ranks:
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def token_counter(model_path: str | Callable[[], str]) -> Callable[[str | Column], Column]:
    """A column function that gives the number of tokens of a text column as a long.

    ``model_path`` names a sentencepiece BPE model on every executor, or is a function that finds it
    there. Whole texts are counted, of any length; null and empty texts have no tokens.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        ranks = _ranks(model_path if isinstance(model_path, str) else model_path())
        return pd.Series([ranks.count(t) for t in texts], dtype="int64")

    return count
