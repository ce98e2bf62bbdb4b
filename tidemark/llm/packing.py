"""Packing of token sequences by bounded-space online best fit."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, OPEN_BINS = 4096, 64
#: Tasks whose last open bins go to one second packer; with OPEN_BINS it bounds a group.
JOINED = 16
#: Distinct words that a task remembers.
CACHE_WORDS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean"


class OpenBins:
    """At most ``most`` open bins in a bitset keyed by free space: the fullest that still holds an item takes it.

    Where no bin holds it and all places are taken, the fullest bin closes.
    """

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most, self.set, self.n, self.made = capacity, most, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            del self.by_free[free]
            self.set &= ~(1 << free)
        self.n -= 1
        return b

    def add(self, size: int) -> tuple[int, int]:
        """The number of the item's bin, and its offset there."""
        if fits := self.set >> size:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.n >= self.most:
                self._take((self.set & -self.set).bit_length() - 1)
            free, b = self.capacity, self.made
            self.made += 1
        if rest := free - size:
            self.by_free.setdefault(rest, []).append(b)
            self.set |= 1 << rest
            self.n += 1
        return b, self.capacity - free

    def open(self) -> set[int]:
        return {b for bins in self.by_free.values() for b in bins}


_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"([{_LATIN}]+)([.,;:!?]*)")


#: Texts that tell, when a file is loaded, whether its identifiers may be made word by word, and Latin words by its model alone.
PROBES = ("Hello World", "ÀÉÎÕÜ ßtraße, ÿñ;", "the  end. of!? a\n\nline\tAND more...", "a b:c :d x,y", "don't stop ISN'T 12 3.5%", "Ω λόγος 日本語 🎉 é", "aaaaaaaaaaaa Zzzz!!! ?!?!", "naïve Curaçao. Œuvre", "word " * 20)


class WordIds(dict):
    """The identifiers of a text by its words, if no token of the file's splitter reaches across white space.

    Words are remembered. A new one that is Latin letters and marks goes to the file's model in
    lower case, letters and marks apart, as the steps of some files would hand them over; others go
    through the file's own steps. PROBES show whether a file allows both; whole texts or words go to the library where it doesn't.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.marks: dict[bytes, bytes] = {}
        self.by_model = self.by_words = True
        own = [self._whole(p) for p in PROBES]
        if [self.encode(p) for p in PROBES] != own:
            self.forget()
            self.by_model = False
            self.by_words = [self.encode(p) for p in PROBES] == own
        self.forget()

    def _whole(self, text: str) -> bytes:
        return _little(array("I", self.library.encode(text, add_special_tokens=False).ids))

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.by_model and (m := _PLAIN.fullmatch(text)):
            letters, marks = m.groups()
            low = letters.lower()  # a word of its own, which is remembered once for all its forms
            ids = self._part(self, low.encode(), low) + (self._part(self.marks, marks.encode(), marks) if marks else b"")
        else:
            ids = self._whole(text)
        self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.marks.clear()

    def _part(self, known: dict[bytes, bytes], key: bytes, part: str) -> bytes:
        if (ids := known.get(key)) is None:
            tokens = self.model.tokenize(part if part.isascii() else _shown(part))
            known[key] = ids = _little(array("I", [t.id for t in tokens]))
        return ids

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit identifiers; bytes.split() cuts at ASCII white space alone."""
        if not self.by_words:
            return self._whole(text or "")
        if len(self) + len(self.marks) > CACHE_WORDS:
            self.forget()
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def _shown(text: str) -> str:
    """Bytes as the printable characters by which byte-level vocabularies write them: the Latin-1 ones
    stand for themselves, the others follow from 256 on."""
    return "".join(_BYTE[b] for b in text.encode())


_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_OWN)))}

_loaded: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Documents (doc_id, text) as pieces in sequences of at most ``capacity`` tokens.

    A document is its identifiers and ``end_id``; only longer ones are cut, into full pieces and a
    rest. Each task packs its pieces in the order it reads them. The pieces of the bins still open at its end,
    at most ``open_bins``, go on to a second packer, which takes those of JOINED tasks in the order in which they came,
    by the same rule and with as many open bins. Nothing is dropped and every other sequence stays as it was.

    The first packing is written to the checkpoint folder, as rows of numbers, since both parts
    of the result read it. Null and empty texts are one piece of the end alone; a null doc_id stays null;
    repeated rows are packed each; further columns are left out; an empty table gives no rows.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(tokenizer if isinstance(tokenizer, str) else tokenizer())
        task = TaskContext.get().partitionId() << 32
        bins, out, end = OpenBins(capacity, open_bins), [], np.array([end_id], "<u4").tobytes()
        last: list[tuple] = []
        waiting: dict[int, list[tuple]] = {}
        for batch in batches:
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                doc, packed = None if doc is None else int(doc), words.encode(text) + end
                n = len(packed) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = packed[4 * start : 4 * (start + capacity)]
                    size = len(part) // 4
                    b, offset = bins.add(size)
                    waiting.setdefault(b, []).append((doc, piece, start, size, zlib.crc32(part), task + b, offset))
            still = bins.open()
            for b in [b for b in waiting if b not in still]:
                out += [(*p, True) for p in waiting.pop(b)]
            yield _frame(out)
            out.clear()
        words.forget()
        for b in waiting:
            last += [(*p, False) for p in waiting[b]]
        yield _frame(last)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "offset"]).reset_index(drop=True)
        bins, base = OpenBins(capacity, open_bins), (1 << 62) + (int(pdf["group"].iloc[0]) << 32)
        placed = [bins.add(int(n)) for n in pdf.length]
        pdf["sequence_id"], pdf["offset"] = [base + b for b, _ in placed], [o for _, o in placed]
        return pdf.assign(closed=True).drop(columns="group")

    packed = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(first, PIECES).checkpoint()
    rest = packed.where(~F.col("closed")).withColumn("group", F.shiftrightunsigned(F.col("sequence_id"), 32) / JOINED)
    rest = rest.withColumns({"group": F.floor("group").cast("long"), "doc_id": F.col("doc_id").cast("string")}).groupBy("group").applyInPandas(again, PIECES.replace("doc_id long", "doc_id string"))
    return packed.where("closed").unionByName(rest.withColumn("doc_id", F.col("doc_id").cast("long"))).drop("closed")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "closed"], dtype=object)
    kinds = dict.fromkeys(("start", "length", "ids_crc32", "sequence_id", "offset"), "int64")
    return df.astype({"doc_id": "Int64", "piece": "int32", "closed": "bool"} | kinds)
