"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subwords are runs of so many bytes of a word and the spaces beside it; they hash to BUCKETS rows.
SIZES, BUCKETS, DIMENSIONS, EPOCHS = (2, 3, 4), 1 << 16, 16, 6
#: Labelled rows that train and calibrate, at most how many of each language, and rows of one step of descent.
EXAMPLES, PER_LANGUAGE, BATCH = 2400, 600, 16
#: Characters of a text that trains; of a longer one it is a passage.
CHARACTERS = 20_000
#: Languages whose edges of the sample are broadcast; beyond it they are joined.
BROADCAST_LANGUAGES = 100_000
#: The part of the calibration texts that may be rejected.
REJECTED = 0.001
#: Every how many examples one more is made that is in no language, its length at most, and code points that it may be written in.
COUNTER, MADE = 2, 8192
SCRIPTS = [(0x61, 0x7B), (0x61, 0x7B), (0xE0, 0x100), (0x3B1, 0x3CA), (0x430, 0x450), (0x5D0, 0x5EB), (0x905, 0x93A), (0x3041, 0x3097), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)]
UNKNOWN = "und"
PIECE = 1 << 18

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def _subwords(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the bucket of the subword at each place and whether there is one."""
    solid = data != 32
    key = data.astype(np.uint32)
    inner = np.ones(len(data), bool)  # no space between the ends
    for size in range(2, max(SIZES) + 1):
        n = len(data) - size + 1
        if n <= 0:
            return
        key = key[:n] * np.uint32(0x01000193) + data[size - 1 :]
        inner = inner[:n] & (solid[size - 2 : size - 2 + n] if size > 2 else True)
        if size in SIZES:
            bucket = ((key ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
            yield bucket, inner & (solid[:n] | solid[size - 1 :]) if size == 2 else inner


def _bytes(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode().translate(_LETTERS) + b" "


def _pieces(data: bytes) -> Iterator[bytes]:
    """Parts of bounded length that share as many bytes as a subword that crosses needs."""
    for at in range(0, max(1, len(data) - max(SIZES) + 1), PIECE):
        yield data[at : at + PIECE + max(SIZES) - 1]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for part, last in _with_last(_pieces(_bytes(text))):
        for bucket, there in _subwords(np.frombuffer(part, np.uint8)):
            keep = there if last else there & (np.arange(len(there)) < PIECE)
            total += np.bincount(bucket[keep], minlength=BUCKETS)
    own = np.flatnonzero(total)
    return own, total[own]


def _with_last(parts: Iterator[bytes]) -> list[tuple[bytes, bool]]:
    all_parts = list(parts)
    return [(p, i == len(all_parts) - 1) for i, p in enumerate(all_parts)]


class Model:
    """A score of each language, and of none, for each bucket: embeddings and softmax weights multiplied out."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.weights, self.bias, self.temperature, self.threshold = languages, np.ascontiguousarray(weights.T.astype(np.float32)), bias, temperature, threshold

    def means(self, texts: list[str | None]) -> np.ndarray:
        """The averaged scores of each text, by buffers of about PIECE bytes."""
        sums, counts = np.zeros((len(texts), len(self.weights))), np.zeros(len(texts))
        held: list[tuple[int, bytes, bool]] = []
        size = 0
        for i, text in enumerate(texts):
            for part, last in _with_last(_pieces(_bytes(text))):
                if not last:  # a piece of a very long text stands alone: its last bytes belong to the next
                    self._add([(i, part)], sums, counts, PIECE)
                    continue
                held.append((i, part))
                size += len(part)
                if size >= PIECE:
                    self._add(held, sums, counts)
                    held, size = [], 0
        if held:
            self._add(held, sums, counts)
        return sums / np.maximum(counts, 1)[:, None]

    def _add(self, held: list[tuple[int, bytes]], sums: np.ndarray, counts: np.ndarray, upto: int | None = None) -> None:
        data = np.frombuffer(b"".join(p for _, p in held), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(p) for _, p in held])])
        owner = np.array([i for i, _ in held])
        for bucket, there in _subwords(data):
            places = np.flatnonzero(there)
            if upto:
                places = places[places < upto]
            cut = np.searchsorted(places, begin[:-1])
            n = np.diff(np.append(cut, len(places)))
            full = n > 0
            own = bucket[places]
            counts[owner[full]] += n[full]
            for k in range(len(self.weights)):
                if full.any():
                    sums[owner[full], k] += np.add.reduceat(self.weights[k][own], cut[full], dtype=np.float64)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Of each language; what is left to 1 is the probability that it is none."""
        return _softmax((self.means(texts) + self.bias) / self.temperature)[:, : len(self.languages)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.probabilities(texts).max(axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def counter_example(text: str, rng: np.random.Generator) -> str:
    """A text in no language with the spaces of a given one: its letters exchanged by a random alphabet, as in a
    language of other sounds, dealt anew, or replaced by random letters of one script."""
    codes = np.frombuffer(text[:MADE].lower().encode("utf-32-le"), np.uint32).copy()
    own, back = np.unique(codes, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in own.tolist()], bool)[back]
    kind = rng.random()
    if kind < 0.6:
        plain = (own >= ord("a")) & (own <= ord("z"))
        own[plain] = ord("a") + rng.permutation(26)[: plain.sum()]
        codes = own[back]
    elif kind < 0.8:
        codes[letters] = rng.permutation(codes[letters])
    else:
        codes[letters] = rng.integers(*SCRIPTS[rng.integers(len(SCRIPTS))], letters.sum())
    return codes.astype("<u4").tobytes().decode("utf-32-le")


class _Batch:
    """Rows (language, buckets, counts) of one step; the share of each of their buckets in each row is spread out only while it is used."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]]):
        self.truth, self.sizes = np.array([k for k, _, _ in rows]), [len(b) for _, b, _ in rows]
        self.own, back = np.unique(np.concatenate([b for _, b, _ in rows]), return_inverse=True)
        self.back, self.part = back.astype(np.int32), np.concatenate([(c / c.sum()).astype(np.float32) for _, _, c in rows])

    def share(self) -> np.ndarray:
        out = np.zeros((len(self.sizes), len(self.own)), np.float32)
        out[np.repeat(np.arange(len(self.sizes)), self.sizes), self.back] = self.part
        return out


def fit(examples: list[tuple[str, str]], seed: int = 7) -> Model:
    """Trains on four fifths of (language, text) and calibrates on the rest.

    A last class of the softmax has made texts that are in no language, so a score is the probability of a
    language against all others and against none. The temperature gives the lowest log loss on the
    rows held back. The threshold is the score below which REJECTED of the real ones among them fall; they count
    once as they are and once with another appended, so that texts in two languages stay.
    """
    languages = sorted({lang for lang, _ in examples})
    rng, index = np.random.default_rng(seed), {lang: k for k, lang in enumerate(languages)}
    examples = [e for e in (examples[i] for i in rng.permutation(len(examples))) if _LETTER.search(e[1])]
    if not examples:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    known = [(index[lang], text) for lang, text in examples]
    held, train = known[: len(known) // 5], known[len(known) // 5 :]

    def rows(part: list[tuple[int, str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        made = [(len(languages), counter_example(text, rng)) for _, text in part[::COUNTER]]
        return [(k, *(x.astype(np.int32) for x in features(text))) for k, text in [*part, *made]]

    embedding = (rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)) / DIMENSIONS).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIMENSIONS, len(languages) + 1)).astype(np.float32)
    bias = np.zeros(len(languages) + 1, np.float32)
    train = [r for r in rows(train) if len(r[1])]
    train = [train[i] for i in rng.permutation(len(train))]
    batches = [_Batch(train[i : i + BATCH]) for i in range(0, len(train), BATCH)]
    train.clear()
    steps, done = EPOCHS * len(batches), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(batches)):
            own, share, truth = batches[i].own, batches[i].share(), batches[i].truth
            rate = np.float32(1.0 * (1 - done / steps) + 0.01)
            done += 1
            mean = share @ embedding[own]
            error = _softmax(mean @ softmax + bias)
            error[np.arange(len(truth)), truth] -= 1
            back = error @ softmax.T
            softmax -= rate * (mean.T @ error)
            bias -= np.float32(0.1) * rate * error.sum(axis=0)
            embedding[own] -= rate * 20 * (share.T @ back)
    weights = embedding @ softmax
    model = Model(languages, weights, bias)
    kept = [r for r in rows(held) if len(r[1])]
    if kept:
        logits = np.stack([(c / c.sum()) @ weights[b] + bias for _, b, c in kept])
        truth = np.array([k for k, _, _ in kept])
        loss = {t: -np.log(_softmax(logits / t)[np.arange(len(kept)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(loss, key=loss.get))
        real = [text for _, text in held]
        mixed = [a + " " + b for a, b in zip(real, real[1:], strict=False)]
        sure = np.sort(model.scores([*real, *mixed]))
        model.threshold = float(sure[int(REJECTED * len(sure))])
    return model


def sample(docs: DataFrame, examples: int = EXAMPLES, per_language: int = PER_LANGUAGE, characters: int = CHARACTERS) -> list[tuple[str, str]]:
    """(lang, text) of the labelled rows of (text, lang) with the lowest hashes, a number of different texts of each language.

    The number is ``per_language`` at most, and ``examples`` over the number of languages, but at least one; no
    language is left out. Hashes and counts of all rows decide which; equal texts are one. Of a text longer than ``characters``
    it is a passage of that length at a place that its hash picks. So what comes to the driver is bounded by these parameters, whatever
    repeats and however long texts are.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text", F.lit(3)).alias("place"))
    first = labelled.groupBy("lang", "place").agg(F.lit(1).alias("one"))
    most = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    few = first.withColumn("n", most).where(F.col("n") <= per_language).select("lang", "place", "n").toPandas()
    each = max(1, min(per_language, examples // max(1, few.lang.nunique())))
    cuts = few[few.n <= each].groupby("lang").place.max()
    if not len(cuts):
        return []
    edges = spark.createDataFrame([(k, int(v)) for k, v in cuts.items()], "lang string, edge long")
    edges = F.broadcast(edges) if len(cuts) <= BROADCAST_LANGUAGES else edges  # a large language would be one task
    spare = F.greatest(F.length("text") - characters, F.lit(0))
    passage = F.substring(F.col("text"), F.pmod(F.col("place"), spare + 1).cast("int") + 1, F.lit(characters))
    rows = labelled.join(edges, "lang").where(F.col("place") <= F.col("edge")).groupBy("lang", "place").agg(F.first(passage).alias("text")).collect()
    return [(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.lang, r.place))]


def train(docs: DataFrame, examples: int = EXAMPLES, per_language: int = PER_LANGUAGE) -> Model:
    """Fits a model on a bounded :func:`sample` of the labelled rows of (text, lang); of longer texts a passage is read."""
    return fit(sample(docs, examples, per_language))


def predictor(model: Model, spark) -> "callable":
    """A column function text -> struct(lang, score, rejected).

    A null text, or one without any letter, is ``und`` with score 0 and rejected. Others get the
    most probable learned language and its calibrated probability, and are rejected where it doesn't reach the
    model's threshold. Without learned languages everything is ``und``.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m, texts = sent.value, texts.tolist()
        known = [bool(m.languages) and t is not None and _LETTER.search(t) is not None for t in texts]
        lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        where = np.flatnonzero(known)
        if len(where):
            p = m.probabilities([texts[i] for i in where])
            best = p.argmax(axis=1)
            score[where] = np.clip(p.max(axis=1), 0, 1)
            rejected[where] = score[where] < m.threshold
            for i, k in zip(where.tolist(), best.tolist(), strict=True):
                lang[i] = m.languages[k]
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return predict


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1: such rows never train. A null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1
