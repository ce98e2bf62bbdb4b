"""Secret scans: fixed patterns, and a character convolutional network over every other candidate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

# The base patterns and the least lengths of their findings.
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the least length may stand in the pattern
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: What the network judges: whole runs of so many characters, twelve with a digit or sixteen of any.
CANDIDATE = re.compile(r"(?=[A-Za-z+/_.=~:@-]*[0-9])[A-Za-z0-9+/_.=~:@-]{12,}|[A-Za-z0-9+/_.=~:@-]{16,}")
#: Characters around a candidate, of it in one view, of an embedding, filters and their width.
CONTEXT, VIEW, EMBEDDING, FILTERS, WIDTH, EPOCHS, BATCH = 16, 48, 8, 32, 5, 10, 64
#: Different candidates (expected) of a part of the training, findings that a part shows, tasks that train parts, and the recall and
#: precision that the threshold must keep on examples held back.
PART, SHOWN, TASKS, RECALL, PRECISION = 3200, 4000, 64, 0.95, 0.98
#: Scores are counted by their logits, in steps of a hundredth between these bounds.
LOGIT = 16
#: Parts at least, so that a small table has the made examples of several, and the first seed.
LEAST, SEED = 4, 11
#: Words of made examples where documents have none.
WORDS = ["the", "value", "name", "station", "given", "house", "water", "report"]
#: Alphabets in which the values of findings are drawn anew, and marks that join words to names, paths and hosts.
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
ALPHABETS += ["0123456789abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-"]
JOINTS = ["_", "-", ".", "/", "://", "@", ":", "=", ""]

_CLASSES = np.full(256, 3, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:@~;\"'(),{}[]<>"):
    _CLASSES[ord(_c)] = 4 + _i
_CLASSES[ord(" ")], _CLASSES[ord("\n")] = 1, 2
#: Classes of the characters of a candidate; those around it are classes of their own, and 0 is what isn't shown.
N_CLASSES = int(_CLASSES.max()) + 1


def findings(text: str | None) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the value) of the fixed patterns, leftmost and non-overlapping within a kind."""
    if not text:
        return []
    out, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), "assign", *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    return [s[:3] for s in findings(text)]


def candidates(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text or "")]


def views(before: str, value: str, after: str) -> np.ndarray:
    """A candidate and its surroundings as rows of character classes; a long one gives several views."""
    codes = lambda part: _CLASSES[np.frombuffer(part.encode("latin-1", "replace"), np.uint8)]
    own, left, right = codes(value), codes(before[-CONTEXT:]) + N_CLASSES, codes(after[:CONTEXT]) + N_CLASSES
    whole = np.zeros(len(own) + 2 * CONTEXT + VIEW, np.int64)
    whole[CONTEXT - len(left) : CONTEXT] = left
    whole[CONTEXT : CONTEXT + len(own)] = own
    whole[CONTEXT + len(own) : CONTEXT + len(own) + len(right)] = right
    starts = np.arange(0, max(1, len(own) - CONTEXT), VIEW)
    return whole[starts[:, None] + np.arange(VIEW + 2 * CONTEXT)]


class Network:
    """Embeddings, a convolution with ReLU, its maximum and mean over places, and a logistic unit."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (2 * N_CLASSES, EMBEDDING)).astype(np.float32)
        self.embedding[0] = 0
        self.kernel = rng.normal(0, 0.2, (WIDTH * EMBEDDING, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.threshold, self.recall, self.precision, self.examples = 0.5, 0.0, 0.0, 0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        seen, n = self.embedding[x], x.shape[1] - WIDTH + 1
        columns = np.concatenate([seen[:, j : j + n] for j in range(WIDTH)], axis=2)
        z = np.maximum(columns.reshape(-1, WIDTH * EMBEDDING) @ self.kernel + self.bias, 0).reshape(len(x), n, FILTERS)
        place = z.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(z, place[:, None], 1)[:, 0], z.mean(axis=1)], axis=1)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30))), pooled, place, z, columns

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        p, pooled, place, z, columns = self._forward(x)
        error = ((p - y) * weight / len(x)).astype(np.float32)
        back = error[:, None] * self.out
        grad = np.repeat(back[:, None, FILTERS:] / z.shape[1], z.shape[1], axis=1)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        grad[rows, place, cols] += back[:, :FILTERS]
        grad = (grad * (z > 0)).reshape(-1, FILTERS)
        inner = (grad @ self.kernel.T).reshape(len(x), z.shape[1], WIDTH, EMBEDDING)
        seen = np.zeros((*x.shape, EMBEDDING), np.float32)
        for j in range(WIDTH):
            seen[:, j : j + z.shape[1]] += inner[:, :, j]
        flat = seen.reshape(-1, EMBEDDING)
        embedding = np.stack([np.bincount(x.ravel(), flat[:, d], len(self.embedding)) for d in range(EMBEDDING)], 1).astype(np.float32)
        embedding[0] = 0  # what isn't shown stays nothing
        return [embedding, columns.reshape(-1, WIDTH * EMBEDDING).T @ grad, grad.sum(axis=0), pooled.T @ error, error.sum(keepdims=True)]

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.kernel, self.bias, self.out, self.out_bias]

    @parameters.setter
    def parameters(self, values: list[np.ndarray]) -> None:
        self.embedding, self.kernel, self.bias, self.out, self.out_bias = (v.astype(np.float32) for v in values)

    def still(self) -> list[np.ndarray]:
        """The moments of Adam before its first step: the first and then the second of each parameter."""
        return [np.zeros_like(p) for p in self.parameters * 2]

    def epoch(self, x: np.ndarray, y: np.ndarray, train: np.ndarray, moments: list[np.ndarray], turn: int, rng: np.random.Generator) -> None:
        """One pass of stochastic gradient descent (Adam) over the rows ``train``, in place; ``turn`` counts from 0 to EPOCHS - 1."""
        positive, half = (y[train] == 1).sum(), len(self.parameters)
        rng.shuffle(train)
        per_turn = -(-len(train) // BATCH)
        step, steps = turn * per_turn, EPOCHS * per_turn
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            weight = np.where(y[rows] == 1, 0.5 / max(1, positive), 0.5 / max(1, len(train) - positive)) * len(train)
            step += 1
            for p, m, v, g in zip(self.parameters, moments[:half], moments[half:], self._gradients(x[rows], y[rows], weight), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (1.05 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def counts(self, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        """How many rows of either label there are by step of logit (label, step, n)."""
        scores = self.score(x).astype(np.float64)
        logit = np.log(np.maximum(scores, 1e-9)) - np.log(np.maximum(1 - scores, 1e-9))
        rows = pd.DataFrame({"label": y.astype(np.int32), "step": np.floor(np.clip(logit, -LOGIT, LOGIT) * 100).astype(np.int32)})
        return rows.groupby(["label", "step"]).size().rename("n").reset_index()

    def settle(self, counts: pd.DataFrame) -> Network:
        """The highest threshold that keeps RECALL of the findings that ``counts`` (of examples held back) has.

        Where that has less than PRECISION there, nothing is ever added: the threshold is out of reach.
        """
        found = counts[counts.label == 1].groupby("step").n.sum().sort_index(ascending=False)
        if len(found):
            step = int(found.index[np.argmax(found.cumsum().to_numpy() >= RECALL * found.sum())])
            right, all_ = int(found[found.index >= step].sum()), int(counts[counts.step >= step].n.sum())
            self.threshold = float(1 / (1 + np.exp(-step / 100)) - 1e-7)
            self.recall, self.precision = right / int(found.sum()), right / all_
            if self.precision < PRECISION:
                self.threshold = 2.0
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        """Fits one part alone, four fifths of its rows; the rest gives the threshold."""
        rng = np.random.default_rng(seed)
        held, train = deal(len(x), rng)
        moments = self.still()
        for turn in range(EPOCHS):
            self.epoch(x, y, train, moments, turn, rng)
        self.examples = len(x)
        return self.settle(self.counts(x[held], y[held]))


def deal(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows that are held back, a fifth, and of those that train."""
    order = rng.permutation(n)
    return order[: n // 5], order[n // 5 :]


def _word(rng: np.random.Generator, words: list[str], least: int) -> str:
    """Words run together to ``least`` letters or more, in one of the ways that texts write them."""
    out = ""
    while len(out) < least:
        out += words[rng.integers(len(words))]
    kind = rng.random()
    out = out.upper() if kind < 0.2 else out.capitalize() if kind < 0.4 else out
    return out + ("" if rng.random() < 0.6 else ".:-/=~"[rng.integers(6)])


def syllables(rng: np.random.Generator, n: int = 400) -> list[str]:
    """Made words of one to four syllables, as names of many languages have them."""
    starts, ends = [*"bcdfghjklmnprstvwyz", "st", "tr", "pl", "ch", "sh", "th", "br", "gr", ""], [*"nrstlmdpkx", "ss", "ck", "nt", "ng", "", "", "", ""]
    part = lambda: starts[rng.integers(len(starts))] + "aeiou"[rng.integers(5)] + ends[rng.integers(len(ends))]
    return ["".join(part() for _ in range(int(rng.integers(1, 5)))) for _ in range(n)]


def made_secret(rng: np.random.Generator, words: list[str]) -> str:
    """A value of some alphabet and length, with letters and digits, sometimes behind a short word and a mark."""
    alphabet = list(ALPHABETS[rng.integers(len(ALPHABETS))])
    value = "".join(rng.choice(alphabet, int(rng.integers(14, 65))))
    value += "" if re.search("[0-9]", value) else "7"  # letters alone are words
    value += "" if re.search("[A-Za-z]", value) else "f"
    if rng.random() < 0.1:  # in the address of a service
        a, b, c = (words[i] for i in rng.integers(0, len(words), 3))
        return f"{a[:8]}://{b[:8]}:{value[:32]}@{c}{['', '.' + a[:3], ':80'][rng.integers(3)]}"
    if rng.random() < 0.1:  # an account in front
        return f"{words[rng.integers(len(words))][:4]}-{rng.integers(10**9, 10**13)}-{value}"
    return f"{words[rng.integers(len(words))][:6]}{JOINTS[rng.integers(len(JOINTS))]}{value}" if rng.random() < 0.3 else value


def made_other(rng: np.random.Generator, words: list[str]) -> str:
    """What looks like a candidate and is no secret: words, names, paths, hosts, mail, numbers of all kinds."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda a, b=None: "".join(map(str, rng.integers(0, 10, int(rng.integers(a, (b or a) + 1)))))
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    kind = int(rng.integers(12))
    if kind <= 2:
        return _word(rng, words, int(rng.integers(12, 22)))
    if kind == 3:  # addresses and numbers in groups
        mark = pick([".", "-", "/", ":", "_"])
        return mark.join(digits(1, int(rng.integers(1, 9))) for _ in range(int(rng.integers(3, 7))))
    if kind == 4:  # network addresses, with and without a port
        return ".".join(str(rng.integers(0, 256)) for _ in range(4)) + (f":{digits(2, 5)}" if rng.random() < 0.3 else pick(["", "", ".", ":"]))
    if kind == 5:  # cards, accounts, telephones
        return pick([digits(12, 20), "-".join(digits(4) for _ in range(4)), f"+{digits(2)}-{digits(3)}-{digits(7)}"])
    if kind == 6:  # bank accounts by country
        bank = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 4)) if rng.random() < 0.5 else ""
        return "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 2)) + digits(2) + bank + digits(12, 20)
    if kind == 7:  # identifiers in five groups
        name = "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
        return name.upper() if rng.random() < 0.3 else name
    if kind == 8:
        return f"{pick(words)}.{digits(1, 3)}@{pick(words)}{digits(1, 2)}.{pick(words)[:8]}.{pick(words)[:3]}"
    if kind == 10:  # paths, packages and names in code
        parts = [pick(words) for _ in range(int(rng.integers(2, 6)))]
        way = int(rng.integers(6))
        if way == 5:
            host = ".".join(w[:10] for w in parts[:3]) + pick(["", f":{digits(2, 4)}"])
            return f"{pick(['http', 'https', pick(words)[:8]])}://{pick(['', pick(words)[:8] + '@'])}{host}/" + pick(["", "/".join(parts), digits(3, 8), parts[0] + ".html", f"{parts[0]}?id={digits(1, 6)}"])
        if way == 0:
            return pick(["/", "./", "~/", ""]) + "/".join(parts) + pick(["", "", "/", ".py", ".txt"])
        if way == 1:
            return parts[0] + "".join(w.capitalize() for w in parts[1:])
        if way == 2:
            return "_".join(parts).upper() if rng.random() < 0.5 else "_".join(parts) + pick(["", "_2", "_v3"])
        return ".".join(parts[:-1]) + "." + parts[-1].capitalize() if way == 3 else "-".join(parts) + pick(["", ".com", f"-{digits(1, 2)}"])
    if kind == 9:  # times
        date = f"{rng.integers(1950, 2050)}-{rng.integers(1, 13):02d}-{rng.integers(1, 32):02d}"
        return date + pick(["T", "_", "/"]) + f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}:{rng.integers(0, 60):02d}" + pick(["", "Z", f".{digits(3)}Z"])
    parts = [pick(words)[: int(rng.integers(2, 13))] for _ in range(int(rng.integers(2, 6)))]
    parts = [w.capitalize() if rng.random() < 0.3 else w.upper() if rng.random() < 0.1 else w for w in parts]
    parts = [w + digits(1, 3) if rng.random() < 0.2 else w for w in parts]
    mark = pick(JOINTS)
    return "".join(x for w in parts for x in (w, mark if rng.random() < 0.7 else pick(JOINTS)))


def made_examples(found: list[tuple[str, str, str]], other: list[tuple[str, str, str]], words: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Views and labels of the findings and the other candidates of a part, each (before, value, after), and of made ones: SHOWN and 3 * SHOWN in all.

    Every real one is shown as it stands; while they are less than a quarter, they come again where another candidate stood and with nothing around them. The
    rest are made, so that the network learns the same from a table with few findings, or none: neither a keyword nor
    the shape of one kind tells a secret.
    """
    rng = np.random.default_rng(seed)
    made = syllables(rng)
    words = [*(words or WORDS)[: len(made)], *made]
    nothing = ("", "", "")
    places = lambda pool: pool[rng.integers(len(pool))] if pool else nothing

    def around() -> tuple[str, str]:
        kind = rng.random()
        if kind < 0.3:
            return "", ""
        if kind < 0.5:
            mark = [" = ", ": ", "=", ' "', ":"][rng.integers(5)]
            return f"{words[rng.integers(len(words))]} {words[rng.integers(len(words))]}{mark}", ["", " ", '"', "\n"][rng.integers(4)]
        if kind < 0.6:
            place = places(found)
        elif kind < 0.8:
            place = places(other)
        else:
            said = [words[rng.integers(len(words))] for _ in range(6)]
            return " ".join(said[:3]) + " ", " " + " ".join(said[3:])
        return place[0], place[2]

    rows: list[tuple[int, np.ndarray]] = []
    for label, pool, make, n in ((1, found, made_secret, SHOWN), (0, other, made_other, 3 * SHOWN)):
        shown = 0
        for turn in range(3):
            for before, value, after in pool if not turn or shown < n // 4 else ():
                if turn:
                    before, after = around()
                rows += [(label, v) for v in views(before, value, after)]
                shown += 1
        for _ in range(max(0, n - shown)):
            before, after = around()
            rows += [(label, v) for v in views(before, make(rng, words), after)]
    return np.stack([v for _, v in rows]), np.array([y for y, _ in rows], np.float64)


EXAMPLE = "label int, before string, value string, after string"


def examples_of(docs: DataFrame) -> DataFrame:
    """Values of the findings of the fixed patterns (label 1), and candidates that touch none (0), each with what stands around it.

    Of every document; equal ones once.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch.text:
                spans = findings(text)
                own = [(1, s, e) for *_, s, e in spans]
                own += [(0, s, e) for s, e in candidates(text) if not any(b < e and s < f for b, f, *_ in spans)]
                rows += [(k, text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT]) for k, s, e in own]
            yield pd.DataFrame(rows, columns=["label", "before", "value", "after"]).astype({"label": "int32"})

    return docs.select("text").mapInPandas(extract, EXAMPLE).dropDuplicates()


def words_of(examples: DataFrame, n: int = 400) -> list[str]:
    """The words that are in and around most candidates."""
    said = F.regexp_extract_all(F.lower(F.concat_ws("|", "before", "value", "after")), F.lit("[a-z]{2,12}"), F.lit(0))
    top = examples.where("label = 0").select(F.explode(said).alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word")
    return [r.word for r in top.limit(n).collect()]


def parts_of(examples: DataFrame, words: list[str], parts: int) -> DataFrame:
    """All examples dealt to parts by their hash, with made ones beside them: a row for each part, its views and labels as bytes."""
    spark = examples.sparkSession
    place = F.xxhash64("label", "before", "value", "after")
    dealt = examples.select(F.pmod(place, F.lit(parts)).cast("int").alias("part"), place.alias("place"), "label", "before", "value", "after")
    every = spark.range(parts).selectExpr("CAST(id AS INT) AS part", "0L AS place", "-1 AS label", "'' AS before", "'' AS value", "'' AS after")  # parts without any

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows, part = rows.sort_values(["place", "value"], kind="stable"), int(rows.part.iloc[0])
        pools = [list(rows[rows.label == k][["before", "value", "after"]].itertuples(index=False, name=None)) for k in (1, 0)]
        x, y = made_examples(*pools, words, SEED + part)
        return pd.DataFrame({"part": [part], "x": [x.astype(np.uint8).tobytes()], "y": [y.astype(np.uint8).tobytes()]})

    return dealt.unionByName(every).groupBy("part").applyInPandas(make, "part int, x binary, y binary").repartition(min(parts, TASKS), "part").checkpoint()


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A part's views and labels, and which of its rows are held back and which train; the same each time."""
    x = np.frombuffer(row.x, np.uint8).reshape(-1, VIEW + 2 * CONTEXT).astype(np.int64)
    return x, np.frombuffer(row.y, np.uint8).astype(np.float64), *deal(len(x), np.random.default_rng(SEED + row.part))


def fit_parts(parts: DataFrame, number: int) -> Network:
    """One network from all parts: each goes over its examples once from the common parameters, these and the moments are averaged, and
    so on for EPOCHS turns. The threshold comes from the examples that all parts hold back.
    """
    network = Network()
    state = [*network.parameters, *network.still()]
    shapes, ends = [p.shape for p in state], np.cumsum([p.size for p in state])[:-1]
    whole = lambda flat: [p.reshape(shape).astype(np.float32) for p, shape in zip(np.split(flat, ends), shapes, strict=True)]
    flat, half = np.concatenate([p.ravel() for p in state]).astype(np.float64), len(network.parameters)

    def passed(start: np.ndarray, turn: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, first = np.zeros_like(start), None
            for row in (r for batch in batches for r in batch.sort_values("part").itertuples(index=False)):
                x, y, _, train = _opened(row)
                own, values = Network(), whole(start)
                own.parameters, moments = values[:half], values[half:]
                own.epoch(x, y, train, moments, turn, np.random.default_rng(1000 * (SEED + row.part) + turn))
                total += np.concatenate([p.ravel() for p in [*own.parameters, *moments]])
                first = row.part if first is None else first
            if first is not None:
                yield pd.DataFrame({"first": [first], "total": [total.tobytes()]})

        return run

    def held_back(start: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Network()
            own.parameters = whole(start)[:half]
            for row in (r for batch in batches for r in batch.itertuples(index=False)):
                x, y, held, _ = _opened(row)
                yield own.counts(x[held], y[held])

        return run

    for turn in range(EPOCHS):
        sums = parts.mapInPandas(passed(flat, turn), "first int, total binary").collect()  # a row for each of at most TASKS tasks
        flat = sum(np.frombuffer(r.total) for r in sorted(sums, key=lambda r: r.first)) / number
    network.parameters = whole(flat)[:half]
    told = parts.mapInPandas(held_back(flat), "label int, step int, n long").groupBy("label", "step").agg(F.sum("n").alias("n")).collect()
    network.examples = parts.select(F.sum(F.length("y"))).first()[0]
    return network.settle(pd.DataFrame([tuple(r) for r in told], columns=["label", "step", "n"]))


def train(docs: DataFrame) -> Network:
    """A network from labelled findings of every document: those of the fixed patterns against all other candidates.

    See :func:`made_examples` for what is shown beside them; parts, of PART candidates each, are as many as the table needs.
    """
    shared_folder(docs.sparkSession)
    examples = examples_of(docs).checkpoint()
    number = max(LEAST, -(-examples.count() // PART))
    return fit_parts(parts_of(examples, words_of(examples), number), number)


def scan_text(text: str | None, network: Network | None) -> list[tuple[int, int, str, float]]:
    """All spans of a text by start and then by kind; what the network adds touches no other span."""
    base = base_spans(text)
    out = [(s, e, k, 1.0) for s, e, k in base]
    if network is not None:
        free = [c for c in candidates(text) if not any(s < c[1] and c[0] < e for s, e, _ in base)]
        if free:
            shown = [views(text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT]) for s, e in free]
            scores = network.score(np.concatenate(shown))
            at = 0
            for c, v in zip(free, shown, strict=True):
                best = float(scores[at : at + len(v)].max())
                at += len(v)
                if best >= network.threshold:
                    out.append((*c, "model", best))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def scanner(network: Network | None, spark) -> "callable":
    """A column function text -> spans(kind, start, end, score), in code points, end exclusive.

    The spans of the fixed patterns come first and always stay; the network adds candidates that it
    scores at its threshold or above. Whole texts are read; null and empty texts have no spans.
    """
    sent = spark.sparkContext.broadcast(network)

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e, "score": p} for s, e, k, p in scan_text(t, sent.value)] for t in texts], dtype=object)

    return scan


def redact(text: str | Column, spans: str | Column) -> Column:
    """The text with each span, or overlapping spans together, replaced by ``[secret]``; a null text stays null."""
    return F.pandas_udf(_redact, "string")(text, spans)


def _redact(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans, strict=True):
        if text is None or found is None or not len(found):
            out.append(text)
            continue
        parts, at = [], 0
        for s in found:
            if s["start"] >= at:
                parts += [text[at : s["start"]], "[secret]"]
            at = max(at, s["end"])
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)
