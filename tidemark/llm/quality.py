"""Quality rules: counts of each text, and cutoffs whose share of false rejections is bounded by labelled holdouts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of good documents of a stratum that the rules may reject, and the chance that any stratum's bound fails.
ALPHA, DELTA = 0.05, 0.05
#: Levels of strictness: shares of the proposing good documents that a rule may lie beyond; each is tried after the looser ones.
LEVELS = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02)
#: One in so many labelled texts proposes cutoffs; the others test them.
PROPOSING = 4
#: Signals are whole numbers from 0 to GRID, so that their distribution is a small exact histogram.
GRID = 1000
#: Cutoff rows up to which the join sends them to all executors.
SENT_ROWS = 10_000

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that stand in the text twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:  # three numbers do not fit into a long; two always do
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, of, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[of] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The columns of COUNTS; a null text has nothing."""
    text = text or ""
    words = text.encode().split()  # of bytes this splits at SPACE, and nowhere else
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in texts], columns=[c.split()[0] for c in COUNTS.split(", ")])


def signals() -> dict[str, Column]:
    """What the rules hold against a cutoff, each larger where a text is worse, as whole numbers from 0 to GRID."""
    share = lambda a, b: F.floor(F.lit(GRID) * a / F.greatest(b, F.lit(1))).cast("int")
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": share(F.col("n_symbols"), F.col("n_symbols") + words),
        "repeats": share(F.col("n_repeat_words"), words),
        "lines": share(F.col("n_dup_lines"), F.col("n_lines")),
        "long_words": share(chars, chars + 5 * words),
        "short_words": share(5 * words, chars + 5 * words),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """The chance of at most k hits in n with chance p each; 1 where k is no less than what is expected, as nothing can be shown then."""
    if k >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    while k >= 0 and term > 1e-18 * total:
        total += term
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    return min(1.0, total)


def proposals(labelled: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """For each stratum and level the cutoff of every rule, from the proposing rows: halfway between the good documents' value at that
    level and the next higher of bad ones; a rule that no bad document goes beyond is off (GRID).

    All from histograms of at most GRID + 1 bins for each rule and stratum, cumulated from the top.
    """
    names = list(signals())
    long = labelled.where("proposes").select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("value")) for n in names])).alias("s")).select("stratum", "good", "s.*")
    bins = long.groupBy("stratum", "rule", "value").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    packed = bins.groupBy("stratum", "rule").agg(F.array_sort(F.collect_list(F.struct("value", "good", "bad"))).alias("bins"), F.sum("good").alias("n"))
    level = F.col("level")
    # The smallest value that at most level * n good documents lie beyond, and the smallest value of a bad one beyond it.
    beyond = lambda v: F.aggregate(F.filter("bins", lambda b: b["value"] > v), F.lit(0).cast("long"), lambda a, b: a + b["good"])
    edge = F.array_min(F.transform(F.filter("bins", lambda b: (beyond(b["value"]) <= level * F.col("n"))), lambda b: b["value"]))
    next_bad = F.array_min(F.transform(F.filter("bins", lambda b: (b["value"] > F.col("edge")) & (b["bad"] > 0)), lambda b: b["value"]))
    each = packed.select("*", F.posexplode(F.array(*[F.lit(x) for x in levels])).alias("at", "level")).withColumn("edge", edge)
    each = each.withColumn("cutoff", F.coalesce(F.floor((F.col("edge") + next_bad) / 2).cast("int"), F.lit(GRID)))
    return each.groupBy("stratum", "at").pivot("rule", names).agg(F.first("cutoff"))


def beyond_any(cutoffs: Column | None = None, rules: int | None = None) -> Column:
    """Whether any signal, or any of the first ``rules``, lies beyond its cutoff; cutoffs are a struct column, or columns named ``cut_<rule>``."""
    out = F.lit(False)
    for n in [*signals()][:rules]:
        out = out | (F.col(n) > (cutoffs[n] if cutoffs is not None else F.col(f"cut_{n}")))
    return out


def certified(labelled: DataFrame, alpha: float, delta: float, levels: tuple[float, ...]) -> DataFrame:
    """The cutoffs of each stratum for which the share of good documents rejected is at most alpha, all strata together with a chance of 1 - delta.

    Levels are tested from the loosest on, with the exact binomial tail of the false rejections among the testing rows, each at delta
    over the number of strata (Bonferroni), until one fails: a fixed sequence needs no further correction. Of those that
    pass, the one that catches most bad proposing rows is taken, the loosest of equal ones, and of its rules, in their order, only as many
    as that takes: fewer rules reject no more. A stratum where none passes has no row.
    """
    proposed = proposals(labelled, levels).withColumn("cut", F.struct(*signals()))
    steps = proposed.groupBy(F.col("stratum").alias("s")).agg(F.array_sort(F.collect_list(F.struct("at", "cut"))).alias("steps"))
    tried = labelled.join(steps, F.col("stratum").eqNullSafe(F.col("s"))).select("stratum", "proposes", "good", *signals(), F.explode("steps").alias("step"))
    hit = beyond_any(F.col("step")["cut"])
    testing = ~F.col("proposes") & F.col("good")
    count = lambda c: F.sum(c.cast("long"))
    bad = F.col("proposes") & ~F.col("good")
    by_rules = F.array(*[count(bad & beyond_any(F.col("step")["cut"], j + 1)) for j in range(len(signals()))])
    told = tried.groupBy("stratum", F.col("step.at").alias("at")).agg(count(testing).alias("n"), count(testing & hit).alias("k"), count(bad & hit).alias("caught"), by_rules.alias("by_rules"), F.first("step.cut").alias("cut"))
    told = told.withColumn("rules", F.array_position("by_rules", F.col("caught")).cast("int"))  # the first so many catch all

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), alpha) for a, b in zip(k, n, strict=True)], dtype=float)

    told = told.withColumn("p", tail("k", "n")).checkpoint()  # strata times levels
    strata = max(1, told.select("stratum").distinct().count())
    ladder = told.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("at", "p", "caught", "cut", "n", "k", "rules"))).alias("steps"))
    failed = F.array_min(F.transform(F.filter("steps", lambda s: s["p"] > delta / strata), lambda s: s["at"]))
    passed = F.filter("steps", lambda s: failed.isNull() | (s["at"] < failed))
    best = F.array_max(F.transform(passed, lambda s: F.struct(s["caught"], (-s["at"]).alias("loose"), s["cut"], s["n"], s["k"], s["p"], s["rules"])))
    chosen = ladder.select("stratum", best.alias("b")).where("b IS NOT NULL AND b.caught > 0")
    return chosen.select(F.col("stratum").alias("s"), *[F.when(F.col("b.rules") > j, F.col(f"b.cut.{n}")).otherwise(F.lit(GRID)).alias(f"cut_{n}") for j, n in enumerate(signals())], F.col("b.n").alias("tested"), F.col("b.k").alias("rejected_good"), F.col("b.p").alias("p_value"), (-F.col("b.loose")).alias("level"))


def counted(docs: DataFrame, text: str = "text", stratum: str = "lang", key: str = "doc_id") -> DataFrame:
    """Key, stratum, a hash of the text, its counts and signals of every document, without the texts."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), F.pandas_udf(_counts, COUNTS)(text).alias("c"))
    return rows.select("doc_id", "stratum", "hash", "c.*").withColumns(signals())


def labelled_rows(rows: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Documents whose quality is told, equal texts of a stratum once; the text's hash decides whether it proposes or tests."""
    told = labels.where(F.col(quality).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg((F.min(quality) >= 1).alias("good"))
    own = rows.join(told, "doc_id").where(~base_failed())
    first = own.groupBy("stratum", "hash").agg(F.min("good").alias("good"), *[F.first(n).alias(n) for n in signals()])
    return first.withColumn("proposes", F.pmod(F.xxhash64("hash"), F.lit(PROPOSING)) == 0)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, levels: tuple[float, ...] = LEVELS, stratum: str = "lang") -> DataFrame:
    """Documents (doc_id, text, ``stratum``) to doc_id, stratum, counts, signals, base_failed and kept.

    A document is rejected by the fixed base rule (under 50 words, or over half of its words in repeated windows), or where
    one of its signals lies beyond the cutoff of its stratum; ``labels`` (doc_id, quality 0/1) tell the cutoffs, see :func:`certified`.
    Of the documents that pass the base rule and whose quality is 1, at most ``alpha`` of each stratum is rejected by cutoffs, with
    a chance of 1 - ``delta`` for all strata together, as far as labelled documents are drawn like the others.

    Null text has no words; a null stratum is one of its own; a stratum without enough labels keeps all that passes the base rule, as do
    empty labels; a document with several labels is good if all are; rows with a null or repeated doc_id are each judged by their text;
    further columns are left out; an empty table gives no rows.
    """
    rows = counted(docs, stratum=stratum).checkpoint()
    cutoffs = certified(labelled_rows(rows, labels), alpha, delta, levels).checkpoint()
    side = F.broadcast(cutoffs) if cutoffs.count() <= SENT_ROWS else cutoffs
    told = rows.join(side, F.col("stratum").eqNullSafe(F.col("s")), "left")
    failed = base_failed()
    return told.select(*rows.columns, failed.alias("base_failed"), (~failed & ~F.coalesce(beyond_any(), F.lit(False))).alias("kept"))
