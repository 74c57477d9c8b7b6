"""Learned decision lists over text statistics.

Sequential covering: a rule is a conjunction of thresholds; it is grown by information gain on one
part of the labelled rows, pruned on the rest, and taken into the ordered list while it stays precise.
The list becomes one Spark conditional expression, so that applying it needs no Python beyond the
statistics themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAKS, free_name, hash_sample

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows of labels that a list is fitted on, at most (about; picked by a hash of doc_id).
MAX_LABELLED = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
COUNTS_DDL = ", ".join(f"{c} bigint" for c in COUNTS)

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARKS = b"!?.,;:"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which occurs twice or more; all occurrences count.

    Windows are compared exactly: words get numbers, and windows of twice the width get the number of
    the pair of their halves. ``window`` must be a power of two.
    """
    number: dict[bytes, int] = defaultdict(count().__next__)
    codes = np.array(list(map(number.__getitem__, words)), np.int64)
    step = 1
    while step < window and len(codes) > step:
        pairs = codes[:-step] * (int(codes.max()) + 1) + codes[step:]
        distinct, codes = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(codes):
            return 0
        step *= 2
    if step < window or not len(codes):
        return 0
    starts = np.flatnonzero(np.bincount(codes)[codes] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one whole text; null counts as having no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, WORD_BREAKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _DIGIT)),
        len(raw) - len(raw.translate(None, _MARKS)),
    )


def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_text(t) for t in texts], columns=COUNTS, dtype="int64")


def text_counts(text: Column) -> Column:
    """A struct of ``COUNTS``: one Arrow pass over the text, only numbers come back."""
    return F.pandas_udf(_counts, COUNTS_DDL)(text)


#: Features that rules may test, as Spark expressions over the counts struct: name -> (part, whole).
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "mean_word": ("word_chars", "n_words"),
}
FEATURES = ["n_words", *RATIOS]


def feature(name: str, counts: Column) -> Column:
    if name not in RATIOS:
        return counts[name].cast("double")
    part, whole = RATIOS[name]
    return F.coalesce(counts[part] / F.nullif(counts[whole], F.lit(0)), F.lit(0.0))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.cut if self.above else v < self.cut

    def column(self, counts: Column) -> Column:
        v = feature(self.feature, counts)
        return v >= F.lit(self.cut) if self.above else v < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    covered: int
    precision: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for t in self.tests:
            hit &= t.holds(x)
        return hit

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


def _grow(x: np.ndarray, y: np.ndarray, most_tests: int, cuts: int) -> list[Test]:
    """Add the threshold with the greatest information gain until the rule covers only rejects."""
    tests: list[Test] = []
    inside = np.ones(len(x), bool)
    while len(tests) < most_tests and y[inside].sum() < inside.sum():
        p0, n0 = y[inside].sum(), inside.sum()
        base, best = math.log2(p0 / n0), (0.0, None)
        for j, name in enumerate(FEATURES):
            v = x[inside, j]
            edges = np.unique(np.quantile(v, np.linspace(0, 1, cuts), method="higher"))
            edges = np.unique(np.concatenate([edges, np.quantile(v[y[inside]], np.linspace(0, 1, cuts), method="higher")]))
            order = np.argsort(v, kind="stable")
            sums = np.concatenate([[0], np.cumsum(y[inside][order])])
            at = np.searchsorted(v[order], edges, side="left")
            for above, p, n in ((True, p0 - sums[at], n0 - at), (False, sums[at], at)):
                ok = p > 0
                gain = np.where(ok, p * (np.log2(np.where(ok, p, 1) / np.maximum(n, 1)) - base), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Test(name, above, float(edges[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= best[1].holds(x)
    return tests


def _prune(tests: list[Test], x: np.ndarray, y: np.ndarray) -> list[Test]:
    """The prefix of the tests with the best (p - n) / (p + n) on rows that growing did not see."""
    best, worth = tests, -2.0
    for k in range(len(tests), 0, -1):
        hit = Rule(tuple(tests[:k]), 0, 0).holds(x)
        p, n = y[hit].sum(), (~y[hit]).sum()
        value = (p - n) / (p + n) if p + n else -1.0
        if value >= worth:
            best, worth = tests[:k], value
    return best


def learn(x: np.ndarray, reject: np.ndarray, least_precision: float = 0.9, least_covered: int = 5, most_rules: int = 24, most_tests: int = 5, cuts: int = 48, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that reject; what no rule covers is kept.

    ``x`` holds FEATURES by column. Ties between thresholds go to the feature that stands first. One
    class only, or no rows, gives the empty list.
    """
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    left = np.arange(len(x))
    misses = 0
    while len(rules) < most_rules and misses < 3 and reject[left].sum() >= least_covered and not reject[left].all():
        mixed = rng.permutation(left)
        grow, prune = mixed[: 2 * len(mixed) // 3], mixed[2 * len(mixed) // 3 :]
        if not reject[grow].any():
            break
        tests = _prune(_grow(x[grow], reject[grow], most_tests, cuts), x[prune], reject[prune])
        hit = Rule(tuple(tests), 0, 0).holds(x[left])
        seen = Rule(tuple(tests), 0, 0).holds(x[prune])
        precision = reject[left][hit].mean() if hit.any() else 0.0
        held = reject[prune][seen].mean() if seen.any() else 0.0
        if not tests or hit.sum() < least_covered or min(precision, held) < least_precision:
            misses += 1
            continue
        rules.append(Rule(tuple(tests), int(hit.sum()), float(precision)))
        left = left[~hit]
    return rules


def rejecting_rule(rules: list[Rule], counts: Column) -> Column:
    """The number, from 1, of the first rule that rejects the text; null where none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        test = F.lit(True)
        for t in rules[k - 1].tests:
            test = test & t.column(counts)
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, **learning) -> list[Rule]:
    """Learn the list from the labelled documents: 0 marks what to reject, 1 what to keep.

    At most about ``max_labelled`` labels are taken, picked by a hash of the id. Null ids or labels are
    left out; of repeated labels of an id the lowest counts, of repeated documents the one with the least counts.
    """
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).dropna().groupBy("_id").agg(F.min("_y").alias("_y"))
    marks = hash_sample(marks, "_id", max_labelled)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    # The sample is bounded by max_labelled rows of two numbers, so it is safe to broadcast.
    joined = texts.join(F.broadcast(marks), "_id").select("_id", "_y", text_counts(F.col("_t")).alias("_c"))
    rows = joined.groupBy("_id", "_y").agg(F.min("_c").alias("_c")).select("_id", "_y", *[feature(f, F.col("_c")).alias(f) for f in FEATURES]).toPandas().sort_values("_id")
    if rows.empty:
        return []
    return learn(rows[FEATURES].to_numpy(float), rows["_y"].to_numpy() == 0, **learning)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` and three more columns: counts (struct), rule (int, null: none), kept (boolean).

    Every row is judged by itself: repeated rows get equal results, null and empty texts fail the base
    rule, an empty table stays empty. Where docs has columns with these names, they stay and the new ones get underscores
    behind them.
    """
    counts = free_name(docs, "counts")
    out = docs.withColumn(counts, text_counts(F.col(text_col)))
    c = F.col(counts)
    return out.withColumns({free_name(docs, "rule"): rejecting_rule(rules, c), free_name(docs, "kept"): ~base_failed(c) & rejecting_rule(rules, c).isNull()})
