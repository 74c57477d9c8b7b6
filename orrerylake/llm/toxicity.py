"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the starts of words. Those that tell toxic examples from others are chosen by
covering: the most telling term first, then the most telling one on the examples that are not yet told by
COVERED terms, so that words which merely stand beside telling ones are passed over. An index holds
the examples' TF-IDF vectors over these terms, postings cut into blocks with each block's greatest
weights; a search goes through blocks by falling upper bound and stops when no block can still hold one of the
nearest, so its result is exact. The neighbours vote by similarity; votes become calibrated scores
by a curve fitted on the examples, each judged by the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, hash_sample, staged

#: Labelled examples that are taken at most (about; picked by a hash of the id), by label.
MAX_EXAMPLES = {1: 4_000, 0: 12_000}
STARTS = (4, 5, 6, 7)
LEAST_EXAMPLES = 5
#: A term must be this telling (log-likelihood ratio).
LEAST_RATIO = 16.0
#: Terms that a toxic example is to be told by before it counts as covered.
COVERED = 4
BLOCK = 64
NEIGHBOURS = 15

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def parts(word: str) -> list[str]:
    """The terms that a word stands for: itself, and its starts, marked so."""
    return [word, *[word[:n] + "*" for n in STARTS if len(word) > n]]


def terms(text: str | None) -> list[str]:
    return sorted({p for w in set(words(text)) for p in parts(w)})


def ratio(p: np.ndarray, n: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """Log-likelihood ratio of terms in p of pos toxic and n of neg other examples; 0 where they lean to the others."""
    share = (p + n) / max(pos + neg, 1e-9)

    def part(seen: np.ndarray, due: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(due, 1e-12)), 0)

    g = part(p, pos * share) + part(n, neg * share) + part(pos - p, pos * (1 - share)) + part(neg - n, neg * (1 - share))
    return np.where(p * max(neg, 1e-9) > n * pos, g, 0)


def cover(has: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, pos: float, neg: float, least: float) -> list[int]:
    """Numbers of the terms chosen, until none that is left gains more than ``least``. ``has``: for each term the examples that contain it; pos and neg: the
    weight of all toxic and other examples, those without any term included. Of terms in the same examples
    the first is taken.
    """
    left = np.ones(len(toxic), bool)
    told = np.zeros(len(toxic), int)
    chosen: list[int] = []
    value = np.full(len(has), np.inf)  # covering only takes examples away; a stale value is looked at again
    alike: set[bytes] = set()
    for t, own in enumerate(has):
        value[t] = -1 if own.tobytes() in alike else np.inf
        alike.add(own.tobytes())
    while len(has):
        best, gain = -1, least
        for t in np.argsort(-value, kind="stable"):
            if value[t] <= gain:
                break
            own = has[t][left[has[t]]]
            p, n = weight[own][toxic[own]].sum(), weight[own][~toxic[own]].sum()
            g = float(ratio(np.array(p), np.array(n), pos, neg)) if (toxic[own].sum() >= 3) else 0.0
            value[t] = g
            if g > gain:
                best, gain = int(t), g
        if best < 0:
            break
        chosen.append(best)
        value[best] = -1
        told[has[best][toxic[has[best]]]] += 1
        left = told < COVERED
        pos -= weight[toxic & ~left & (told == COVERED) & np.isin(np.arange(len(toxic)), has[best])].sum()
        value[value > 0] = np.inf
    return chosen


#: Weight of a term that every text has once; beside it, the cosine also tells many hits from few.
EVERY = 4.0


class Vectors:
    """TF-IDF over chosen terms and one that every text has: (1 + log tf) * idf, of length 1.

    A text without chosen terms has no vector.
    """

    def __init__(self, chosen: list[str], idf: list[float]):
        self.number = {t: i for i, t in enumerate(chosen)}
        self.idf = idf
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        out = self.known.get(word)
        if out is None:
            out = tuple(n for p in parts(word) if (n := self.number.get(p)) is not None)
            if len(self.known) < 300_000:
                self.known[word] = out
        return out

    def counts(self, text: str | None) -> dict[int, int]:
        found = words(text)
        telling = {w: ns for w in set(found) if (ns := self.of_word(w))}
        out: Counter[int] = Counter()
        if telling:
            for w, c in Counter(w for w in found if w in telling).items():
                for n in telling[w]:
                    out[n] += c
        return dict(sorted(out.items()))

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {n: (1 + math.log(c)) * self.idf[n] for n, c in counts.items()}
        if raw:
            raw[len(self.number)] = EVERY
        length = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {n: v / length for n, v in raw.items()}


class Index:
    """A block-max inverted index of vectors, searched exactly."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, block: int = BLOCK):
        # Vectors with the same leading terms stand together, which keeps the blocks' bounds tight.
        self.order = sorted(range(len(vectors)), key=lambda i: (sorted(vectors[i], key=lambda t: (-vectors[i][t], t)), i))
        self.block = block
        self.blocks = -(-len(vectors) // block)
        self.most = np.zeros((n_terms, self.blocks))
        self.postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        held: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for at, i in enumerate(self.order):
            for t, v in vectors[i].items():
                held.setdefault((t, at // block), []).append((at % block, v))
        for (t, b), pairs in held.items():
            where, value = zip(*pairs, strict=True)
            self.postings[t, b] = np.array(where), np.array(value)
            self.most[t, b] = max(value)

    def nearest(self, vector: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(similarity, number) of the k most similar vectors; equal ones by number; those at 0 are left out."""
        if not vector or not self.blocks:
            return []
        bound = sum(v * self.most[t] for t, v in vector.items())
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] < -best[-1][0] - 1e-12:
                break
            score = np.zeros(self.block)
            for t, v in vector.items():
                if (got := self.postings.get((t, b))) is not None:
                    score[got[0]] += v * got[1]
            for at in np.flatnonzero(score > 0).tolist():
                best.append((-round(float(score[at]), 12), self.order[b * self.block + at]))
            best = sorted(best)[:k]
        return [(-s, i) for s, i in best]


@dataclass
class Model:
    vectors: Vectors
    index: Index
    toxic: np.ndarray
    weight: np.ndarray
    ids: list[int | None]
    prior: float
    #: Score of a text without any of the terms.
    blank: float
    slope: float = 1.0
    offset: float = 0.0
    k: int = NEIGHBOURS

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic neighbours by similarity, with one neighbour's worth of the prior."""
        up, all_ = 0.5 * self.prior, 0.5
        for s, i in near:
            up += s * self.weight[i] * self.toxic[i]
            all_ += s * self.weight[i]
        return up / all_

    def calibrated(self, vote: float) -> float:
        x = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(x / (1 - x)) + self.offset)))

    def judge(self, text: str | None, memo: dict | None = None) -> tuple[float, int, list[int | None]]:
        """(score, neighbours, evidence): evidence are the ids of the nearest examples."""
        counts = self.vectors.counts(text)
        key = tuple(counts.items())
        if memo is not None and key in memo:
            return memo[key]
        near = self.index.nearest(self.vectors.vector(counts), self.k)
        out = (self.calibrated(self.vote(near)) if near else self.blank, len(near), [self.ids[i] for _, i in near[:3]])
        if memo is not None and len(memo) < 200_000:
            memo[key] = out
        return out


def _curve(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes' log odds, by Newton steps with a light pull to (1, 0)."""
    x = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / (1 - np.clip(votes, 1e-6, 1 - 1e-6)))
    a = np.stack([x, np.ones_like(x)], 1)
    w, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(2), a.T @ (weight * (toxic - p)) - (w - start))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.05), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: dict[int, int] = MAX_EXAMPLES) -> Model:
    """Learn from the labelled documents, whose whole texts are read.

    About ``max_examples`` of each label are taken at most. Null ids, labels and labels other than 0 and 1 are left
    out; an id labelled both ways counts as toxic; of equal texts one example is taken, toxic if any is.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().where("y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    totals = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [hash_sample(marks.where(F.col("y") == y), "id", most) for y, most in max_examples.items()]
    # Both samples are bounded by max_examples, two numbers a row, and so is what is derived from them.
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, "id")
    single = texts.groupBy("text").agg(F.max("y").alias("y"), F.min("id").alias("id"))
    term_lists = F.pandas_udf(_term_lists, "array<string>")
    examples = staged(single.select("id", "y", "text", term_lists("text").alias("terms")), "examples")
    sizes = {r.y: r.n for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    scale = {1: 1.0, 0: max(1.0, totals.get(0, 0) / max(1, totals.get(1, 0)) * max(1, pos) / max(1, neg))}
    prior = (pos + 0.5) / (pos + scale[0] * neg + 1)
    counts = examples.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).where((F.col("p") + F.col("n") >= LEAST_EXAMPLES) & (F.col("p") * neg > F.col("n") * pos * 2))
    # Every term that is frequent enough among the examples, whose number is bounded.
    counts = counts.orderBy((F.col("p") / F.sqrt(F.col("p") + F.col("n") * (pos / max(neg, 1)))).desc(), "term").toPandas()
    g = ratio(counts["p"].to_numpy(float), counts["n"].to_numpy(float) * scale[0], pos, neg * scale[0])
    names = counts["term"][g > LEAST_RATIO].tolist()
    held = examples.select("id", "y", F.array_intersect("terms", F.lit(names) if names else F.array().cast("array<string>")).alias("terms")).where(F.size("terms") > 0).toPandas().sort_values("id", ignore_index=True)
    toxic = held["y"].to_numpy() == 1
    weight = np.where(toxic, scale[1], scale[0]).astype(float)
    number = {t: i for i, t in enumerate(names)}
    has: list[list[int]] = [[] for _ in names]
    for i, own in enumerate(held["terms"]):
        for t in own:
            has[number[t]].append(i)
    chosen = [names[t] for t in cover([np.array(h, int) for h in has], toxic, weight, pos, neg * scale[0], LEAST_RATIO)]
    df = {t: len(has[number[t]]) for t in chosen}
    vectors = Vectors(chosen, [math.log((1 + pos + neg) / (1 + df[t])) + 1 for t in chosen])

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([list(vectors.counts(t).items()) for t in texts], dtype=object)

    rows = examples.select("id", "y", F.pandas_udf(count, "array<struct<term:int,n:int>>")("text").alias("counts"))
    telling = rows.where(F.size("counts") > 0).toPandas().sort_values("id", ignore_index=True)
    own = [vectors.vector({r["term"]: r["n"] for r in c}) for c in telling["counts"]]
    y = telling["y"].to_numpy(float)
    weight = np.where(y == 1, scale[1], scale[0]).astype(float)
    blank_pos, blank_all = pos - y.sum(), (pos - y.sum()) + (neg - (1 - y).sum()) * scale[0]
    model = Model(vectors, Index(own, len(chosen) + 1), y, weight, telling["id"].tolist(), prior, float((blank_pos + prior) / (blank_all + 1)))
    if len(own):
        votes = np.array([model.vote([x for x in model.index.nearest(v, model.k + 1) if x[1] != i][: model.k]) for i, v in enumerate(own)])
        model.slope, model.offset = _curve(votes, y, weight)
    return model


def _term_lists(texts: pd.Series) -> pd.Series:
    return pd.Series([terms(t) for t in texts], dtype=object)


def scores(text: Column, model: Model) -> Column:
    """struct<score, neighbours, evidence> of each whole text. The model holds terms of the examples, which MAX_EXAMPLES bounds."""

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for texts in batches:
            yield pd.DataFrame([model.judge(t, memo) for t in texts], columns=["score", "neighbours", "evidence"])

    return F.pandas_udf(judge, "score double, neighbours int, evidence array<bigint>")(text)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``toxicity``: score (0 to 1), neighbours, evidence (ids of the nearest examples).

    The score hangs on the text alone, so repeated rows get equal ones. Null and empty texts, and those
    without any telling term, get the share of toxic examples among the examples without one. An empty
    table stays empty. A column of docs named toxicity is replaced.
    """
    held = free_name(docs, "_toxicity")
    return docs.withColumn(held, scores(F.col(text_col), model)).withColumn("toxicity", F.col(held)).drop(held)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5. Null ids are not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))
