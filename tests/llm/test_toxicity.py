import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from orrerylake.llm import queries
from orrerylake.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_index_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(900):
        v = {int(t): float(x) for t, x in zip(rng.choice(40, rng.integers(1, 6), replace=False), rng.gamma(1, 1, 6), strict=False)}
        n = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / n for t, x in v.items()})
    index = T.Index(vectors, 40, block=16)
    for q in vectors[::15]:
        every = sorted((-round(sum(x * v.get(t, 0) for t, x in q.items()), 12), i) for i, v in enumerate(vectors))
        want = [(-s, i) for s, i in every[:15] if s < 0]
        got = index.nearest(q, 15)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want]
        edge = round(want[-1][0], 9)
        assert {i for s, i in got if round(s, 9) > edge} == {i for s, i in want if round(s, 9) > edge}


def test_scores_equal_brute_force(spark):
    """Vectors, neighbours, votes and scores of every document anew: all examples compared, no index, no memo."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learnt = labels.where(~T.held_out(F.col("doc_id")))
    model = T.fit(docs, learnt)
    number, texts = model.vectors.number, {r.doc_id: r.text for r in docs.collect()}

    def vector(text):
        out = np.zeros(len(number) + 1)
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for term in [w, *[w[:n] + "*" for n in T.STARTS if len(w) > n]]:
                if term in number:
                    out[number[term]] += 1
        out = np.array([(1 + math.log(c)) * model.vectors.idf[i] if c else 0.0 for i, c in enumerate(out)])
        if out.any():
            out[-1] = T.EVERY
            out /= np.sqrt((out * out).sum())
        return out

    assert number and len(set(model.ids)) == len(model.ids)
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in model.ids)
    examples = np.array([vector(texts[i]) for i in model.ids])
    told = 0
    for r in queries.op4_toxicity(spark, SF).collect():
        own = vector(texts[r.doc_id])
        likeness = np.round(examples @ own, 12)
        near = [i for i in np.argsort(-likeness, kind="stable")[: T.NEIGHBOURS] if likeness[i] > 0]
        assert r.neighbours == len(near)
        if not near:
            assert r.score == model.blank and r.evidence == []
            continue
        told += 1
        # Where the last neighbours tie, any of them may vote: the vote lies between the extremes.
        edge = likeness[near[-1]]
        sure = [i for i in near if likeness[i] > edge + 1e-9]
        tied = np.flatnonzero(np.abs(likeness - edge) <= 1e-9)
        votes = []
        for order in (np.argsort(model.toxic[tied]), np.argsort(-model.toxic[tied])):
            voters = sure + list(tied[order][: len(near) - len(sure)])
            up, all_ = 0.5 * model.prior, 0.5
            for i in voters:
                share = likeness[i] * (model.weight[i])
                up, all_ = up + share * model.toxic[i], all_ + share
            x = up / all_
            votes.append(1 / (1 + math.exp(-(model.slope * math.log(x / (1 - x)) + model.offset))))
        assert min(votes) - 1e-6 <= r.score <= max(votes) + 1e-6
        assert [round(likeness[model.ids.index(e)], 9) for e in r.evidence] == [round(likeness[i], 9) for i in near[:3]]
    assert told > 20


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op4_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert not any(e is not None and zlib.crc32(str(e).encode()) % 5 == 0 for e in r.evidence)
    judged = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    y, s = np.array(judged).T
    assert ((s >= 0.5) == (y == 1)).mean() > 0.97
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean() > 0.94


def test_edge_cases(spark):
    bad, good = "you {} worthless idiot", "a fine {} morning river"
    rows = [(i, (bad if i % 3 == 0 else good).format(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}"), None) for i in range(300)]
    rows += [(None, bad, "x"), (1000, None, "x"), (1001, "", "x"), (1002, "river " * 50_000 + "idiot", "x"), (0, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxicity string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None), (3, 1), (7, 9)], "doc_id bigint, toxic int")
    model = T.fit(docs, labels)
    got = T.score(docs, model)
    assert got.columns == docs.columns
    for r in got.select("doc_id", "text", "toxicity.score").collect():
        assert (r.score >= 0.5) == ("idiot" in (r.text or ""))
    assert T.score(docs.limit(0), model).count() == 0
    empty = T.fit(docs, labels.where(F.lit(False)))
    assert {r.score for r in T.score(docs, empty).select("toxicity.score").collect()} == {0.5} or len(empty.vectors.number) == 0
