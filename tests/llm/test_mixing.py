import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerylake.llm import mixing

SF = "/root/testdata/sf0.01"


def test_raked_margins_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.weigh(docs).select("doc_id", "source", "lang", "text", "mix.*").collect()
    total = sum(r.tokens for r in rows)
    for name, of in (("source", lambda r: r.source), ("lang", lambda r: r.lang), ("topic", lambda r: r.topic)):
        have = defaultdict(float)
        for r in rows:
            assert r.tokens == len(r.text.encode().split())
            have[of(r)] += r.weight * r.tokens
        goal = {k: v for k, v in mixing.PLAN.margins[name].items() if k in have}
        for k, v in have.items():
            assert v / total == pytest.approx(goal[k] / sum(goal.values()), rel=1e-9)
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(mixing.PLAN.keep * total, rel=1e-9)
    for r in rows:
        draw = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.sampled == (draw < r.probability)
        hits = [n for n, strings in mixing.TOPICS.items() if any(x in r.text for x in strings)]
        assert r.topic == (hits[0] if hits else mixing.GENERAL)


def test_rake_says_what_it_misses():
    tokens = np.array([5.0, 1.0, 2.0, 4.0])
    codes = {"a": np.array([0, 0, 1, 1]), "b": np.array([0, 1, 0, 1])}
    fitted, error = mixing.rake(tokens, codes, {"a": np.array([3.0, 9.0]), "b": np.array([8.0, 4.0])})
    assert error <= mixing.TOLERANCE
    assert np.bincount(codes["a"], fitted) == pytest.approx([3, 9]) and np.bincount(codes["b"], fitted) == pytest.approx([8, 4])
    assert fitted[0] * fitted[3] / (fitted[1] * fitted[2]) == pytest.approx(5 * 4 / (1 * 2))  # raking keeps the odds ratio
    diagonal = {"a": np.array([0, 1]), "b": np.array([0, 1])}
    _, error = mixing.rake(np.array([1.0, 1.0]), diagonal, {"a": np.array([1.5, 0.5]), "b": np.array([0.5, 1.5])})
    assert error > 0.5
    assert mixing.rake(np.array([2.0]), {}, {})[1] == 0


def test_margins_achieved(spark):
    rows = [(i, "a b c d", f"s{i % 2}", "en" if i % 2 else "de") for i in range(40)] + [(None, "a", None, None), (99, None, "s0", "de"), (1, "a b c d", "s1", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    plan = mixing.Plan((("s0", 0.75), ("s1", 0.25)), (("de", 0.75), ("en", 0.25)), (("general", 1.0),), keep=0.9)
    got = {(r.margin, r.category): r for r in mixing.achieved(mixing.weigh(docs, plan), plan).collect()}
    assert {k: r.tokens for k, r in got.items() if k[0] != "topic"} == {("source", "s0"): 80, ("source", "s1"): 84, ("source", "other"): 1, ("lang", "de"): 80, ("lang", "en"): 84, ("lang", "other"): 1}
    for r in got.values():
        assert r.weighted == pytest.approx(r.target)
    assert got["source", "s0"].cut == 80 and got["source", "s0"].expected < 0.75 and got["source", "s1"].cut == 0
    crossed = mixing.Plan((("s0", 0.75), ("s1", 0.25)), (("de", 0.25), ("en", 0.75)), (("general", 1.0),))
    with pytest.warns(UserWarning, match="margins"):
        missed = mixing.achieved(mixing.weigh(docs, crossed), crossed).collect()
    assert max(abs(r.weighted - r.target) for r in missed) > 0.3
    assert mixing.achieved(mixing.weigh(docs.limit(0), plan), plan).count() == 0


def test_kept_columns_give_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = {r.doc_id: r.mix for r in mixing.weigh(docs).collect()}
    assert {r.doc_id: r.mix for r in mixing.weigh(docs, keep=["doc_id"]).collect()} == every


def test_probabilities_meet_the_budget():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 30)
        tokens, weight = rng.integers(1, 1000, n).astype(float), rng.gamma(0.5, 2, n)
        for keep in (0.0, 0.1, 0.7, 1.0):
            p = mixing.probabilities(tokens, weight, keep * tokens.sum())
            assert (p <= 1).all() and (p * tokens).sum() == pytest.approx(keep * tokens.sum(), rel=1e-9)
            low = p < 1
            assert np.ptp((p / weight)[low]) < 1e-9 * max(1, (p / weight)[low].max()) if low.any() else True


def test_edge_cases(spark):
    rows = [(1, None, None, None, "x"), (2, "a b", "src1", "en", "x"), (2, "a b", "src1", "en", "x"), (None, "c " * 90_000, "new", "xx", None), (4, "", "src1", "en", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, mix string")
    got = mixing.weigh(docs).select("doc_id", "source", "mix.*").collect()
    assert sorted((str(r.doc_id), r.tokens) for r in got) == [("1", 0), ("2", 2), ("2", 2), ("4", 0), ("None", 90_000)]
    kept = mixing.sample(docs, mixing.Plan((("src1", 1.0),), (("en", 1.0),), (("general", 1.0),), keep=1.0))
    assert kept.columns == docs.columns
    assert mixing.weigh(docs.limit(0)).count() == 0
    assert mixing.sample(docs.where(F.lit(False))).count() == 0
