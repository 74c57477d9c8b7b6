"""Exact quantiles against numpy, with ties, extremes, nulls and groups of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerylake.operators.quantiles import ordered_key, quantiles

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, -1.0, 1.5, 0.1, -0.1, 1e300, -1e300, 1.7976931348623157e308, float("inf"), float("-inf"), 3.0, 2.9999999999999996, 2.0**52, 2.0**53 - 1, 7.0 / 3]


def test_keys_are_the_bits(spark):
    rng = np.random.default_rng(1)
    values = EDGES + np.ldexp(rng.normal(size=300), rng.integers(-1070, 1000, 300)).tolist()
    got = {r.v: r.k for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_key(F.col("v")).alias("k")).collect()}
    for v, k in got.items():
        assert k == int(np.float64(abs(v)).view(np.int64)) * (-1 if v < 0 else 1), v
    nan = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(ordered_key(F.col("v")).alias("k")).collect()
    assert nan[0].k > max(got.values()) and nan[1].k is None


def test_equals_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"one": [4.25], "two": [1.0, -3.0], "ties": [2.0] * 50 + [3.0], "wide": np.ldexp(rng.normal(size=400), rng.integers(-300, 300, 400)).tolist(), "close": (1 + np.arange(300) * 2.0**-52).tolist(), None: rng.integers(-9, 9, 200).astype(float).tolist()}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("one", None), ("none", None)]
    shares = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        x = np.sort(own)
        for name, s in shares.items():
            place = s * (len(x) - 1)
            low = int(np.floor(place))
            high = min(low + 1, len(x) - 1)
            want = x[low] + (x[high] - x[low]) * (place - low)
            assert got[g][name] == pytest.approx(want, rel=1e-15), (g, name)


def test_edges(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 1.0), (1, 2.0)], "g int, v double")
    r = quantiles(df, ["g"], "v", {"m": 0.5, "x": 1.0}).first()
    assert r.m == 2.0 and np.isnan(r.x)
    assert quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
    assert quantiles(df.where("v < 9"), [], "v", {"m": 0.5}).first().m == 1.5
    whole = spark.createDataFrame([(3, k) for k in range(101)], "v int, _v int").select(F.col("_v").alias("v"), F.lit("x").alias("_rank"))
    assert quantiles(whole, ["_rank"], "v", {"m": 0.905}).first().m == 90.5
    with pytest.raises(ValueError):
        quantiles(df, ["g"], "v", {"m": 1.5})
