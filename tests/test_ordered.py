"""Ordered statistics against brute force, with groups cut into ranges and without."""

import numpy as np
import pytest
from launchgrid.functions import ordered
from pyspark.sql import functions as F


def sample(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    # one key holds most rows, values repeat
    rows = [(("hot" if rng.random() < 0.7 else f"k{rng.integers(3)}"), float(np.round(rng.gamma(2.0), 2)), int(rng.integers(0, 5))) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v double, w long")


@pytest.mark.parametrize("hot", [5, 10**9])
def test_quantiles(spark, hot):
    rows, df = sample(spark)
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.999}, hot=hot).collect()}
    for k in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == k]
        assert got[k]["n"] == len(v)
        for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.999)):
            assert got[k][name] == pytest.approx(np.quantile(v, q))


@pytest.mark.parametrize("hot", [5, 10**9])
def test_lower_element_quantile_and_whole_table(spark, hot):
    rows, df = sample(spark)
    v = sorted(r[1] for r in rows)
    got = ordered.quantiles(df, [], "v", {"q": 0.37}, interpolate=False, hot=hot).first()["q"]
    assert got == v[int(0.37 * (len(v) - 1))]


@pytest.mark.parametrize("hot", [5, 10**9])
def test_rank_is_a_permutation_in_order(spark, hot):
    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("a"), F.col("id").cast("string").alias("b"))
    got = ordered.ranked(df, [], [F.col("a"), F.col("b")], total="n", hot=hot).orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(500)) and got[0]["n"] == 500
    assert [(r["a"], r["b"]) for r in got] == sorted((r["a"], r["b"]) for r in got)


@pytest.mark.parametrize("hot", [1, 10**9])
@pytest.mark.parametrize("values, weights, want", [
    ([1.0, 5.0, 3.0], [1.0, 1.0, 1.0], 3.0), ([1.0, 9.0], [0.001, 1000.0], 9.0), ([2.0, 4.0, 6.0], [0.0, 0.0, 0.0], 4.0)])
def test_weighted_median_known(spark, values, weights, want, hot):
    df = spark.createDataFrame([(1, v, w) for v, w in zip(values, weights)], "k int, v double, w double")
    assert ordered.weighted_median(df, ["k"], "v", "w", hot=hot).first()["wmedian"] == want


def test_weighted_median_of_nothing(spark):
    df = spark.createDataFrame([], "k int, v double, w double")
    assert ordered.weighted_median(df, ["k"], "v", "w").count() == 0


@pytest.mark.parametrize("hot", [5, 10**9])
def test_weighted_median_brute(spark, hot):
    rows, df = sample(spark, 800, 3)
    got = {r["k"]: r["wmedian"] for r in ordered.weighted_median(df, ["k"], "v", "w", hot=hot).collect()}
    for k in got:
        part = sorted((r[1], r[2]) for r in rows if r[0] == k)
        c = np.cumsum([w for _, w in part])
        assert got[k] == part[int(np.searchsorted(c, 0.5 * c[-1]))][0]


def test_near_equal_blocks(spark):
    for n in (5, 7, 12, 23):
        got = [r["b"] for r in spark.range(n).select(ordered.near_equal_block(F.col("id"), F.lit(n), 5).alias("b"), "id").orderBy("id").collect()]
        want = [i for i, part in enumerate(np.array_split(np.arange(n), 5)) for _ in part]
        assert got == want
