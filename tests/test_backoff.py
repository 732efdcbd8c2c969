"""Back-off tables and cross-fitted steps against plain Python over the same rows."""

import random
import statistics

from launchgrid.operators import calibrate, models
from pyspark.sql import functions as F

LEVELS = [["h", "b"], ["h"]]


def sample(n=400):
    rng = random.Random(3)
    return [(i % 3 if i < n // 2 else 0, 4 + rng.randrange(2), rng.randrange(3), rng.choice([0.0, 0.0, 1.0, 2.5, rng.random()])) for i in range(n)]


def expected(rows, stat, least, fold, h, b):
    others = [r for r in rows if r[0] != fold]
    for pick in (lambda r: r[1] == h and r[2] == b, lambda r: r[1] == h, lambda r: True):
        ys = [r[3] for r in others if pick(r)]
        if len(ys) >= least:
            return stat(ys)
    return stat([r[3] for r in others])


def check(spark, kind, stat, least):
    rows = sample()
    df = spark.createDataFrame(rows, "fold int, h int, b int, y double")
    got = models.backoff_fit_apply(df, LEVELS, kind, least, 3, "v").distinct().collect()
    assert {(r.fold, r.h, r.b) for r in got} == {r[:3] for r in rows}
    for r in got:
        assert abs(r.v - expected(rows, stat, least, r.fold, r.h, r.b)) < 1e-12


def test_medians_of_the_other_folds(spark):
    for least in (1, 40, 120, 10_000):  # the finest level, the next, and the whole
        check(spark, "median", statistics.median, least)


def test_zero_shares_of_the_other_folds(spark):
    for least in (1, 120):
        check(spark, "zero", lambda ys: sum(y == 0 for y in ys) / len(ys), least)


def test_no_row_outside_the_fold_gives_null(spark):
    df = spark.createDataFrame([(0, 4, 1, 1.0)], "fold int, h int, b int, y double")
    for kind in ("median", "zero"):
        assert models.backoff_fit_apply(df, LEVELS, kind, 1, 3, "v").first().v is None


def test_crossfit_post_by_hand(spark):
    """Each step fitted over the other folds' rows, in plain loops."""
    rng, k = random.Random(8), 3
    rows = [(i % k, 4 + i % 2, a := rng.random() + (i % k) * 0.3, rng.random() * 2, rng.random(), a * rng.choice([0.0, 0.8, 1.1]), 1 + i % 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "fold int, h int, A double, B double, p0 double, y double, w bigint")
    got = {(r.fold, r.h, r.A): r.post for r in calibrate.crossfit_post(df, k, "w").collect()}
    best = lambda grid, err: min(grid, key=lambda g: round(err(g), 9))  # the first of equals
    tenth = lambda p: min(int(p * 10), 9)
    for f in range(k):
        train = [r for r in rows if r[0] != f]
        wa = best(calibrate.BLEND_GRID, lambda g: sum(r[6] * abs(r[5] - g * r[2] - (1 - g) * r[3]) for r in train))
        r1 = lambda r: wa * r[2] + (1 - wa) * r[3]
        zm = {}
        for z in range(10):
            part = [r for r in train if tenth(r[4]) == z]
            zm[z] = best(calibrate.ZERO_GRID, lambda g: sum(r[6] * abs(r[5] - g * r1(r)) for r in part)) if len(part) >= calibrate.MIN_BIN else 1.0
        for h in (4, 5):
            part = [r for r in train if r[1] == h]
            hm = best(calibrate.HORIZON_GRID, lambda g: sum(r[6] * abs(r[5] - g * r1(r) * zm[tenth(r[4])]) for r in part))
            for r in rows:
                if r[0] == f and r[1] == h:
                    assert abs(got[f, h, r[2]] - max(r1(r) * zm[tenth(r[4])] * hm, 0)) < 1e-9


def test_crossfit_post_does_not_hold_the_plans_of_its_fits(spark):
    """The result reads the rows and three written parameter tables, so the driver's plan does not grow with the steps."""
    rows = [(i % 3, 4 + i % 2, 1.0 + i % 5, 1.0 + i % 7, i % 10 / 10, 1.0 + i % 4, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "fold int, h int, A double, B double, p0 double, y double, w bigint")
    out = calibrate.crossfit_post(df, 3, "w")
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 4
    assert out.count() == len(rows)


def test_one_fit_of_all_levels_serves_every_choice_of_them(spark):
    df = spark.createDataFrame([(*r, r[1] * r[2] % 3) for r in sample()], "group_fold int, h int, b int, y double, time_fold int")
    shared = models.scheme_medians(df, LEVELS, 3, ["group_fold", "time_fold"]).cache()
    for scheme, levels, least in (("group_fold", LEVELS, 40), ("time_fold", LEVELS[1:], 40), ("time_fold", LEVELS[:1], 120)):
        rows, own = df.withColumn("fold", F.col(scheme)), shared.where(F.col("scheme") == scheme)
        want = models.backoff_fit_apply(rows, levels, "median", least, 3, "v")
        got = models.backoff_from(own, rows, LEVELS, levels, least, "v")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
