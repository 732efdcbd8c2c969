"""Release detection, windows and outputs on hand-made facts, against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from launchgrid import schemas
from launchgrid.operators import calendar, calibrate, competition, correct, curves, folds, pair, profile, release, windows
from launchgrid.plans.features import feature_table
from launchgrid.sources import sinks, tables
from pyspark.sql import functions as F

D0 = dt.date(2024, 1, 1)
SCHEMA = "item string, site string, city string, ds date, qty long, slots long, rate double"


def make_facts(seed=0, tail=None):
    """An old item on the first day, previews before a wide day, gaps, a site that leaves early."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, (item, start, sites) in enumerate([("old", 0, 6), ("prev", 3, 8), ("wide", 5, 8), ("late", 20, 5)]):
        for s in range(sites):
            first = start + (2 if item == "prev" and s > 0 else 0)
            last = start + (4 if s == 1 else 14)
            for day in range(first, last + 1):
                if rng.random() < 0.12 and day > first:
                    continue
                q = int(rng.integers(1, 200))
                if tail is not None and day - first >= 3:
                    q = int(tail.integers(1, 200))
                rows.append((item, f"s{s}", f"c{s % 2}", D0 + dt.timedelta(days=day), q, int(rng.integers(1, 9)), float(q)))
    return rows


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(make_facts(), SCHEMA)


def test_release_rules(facts):
    got = {r["item"]: r for r in release.release_dates(facts, "wide").collect()}
    assert got["old"]["left_censored"] and not got["wide"]["left_censored"]
    assert got["prev"]["shift"] == 2 and got["prev"]["first_ds"] == D0 + dt.timedelta(days=3)
    early = {r["item"]: r["shift"] for r in release.release_dates(facts, "early").collect()}
    assert early["prev"] == 2
    assert {r["item"] for r in release.release_dates(facts, "alltime").collect()} <= set(got)


@pytest.mark.parametrize("offsets", [[0], [-1, 0, 2, 5]])
def test_windows_against_loops(spark, facts, offsets):
    rows = make_facts()
    starts = {"prev": D0 + dt.timedelta(days=5), "wide": D0 + dt.timedelta(days=5), "late": D0 + dt.timedelta(days=20)}
    end = max(r[3] for r in rows)
    cell = {(r[0], r[1], r[3]): r for r in rows}
    want = {}
    for item, d in starts.items():
        for off in offsets:
            d1 = d + dt.timedelta(days=off)
            if d1 + dt.timedelta(days=9) > end:
                continue
            for s in range(8):
                days = [cell.get((item, f"s{s}", d1 + dt.timedelta(days=k))) for k in range(10)]
                if any(days):
                    want[(item, f"s{s}", off)] = [x[4] if x else 0 for x in days]
    st = spark.createDataFrame(list(starts.items()), "item string, d1 date")
    wide = windows.window_wide(facts, st, offsets)
    got = {(r["item"], r["site"], r["off"]): [r["t1"], r["t2"], r["t3"]] + [(x["qty"] if x else 0) for x in r["targets"]] for r in wide.collect()}
    assert got == want
    rows_ = windows.target_rows(windows.observed_pairs(wide)).collect()
    assert all(r["y"] == pytest.approx(r["qty"] / max((r["t1"] + r["t2"] + r["t3"]) / 3, 1)) for r in rows_)
    assert len(rows_) == 7 * sum(v[2] > 0 for v in want.values())


def test_bad_span_flag(spark, facts):
    bad = spark.createDataFrame([(D0 + dt.timedelta(days=14), D0 + dt.timedelta(days=14))], "start date, end date")
    st = spark.createDataFrame([("wide", D0 + dt.timedelta(days=5))], "item string, d1 date")
    got = {r["off"]: r["bad"] for r in windows.anchors(st, facts, [0, 8, 10, 12], bad).collect()}
    assert got == {0: True, 8: True, 10: False, 12: False}


def test_features_see_only_observed_days(spark):
    def table(tail):
        f = spark.createDataFrame(make_facts(tail=tail), SCHEMA)
        st = spark.createDataFrame([("wide", D0 + dt.timedelta(days=5))], "item string, d1 date")
        cal = calendar.calendar_table(calendar.spine(f), spark.createDataFrame([(D0, "weekday", "holiday")], "ds date, day_type string, holiday_type string"))
        rows = feature_table(windows.window_wide(f, st, [0]), cal)
        return sorted(map(str, rows.drop("y", "qty").orderBy("site", "h").collect()))

    assert table(np.random.default_rng(5)) == table(np.random.default_rng(6))


def test_rounding_rules(spark):
    rq = spark.createDataFrame([(1, "a", "s", D0), (2, "b", "s", D0), (3, "c", "s", D0)], "id long, item string, site string, ds date")
    p = spark.createDataFrame([("a", "s", D0, 0.5, 5.0, 9), ("b", "s", D0, 0.5, 5.0, 0)], "item string, site string, ds date, ratio double, scale double, sum3 long")
    assert [r[1] for r in correct.build_output(rq, p).orderBy("id").collect()] == [3, 0, 0]
    assert [r[1] for r in correct.build_output(rq, p, "even").orderBy("id").collect()] == [2, 0, 0]
    assert set(correct.validate_output(correct.build_output(rq, p), rq).first()) == {1}


def cells(spark, values):
    rows = [("i", "s", 0, h + 4, float(h + 1) if v is not None else None, v, 1.0) for h, v in enumerate(values) if v is not None]
    return calibrate.by_horizon(spark.createDataFrame(rows, "item string, site string, off int, h int, y double, r double, w double"), "r")


@pytest.mark.parametrize("tau, want", [(0.1, [0.9, 0.5, 0, 0, 0]), (0.0, [0.9, 0.5, 0.01, 0.4, 0.8]), (10.0, [0] * 5)])
def test_absorbing_zero(spark, tau, want):
    got = cells(spark, [0.9, 0.5, 0.01, 0.4, 0.8]).select(calibrate.absorb(F.col("cells"), tau)).first()[0]
    assert got == want + [None, None]


def test_absorbing_zero_ignores_missing_cells(spark):
    got = cells(spark, [0.5, None, 0.6]).select(calibrate.absorb(F.col("cells"), 0.1)).first()[0]
    assert got == [0.5, None, 0.6] + [None] * 4


def test_monotone_curve(spark):
    rng = np.random.default_rng(0)
    r = rng.uniform(0, 2, 8000)
    y = 1.5 * r + rng.normal(0, 0.05, 8000)
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(r, y)], "A double, y double, w double")
    knots = curves.monotone_curve(df, [], "A", bins=40, hot=50)
    v = [k["v"] for k in knots.orderBy("k").collect()]
    assert all(b >= a for a, b in zip(v, v[1:])) and len(v) > 30
    probe = spark.createDataFrame([(0.5,), (1.0,), (1.5,)], "A double")
    got = [x["m"] for x in curves.apply_curve(probe, knots, [], "A", "m").orderBy("A").collect()]
    assert np.allclose(got, [0.75, 1.5, 2.25], atol=0.08)


@pytest.mark.parametrize("rows", [[(1.0, 1.0, 1.0)] * 500, [(i / 100, i / 100, 1.0) for i in range(100)]])
def test_monotone_curve_falls_back_to_identity(spark, rows):
    df = spark.createDataFrame(rows, "A double, y double, w double")
    assert [(k["x"], k["v"]) for k in curves.monotone_curve(df, [], "A").orderBy("k").collect()] == [(0.0, 0.0), (1.0, 1.0)]


def test_level_errors_against_all_pairs(spark):
    from launchgrid.operators import curves

    rnd = random.Random(4)
    ys = {k: [rnd.choice([0.0, 0.5, 1.0, rnd.random() * 3]) for _ in range(40)] for k in (1, 2)}
    rs = {k: [rnd.choice([0.0, 1.0, -0.5, rnd.random() * 2]) for _ in range(30)] for k in (1, 2)}
    t = spark.createDataFrame([(k, y) for k in ys for y in ys[k]] + [(3, 1.0), (1, None)], "k int, y double")
    q = spark.createDataFrame([(k, r) for k in rs for r in rs[k]] + [(4, 1.0), (2, None)], "k int, r double")
    err = lambda k, m: sum(abs(y - m * r) for y in ys[k] for r in rs[k]) / len(ys[k]) / len(rs[k])
    grid = [round(0.4 + 0.02 * i, 4) for i in range(81)]
    for hot in (3, 1000):
        got = {r.k: r for r in curves.optimal_multiplier(t, q, ["k"], grid, hot=hot).collect()}
        assert set(got) == {1, 2}
        for k, r in got.items():
            best = min(grid, key=lambda m: (round(err(k, m), 12), m))
            assert r.best_m == best and abs(r.err_best - err(k, best)) < 1e-9 and abs(r.err_at_1 - err(k, 1.0)) < 1e-9
            assert (r.n_true, r.n_pred) == (40, 30)
    flat = curves.optimal_multiplier(spark.createDataFrame([(1, 2.0)], "k int, y double"), spark.createDataFrame([(1, 0.0)], "k int, r double"), ["k"], grid)
    assert flat.first().best_m == grid[0]  # all equal: the first


def test_curves_learn_from_other_folds_only(spark):
    from launchgrid.operators import curves

    rnd = random.Random(6)
    rows = [(i % 5, rnd.random() * 2, 1) for i in range(1500)]
    frame = spark.createDataFrame([(i, f, x, 0.5 * x, w) for i, (f, x, w) in enumerate(rows)], "id int, fold int, A double, y double, w int")
    cut = lambda df: {r.id: r.mapped for r in curves.curve_crossfit(df, 5, [], "A", bins=10, least=20).select("id", "mapped").collect()}
    whole = cut(frame)
    assert sum(abs(whole[i] - 0.5 * x) for i, (_, x, _) in enumerate(rows)) < 0.05 * sum(0.5 * x for _, x, _ in rows)
    other = cut(frame.withColumn("y", F.when(F.col("fold") == 2, F.lit(9.0)).otherwise(F.col("y"))))
    assert all(other[i] == whole[i] for i, (f, _, _) in enumerate(rows) if f == 2) and any(other[i] != whole[i] for i, (f, _, _) in enumerate(rows) if f != 2)
    few = curves.curve_crossfit(frame.limit(50), 5, [], "A", bins=10, least=2, enough=400)
    assert few.where("mapped = A").count() == 50


def test_rounded_objective_against_every_value(spark):
    from launchgrid.operators import calibrate

    rnd = random.Random(7)
    rows = [(h, rnd.randrange(9), rnd.random() * 3 - 0.2, rnd.choice([1.0, 2.5, 7.0]), rnd.randrange(1, 4)) for h in (4, 5) for _ in range(60)]
    got = {r.h: r for r in calibrate.calibrate_rounded(spark.createDataFrame(rows, "h int, qty int, A double, scale double, w int"), ["h"], "A", weight="w").collect()}
    for h in (4, 5):
        mine = [r for r in rows if r[0] == h]
        err = lambda g: sum(w * abs(q - math.floor(max(g * a, 0) * s + 0.5)) / s for _, q, a, s, w in mine) / sum(r[4] for r in mine)
        best = min(calibrate.HORIZON_GRID, key=lambda g: (round(err(g), 9), g))
        assert got[h].mult == best and abs(got[h].err - err(best)) < 1e-9 and abs(got[h].err_at_1 - err(1.0)) < 1e-9


def test_gaps_in_level_prices_and_scores(spark):
    """A week without a level, a city without a Friday price, an entry without a score."""
    from launchgrid.operators import market, selection

    days = spark.sql("select explode(sequence(date '2024-01-01', date '2024-01-28')) as ds")
    level = days.where("ds not between date '2024-01-15' and date '2024-01-21'").selectExpr("ds", "if(ds < date '2024-01-15', 1d, 3d) as f", "1d as tps", "1L as n_items")
    none = spark.createDataFrame([], "k int, level double")
    got = {str(r.ds): r.level for r in market.market_index(level, days, "2024-01-22", none).collect()}
    assert got["2024-01-14"] == 1 and got["2024-01-22"] == 3 and all(1 < got[f"2024-01-{k}"] < 3 for k in range(15, 22))
    ranks = {r.file: (r.expected, r.place) for r in selection.ledger_rank(spark.createDataFrame([("a", None), ("b", 0.5), ("c", 0.4)], "file string, score double")).collect()}
    assert ranks["a"] == (None, 3) and ranks["c"][1] == 1



@pytest.mark.parametrize("low", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_displaced_mass(spark, low):
    rng = np.random.default_rng(0)
    n = 4000
    scale, ratio = rng.integers(1, 400, n).astype(float), rng.uniform(0.05, 1.2, n)
    hit = rng.random(n) < 0.1
    ref = np.floor(ratio * scale + 0.5)
    new = np.floor(ratio * np.where(hit, 0.5, 1.0) * scale + 0.5)
    y = ref.copy()
    down = hit & (rng.random(n) < low)
    y[down], y[hit & ~down] = 0.0, ref[hit & ~down] * 3
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(scale, ref, new, y)], "scale double, a double, b double, qty double")
    got = correct.displaced_mass(df, "a", "b").first()
    d = np.abs(new - ref) / scale
    assert got["f"] == pytest.approx((d * (np.abs(y - new) < np.abs(y - ref))).sum() / d.sum(), abs=1e-9)
    assert abs(got["gain"]) <= got["ceiling"] + 1e-12


def test_off_runs_and_repeated_holiday(spark):
    days = spark.createDataFrame([(D0 + dt.timedelta(days=i),) for i in range(14)], "ds date")
    hol = spark.createDataFrame([(dt.date(2024, 1, 8), "weekday", "holiday")] * 2, "ds date, day_type string, holiday_type string")
    cal = calendar.off_runs(calendar.calendar_table(days, hol)).orderBy("ds").collect()
    assert len(cal) == 14
    assert [c["run"] for c in cal] == [0, 0, 0, 0, 0, 3, 3, 3, 0, 0, 0, 0, 2, 2]


def test_repeated_holiday_keeps_the_first_row_whole(spark, tmp_path):
    path = tmp_path / "holidays.csv"
    names = [f.name for f in schemas.HOLIDAYS.fields]
    first = {"date": "2024-01-08", "day_tipe": "weekend", "holiday_tipe": "normal", "holiday_name": "b"}
    again = {"date": "2024-01-08", "day_tipe": "friday", "holiday_tipe": "holiday", "holiday_name": "a"}
    path.write_text("\n".join(",".join(x) for x in [names, *[[r.get(n, "") for n in names] for r in (first, again)]]) + "\n")
    days = spark.createDataFrame([(dt.date(2024, 1, 8),)], "ds date")
    got = calendar.calendar_table(days, tables.load_holidays(spark, str(path))).first()
    assert (got["dtype"], got["hol"]) == (2, 0)


def test_competition_matches_a_plain_sum(spark, facts):
    rel = release.release_dates(facts, "wide").where("not left_censored")
    strength = competition.launch_strength(facts, rel)
    per = {(r["site"], r["ds"]): r["strength"] for r in strength.collect()}
    wide = windows.window_wide(facts, rel, [0])
    rows = windows.target_rows(pair.item_opening(windows.observed_pairs(wide), wide))
    for r in competition.competition(rows, strength, facts).collect():
        lo = r["d1"] + dt.timedelta(days=2)
        want = sum(v for (s, ds), v in per.items() if s == r["site"] and lo < ds <= r["ds"])
        assert r["comp_cl"] == pytest.approx(np.log1p(want))


def test_fold_blocks_purge(spark, facts):
    st = spark.createDataFrame([("prev", D0 + dt.timedelta(days=5)), ("late", D0 + dt.timedelta(days=20))], "item string, d1 date")
    pairs = windows.observed_pairs(windows.window_wide(facts, st, [0]))
    f = folds.time_folds(folds.items_of(pairs), 2)
    got = {(r["item"], r["train_for"]) for r in folds.purged_training(pairs, f).collect()}
    assert got == {("prev", 1), ("late", 0)}


def test_pair_rank_with_a_hot_item(spark, facts):
    st = spark.createDataFrame([("wide", D0 + dt.timedelta(days=5))], "item string, d1 date")
    pairs = windows.observed_pairs(windows.window_wide(facts, st, [0]))
    a, b = (sorted(map(str, pair.pair_rank(pairs, hot=h).select("site", "rank_pct", "rank_order").collect())) for h in (1, 10**9))
    assert a == b and len(a) == pairs.count()


def test_balance_keeps_history(spark, facts):
    st = spark.createDataFrame([("prev", D0 + dt.timedelta(days=3))], "item string, d1 date")
    wide = windows.window_wide(facts, st, [0, 5])
    out = windows.balance_history(wide, 0.0)
    assert out.where("t1 + t2 + t3 = 0").count() == 0 and out.count() == wide.where("t1 + t2 + t3 > 0").count()


def test_csv_round_trip(spark, tmp_path, facts):
    head = ",".join(f.name for f in schemas.FACTS)
    (tmp_path / "facts.csv").write_text(head + "\n2024-01-02, s1 ,City, Film ,5,0.5,2\n2024-01-02,s1,City,Film,3,0.7,1\n")
    got = tables.load_facts(spark, str(tmp_path / "facts.csv")).collect()
    assert len(got) == 1 and got[0]["qty"] == 8 and got[0]["item"] == "Film" and got[0]["rate"] == pytest.approx(0.6)
    prof = profile.table_profile(facts, ["item", "site", "ds"], "qty").first()
    assert prof["repeated_keys"] == 0 and prof["n_rows"] == facts.count()
    res = spark.createDataFrame([(2, 5), (1, 4)], "id long, total_ticket long")
    sinks.write_results(res, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == ["1", "2"]
    with pytest.raises(Exception, match="exists"):
        sinks.write_results(res, str(tmp_path / "out"))


def test_simplex_grid():
    assert len(calibrate.simplex(4, 0.1)) == 286 and all(abs(sum(w) - 1) < 1e-9 for w in calibrate.simplex(3, 0.1))


def test_bootstrap_counts_have_the_spread_of_drawing_with_replacement(spark):
    from launchgrid.operators import metrics

    n = 1_000_003
    got = spark.range(n).selectExpr(f"{metrics.draw_count('id')} as c").selectExpr("avg(c) as m", "var_pop(c) as v").first()
    assert abs(got.m - 1) < 1e-3 and abs(got.v - 1) < 2e-3
    rows = [(f"i{i}", float(i % 7) - 2, 1.0) for i in range(400)]
    out = metrics.paired_bootstrap(spark.createDataFrame(rows, "item string, num double, den double")).first()
    sd = (sum((r[1] - sum(x[1] for x in rows) / 400) ** 2 for r in rows) / 400) ** 0.5 / 20
    assert abs((out.hi - out.lo) / (2 * 1.96 * sd) - 1) < 0.12


def test_early_shape_is_the_exponential():
    from launchgrid.catalog import output_queries

    assert abs(output_queries._SHAPES["early"][10] - 0.416446) < 1e-5
