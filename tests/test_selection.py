"""Stage selection with its ledger, and the choice between step lists."""

import random

import pytest
from launchgrid.operators import calibrate, selection

SCORES = {("a", 40): (1.0, 1.0), ("b", 40): (0.8, 1.1), ("c", 40): (0.9, 0.9), ("d", 40): (0.7, 0.7), ("d", 20): (0.7, 0.7), ("d", 80): (0.6999, 0.6999)}


def test_stages_are_greedy_and_no_fit_runs_twice(spark, tmp_path):
    ran, path = [], str(tmp_path / "fits")

    def score(config, scheme):
        ran.append((config["bundle"], config["least"], scheme))
        return SCORES[config["bundle"], config["least"]][scheme == "time"]

    def broken(config, scheme):
        if config["bundle"] == "d":
            raise RuntimeError("lost")
        return score(config, scheme)

    args = {"bundle": "a", "least": 40}, [("bundle", ["a", "b", "c", "d"]), ("least", [20, 40, 80])]
    with pytest.raises(RuntimeError):
        selection.choose_stages(spark, *args, broken, path)
    before = len(selection.read_fits(spark, path))
    log = selection.choose_stages(spark, *args, score, path)
    assert before < len(selection.read_fits(spark, path)) == 12
    picked = [(r["stage"], r["bundle"], r["least"]) for r in log if r["chosen"]]
    assert picked == [(1, "d", 40), (2, "d", 40)]  # the gain of the last is below the margin
    assert [r["accepted"] for r in log if r["bundle"] == "b"] == [0]  # worse on one scheme
    ran.clear()
    assert selection.choose_stages(spark, *args, score, path) == log and not ran


def test_fingerprint_is_that_of_the_table(spark):
    config = {"least": 40, "bundle": "weekday"}
    row = selection.config_fingerprint(spark.createDataFrame([(40, "weekday")], "least int, bundle string")).first()
    assert row.fingerprint == selection.fingerprint(config)


def frame(spark, true_y):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        a, b, scale = rng.uniform(0.5, 2), rng.uniform(0.5, 2), 100.0
        y = true_y(a, b)
        rows.append((i % 5, 4 + i % 7, i % 3, y, round(y * scale), scale, 1, a, b, rng.random()))
    return spark.createDataFrame(rows, "fold int, h int, d1_dow int, y double, qty long, scale double, w long, A double, B double, p0 double")


@pytest.mark.parametrize("true_y, best", [(lambda a, b: a, "none"), (lambda a, b: 0.3 * a + 0.7 * b, "blend"), (lambda a, b: 0.9 * a, "horizon")])
def test_the_step_list_that_made_the_rows_is_chosen(spark, true_y, best):
    got = {r.recipe: r for r in calibrate.recipe_choice(frame(spark, true_y), 5, "w").collect()}
    assert [n for n, r in got.items() if r.chosen] == [best]
    assert got["none"].gain == 0 and got["none"].kept == 0
    assert got[best].weighted == pytest.approx(0, abs=1e-9) and (best == "none" or got[best].kept == 1)
