"""Catalogued queries against the second engine. LAUNCHGRID_ALL=1 runs every one, models included."""

import os

import oracle
import pytest
from launchgrid.catalog import CATALOG

SF = os.environ.get("LAUNCHGRID_SF", "/root/testdata/sf0.001")
CORE = [
    "load_facts", "table_profile", "release_dates", "anchors", "pair_window", "target_grid", "future_only_pairs", "history_balance", "label_clip",
    "category_codes", "pair_coverage", "calendar_table", "feast_calendar", "calendar_diff", "site_stats", "site_dow_profile", "price_features",
    "pair_features", "pair_rank", "competition", "incumbents", "item_meta", "market_index", "market_ratio", "ratio_profile", "group_folds",
    "time_purge", "backoff_median", "mix_weights", "error_segments", "auc", "paired_bootstrap", "calibrate_blend", "quantile_snap",
    "crossfit_post", "recipe_choice", "stage_selection", "shifted_features", "holdout_scores", "absorbing_zero", "monotone_curve", "optimal_multiplier", "build_output", "prob_variants", "minimax_regret", "response_curve",
]
NAMES = list(CATALOG) if os.environ.get("LAUNCHGRID_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches(spark, con, name):
    ok, info = oracle.compare(spark, con, name, SF)
    assert ok, info


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["ratio_profile", "group_folds", "error_segments"])
def test_same_result_for_other_partition_counts(spark, name):
    rows = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, CATALOG[name].run(spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
