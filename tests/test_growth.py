"""Queries on rows made here: windows past the last fact, and steps that must not grow faster than the rows."""

import datetime as dt
import random

import oracle
import pytest
from launchgrid.catalog import CATALOG


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with an events table of 24 days; users start on different days."""
    rng = random.Random(5)
    rows = []
    for user in range(40):
        first = rng.randrange(0, 20)
        for _ in range(60):
            day = first + min(int(rng.expovariate(0.25)), 23 - first)
            ts = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=rng.randrange(86400))
            rows.append((len(rows), ts, user, rng.choice(["view", "click", "signup"]), rng.uniform(1, 60), f'{{"k": {rng.randrange(2)}}}'))
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/whole")
    spark.read.parquet(f"{folder}/whole").coalesce(1).toPandas().to_parquet(f"{folder}/events.parquet", coerce_timestamps="us")
    return folder


def test_competition_is_imputed_past_the_last_fact(spark, events):
    ok, info = oracle.compare(spark, oracle.connection(events), "competition_imputed", events)
    assert ok, info
    key = ["item", "site", "off", "h"]
    known, whole = (CATALOG[n].run(spark, events) for n in ("competition", "competition_imputed"))
    late = whole.join(known, key, "left_anti")
    assert whole.count() == known.count() + late.count() and late.count() > 0


def test_back_off_keeps_every_row_without_a_table(spark):
    """No row to learn from, an unknown bin, and a fold that has no entry: the row stays, with the best level or none."""
    from launchgrid.operators import models

    rows = spark.createDataFrame([(4, "a", 0), (4, None, 1), (5, "b", 2)], "h int, p string, fold int")
    none = spark.createDataFrame([], "fold int, level int, key string, value double")
    assert [r.v for r in models.backoff_lookup(rows, none, [["h", "p"], ["h"]], ["fold"], "v").collect()] == [None] * 3
    some = spark.createDataFrame([(0, 0, "4|a", 1.0), (0, 2, "", 9.0), (1, 1, "4", 2.0), (2, 2, "", 3.0)], none.schema)
    got = {r.fold: r.v for r in models.backoff_lookup(rows, some, [["h", "p"], ["h"]], ["fold"], "v").collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0}


def test_shared_windows_are_written_once(spark, events):
    """Folds, pairs and rows read one written table; offset 0 is cut alone and equals the wide table's."""
    from launchgrid.catalog.base import Data

    d = Data(spark, events)
    files = {f for df in (d.pairs, d.frame) for f in df.inputFiles()}
    assert files and all("/table-" in f for f in files)
    key = ["item", "site", "off", "h", "y", "A", "B", "w"]
    one, all_ = ([tuple(r) for r in df.select(*key).orderBy(*key).collect()] for df in (d.opening_frame, d.frame.where("off = 0")))
    assert one == all_ and len(one) > 0
    wide, alone = (sorted(map(str, df.collect())) for df in (d.sparse_wide.where("off = 0"), d.release_wide))
    assert wide == alone and len(alone) > 0


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64])
def test_bisection_counts_like_a_scan(spark, n):
    from launchgrid.functions.ordered import count_below
    from pyspark.sql import functions as F

    line = [float(i // 2) for i in range(n)]
    rows = spark.createDataFrame([(line, v) for v in (-1.0, 0.0, 3.0, 15.5, 31.0, 99.0, None)], "line array<double>, v double")
    for equal in (False, True):
        scan = "size(filter(line, e -> e <= v))" if equal else "size(filter(line, e -> e < v))"
        out = count_below(rows, "line", F.col("v"), "got", 64, equal=equal).selectExpr("got", f"{scan} as want").collect()
        assert [r.got for r in out] == [r.want for r in out]
