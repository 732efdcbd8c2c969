"""Checked sinks, strict joins, non-finite values and shifted features."""

import os

import pytest
from launchgrid.functions.joins import strict_join
from launchgrid.operators import diagnose, profile
from launchgrid.sources import sinks

INF, NAN = float("inf"), float("nan")


def ids(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "id long")


def results(spark, *rows):
    return spark.createDataFrame(rows, "id long, total_ticket double")


def test_checked_write_keeps_whole_results(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_checked(results(spark, (2, 7.0), (1, 0.0)), ids(spark, 1, 2), path)
    assert [(r.id, r.total_ticket) for r in spark.read.csv(path, header=True, inferSchema=True).orderBy("id").collect()] == [(1, 0), (2, 7)]
    with pytest.raises(FileExistsError):
        sinks.write_checked(results(spark, (1, 1.0)), ids(spark, 1), path)
    assert spark.read.csv(path, header=True).count() == 2


@pytest.mark.parametrize("rows, asked, said", [
    ([(1, 1.0), (1, 2.0)], [1], "given twice"), ([(1, 1.0)], [1, 1], "asked for twice"), ([(1, 1.0)], [1, 2], "missing"), ([(1, 1.0), (3, 1.0)], [1], "not asked for"),
    ([(1, None)], [1], "no finite value"), ([(1, NAN)], [1], "no finite value"), ([(1, INF)], [1], "no finite value"), ([(1, -1.0)], [1], "no finite value"),
    ([(None, 1.0)], [1], "no id")])
def test_checked_write_fails_and_leaves_nothing(spark, tmp_path, rows, asked, said):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match=said):
        # Only the bad rows may speak up, whichever task comes first.
        sinks.write_checked(results(spark, *rows), ids(spark, *asked).where("id is not null") if said != "no id" else ids(spark), path)
    assert not os.path.exists(path)


def test_ledger_gives_the_latest_entry_of_a_file(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for score in (0.5, 0.4):
        sinks.append_ledger(spark.createDataFrame([("a", score)], "file string, score double"), path)
    sinks.append_ledger(spark.createDataFrame([("b", 0.9)], "file string, score double"), path)
    assert {(r.file, r.score) for r in sinks.read_ledger(spark, path).collect()} == {("a", 0.4), ("b", 0.9)}


def test_strict_join_keeps_rows_or_fails(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    right = lambda *r: spark.createDataFrame(r, "k int, b string")
    got = strict_join(left, right((1, "p"), (2, None), (3, "q")), ["k"]).collect()
    assert sorted((r.k, r.a, r.b or "") for r in got) == [(1, "x", "p"), (1, "y", "p"), (2, "z", "")]
    with pytest.raises(Exception, match="no match for k=2"):
        strict_join(left, right((1, "p")), ["k"]).collect()
    with pytest.raises(Exception, match="more than one match for k=1"):
        strict_join(left, right((1, "p"), (1, "p"), (2, "q")), ["k"]).collect()


def test_nonfinite_values_are_counted_and_cleared(spark):
    df = spark.createDataFrame([(1.0, NAN), (INF, None), (-INF, 2.0), (None, 3.0)], "a double, b double")
    got = {r.feature: tuple(r)[1:] for r in profile.nonfinite_report(df, ["a", "b"]).collect()}
    assert got == {"a": (4, 1, 0, 2), "b": (4, 1, 1, 0)}
    clean = profile.clear_nonfinite(df, ["a", "b"])
    assert [tuple(r) for r in profile.nonfinite_report(clean, ["a", "b"]).orderBy("feature").collect()] == [("a", 4, 3, 0, 0), ("b", 4, 2, 0, 0)]
    assert profile.nonfinite_report(df.limit(0), ["a"]).collect()[0].n_rows == 0


@pytest.mark.parametrize("hot", [200_000, 2])
def test_shifted_features_against_brute_force(spark, hot):
    left, right = [1.0, 2.0, 2.0, 5.0, None], [2.0, 6.0, 7.0]
    mk = lambda v: spark.createDataFrame([(x, 1.0) for x in v], "f double, same double")
    got = {r.feature: r for r in diagnose.shifted_features(mk(left), mk(right), ["f", "same"], hot=hot).collect()}
    a = [x for x in left if x is not None]
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in right) / len(right)) for v in a + right)
    assert got["f"].distance == pytest.approx(want) and (got["f"].left_med, got["f"].right_med) == (2.0, 6.0)
    assert (got["f"].n_left, got["f"].n_right, got["f"].place) == (4, 3, 1)
    assert got["same"].distance == 0 and got["same"].place == 2
