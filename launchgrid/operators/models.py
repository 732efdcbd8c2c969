"""Predictors without a learner: priors, back-off tables, item curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchgrid.functions.ordered import medians, quantiles, running
from launchgrid.session import durable


def decay_prior(rows: DataFrame) -> DataFrame:
    """Median of y over uplift per horizon; an empty horizon takes its neighbour's."""
    out = quantiles(rows, ["h"], F.expr("y / greatest(uplift, 1e-6)"), {"prior": 0.5}, extra={"_u": F.col("uplift")})
    seven = rows.sparkSession.range(4, 11).select(F.col("id").cast("int").alias("h"))
    whole = seven.join(F.broadcast(out), "h", "left")
    w = Window.partitionBy().orderBy("h")  # seven rows
    filled = F.coalesce(F.last("prior", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                        F.first("prior", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return whole.select("h", filled.alias("prior"), (F.col("_u") / F.col("n")).alias("mean_uplift"), "n")


def baselines(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """Error of four simple predictions in one pass over the rows."""
    preds = {"scale": F.lit(1.0), "last_day": F.col("t3") / F.col("scale"), "uplift": F.col("uplift"),
             "prior_uplift": F.col("prior") * F.col("uplift")}
    wide = rows.join(F.broadcast(prior.select("h", "prior")), "h").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.abs(F.col("y") - F.greatest(p, F.lit(0.0)))).alias(k) for k, p in preds.items()])
    return wide.unpivot(["n"], list(preds), "baseline", "mase")


# ------------------------------------------------------------------ back-off tables
# Key levels from the most specific to the least, and the least group size.
BACKOFF_LEVELS = [["h", "d1_dow", "pattern", "sb"], ["h", "d1_dow", "pattern"], ["h", "pattern", "sb"],
                  ["h", "d1_dow"], ["h", "pattern"], ["h"]]
CURVE_LEVELS = [["h", "dow", "trend", "size", "up"], ["h", "dow", "trend", "up"], ["h", "dow", "trend"], ["h", "dow", "up"],
                ["h", "dow", "size"], ["h", "dow"], ["h", "trend"], ["h"]]


def level_keys(levels: list[list[str]]) -> Column:
    """``level, key`` of a row at every level; the last level holds all rows."""
    key = lambda lv: F.concat_ws("|", *[F.col(c).cast("string") for c in lv]) if lv else F.lit("")
    return F.inline(F.array(*[F.struct(F.lit(i).alias("level"), key(lv).alias("key")) for i, lv in enumerate([*levels, []])]))


def scheme_medians(train: DataFrame, levels: list[list[str]], k: int, schemes: list[str]) -> DataFrame:
    """Median of y per (scheme, fold, level, key) over the rows outside the fold: ``scheme, fold, level, key, value, n``.

    A scheme is a column of fold numbers. Folds are columns of counts: one ordering per level serves them all, as the
    running count of "all other folds" is the whole running count less the fold's own.
    """
    finest = list(dict.fromkeys(c for lv in levels for c in lv))
    names = {(s, f): f"_c{i}_{f}" for i, s in enumerate(schemes) for f in range(k)}
    counts = train.groupBy(*finest, "y").agg(*[F.count(F.when(F.col(s) == f, 1)).alias(c) for (s, f), c in names.items()])
    run = running(counts.select("y", *names.values(), level_keys(levels)), ["level", "key"], F.col("y"), {c: F.col(c) for c in names.values()})
    parts = []
    for s, f in names:
        rest = lambda end: sum((F.col(names[s, g] + end) for g in range(k) if g != f), F.lit(0))
        n, upto = rest("_tot"), rest("_cum")
        pos = F.lit(0.5) * (n - 1)
        at = lambda j: F.max(F.when((upto - rest("") <= j) & (j < upto), F.col("_v")))
        lower, upper = at(F.floor(pos)), at(F.ceil(pos))
        parts.append(F.struct(F.lit(s).alias("scheme"), F.lit(f).alias("fold"), (lower + (upper - lower) * F.lit(0.5)).alias("value"), F.max(n).alias("n")))
    return run.groupBy("level", "key").agg(F.array(*parts).alias("_f")).select("level", "key", F.inline("_f"))


def other_medians(train: DataFrame, levels: list[list[str]], k: int) -> DataFrame:
    """Median of y per (fold, level, key) over the rows outside the fold: ``fold, level, key, value, n``."""
    return scheme_medians(train, levels, k, ["fold"]).drop("scheme")


def other_zero_shares(train: DataFrame, levels: list[list[str]], k: int) -> DataFrame:
    """Share of y = 0 per (fold, level, key) over the rows outside the fold: ``fold, level, key, value, n``.

    Rows are counted once by fold and finest key, which are bins; levels and folds are rolled up from those counts.
    """
    finest = list(dict.fromkeys(c for lv in levels for c in lv))
    counts = train.groupBy("fold", *finest).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y") == 0).alias("_z"))
    at = lambda c, f: F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0))
    parts = [F.struct(F.lit(f).alias("fold"), F.try_divide(at("_z", f), at("_n", f)).alias("value"), at("_n", f).alias("n")) for f in range(k)]
    rolled = counts.select("fold", "_n", "_z", level_keys(levels)).groupBy("level", "key").agg(F.array(*parts).alias("_f"))
    return rolled.select("level", "key", F.inline("_f"))


def backoff_lookup(rows: DataFrame, table: DataFrame, levels: list[list[str]], by: list[str], name: str) -> DataFrame:
    """The value of the most specific level present, else the overall one.

    The keys are combinations of bins, so the table is bounded by the product of their sizes (a few
    thousand), whatever the number of rows; its levels are hashed one by one, so a row costs one probe a level.
    """
    table = durable(table.select(*by, "level", "key", "value"))
    out = rows
    for i, lv in enumerate([*levels, []]):
        part = F.broadcast(table.where(F.col("level") == i).select(
            *[F.col(c).alias(f"_by_{c}") for c in by], F.col("key").alias("_k"), F.col("value").alias(f"_v{i}")))
        same = F.col("_k") == (F.concat_ws("|", *[out[c].cast("string") for c in lv]) if lv else F.lit(""))
        for c in by:
            same &= F.col(f"_by_{c}") == out[c]
        out = out.join(part, same, "left").drop("_k", *[f"_by_{c}" for c in by])
    names = [f"_v{i}" for i in range(len(levels) + 1)]
    return out.withColumn(name, F.coalesce(*names)).drop(*names)


def backoff_fit_apply(rows: DataFrame, levels: list[list[str]], stat: str, least: int, k: int, name: str,
                      positive_only: bool = False) -> DataFrame:
    """Out-of-fold back-off prediction: fold f is predicted from the other folds.

    ``stat`` is "median" or "zero". No row is repeated for a fold. A group with fewer than ``least``
    training rows gives way to the next level.
    """
    train = rows.where("y > 0") if positive_only else rows
    fit = {"median": other_medians, "zero": other_zero_shares}[stat]
    table = fit(train, levels, k).where((F.col("n") >= least) | (F.col("level") == len(levels)))
    return backoff_lookup(rows, table, levels, ["fold"], name)


def backoff_from(medians: DataFrame, rows: DataFrame, fitted: list[list[str]], levels: list[list[str]], least: int, name: str) -> DataFrame:
    """What ``backoff_fit_apply`` predicts by ``levels``, which are among the ``fitted`` ones, from their medians in one scheme."""
    place = {fitted.index(lv): i for i, lv in enumerate(levels)} | {len(fitted): len(levels)}
    renumbered = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    table = medians.where(F.col("level").isin(*place)).withColumn("level", renumbered[F.col("level")])
    return backoff_lookup(rows, table.where((F.col("n") >= least) | (F.col("level") == len(levels))), levels, ["fold"], name)


def item_curve_rows(wide_rows: DataFrame) -> DataFrame:
    """Item-window ratio per horizon: target totals over the mean of the observed totals, with its bins.

    ``wide_rows`` are target rows with ``t1..t3``, ``qty``, ``uplift_global`` and ``fold``.
    """
    agg = wide_rows.groupBy("item", "off", "h").agg(
        F.min("d1").alias("d1"), F.min("fold").alias("fold"), F.sum("qty").alias("q"), F.sum("t1").alias("s1"), F.sum("t2").alias("s2"),
        F.sum("t3").alias("s3"), F.count(F.lit(1)).alias("np"), F.min("uplift_global").alias("ug"))
    from launchgrid.functions.scalar import BACKOFF_EDGES, TREND_EDGES, right_closed_bin

    tot = F.col("s1") + F.col("s2") + F.col("s3")
    return agg.select("item", "off", "h", "fold", F.weekday("d1").alias("dow"),
                      right_closed_bin(F.col("s3") / F.greatest("s1", F.lit(1)), TREND_EDGES).alias("trend"),
                      right_closed_bin(F.greatest(tot, F.lit(1)) / 1000.0, BACKOFF_EDGES).alias("size"),
                      right_closed_bin(F.col("ug"), TREND_EDGES).alias("up"),
                      (F.col("q") / F.greatest(tot / 3.0, F.lit(1.0))).alias("y"))
