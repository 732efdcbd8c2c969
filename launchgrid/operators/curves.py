"""Monotone calibration curves and exact level checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from launchgrid.functions.joins import one_row
from launchgrid.functions.ordered import HOT_VALUES, quantiles, running, weighted_median
from launchgrid.operators.calibrate import LEVEL_GRID, others
from launchgrid.session import durable


def equal_count_edges(frame: DataFrame, keys: list[str], value: str, bins: int, hot: int = HOT_VALUES) -> DataFrame:
    """``keys, _edges``: the distinct quantiles at 0, 1 / bins, ..., 1, ascending.

    Each value says which quantiles it bounds, so the plan does not grow with the number of bins.
    """
    run = running(frame, keys, F.col(value), {"_c": F.lit(1)}, hot=hot)
    at = f"transform(sequence(0, {bins}), j -> named_struct('j', j, 'pos', (j / {bins}d) * (_c_tot - 1)))"
    inside = lambda f: f"({f}(s.pos) >= _c_cum - _c and {f}(s.pos) < _c_cum)"
    hits = run.selectExpr(*keys, "_v", "_c", "_c_cum", f"inline(filter({at}, s -> {inside('floor')} or {inside('ceil')}))")
    ends = hits.groupBy(*keys, "j").agg(*[F.max(F.expr(f"case when {f}(pos) >= _c_cum - _c and {f}(pos) < _c_cum then _v end")).alias(f) for f in ("floor", "ceil")],
                                        F.max(F.expr("pos - floor(pos)")).alias("frac"))
    return ends.groupBy(*keys).agg(F.array_sort(F.collect_set(F.expr("floor + (ceil - floor) * frac"))).alias("_edges"))


def monotone_curve(frame: DataFrame, keys: list[str], pred: str = "A", bins: int = 40, least: int = 80,
                   hot: int = HOT_VALUES) -> DataFrame:
    """Knots ``keys, k, x, v`` of a non-decreasing curve from prediction to weighted-median truth.

    Equal-count bins by prediction; a key with fewer than three usable bins gets the identity.
    """
    rows = frame.select(*keys, F.col(pred).alias("x"), "y", "w")
    if not keys:
        rows, keys = rows.withColumn("_one", F.lit(0)), ["_one"]
    edges = durable(equal_count_edges(rows, keys, "x", bins, hot))
    # At most bins + 1 numbers per key; the keys are horizons and folds.
    put = rows.join(F.broadcast(edges), keys).withColumn(
        "_b", F.greatest(F.lit(0), F.least(F.size(F.filter("_edges", lambda e: e <= F.col("x"))) - 1, F.size("_edges") - 2)))
    by = [*keys, "_b"]
    mid = quantiles(put, by, "x", {"x": 0.5}, hot=hot).where(F.col("n") >= least)
    knots = durable(mid.join(weighted_median(put, by, "y", "w", "y", hot=hot), by))
    w = Window.partitionBy(*keys)  # at most `bins` knots per key
    good = knots.select(
        *keys, "x", F.max("y").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)).alias("v"),
        (F.row_number().over(w.orderBy("_b")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("_n")).where("_n >= 3").drop("_n")
    bad = edges.select(*keys).join(good.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.inline(F.array(*[F.struct(F.lit(float(i)).alias("x"), F.lit(float(i)).alias("v"), F.lit(i).alias("k")) for i in (0, 1)])))
    return good.unionByName(bad).drop("_one")


def apply_curve(frame: DataFrame, knots: DataFrame, keys: list[str], pred: str, name: str) -> DataFrame:
    """Linear interpolation between the knots, flat outside; a key without knots keeps its value."""
    lines = knots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("_k"))
    out = frame.join(F.broadcast(lines), keys, "left") if keys else frame.crossJoin(one_row(lines))
    out = out.withColumn("_i", F.size(F.filter("_k", lambda k: k["x"] <= F.col(pred))))
    a, b = F.get("_k", F.col("_i") - 1), F.get("_k", F.col("_i"))
    inner = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col(pred) - a["x"], b["x"] - a["x"])
    return out.withColumn(name, F.when(F.col("_k").isNull(), F.col(pred)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(inner)).drop("_k", "_i")


def curve_crossfit(frame: DataFrame, k: int, keys: list[str], pred: str = "A", bins: int = 40, least: int = 80, enough: int = 0,
                   hot: int = HOT_VALUES) -> DataFrame:
    """Each fold's predictions through a curve fitted on all other folds: adds ``mapped``.

    A fold and key with fewer than ``enough`` rows to learn from keeps its predictions. ``frame`` holds fold, y and w.
    """
    frame = durable(frame)  # read several times below
    train = others(frame, k)
    by = ["fit_for", *keys]
    knots = monotone_curve(train, by, pred, bins, least, hot)
    if enough:  # at most one row per fold and key
        knots = knots.join(F.broadcast(train.groupBy(*by).count().where(F.col("count") >= enough)), by, "left_semi")
    return apply_curve(frame.withColumn("fit_for", F.col("fold")), durable(knots), by, pred, "mapped").drop("fit_for")


def _merged(truth: DataFrame, preds: DataFrame, keys: list[str], at: DataFrame, y_keys: list[str], hot: int) -> DataFrame:
    """Counted truths (y, c) and predictions (r, p), these times the ``m`` of their cell, in one running order.

    ``at`` holds one or a few multipliers per cell of a product of bins.
    """
    none = F.lit(0).cast("bigint")
    p = preds.join(F.broadcast(at), keys).select(*y_keys, (F.col("m") * F.col("r")).alias("v"), none.alias("c"), "p", (F.col("p") * F.col("r")).alias("pr"))
    y = truth if y_keys == keys else truth.join(F.broadcast(at), keys)
    y = y.select(*y_keys, F.col("y").alias("v"), "c", none.alias("p"), F.lit(0.0).alias("pr"))
    up, down = F.greatest(F.col("pr"), F.lit(0.0)), F.greatest(-F.col("pr"), F.lit(0.0))
    return running(y.unionByName(p), y_keys, F.col("v"), {"_c": F.col("c"), "_s": F.col("c") * F.col("v"), "_p": F.col("p"), "_up": up, "_dn": down}, hot=hot)


def level_errors(truth: DataFrame, preds: DataFrame, keys: list[str], at: DataFrame, hot: int = HOT_VALUES) -> DataFrame:
    """Mean absolute error of ``m * r`` against every ``y`` of its cell, for the multipliers ``at`` (keys, m): exact.

    Both samples are merged in value order and the true values' running count and sum give each
    prediction its error at once, so no pair of rows is ever formed. Samples come counted: (y, c), (r, p).
    """
    run = _merged(truth, preds, keys, at, [*keys, "m"], hot)
    left = F.col("_c_cum") * F.col("_v") - F.col("_s_cum")
    right = (F.col("_s_tot") - F.col("_s_cum")) - (F.col("_c_tot") - F.col("_c_cum")) * F.col("_v")
    return run.groupBy(*keys, "m").agg((F.sum(F.col("_p") * (left + right)) / F.max("_c_tot") / F.max("_p_tot")).alias("err"),
                                       F.max("_c_tot").alias("n_true"), F.max("_p_tot").alias("n_pred"))


def level_slopes(truth: DataFrame, preds: DataFrame, keys: list[str], at: DataFrame, hot: int = HOT_VALUES) -> DataFrame:
    """Slope of that error in ``m``, to the right of each cell's one multiplier."""
    run = _merged(truth, preds, keys, at, keys, hot)
    below, above = F.col("_c_cum") - F.col("_c"), F.col("_c_tot") - F.col("_c_cum")
    return run.groupBy(*keys).agg(F.sum(F.col("_up") * (below + F.col("_c") - above) + F.col("_dn") * (above + F.col("_c") - below)).alias("slope"))


def optimal_multiplier(truth: DataFrame, preds: DataFrame, keys: list[str], grid: list[float] = LEVEL_GRID, hot: int = HOT_VALUES) -> DataFrame:
    """Best multiplier per cell, the first of equals, with the error there and at 1.

    The error is convex in the multiplier, so a bisection on its slope finds the grid values on both sides
    of the least one in log2(grid) rounds over the counted samples; only these and 1 are then evaluated.
    The cells are a product of bins: their bounds, a few numbers each, are kept on the driver.
    """
    truth = durable(truth.where("y is not null").groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("c")))
    preds = durable(preds.where("r is not null").groupBy(*keys, "r").agg(F.count(F.lit(1)).alias("p")))
    spark, kinds = truth.sparkSession, ", ".join(f"{c} {truth.schema[c].dataType.simpleString()}" for c in keys)
    cells = truth.select(*keys).distinct().join(preds.select(*keys).distinct(), keys).collect()
    bounds = {tuple(c): (-1, len(grid)) for c in cells}
    table = lambda rows: spark.createDataFrame(rows, f"{kinds}, m double")
    while any(hi - lo > 1 for lo, hi in bounds.values()):
        mid = {c: (lo + hi) // 2 for c, (lo, hi) in bounds.items() if hi - lo > 1}
        for r in level_slopes(truth, preds, keys, table([(*c, float(grid[i])) for c, i in mid.items()]), hot).collect():
            if (c := tuple(r[x] for x in keys)) in mid:
                bounds[c] = (mid[c], bounds[c][1]) if r["slope"] < 0 else (bounds[c][0], mid[c])
    tried = {(*c, float(m)) for c, (lo, hi) in bounds.items() for m in (grid[max(lo, 0)], grid[min(hi, len(grid) - 1)], 1.0)}
    e = level_errors(truth, preds, keys, table(sorted(tried)), hot)
    near = F.array(*[F.lit(float(m)) for m in grid])
    return e.groupBy(*keys).agg(F.min(F.when(F.array_contains(near, F.col("m")), F.struct(F.round("err", 12).alias("e"), "m", "err"))).alias("_b"),
                                F.max(F.when(F.col("m") == 1.0, F.col("err"))).alias("err_at_1"),
                                F.max("n_true").alias("n_true"), F.max("n_pred").alias("n_pred")).select(
        *keys, "n_true", "n_pred", F.col("_b.m").alias("best_m"), F.col("_b.err").alias("err_best"), "err_at_1",
        (F.col("err_at_1") - F.col("_b.err")).alias("gain"))


def level_check(truth: DataFrame, preds: DataFrame, keys: list[str], least: int = 150) -> DataFrame:
    """True and predicted quartiles per cell, agreement of medians, and the best multiplier."""
    probs = {"q25": 0.25, "med": 0.5, "q75": 0.75}
    side = lambda df, col, tag: quantiles(df, keys, col, {f"{tag}_{k}": v for k, v in probs.items()}).drop("n")
    best = optimal_multiplier(truth, preds, keys).where((F.col("n_true") >= least) & (F.col("n_pred") >= least))
    out = best.join(side(truth, "y", "true"), keys).join(side(preds, "r", "pred"), keys)
    return out.selectExpr("*", "true_med / nullif(pred_med, 0) as med_mult",
                          "int(abs(true_med - pred_med) < 1e-9 or (pred_med > 0 and abs(true_med / nullif(pred_med, 0) - 1) < 0.10)) as med_agree")
