"""Scores: scaled error, weighted and rounded forms, weights, ranking quality, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchgrid.functions.joins import one_row
from launchgrid.functions.ordered import HOT_VALUES, running
from launchgrid.functions.scalar import SCALE_EDGES, half_even, half_up, right_closed_bin


def abs_error(pred: str, rounded: str | None = None) -> Column:
    """Error on the scaled target; ``rounded``: after rounding to whole units, 'up' or 'even'."""
    p = F.greatest(F.col(pred), F.lit(0.0))
    if rounded is None:
        return F.abs(F.col("y") - p)
    whole = (half_up if rounded == "up" else half_even)(p * F.col("scale"))
    return F.abs(F.col("qty") - whole) / F.col("scale")


def weighted_metric(frame: DataFrame, preds: list[str]) -> DataFrame:
    """Plain, weighted and rounded scores of several predictions in one pass."""
    aggs = []
    for p in preds:
        e = abs_error(p)
        aggs += [F.avg(e).alias(f"{p}_plain"), (F.sum(F.col("w") * e) / F.sum("w")).alias(f"{p}_weighted"),
                 F.avg(abs_error(p, "up")).alias(f"{p}_up"), F.avg(abs_error(p, "even")).alias(f"{p}_even")]
    cols = ["plain", "weighted", "up", "even"]
    return frame.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("model"), *[F.col(f"{p}_{c}").alias(c) for c in cols]) for p in preds])))


def mix_weights(validation: DataFrame, target: DataFrame, cap: float = 8.0) -> DataFrame:
    """Weight per scale bin that turns the validation mix into the target's: eight rows.

    ``weight`` is the share ratio (1 where validation has none); ``capped`` is it cut at ``cap`` and
    normalised to mean one over validation; ``weight_share`` the part of all weight in the bin.
    """
    bins = lambda df, n: df.groupBy(right_closed_bin(F.col("scale"), SCALE_EDGES).alias("sb")).agg(F.count(F.lit(1)).alias(n))
    all_bins = validation.sparkSession.range(8).select(F.col("id").cast("int").alias("sb"))
    both = (all_bins.join(F.broadcast(bins(validation, "v")), "sb", "left").join(F.broadcast(bins(target, "t")), "sb", "left")
            .fillna(0, ["v", "t"]))
    share = both.selectExpr("sb", "v", "v / sum(v) over () as v_share", "t / sum(t) over () as t_share").selectExpr(
        "*", "coalesce(t_share / nullif(v_share, 0), 1.0) as weight", f"least(coalesce(t_share / nullif(v_share, 0), 1.0), {cap}d) as _c")
    return share.selectExpr("sb", "v as n_rows", "v_share", "t_share", "weight", "_c / (sum(_c * v) over () / sum(v) over ()) as capped",
                            "weight * v / sum(weight * v) over () as weight_share",
                            "pow(sum(_c * v) over (), 2) / sum(_c * _c * v) over () / sum(v) over () as effective")


def with_weights(frame: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight of each row's scale bin; the weight table has eight rows."""
    return (frame.drop("w").withColumn("sb", right_closed_bin(F.col("scale"), SCALE_EDGES))
            .join(F.broadcast(weights.select("sb", F.col("weight").alias("w"))), "sb", "left"))


def auc(frame: DataFrame, score: str, positive: Column, hot: int = HOT_VALUES) -> DataFrame:
    """Area under the ROC curve by averaged ranks; tied scores are one step of the running count."""
    run = running(frame.withColumn("_pos", positive.cast("int")), [], F.col(score),
                  {"_c": F.lit(1), "_p": F.col("_pos")}, hot=hot)
    rank = F.col("_c_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0
    p, n = F.max("_p_tot"), F.max("_c_tot")
    return run.agg(n.alias("n"), p.alias("positives"),
                   ((F.sum(rank * F.col("_p")) - p * (p + 1) / 2.0) / (p * (n - p))).alias("auc"))


def item_scores(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Weighted gain of ``b`` over ``a`` and weight per item."""
    return frame.groupBy("item").agg(F.sum(F.col("w") * (abs_error(a) - abs_error(b))).alias("num"), F.sum("w").alias("den"))


# Multipliers and modulus of the draw generator, the same in any SQL engine.
DRAW_A, DRAW_B, DRAW_C, DRAW_M = 7919, 104729, 17, 1000003
# DRAW_M times the distribution function of a Poisson value of mean 1, at 0..6.
DRAW_STEPS = (367881, 735761, 919701, 981015, 996343, 999409, 999920)
DRAWS = 2000


def draw_count(u: str) -> str:
    """How often an item is drawn, from a number below DRAW_M; the text is valid in both dialects."""
    return "(" + " + ".join(f"CASE WHEN {u} >= {t} THEN 1 ELSE 0 END" for t in DRAW_STEPS) + ")"


def paired_bootstrap(scores: DataFrame, draws: int = DRAWS) -> DataFrame:
    """Interval of the mean gain over items, resampled by arithmetic counts.

    Every (item, replicate) takes a Poisson count of mean 1 from a generator, which has the spread
    of drawing with replacement. The items are repeated once per replicate and summed in their
    task before the shuffle.
    """
    key = F.conv(F.substring(F.md5(F.col("item").cast("binary")), 1, 7), 16, 10).cast("bigint")
    base = scores.withColumn("_k", key % DRAW_M)
    rep = base.selectExpr("num", "den", "_k", f"explode(sequence(1, {draws})) as rep").selectExpr(
        "rep", "num", "den", f"pmod(_k * {DRAW_A} + rep * {DRAW_B} + {DRAW_C} * _k * rep, {DRAW_M}) as _u").selectExpr(
        "rep", "num", "den", f"{draw_count('_u')} as c")
    per = rep.groupBy("rep").agg((F.sum(F.col("c") * F.col("num")) / F.sum(F.col("c") * F.col("den"))).alias("gain"))
    point = scores.agg((F.sum("num") / F.sum("den")).alias("point"), F.count(F.lit(1)).alias("items"))
    # One value per replicate: the percentiles see `draws` values.
    return per.agg(F.percentile("gain", F.lit(0.025)).alias("lo"), F.percentile("gain", F.lit(0.975)).alias("hi"),
                   F.avg((F.col("gain") > 0).cast("double")).alias("better")).crossJoin(one_row(point))


def noise_floor(scores: DataFrame) -> DataFrame:
    """Spread of a score over seeds per (config, scheme), and the least difference worth noting."""
    per = scores.groupBy("config", "scheme").agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), (F.max("score") - F.min("score")).alias("range"))
    return per.selectExpr("*", "avg(std) over () * 2.8 as threshold")  # one row per run in the score log


def seed_average(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("seeds"))


def holdout_errors(frame: DataFrame, preds: list[str]) -> DataFrame:
    """Plain and weighted error of each prediction over the held-out rows, in one row with their cut day."""
    e = {p: F.abs(F.col("y") - F.col(p)) for p in preds}
    return frame.agg(
        F.min("cut").alias("cut"), F.count(F.lit(1)).alias("n"), F.countDistinct("item").alias("items"),
        *[F.avg(e[p]).alias(f"mase_{p.lower()}") for p in preds], *[(F.sum(F.col("w") * e[p]) / F.sum("w")).alias(f"wmase_{p.lower()}") for p in preds])
