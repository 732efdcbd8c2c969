"""Profiles, errors by segment, drift, and comparisons of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from launchgrid.functions.joins import one_row
from launchgrid.functions.ordered import HOT_VALUES, quantiles, running
from launchgrid.functions.scalar import right_closed_bin


def ratio_profile(rows: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """Rows, mean, median, p10, p90 and zero share per group; exact, whatever the group's size."""
    zero = (F.col(value) == 0).cast("int")
    out = quantiles(rows, keys, value, {"median_ratio": 0.5, "p10": 0.1, "p90": 0.9},
                    extra={"_sum": F.col(value), "_zero": zero})
    return out.select(*keys, F.col("n").alias("n_rows"), (F.col("_sum") / F.col("n")).alias("mean_ratio"), "median_ratio",
                      "p10", "p90", (F.col("_zero") / F.col("n")).alias("zero_share"))


def profile_reweight(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """Profile by D1 weekday, re-weighted to another weekday mix and renormalised over known cells.

    ``mix(d1_dow, share)`` has at most seven rows.
    """
    cells = rows.groupBy("d1_dow", "h").agg(F.avg("y").alias("m"), F.avg((F.col("y") == 0).cast("double")).alias("z"))
    w = cells.join(F.broadcast(mix), "d1_dow")
    return w.groupBy("h").agg(
        (F.sum(F.col("share") * F.col("m")) / F.sum(F.when(F.col("m").isNotNull(), F.col("share")))).alias("mean_ratio"),
        (F.sum(F.col("share") * F.col("z")) / F.sum("share")).alias("zero_share"), F.sum("share").alias("coverage"))


def profile_compare(true_profile: DataFrame, pred_profile: DataFrame) -> DataFrame:
    p = pred_profile.select("h", F.col("mean_ratio").alias("pred_mean"), F.col("zero_share").alias("pred_zero"))
    return true_profile.select("h", F.col("mean_ratio").alias("true_mean"), F.col("zero_share").alias("true_zero")).join(F.broadcast(p), "h").selectExpr(
        "*", "true_mean / nullif(pred_mean, 0) as mean_mult", "(true_zero - pred_zero) * 100 as zero_gap_pp")


def leverage(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows and of 1/scale per group, with the median scale."""
    inv = F.lit(1.0) / F.col("scale")
    out = quantiles(pairs, keys, "scale", {"med_scale": 0.5}, extra={"lev": inv})
    tot = pairs.agg(F.count(F.lit(1)).alias("_n"), F.sum(inv).alias("_l"))
    return out.crossJoin(one_row(tot)).select(*keys, F.col("n").alias("n_rows"), (F.col("n") / F.col("_n")).alias("row_share"),
                                               "med_scale", (F.col("lev") / F.col("_l")).alias("leverage_share"))


def leverage_below(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Share of rows and of 1/scale at or below each scale threshold, in one pass."""
    inv = F.lit(1.0) / F.col("scale")
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(inv).alias("_l")]
    for i, t in enumerate(thresholds):
        below = F.col("scale") <= F.lit(float(t))
        aggs += [F.count(F.when(below, 1)).alias(f"n{i}"), F.coalesce(F.sum(F.when(below, inv)), F.lit(0.0)).alias(f"l{i}")]
    parts = [F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"n{i}") / F.col("_n")).alias("row_share"),
                      (F.col(f"l{i}") / F.col("_l")).alias("leverage_share")) for i, t in enumerate(thresholds)]
    return pairs.agg(*aggs).select(F.inline(F.array(*parts)))


def error_segments(frame: DataFrame, segments: list[str], pred: str = "A") -> DataFrame:
    """Error by each segment column and overall, from one pass with grouping sets.

    The keys are low-cardinality, so map-side partial sums carry all sets through one shuffle.
    """
    err = frame.withColumn("_e", F.abs(F.col("y") - F.col(pred))).select(
        *[F.col(s).cast("string").alias(s) for s in segments], "_e", "w")
    sets = [[F.col(s)] for s in segments] + [[]]
    out = err.groupingSets(sets, *segments).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mase"), (F.sum(F.col("w") * F.col("_e")) / F.sum("w")).alias("wmase"),
        *[F.grouping(s).alias(f"_g{s}") for s in segments])
    name, level = F.lit("all"), F.lit("all")
    for s in segments:
        name = F.when(F.col(f"_g{s}") == 0, F.lit(s)).otherwise(name)
        level = F.when(F.col(f"_g{s}") == 0, F.col(s)).otherwise(level)
    return out.select(name.alias("segment"), level.alias("level"), "n", "mase", "wmase")


def error_concentration(frame: DataFrame, shares: list[float], pred: str = "A", hot: int = HOT_VALUES) -> DataFrame:
    """Share of all error carried by the worst rows; a tie at the cut takes its part of the count."""
    e = F.abs(F.col("y") - F.col(pred))
    run = running(frame.select(e.alias("_e")), [], -F.col("_e"), {"_c": F.lit(1), "_s": F.col("_e")}, hot=hot)
    aggs = []
    for i, f in enumerate(shares):
        k = F.floor(F.lit(f) * F.col("_c_tot"))
        before = F.col("_c_cum") - F.col("_c")
        take = F.greatest(F.lit(0), F.least(F.col("_c"), k - before))
        aggs.append((F.sum(take * -F.col("_v")) / F.max("_s_tot")).alias(f"s{i}"))
    parts = [F.struct(F.lit(f).alias("worst"), F.col(f"s{i}").alias("error_share")) for i, f in enumerate(shares)]
    return run.agg(*aggs).select(F.inline(F.array(*parts)))


def model_diversity(frame: DataFrame, preds: list[str]) -> DataFrame:
    """Error of each model, its correlation with the first, and the best-of-all error."""
    errs = frame.select(*[F.abs(F.col("y") - F.col(p)).alias(p) for p in preds])
    row = errs.agg(F.avg(F.least(*preds)).alias("best_of"), *[F.avg(p).alias(f"m{p}") for p in preds],
                   *[F.corr(p, preds[0]).alias(f"c{p}") for p in preds])
    return row.select(F.inline(F.array(*[F.struct(F.lit(p).alias("model"), F.col(f"m{p}").alias("mase"), F.col(f"c{p}").alias("corr_first"),
                                                  F.col("best_of").alias("best_of")) for p in preds])))


def drift_table(left: DataFrame, right: DataFrame, features: list[str]) -> DataFrame:
    """Median, p10, p90 and NULL share of each feature on two sides."""
    side = lambda df, tag: df.select(*[F.col(f).cast("double").alias(f) for f in features]).withColumn("side", F.lit(tag)).unpivot(
        ["side"], features, "feature", "value")
    long = side(left, "left").unionByName(side(right, "right"))
    q = quantiles(long, ["side", "feature"], "value", {"med": 0.5, "p10": 0.1, "p90": 0.9})
    nulls = long.groupBy("side", "feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("null_share"))
    both = nulls.join(q.drop("n"), ["side", "feature"], "left")
    cols = ["med", "p10", "p90", "null_share"]
    return both.groupBy("feature").pivot("side", ["left", "right"]).agg(*[F.first(c).alias(c) for c in cols])


def shifted_features(left: DataFrame, right: DataFrame, features: list[str], hot: int = HOT_VALUES) -> DataFrame:
    """Features by how far their two distributions lie apart: the largest gap of the running shares.

    All features and both sides go through one ordering; a row per side holds the number of known
    values. A feature that one side never knows has no distance and comes last. Ties by name.
    """
    side = lambda df, a: df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [], features, "feature", "_x").select("feature", "_x", F.lit(a).alias("_l"), F.lit(1 - a).alias("_r"))
    long = side(left, 1).unionByName(side(right, 0)).where("not isnan(_x)")
    run = running(long, ["feature"], F.col("_x"), {"_l": F.col("_l"), "_r": F.col("_r")}, hot=hot)
    gap = F.abs(F.try_divide("_l_cum", "_l_tot") - F.try_divide("_r_cum", "_r_tot"))

    def median(s: str):
        pos = F.lit(0.5) * (F.col(f"{s}_tot") - 1)
        at = lambda k: F.max(F.when((F.col(f"{s}_cum") - F.col(s) <= k) & (k < F.col(f"{s}_cum")), F.col("_v")))
        return (at(F.floor(pos)) + at(F.ceil(pos))) / F.lit(2.0)

    out = run.groupBy("feature").agg(F.max(gap).alias("distance"), median("_l").alias("left_med"), median("_r").alias("right_med"),
                                     F.max("_l_tot").alias("n_left"), F.max("_r_tot").alias("n_right"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("distance"), "feature")))  # a row per feature


def regime_share(source: DataFrame, target: DataFrame, score: str, label: str, parts: int = 10) -> DataFrame:
    """Label shares expected in the target: P(label | score part) on the source, times the target's parts."""
    edges = quantiles(source, [], score, {f"e{i}": i / parts for i in range(1, parts)})
    bin_ = sum([(F.col(score) >= F.col(f"e{i}")).cast("int") for i in range(1, parts)], F.lit(0))
    put = lambda df: df.crossJoin(one_row(edges.drop("n"))).withColumn("_b", bin_)
    s = put(source).groupBy("_b", label).agg(F.count(F.lit(1)).alias("_n"))
    t = put(target).groupBy("_b").agg(F.count(F.lit(1)).alias("_t"))
    w, all_ = Window.partitionBy("_b"), Window.partitionBy()  # at most ten parts
    cond = s.withColumn("_p", F.col("_n") / F.sum("_n").over(w))
    share = t.withColumn("_q", F.col("_t") / F.sum("_t").over(all_))
    return cond.join(F.broadcast(share), "_b").groupBy(label).agg(F.sum("_n").alias("n_source"), F.sum(F.col("_p") * F.col("_q")).alias("target_share"))


def output_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two result tables row by row: share differing, median relative gap, totals, zeros, correlation."""
    j = a.select("id", F.col("total_ticket").alias("x")).join(b.select("id", F.col("total_ticket").alias("z")), "id")
    gap = F.abs(F.col("x") - F.col("z")) / F.greatest((F.col("x") + F.col("z")) / 2.0, F.lit(1.0))
    med = quantiles(j.where("x <> z"), [], gap, {"median_gap": 0.5}).select("median_gap")
    one = j.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x") != F.col("z")).cast("double")).alias("differing"),
                F.sum("x").alias("total_a"), F.sum("z").alias("total_b"), F.avg((F.col("x") == 0).cast("double")).alias("zeros_a"),
                F.avg((F.col("z") == 0).cast("double")).alias("zeros_b"), F.corr("x", "z").alias("corr"))
    return one.join(one_row(med), how="left")


DIAGNOSIS_EDGES = (2, 5, 10, 25, 50, 100)


def output_diagnosis(out: DataFrame, segments: list[str], flat: list[float]) -> DataFrame:
    """Predicted profile by segment with leverage share and the error a flat true ratio would leave.

    One pass with grouping sets over low-cardinality keys.
    """
    d = out.withColumn("ratio", F.col("pred") / F.col("scale")).withColumn(
        "scale_bin", right_closed_bin(F.col("scale"), DIAGNOSIS_EDGES)).select(
        *[F.col(s).cast("string").alias(s) for s in segments], "ratio", "pred", "scale")
    tot = d.agg(F.count(F.lit(1)).alias("_n"), F.sum(1 / F.col("scale")).alias("_l"))
    g = d.groupingSets([[F.col(s)] for s in segments], *segments).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean_ratio"), F.avg((F.col("pred") == 0).cast("double")).alias("zero_share"),
        F.avg("pred").alias("mean_pred"), F.sum(1 / F.col("scale")).alias("_lev"),
        *[F.sum(F.abs(F.lit(r) - F.col("ratio"))).alias(f"_r{i}") for i, r in enumerate(flat)],
        *[F.grouping(s).alias(f"_g{s}") for s in segments])
    name, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in segments:
        name = F.when(F.col(f"_g{s}") == 0, F.lit(s)).otherwise(name)
        level = F.when(F.col(f"_g{s}") == 0, F.col(s)).otherwise(level)
    return g.crossJoin(one_row(tot)).select(
        name.alias("segment"), level.alias("level"), "n", "mean_ratio", "zero_share", "mean_pred",
        (F.col("_lev") / F.col("_l")).alias("leverage_share"), *[(F.col(f"_r{i}") / F.col("_n")).alias(f"flat{i}") for i in range(len(flat))])
