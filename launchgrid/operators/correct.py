"""Outputs from saved predictions: whole units, variants, floors, and what their scores say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from launchgrid.functions.joins import one_row
from launchgrid.functions.scalar import half_even, half_up


def build_output(requests: DataFrame, predictions: DataFrame, rounding: str = "up") -> DataFrame:
    """``id, total_ticket`` for every request; no observed sales means zero.

    ``predictions``: ``item, site, ds, ratio, scale, sum3``, one row per key.
    """
    whole = half_up if rounding == "up" else half_even
    out = requests.join(predictions.select("item", "site", "ds", "ratio", "scale", "sum3"), ["item", "site", "ds"], "left")
    units = whole(F.greatest(F.col("ratio"), F.lit(0.0)) * F.coalesce("scale", F.lit(1.0)))
    return out.select("id", F.when(F.coalesce("sum3", F.lit(0)) == 0, F.lit(0)).otherwise(units).cast("bigint").alias("total_ticket"))


def validate_output(output: DataFrame, requests: DataFrame) -> DataFrame:
    """Eight checks in one row. Fail a job on any zero."""
    ids = output.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("total_ticket").isNull().cast("int")).alias("nulls"),
                                   F.min("total_ticket").alias("lo"), F.max(F.isnan(F.col("total_ticket").cast("double"))).alias("nan"))
    both = requests.select("id", F.lit(1).alias("_r")).join(ids, "id", "full")
    row = both.agg(F.sum(F.coalesce("n", F.lit(0))).alias("_out"), F.sum(F.coalesce("_r", F.lit(0))).alias("_req"), F.max("n").alias("_dup"),
                   F.sum((F.col("n").isNull() | F.col("_r").isNull()).cast("int")).alias("_odd"), F.sum("nulls").alias("_null"),
                   F.min("lo").alias("_lo"), F.max(F.coalesce("nan", F.lit(False)).cast("int")).alias("_nan"))
    ok = lambda c: c.cast("int")
    return row.select(
        ok(F.col("_out") == F.col("_req")).alias("row_count"), ok(F.col("_dup") == 1).alias("unique_ids"), ok(F.col("_odd") == 0).alias("same_ids"),
        ok(F.col("_null") == 0).alias("no_null"), ok(F.col("_lo") >= 0).alias("non_negative"), ok(F.col("_nan") == 0).alias("finite"),
        ok(F.lit(output.columns == ["id", "total_ticket"])).alias("columns"),
        ok((F.col("_odd") == 0) & (F.col("_dup") == 1)).alias("orderable"))


def prediction_keys(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Repeated prediction keys, and requests that no prediction covers."""
    dup = predictions.groupBy("item", "site", "ds").agg(F.count(F.lit(1)).alias("n")).agg(F.sum((F.col("n") > 1).cast("int")).alias("repeated"))
    miss = requests.join(predictions, ["item", "site", "ds"], "left_anti").agg(F.count(F.lit(1)).alias("uncovered"))
    return dup.crossJoin(one_row(miss))


def prob_variants(preds: DataFrame, variants: list[tuple[str, float, float, float]]) -> DataFrame:
    """``variant, id, base, total_ticket``: ratio times cohort, fast and school multipliers.

    ``preds``: ``id, ratio, scale, cohort, fast_exp, school_exp``. Variants are generated on the row.
    """
    vs = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), *[F.lit(float(v)).alias(k) for k, v in zip(("me", "mf", "ms"), m)])
                             for n, *m in variants])).alias("v")
    out = preds.select("*", vs)
    return out.selectExpr(
        "v.variant as variant", "id", "cast(floor(greatest(ratio, 0d) * scale + 0.5) as bigint) as base",
        "cast(floor(greatest(ratio * case when cohort = 1 then v.me else 1d end * pow(v.mf, fast_exp) * pow(v.ms, school_exp), 0d) * scale + 0.5) as bigint) as total_ticket")


def variant_summary(variants: DataFrame) -> DataFrame:
    return variants.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("base") != F.col("total_ticket")).cast("int")).alias("changed"),
        F.sum("base").alias("base_total"), F.sum("total_ticket").alias("total"))


def shape_variants(preds: DataFrame, shapes: dict[str, dict[int, float]], level: float) -> DataFrame:
    """Horizon shapes on the cohort, each scaled so that its quantity-weighted mean is ``level``."""
    raw = lambda s: F.create_map(*[x for h, m in s.items() for x in (F.lit(h), F.lit(float(m)))])
    tick = F.greatest(F.col("ratio"), F.lit(0.0)) * F.col("scale")
    cohort = F.col("cohort") == 1
    at = lambda s: F.coalesce(F.try_element_at(raw(s), F.col("h")), F.lit(1.0))
    mean = preds.agg(*[(F.sum(F.when(cohort, at(s) * tick)) / F.sum(F.when(cohort, tick))).alias(f"_{n}") for n, s in shapes.items()])
    parts = [F.struct(F.lit(n).alias("variant"), F.when(cohort, at(s) * level / F.col(f"_{n}")).otherwise(1.0).alias("mult")) for n, s in shapes.items()]
    out = preds.crossJoin(one_row(mean)).select("id", "h", "ratio", "scale", "cohort", F.inline(F.array(*parts)))
    return out.selectExpr("variant", "id", "h", "cohort", "mult", "cast(floor(greatest(ratio, 0d) * scale + 0.5) as bigint) as base",
                          "cast(floor(greatest(ratio * mult, 0d) * scale + 0.5) as bigint) as total_ticket")


def floor_guard(rows: DataFrame, mode: str, k: float) -> DataFrame:
    """Raise straddling rows to a floor: flat ``k`` or ``k`` times the calendar uplift."""
    level = {"none": F.lit(None).cast("double"), "flat": F.lit(k), "calendar": F.lit(k) * F.col("uplift")}[mode]
    out = rows.withColumn("floor", F.when(F.col("straddle") == 1, level))
    return out.withColumn("guarded", F.greatest(F.col("ratio"), F.coalesce("floor", F.col("ratio"))))


# Strategies and truths of the cost matrix.
STRATEGIES = [("none", 0.0), ("flat", 0.6), ("flat", 0.8), ("flat", 1.0), ("flat", 1.2),
              ("calendar", 0.5), ("calendar", 0.6), ("calendar", 0.8), ("calendar", 1.0)]
SCENARIOS = [("flat", 0.3), ("flat", 0.6), ("flat", 1.0), ("flat", 1.5), ("calendar", 0.6), ("calendar", 0.9), ("calendar", 1.2)]


def minimax_regret(rows: DataFrame) -> DataFrame:
    """Cost of each strategy under each truth on straddling rows, and its worst regret against none.

    Every cell of the matrix is one aggregate of a single pass.
    """
    value = lambda mode, k: f"{k}d * uplift" if mode == "calendar" else f"{k}d"
    cost = lambda s, c: f"sum(case when straddle = 1 then abs({value(*c)} - " + ("ratio" if s[0] == "none" else f"greatest(ratio, {value(*s)})") + ") end)"
    cells = [F.expr(cost(s, c)).alias(f"_{i}_{j}") for i, s in enumerate(STRATEGIES) for j, c in enumerate(SCENARIOS)]
    one = rows.agg(F.count(F.lit(1)).alias("_n"), *cells)
    parts = []
    for i, (mode, k) in enumerate(STRATEGIES):
        costs = [F.coalesce(F.col(f"_{i}_{j}"), F.lit(0.0)) / F.col("_n") for j in range(len(SCENARIOS))]
        base = [F.coalesce(F.col(f"_0_{j}"), F.lit(0.0)) / F.col("_n") for j in range(len(SCENARIOS))]
        parts.append(F.struct(F.lit(mode).alias("mode"), F.lit(k).alias("k"), *[c.alias(f"c{j}") for j, c in enumerate(costs)],
                              F.greatest(*[c - b for c, b in zip(costs, base)]).alias("worst")))
    return one.select(F.inline(F.array(*parts)))


def response_scores(rows: DataFrame, ms: list[float]) -> DataFrame:
    """Score of each cohort multiplier: ``m, score``, one pass."""
    one = rows.agg(*[F.expr(f"avg(abs(y - ratio * case when cohort = 1 then {m}d else 1d end))").alias(f"_{i}") for i, m in enumerate(ms)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"_{i}").alias("score")) for i, m in enumerate(ms)])))


# Quadratic least squares around the mean multiplier; valid in both dialects.
QUAD = ("(s2 * sy2 - s3 * sy1 - s2 * s2 * sy0 / n) / (s2 * s4 - s3 * s3 - s2 * s2 * s2 / n)",
        "(sy1 - s3 * c2) / s2")


def response_curve(scores: DataFrame) -> DataFrame:
    """Segment slopes, the vertex of a quadratic fit and where the slope line crosses zero.

    ``scores`` holds one row per submitted multiplier.
    """
    w = Window.orderBy("m")
    seg = scores.select("m", "score", F.lag("m").over(w).alias("_m"), F.lag("score").over(w).alias("_s")).selectExpr(
        "m", "score", "(_s - score) / (m - _m) as slope", "(_m + m) / 2.0 as mid")
    mean = scores.agg(F.avg("m").alias("mm"), F.avg("score").alias("ms"))
    u = scores.crossJoin(one_row(mean)).selectExpr("m - mm as u", "score - ms as v", "mm", "ms")
    sums = u.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("u * u")).alias("s2"), F.sum(F.expr("u * u * u")).alias("s3"),
                 F.sum(F.expr("u * u * u * u")).alias("s4"), F.sum("v").alias("sy0"), F.sum(F.expr("u * v")).alias("sy1"),
                 F.sum(F.expr("u * u * v")).alias("sy2"), F.first("mm").alias("mm"))
    fit = sums.selectExpr("*", f"{QUAD[0]} as c2").selectExpr("*", f"{QUAD[1]} as c1").selectExpr("c2", "mm - c1 / (2 * c2) as vertex")
    line = seg.where("slope is not null").agg(F.regr_slope("slope", "mid").alias("_b"), F.regr_intercept("slope", "mid").alias("_a"))
    cross = line.selectExpr("-_a / nullif(_b, 0) as zero_slope")
    return seg.crossJoin(one_row(fit)).crossJoin(one_row(cross))


def displaced_mass(rows: DataFrame, ref: str, new: str) -> DataFrame:
    """Ceiling D of the gain from moving ``ref`` to ``new``, the gain G, and the share moved rightly."""
    d = F.abs(F.col(new) - F.col(ref)) / F.col("scale")
    gain = (F.abs(F.col("qty") - F.col(ref)) - F.abs(F.col("qty") - F.col(new))) / F.col("scale")
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(new) != F.col(ref)).cast("int")).alias("moved"),
                   (F.sum(d) / F.count(F.lit(1))).alias("ceiling"), F.avg(gain).alias("gain"))
    return one.withColumn("f", (F.lit(1.0) + F.try_divide("gain", "ceiling")) / 2)


def output_blend(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    j = a.select("id", F.col("total_ticket").alias("x")).join(b.select("id", F.col("total_ticket").alias("z")), "id")
    return j.select("id", F.greatest(half_up(F.col("x") * weight + F.col("z") * (1 - weight)), F.lit(0)).cast("bigint").alias("total_ticket"))


def oracle_variants(frame: DataFrame, pred: str) -> DataFrame:
    """Scores with one quantity known: slots of the target day, the zero state, or the level."""
    tps3 = "case when shw3 > 0 then t3 / cast(shw3 as double) else 0d end"
    level = f"slots * {tps3} / scale"
    preds = {"reference": pred, "slots_known": level, "zero_state": f"case when slots > 0 then {pred} else 0d end",
             "level_only": f"case when slots > 0 then {level} else {pred} end", "zero_known": f"case when y = 0 then 0d else {pred} end"}
    if "slot_ratio" in frame.columns:
        preds["slots_predicted"] = f"slot_ratio * shw3 * {tps3} / scale"
    one = frame.agg(*[F.expr(f"sum(w * abs(y - greatest({e}, 0d))) / sum(w)").alias(n) for n, e in preds.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("wmase")) for n in preds])))


def cutoff_filter(facts: DataFrame, cutoff: str, date: str, flag: str) -> DataFrame:
    """Reference rows known by the cut-off: not dated after it and not flagged 'no'; unknown stays."""
    late = F.coalesce(F.col(date) > F.lit(cutoff).cast("date"), F.lit(False))
    closed = F.coalesce(F.lower(F.trim(flag)) == "no", F.lit(False))
    return facts.withColumns({"too_late": late.cast("int"), "closed": closed.cast("int")})
