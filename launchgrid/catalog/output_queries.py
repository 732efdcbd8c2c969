"""Outputs, corrections and what-ifs; the pyspark.ml models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from launchgrid.catalog.base import CTES, Data, query, sql_bin
from launchgrid.catalog.calendar_queries import _CAL4, Calendar, labelled_rows, uplift_rows
from launchgrid.catalog.metric_queries import _backoff_sql, folded
from launchgrid.functions.ordered import ranked
from launchgrid.operators import boosting, calendar as cal_ops, correct, diagnose, metrics, models, pair, windows
from launchgrid.plans.features import feature_table
from launchgrid.session import durable, durable_parts, durable_table

# ------------------------------------------------------------------ requests and predictions
_SEVEN = "(SELECT CAST(unnest([4,5,6,7,8,9,10]) AS INTEGER) AS h) hh"
CTES["rq"] = f"""SELECT row_number() OVER (ORDER BY item, site, h) - 1 AS id, item, site, d1, h, d1 + (h - 1) AS ds, t1 + t2 + t3 AS sum3
  FROM ws CROSS JOIN {_SEVEN} WHERE off = 0"""
CTES["prd"] = "SELECT item, site, ds, h, d1, t3 / scale * (1.0 - 0.08 * (h - 3)) AS ratio, (t1 + t3) / (2.0 * scale) * (1.0 - 0.06 * (h - 3)) AS ratio2, scale, t1 + t2 + t3 AS sum3 FROM gs WHERE off = 0"


def requests(d: Data):
    """Every pair of a release window asks for seven days; ids follow item, site and day."""
    seven = d.release_wide.selectExpr("item", "site", "d1", "explode(sequence(4, 10)) as h")
    ids = ranked(seven, [], [F.col("item"), F.col("site"), F.col("h"), F.col("d1")], name="id")
    return ids.withColumn("ds", F.date_add("d1", F.col("h") - 1))


def predictions(d: Data):
    rows = windows.target_rows(windows.observed_pairs(d.release_wide))
    return rows.selectExpr("item", "site", "ds", "h", "d1", "qty", "y", "t3 / scale * (1.0 - 0.08 * (h - 3)) as ratio",
                           "(t1 + t3) / (2.0 * scale) * (1.0 - 0.06 * (h - 3)) as ratio2", "scale", "t1 + t2 + t3 as sum3")


def _out_sql(ratio: str, rnd: str = "floor({x} + 0.5)") -> str:
    return f"""SELECT r.id, CAST(CASE WHEN coalesce(p.sum3, 0) = 0 THEN 0 ELSE {rnd.format(x=f'greatest(p.{ratio}, 0) * coalesce(p.scale, 1.0)')} END AS BIGINT) AS total_ticket
      FROM rq r LEFT JOIN prd p ON r.item = p.item AND r.site = p.site AND r.ds = p.ds"""


CTES["out1"] = _out_sql("ratio")
CTES["out2"] = _out_sql("ratio2")


def outputs(d: Data):
    rq, p = requests(d), predictions(d)
    return (correct.build_output(rq, p), correct.build_output(rq, p.drop("ratio").withColumnRenamed("ratio2", "ratio")), rq)


@query("build_output", "#id #total_ticket", "SELECT * FROM out1")
def build_output(d: Data):
    return correct.build_output(requests(d), predictions(d))


@query("build_output_even", "#id #total_ticket", _out_sql("ratio", "round_even({x}, 0)"))
def build_output_even(d: Data):
    return correct.build_output(requests(d), predictions(d), "even")


@query("validate_output", "#row_count #unique_ids #same_ids #no_null #non_negative #finite #columns #orderable",
       """SELECT CASE WHEN (SELECT count(*) FROM out1) = (SELECT count(*) FROM rq) THEN 1 ELSE 0 END AS row_count,
          CASE WHEN (SELECT count(DISTINCT id) FROM out1) = (SELECT count(*) FROM out1) THEN 1 ELSE 0 END AS unique_ids,
          CASE WHEN (SELECT count(*) FROM out1 o FULL JOIN rq r ON o.id = r.id WHERE o.id IS NULL OR r.id IS NULL) = 0 THEN 1 ELSE 0 END AS same_ids,
          CASE WHEN (SELECT count(*) FROM out1 WHERE total_ticket IS NULL) = 0 THEN 1 ELSE 0 END AS no_null,
          CASE WHEN (SELECT min(total_ticket) FROM out1) >= 0 THEN 1 ELSE 0 END AS non_negative, 1 AS finite, 1 AS columns, 1 AS orderable""")
def validate_output(d: Data):
    return correct.validate_output(correct.build_output(requests(d), predictions(d)), requests(d))


@query("output_keys", "#repeated #uncovered",
       "SELECT (SELECT count(*) FROM (SELECT item FROM prd GROUP BY item, site, ds HAVING count(*) > 1) a) AS repeated, (SELECT count(*) FROM rq WHERE sum3 = 0 OR NOT EXISTS (SELECT 1 FROM prd p WHERE p.item = rq.item AND p.site = rq.site AND p.ds = rq.ds)) AS uncovered")
def output_keys(d: Data):
    return correct.prediction_keys(requests(d), predictions(d))


_EXPO = f"""t.fast * (1.0 - (a.fast + b.fast + c.fast) / 3.0) AS fast_exp, t.sch * (1.0 - (a.sch + b.sch + c.sch) / 3.0) AS school_exp,
   CASE WHEN g.ds BETWEEN DATE '2024-01-18' AND DATE '2024-01-24' AND g.d1 <= DATE '2024-01-15' THEN 1 ELSE 0 END AS cohort"""
CTES["ptab"] = f"SELECT r.id, g.item, g.site, g.ds, g.d1, g.h, g.ratio, g.scale, {_EXPO} FROM prd g JOIN rq r ON g.item = r.item AND g.site = r.site AND g.ds = r.ds {_CAL4}"


def prediction_rows(d: Data):
    """The saved prediction table: id, ratio, scale, h, cohort flag and exposures."""
    cal = Calendar(d.dense).cal
    rows = cal_ops.exposure(cal_ops.exposure(predictions(d), cal, "fast", "fast_exp"), cal, "sch", "school_exp")
    rows = rows.withColumn("cohort", cal_ops.cohort_mask("2024-01-18", "2024-01-24", "2024-01-15"))
    return requests(d).select("id", "item", "site", "ds").join(rows, ["item", "site", "ds"])


@query("prediction_table", "#id ~ratio ~scale #h #cohort ~fast_exp ~school_exp", "SELECT * FROM ptab")
def prediction_table(d: Data):
    return prediction_rows(d)


_VARS = [("base", 1.0, 1.0, 1.0), ("event16", 1.6, 1.0, 1.0), ("event20", 2.0, 1.0, 1.0), ("fast05", 2.0, 0.5, 1.0), ("all", 1.2, 0.75, 1.1)]
CTES["vars"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {s}::DOUBLE)" for n, a, b, s in _VARS) + ") v(variant, me, mf, ms)"


@query("prob_variants", "variant #n #changed #base_total #total",
       """SELECT variant, count(*) AS n, sum(CASE WHEN b <> v THEN 1 ELSE 0 END) AS changed, sum(b) AS base_total, sum(v) AS total FROM
          (SELECT variant, floor(greatest(ratio, 0) * scale + 0.5) AS b, floor(greatest(ratio * CASE WHEN cohort = 1 THEN me ELSE 1 END * pow(mf, fast_exp) * pow(ms, school_exp), 0) * scale + 0.5) AS v FROM ptab CROSS JOIN vars) x GROUP BY variant""")
def prob_variants(d: Data):
    return correct.variant_summary(correct.prob_variants(prediction_rows(d), _VARS))


# Relative multipliers by horizon.
_SHAPES = {"market": {4: 2.407, 5: 2.407, 6: 1.975, 7: 2.398, 8: 2.271, 9: 1.756, 10: 1.519},
           "early": {h: math.exp(-0.146 * (h - 4)) for h in range(4, 11)},
           "implied": {4: 2.515, 5: 2.544, 6: 1.106, 7: 1.334, 8: 1.022, 9: 1.478, 10: 1.057}}
CTES["shp"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {h}, {m}::DOUBLE)" for n, s in _SHAPES.items() for h, m in s.items()) + ") s(variant, h, m)"


@query("shape_variants", "variant #h #n ~mult #changed #total",
       """SELECT variant, h, count(*) AS n, max(mult) AS mult, sum(CASE WHEN floor(ratio * scale + 0.5) <> floor(ratio * mult * scale + 0.5) THEN 1 ELSE 0 END) AS changed, sum(floor(ratio * mult * scale + 0.5)) AS total FROM
          (SELECT s.variant, p.h, p.ratio, p.scale, s.m * 1.15 / z.cur AS mult FROM ptab p JOIN shp s ON p.h = s.h JOIN
             (SELECT s.variant, sum(s.m * p.ratio * p.scale) / sum(p.ratio * p.scale) AS cur FROM ptab p JOIN shp s ON p.h = s.h WHERE p.cohort = 1 GROUP BY s.variant) z ON s.variant = z.variant WHERE p.cohort = 1) x GROUP BY variant, h""")
def shape_variants(d: Data):
    out = correct.shape_variants(prediction_rows(d), _SHAPES, 1.15).where("cohort = 1")
    return out.groupBy("variant", "h").agg(F.count(F.lit(1)).alias("n"), F.max("mult").alias("mult"),
                                           F.sum((F.col("base") != F.col("total_ticket")).cast("int")).alias("changed"), F.sum("total_ticket").alias("total"))


@query("output_blend", "#id #total_ticket", "SELECT a.id, CAST(floor(0.5 * a.total_ticket + 0.5 * b.total_ticket + 0.5) AS BIGINT) AS total_ticket FROM out1 a JOIN out2 b ON a.id = b.id")
def output_blend(d: Data):
    a, b, _ = outputs(d)
    return correct.output_blend(a, b)


@query("output_diff", "#n ~differing ~median_gap #total_a #total_b ~zeros_a ~zeros_b ~corr",
       """SELECT count(*) AS n, avg(CASE WHEN x <> z THEN 1.0 ELSE 0.0 END) AS differing, median(CASE WHEN x <> z THEN abs(x - z) / greatest((x + z) / 2.0, 1.0) END) AS median_gap,
          sum(x) AS total_a, sum(z) AS total_b, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) AS zeros_a, avg(CASE WHEN z = 0 THEN 1.0 ELSE 0.0 END) AS zeros_b, corr(x, z) AS corr
          FROM (SELECT a.total_ticket AS x, b.total_ticket AS z FROM out1 a JOIN out2 b ON a.id = b.id) q""")
def output_diff(d: Data):
    a, b, _ = outputs(d)
    return diagnose.output_diff(a, b)


CTES["diag"] = f"""SELECT floor(A * scale + 0.5) AS pred, floor(A * scale + 0.5) / scale AS ratio, scale, CAST(h AS VARCHAR) AS h, label, CAST(l1 AS VARCHAR) AS l1,
  CAST({sql_bin('scale', diagnose.DIAGNOSIS_EDGES)} AS VARCHAR) AS scale_bin FROM (SELECT *, t3 / scale * (1.0 - 0.08 * (h - 3)) AS A FROM lab_d) x"""
_FLAT = [1.0, 1.5, 2.0]


@query("output_diagnosis", "segment level #n ~mean_ratio ~zero_share ~mean_pred ~leverage_share ~flat0 ~flat1 ~flat2",
       " UNION ALL ".join(f"""SELECT '{s}' AS segment, {s} AS level, count(*) AS n, avg(ratio) AS mean_ratio, avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0.0 END) AS zero_share, avg(pred) AS mean_pred,
          sum(1 / scale) / (SELECT sum(1 / scale) FROM diag) AS leverage_share, """ + ", ".join(f"sum(abs({r} - ratio)) / (SELECT count(*) FROM diag) AS flat{i}" for i, r in enumerate(_FLAT)) + f" FROM diag GROUP BY {s}"
                          for s in ("h", "label", "l1", "scale_bin")))
def output_diagnosis(d: Data):
    rows = labelled_rows(d).withColumn("pred", F.expr("floor(t3 / scale * (1.0 - 0.08 * (h - 3)) * scale + 0.5)"))
    return diagnose.output_diagnosis(rows, ["h", "label", "l1", "scale_bin"], _FLAT)


# ------------------------------------------------------------------ floors and response
CTES["guard"] = """SELECT u.item, u.site, u.off, u.h, u.y, u.qty, u.scale, u.uplift, u.t3 / u.scale * (1.0 - 0.08 * (u.h - 3)) AS ratio,
  CASE WHEN l.label = 'event_week' AND l.straddle = 1 THEN 1 ELSE 0 END AS straddle, CASE WHEN l.label = 'event_week' THEN 1 ELSE 0 END AS cohort
  FROM upl u JOIN lab_d l ON u.item = l.item AND u.site = l.site AND u.off = l.off AND u.h = l.h"""


def guard_rows(d: Data):
    from launchgrid.operators.market import label_rows

    c = Calendar(d.dense)
    keep = ["item", "site", "off", "h", "d1", "ds", "y", "qty", "scale", "uplift", "t3"]
    rows = label_rows(uplift_rows(d).select(*keep), cal_ops.off_runs(c.regimes))
    return rows.selectExpr("*", "t3 / scale * (1.0 - 0.08 * (h - 3)) as ratio").selectExpr(
        *[k for k in keep], "ratio", "int(label = 'event_week' and straddle = 1) as straddle", "int(label = 'event_week') as cohort")


@query("floor_guard", "mode #h #n #raised ~before ~after ~floor",
       " UNION ALL ".join(f"SELECT '{m}' AS mode, h, count(*) AS n, sum(CASE WHEN ratio < {f} THEN 1 ELSE 0 END) AS raised, avg(ratio) AS before, avg(greatest(ratio, {f})) AS after, avg({f}) AS floor FROM guard WHERE straddle = 1 GROUP BY h"
                          for m, f in (("flat", "1.0::DOUBLE"), ("calendar", "(0.8 * uplift)"))))
def floor_guard(d: Data):
    rows, out = guard_rows(d), None
    for m, k in (("flat", 1.0), ("calendar", 0.8)):
        part = correct.floor_guard(rows, m, k).where("straddle = 1").groupBy("h").agg(
            F.count(F.lit(1)).alias("n"), F.sum((F.col("guarded") > F.col("ratio")).cast("int")).alias("raised"), F.avg("ratio").alias("before"),
            F.avg("guarded").alias("after"), F.avg("floor").alias("floor")).withColumn("mode", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


_val = lambda mode, k: f"({k} * uplift)" if mode == "calendar" else f"{k}::DOUBLE"
_cost = lambda s, t: f"sum(abs({_val(*t)} - " + ("ratio" if s[0] == "none" else f"greatest(ratio, {_val(*s)})") + ")) / (SELECT count(*) FROM guard)"
_REGRET = " UNION ALL ".join(
    f"SELECT '{m}' AS mode, {k}::DOUBLE AS k, " + ", ".join(f"{_cost((m, k), t)} AS c{j}" for j, t in enumerate(correct.SCENARIOS)) + ", greatest("
    + ", ".join(f"{_cost((m, k), t)} - {_cost(('none', 0.0), t)}" for t in correct.SCENARIOS) + ") AS worst FROM guard WHERE straddle = 1" for m, k in correct.STRATEGIES)


@query("minimax_regret", "mode ~k " + " ".join(f"~c{j}" for j in range(len(correct.SCENARIOS))) + " ~worst", _REGRET)
def minimax_regret(d: Data):
    return correct.minimax_regret(guard_rows(d))


_MS = [1.0, 1.2, 1.4, 1.6, 1.8, 2.0]
CTES["resp"] = "SELECT m, avg(abs(y - ratio * CASE WHEN cohort = 1 THEN m ELSE 1 END)) AS score FROM guard CROSS JOIN (SELECT unnest([" + ", ".join(f"{m}::DOUBLE" for m in _MS) + "]) AS m) g GROUP BY m"
CTES["rseg"] = "SELECT m, score, (lag(score) OVER (ORDER BY m) - score) / (m - lag(m) OVER (ORDER BY m)) AS slope, (m + lag(m) OVER (ORDER BY m)) / 2.0 AS mid FROM resp"


@query("response_curve", "~m ~score ~slope ~c2 ~vertex ~zero_slope",
       f"""SELECT s.m, s.score, s.slope, f.c2, f.vertex, z.zero_slope FROM rseg s
          CROSS JOIN (SELECT c2, mm - {correct.QUAD[1]} / (2 * c2) AS vertex FROM (SELECT *, {correct.QUAD[0]} AS c2 FROM
            (SELECT count(*) AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(v) AS sy0, sum(u * v) AS sy1, sum(u * u * v) AS sy2, max(mm) AS mm FROM
              (SELECT m - avg(m) OVER () AS u, score - avg(score) OVER () AS v, avg(m) OVER () AS mm FROM resp) a) b) c) f
          CROSS JOIN (SELECT -regr_intercept(slope, mid) / nullif(regr_slope(slope, mid), 0) AS zero_slope FROM rseg WHERE slope IS NOT NULL) z""")
def response_curve(d: Data):
    return correct.response_curve(correct.response_scores(guard_rows(d), _MS))


@query("displaced_mass", "#n #moved ~ceiling ~gain ~f",
       """SELECT *, (1.0 + gain / nullif(ceiling, 0)) / 2 AS f FROM (SELECT count(*) AS n, sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS moved, sum(abs(b - a) / scale) / count(*) AS ceiling,
          avg((abs(qty - a) - abs(qty - b)) / scale) AS gain FROM (SELECT qty, scale, floor(ratio * scale + 0.5) AS a, floor(ratio * CASE WHEN cohort = 1 THEN 1.6 ELSE 1 END * scale + 0.5) AS b FROM guard) x) z""")
def displaced_mass(d: Data):
    rows = guard_rows(d).selectExpr("qty", "scale", "floor(ratio * scale + 0.5) as a", "floor(ratio * case when cohort = 1 then 1.6 else 1 end * scale + 0.5) as b")
    return correct.displaced_mass(rows, "a", "b")


CTES["slotr"] = "SELECT f.item, f.site, f.off, f.h, g.fold, f.d1_dow, f.fslots / greatest(f.shw3, 1e-9) AS y FROM fr f JOIN gf_d g ON f.item = g.item"
_T3 = "CASE WHEN shw3 > 0 THEN t3 * 1.0 / shw3 ELSE 0 END"
_ORA = {"reference": "A", "slots_known": f"fslots * {_T3} / scale", "zero_state": "CASE WHEN fslots > 0 THEN A ELSE 0 END",
        "level_only": f"CASE WHEN fslots > 0 THEN fslots * {_T3} / scale ELSE A END", "zero_known": "CASE WHEN y = 0 THEN 0 ELSE A END",
        "slots_predicted": f"sr * shw3 * {_T3} / scale"}
CTES["oray"] = f"SELECT f.*, s.sr FROM fr f JOIN ({_backoff_sql('slotr', [['h', 'd1_dow'], ['h']], 'median(y)', 1, 'sr')}) s ON f.item = s.item AND f.site = s.site AND f.off = s.off AND f.h = s.h"


@query("oracle_variants", "variant ~wmase", " UNION ALL ".join(f"SELECT '{n}' AS variant, sum(w * abs(y - ({e}))) / sum(w) AS wmase FROM oray" for n, e in _ORA.items()))
def oracle_variants(d: Data):
    rows = windows.target_rows(d.pairs, with_slots=True)
    from launchgrid.catalog.base import FRAME_COLUMNS
    from launchgrid.functions.scalar import SCALE_EDGES, right_closed_bin

    frame = folded(d, rows.withColumn("sb", right_closed_bin(F.col("scale"), SCALE_EDGES)).selectExpr("*", *FRAME_COLUMNS))
    path = frame.withColumn("_y", F.col("y")).withColumn("y", F.expr("slots / greatest(shw3, 1e-9)"))
    path = models.backoff_fit_apply(path, [["h", "d1_dow"], ["h"]], "median", 1, 5, "slot_ratio")
    return correct.oracle_variants(path.withColumn("y", F.col("_y")), "A")


@query("cutoff_filter", "o_orderpriority #n_before #too_late #closed #n_after",
       """SELECT o_orderpriority, count(*) AS n_before, sum(l) AS too_late, sum(c) AS closed, sum(CASE WHEN l = 0 AND c = 0 THEN 1 ELSE 0 END) AS n_after FROM
          (SELECT o_orderpriority, CASE WHEN CAST(o_orderdate AS DATE) > DATE '1998-06-30' THEN 1 ELSE 0 END AS l, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS c FROM orders) x GROUP BY o_orderpriority""")
def cutoff_filter(d: Data):
    facts = d.table("orders").selectExpr("o_orderpriority", "to_date(o_orderdate) as known_on", "case o_orderstatus when 'O' then 'no' when 'F' then 'yes' else 'unknown' end as public")
    return correct.cutoff_filter(facts, "1998-06-30", "known_on", "public").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_before"), F.sum("too_late").alias("too_late"), F.sum("closed").alias("closed"),
        F.sum(((F.col("too_late") == 0) & (F.col("closed") == 0)).cast("int")).alias("n_after"))


# ------------------------------------------------------------------ models (rows only)
_MODEL_KEY = "item site #off #h #fold ~y "


def plain_rows(d: Data):
    """Features with keys, target and folds, not yet written."""
    rows = feature_table(d.dense_wide, Calendar(d.dense).cal)
    keep = ["item", "site", "off", "y", "scale", "qty"]
    return folded(d, rows.select(*keep, *boosting.FEATURES))


def model_rows(d: Data):
    """Assembled rows in folders by horizon and fold: every fit reads its training folders only."""
    return durable_parts(boosting.assemble(plain_rows(d), boosting.FEATURES), ["h", "fold"], "site")


def open_scores(d: Data):
    """Opening window against mid-run window from the observed days, learnt from clear cases only; one row per pair."""
    cols = ["r1", "r2", "r3", "lr31", "lr32", "log_scale", "qty_per_slot", "rng3"]
    rows = folded(d, pair.pair_features(d.pairs)).withColumn("opens", (F.col("off") <= 2).cast("double"))
    rows = durable(boosting.assemble(rows.select("item", "site", "off", "fold", "opens", *cols), cols))
    return boosting.nested_predict(rows, lambda t: boosting.fit_flag(t.where("off <= 2 or off >= 6"), "opens"), "p_open", 5)


def curve_scores(d: Data):
    """Ratio of an item's window at each horizon, over all its sites; one row per (item, off, h)."""
    rows = boosting.item_ratio_rows(folded(d, uplift_rows(d)))
    rows = durable(boosting.assemble(rows, boosting.CURVE_FEATURES))
    return boosting.nested_predict(rows, lambda t: boosting.fit_ratio(t, seeds=(0,)), "curve", 5)


@query("ratio_model", _MODEL_KEY + "~pred ~rounds", None)
def ratio_model(d: Data):
    """Out-of-fold boosted ratio predictions, two seeds averaged, stopped on held-out items."""
    return boosting.oof_predict(model_rows(d), boosting.fit_ratio, "pred", 5)


@query("weighted_model", "weighting #n ~mase ~opening_mase ~rounds", None)
def weighted_model(d: Data):
    """Plain fits against fits in which rows of opening windows count three times, over all rows and over opening rows."""
    rows = model_rows(d).withColumn("weight", F.when(F.col("off") <= 3, 3.0).otherwise(1.0))
    fits = {"plain": None, "opening": "weight"}
    out = [boosting.oof_predict(rows, lambda t, w=w: boosting.fit_ratio(t, seeds=(0,), weight=w), "pred", 5).withColumn("weighting", F.lit(n)) for n, w in fits.items()]
    error = F.abs(F.col("y") - F.col("pred"))
    return boosting.union(out).groupBy("weighting").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mase"),
                                                        F.avg(F.when(F.col("off") <= 3, error)).alias("opening_mase"), F.avg("rounds").alias("rounds"))


@query("horizon_model", _MODEL_KEY + "~pred model ~rounds", None)
def horizon_model(d: Data):
    """One model per horizon, the general one where a horizon has too few rows."""
    return boosting.oof_horizons(model_rows(d), lambda t: boosting.fit_ratio(t, seeds=(0,)), "pred", 5)


@query("two_part_model", _MODEL_KEY + "~p0 ~pos ~pred", None)
def two_part_model(d: Data):
    """Zero classifier and a regressor of the positive rows, each out of fold."""
    return boosting.oof_two_part(model_rows(d), 5, lambda t: boosting.fit_flag(t, "zero"), lambda t: boosting.fit_ratio(t, seeds=(0,)))


@query("stacked_model", _MODEL_KEY + "~p_open ~curve ~pred ~rounds", None)
def stacked_model(d: Data):
    """The ratio model with the opening score and the item curve as features, both nested out of fold."""
    rows = boosting.join_nested(plain_rows(d), open_scores(d), ["item", "site", "off"], "p_open")
    rows = boosting.join_nested(rows, curve_scores(d), ["item", "off", "h"], "curve")
    parts = durable_parts(boosting.assemble(rows, boosting.FEATURES), ["h", "fold"], "site")
    return boosting.oof_predict(parts, lambda t: boosting.fit_ratio(t, seeds=(0,)), "pred", 5, ["p_open", "curve"])


@query("curve_model", "item #off #h #fold ~y ~curve", None)
def curve_model(d: Data):
    """Model form of the item curve, out of fold."""
    return curve_scores(d).withColumn("curve", boosting.own_element("curve"))


@query("zero_model", "#n #positives ~auc", None)
def zero_model(d: Data):
    """AUC of the out-of-fold zero classifier."""
    rows = model_rows(d).withColumn("zero", (F.col("y") == 0).cast("double"))
    return metrics.auc(boosting.oof_predict(rows, lambda t: boosting.fit_flag(t, "zero"), "p0", 5), "p0", F.col("y") == 0)


@query("adversarial", "#n #positives ~auc", None)
def adversarial(d: Data):
    """How well a classifier with every pair feature tells the pairs of the two fact views apart, on items it has not seen."""
    cols = ["scale", "t1", "t2", "t3", "shw1", "shw2", "shw3", "occ1", "occ2", "occ3", "n1", "n2", "n3", *pair.PAIR_FEATURES]
    side = lambda df, v: pair.pair_features(df).select("item", *cols, F.lit(v).alias("side"), F.pmod(F.xxhash64("item"), F.lit(5)).cast("int").alias("fold"))
    both = durable_table(boosting.assemble(side(d.pairs, 0.0).unionByName(side(windows.observed_pairs(d.sparse_wide), 1.0)), cols))
    return metrics.auc(boosting.oof_predict(both, lambda t: boosting.fit_flag(t, "side"), "p", 5), "p", F.col("side") == 1)


@query("opening_classifier", "item site #off ~p_open", None)
def opening_classifier(d: Data):
    """Probability of an opening window, out of fold; ``stacked_model`` uses it as a feature."""
    return open_scores(d).withColumn("p_open", boosting.own_element("p_open"))


@query("feature_gain", "feature ~gain #place", None)
def feature_gain(d: Data):
    """Gain over the models of all folds and two seeds."""
    rows = model_rows(d)
    fits = boosting.side_by_side(lambda f: boosting.fit_ratio(rows.where(F.col("fold") != f)), range(5), boosting.fits_at_once(d.spark, rows.count()))
    return boosting.feature_gain([m for seeds in fits for m in seeds], boosting.FEATURES, d.spark)
