"""Market level, index, regimes, cohorts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchgrid.catalog.base import CTES, Data, query
from launchgrid.catalog.calendar_queries import Calendar, labelled_rows
from launchgrid.operators import calendar as cal_ops, diagnose, market, pair, windows

CTES["lvl_c"] = """SELECT ds, sum(qty) AS qty, sum(slots) AS slots, avg(rate) AS rate, count(*) AS n_rows, count(DISTINCT item) AS n_items,
  count(DISTINCT site) AS n_sites, sum(qty) * 1.0 / nullif(sum(slots), 0) AS tps FROM fc GROUP BY ds"""
CTES["adj_c"] = """SELECT l.*, l.tps / b.base AS f FROM lvl_c l LEFT JOIN (SELECT isodow(ds) AS dw, median(tps) AS base FROM lvl_c
  WHERE ds BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY isodow(ds)) b ON isodow(l.ds) = b.dw"""
CTES["lvl_d"] = CTES["lvl_c"].replace("fc", "fd")
CTES["adj_d"] = CTES["adj_c"].replace("lvl_c", "lvl_d").replace("1997-01-01", "2024-01-01").replace("1997-12-31", "2024-01-31")


def _level(d: Data, view: str):
    span = ("1997-01-01", "1997-12-31") if view == "catalog" else ("2024-01-01", "2024-01-31")
    return market.adjusted_level(market.market_level(getattr(d, view)), *span)


@query("market_level", "$ds #qty #slots ~rate #n_rows #n_items #n_sites ~tps ~f", "SELECT * FROM adj_c")
def market_level(d: Data):
    return _level(d, "catalog")


@query("market_rollup", "unit $period #days ~tps ~f #item_days",
       " UNION ALL ".join(f"SELECT '{u}' AS unit, CAST(date_trunc('{u}', ds) AS DATE) AS period, count(*) AS days, avg(tps) AS tps, avg(f) AS f, sum(n_items) AS item_days FROM adj_c GROUP BY CAST(date_trunc('{u}', ds) AS DATE)" for u in ("week", "month")))
def market_rollup(d: Data):
    level = _level(d, "catalog")
    return market.rollup_level(level, "week").withColumn("unit", F.lit("week")).unionByName(
        market.rollup_level(level, "month").withColumn("unit", F.lit("month")))


@query("market_span_weeks", "#week #days ~f #item_days",
       """SELECT date_diff('day', DATE '1998-02-01', ds) // 7 + 1 AS week, count(*) AS days, avg(f) AS f, sum(n_items) AS item_days FROM adj_c
          WHERE ds BETWEEN DATE '1998-02-01' AND DATE '1998-03-02' GROUP BY date_diff('day', DATE '1998-02-01', ds) // 7 + 1""")
def market_span_weeks(d: Data):
    return market.span_weeks(_level(d, "catalog"), "1998-02-01", 30)


@query("event_level", "$ds #k #qty ~tps ~f ~f_week",
       """SELECT *, avg(CASE WHEN k BETWEEN 1 AND 6 THEN f END) OVER () AS f_week FROM
          (SELECT *, date_diff('day', DATE '1998-03-03', ds) AS k FROM adj_c) x WHERE k BETWEEN -20 AND 20""")
def event_level(d: Data):
    return market.event_level(_level(d, "catalog"), "1998-03-03", -20, 20)


@query("implied_multiplier", "#k #h ~f ~multiplier",
       """SELECT k, k + 4 AS h, f, f / b AS multiplier FROM (SELECT date_diff('day', DATE '1998-03-03', ds) AS k, avg(f) AS f FROM adj_c GROUP BY 1) x
          CROSS JOIN (SELECT avg(f) AS b FROM adj_c WHERE ds BETWEEN DATE '1999-02-26' AND DATE '1999-02-28') y WHERE k BETWEEN 0 AND 6""")
def implied_multiplier(d: Data):
    return market.implied_multiplier(_level(d, "catalog"), "1998-03-03", "1999-02-26", "1999-02-28")


CTES["prof_d"] = "SELECT date_diff('day', DATE '2024-01-08', ds) AS k, f AS level FROM adj_d WHERE ds BETWEEN DATE '2024-01-09' AND DATE '2024-01-14'"
CTES["idx_d"] = """SELECT ds, raw, CASE WHEN raw IS NOT NULL THEN raw WHEN lv IS NULL THEN rv WHEN rv IS NULL THEN lv
    ELSE lv + (rv - lv) * date_diff('day', ld, ds) / (date_diff('day', ld, ds) + date_diff('day', ds, rd)) END AS level FROM
  (SELECT ds, raw, last_value(raw IGNORE NULLS) OVER b AS lv, first_value(raw IGNORE NULLS) OVER a AS rv,
     max(CASE WHEN raw IS NOT NULL THEN ds END) OVER b AS ld, min(CASE WHEN raw IS NOT NULL THEN ds END) OVER a AS rd FROM
   (SELECT k.ds, coalesce(p.level, w.f) AS raw FROM cald k
     LEFT JOIN (SELECT CAST(date_trunc('week', ds) AS DATE) AS wk, avg(f) AS f FROM adj_d GROUP BY 1) w ON CAST(date_trunc('week', k.ds) AS DATE) = w.wk
     LEFT JOIN (SELECT DATE '2024-01-22' + CAST(k AS INTEGER) AS ds, level FROM (SELECT * FROM prof_d UNION ALL SELECT 0, level FROM prof_d WHERE k = 1) z) p ON k.ds = p.ds) r
   WINDOW b AS (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) q"""


def _index(d: Data):
    level = _level(d, "dense")
    profile = level.where("ds between date '2024-01-09' and date '2024-01-14'").selectExpr(
        "datediff(ds, date '2024-01-08') as k", "f as level")
    return market.market_index(level, cal_ops.spine(d.dense), "2024-01-22", profile)


@query("market_index", "$ds ~raw ~level", "SELECT * FROM idx_d")
def market_index(d: Data):
    return _index(d)


CTES["mr_d"] = """SELECT g.*, t.level / ((a.level + b.level + c.level) / 3.0) AS mr FROM lab_d g JOIN idx_d t ON g.ds = t.ds
  JOIN idx_d a ON g.d1 = a.ds JOIN idx_d b ON g.d1 + 1 = b.ds JOIN idx_d c ON g.d1 + 2 = c.ds"""


@query("market_ratio", "l1 label #n_rows ~mean_ratio ~median_ratio ~p10 ~p90",
       """SELECT l1, label, count(*) AS n_rows, avg(mr) AS mean_ratio, median(mr) AS median_ratio, quantile_cont(mr, 0.1) AS p10,
          quantile_cont(mr, 0.9) AS p90 FROM mr_d GROUP BY l1, label""")
def market_ratio(d: Data):
    return diagnose.ratio_profile(market.market_ratio(labelled_rows(d), _index(d)), ["l1", "label"], "mr")


_COHORT = """SELECT *, event + fast + school AS anomaly FROM (SELECT d1, count(*) AS n_rows, count(DISTINCT item) AS items,
   avg(CASE WHEN label = 'event_week' THEN 1.0 ELSE 0.0 END) AS event, avg(CASE WHEN label = 'fast' THEN 1.0 ELSE 0.0 END) AS fast,
   avg(CASE WHEN label = 'school_break' THEN 1.0 ELSE 0.0 END) AS school, count(*) * 1.0 / (SELECT count(*) FROM gd) AS row_share FROM lab_d GROUP BY d1) q"""


@query("cohort_table", "$d1 #n_rows #items ~event ~fast ~school ~row_share ~anomaly",
       f"SELECT * FROM ({_COHORT}) z ORDER BY anomaly DESC, d1 LIMIT 14")
def cohort_table(d: Data):
    return market.cohort_table(labelled_rows(d))


@query("leverage", "pattern #n_rows ~row_share ~med_scale ~leverage_share",
       """SELECT concat(CAST(CAST(t1 > 0 AS INTEGER) AS VARCHAR), CAST(CAST(t2 > 0 AS INTEGER) AS VARCHAR), CAST(CAST(t3 > 0 AS INTEGER) AS VARCHAR)) AS pattern,
          count(*) AS n_rows, count(*) * 1.0 / (SELECT count(*) FROM ps) AS row_share, median(scale) AS med_scale,
          sum(1.0 / scale) / (SELECT sum(1.0 / scale) FROM ps) AS leverage_share FROM ps GROUP BY 1""")
def leverage(d: Data):
    return diagnose.leverage(pair.add_pattern(windows.observed_pairs(d.sparse_wide)), ["pattern"])


_THR = [1, 2, 3, 5, 10, 25, 50]


@query("leverage_below", "~threshold ~row_share ~leverage_share",
       " UNION ALL ".join(f"SELECT {t} AS threshold, avg(CASE WHEN scale <= {t} THEN 1.0 ELSE 0.0 END) AS row_share, sum(CASE WHEN scale <= {t} THEN 1.0 / scale ELSE 0 END) / sum(1.0 / scale) AS leverage_share FROM pd" for t in _THR))
def leverage_below(d: Data):
    return diagnose.leverage_below(d.pairs, _THR)


_PROFILE = """SELECT h, count(*) AS n_rows, avg(y) AS mean_ratio, median(y) AS median_ratio, quantile_cont(y, 0.1) AS p10,
   quantile_cont(y, 0.9) AS p90, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS zero_share FROM {src} GROUP BY h"""
_PCOLS = "#h #n_rows ~mean_ratio ~median_ratio ~p10 ~p90 ~zero_share"


@query("ratio_profile", _PCOLS, _PROFILE.format(src="gd"))
def ratio_profile(d: Data):
    return diagnose.ratio_profile(d.rows, ["h"])


@query("ratio_profile_sparse", _PCOLS, _PROFILE.format(src="gs"))
def ratio_profile_sparse(d: Data):
    return diagnose.ratio_profile(windows.target_rows(windows.observed_pairs(d.sparse_wide)), ["h"])


CTES["mix_dow"] = "SELECT isodow(d1) - 1 AS d1_dow, count(*) * 1.0 / (SELECT count(*) FROM rel_s) AS share FROM rel_s GROUP BY isodow(d1) - 1"
CTES["rew_d"] = """SELECT h, sum(share * m) / sum(CASE WHEN m IS NOT NULL THEN share END) AS mean_ratio, sum(share * z) / sum(share) AS zero_share,
  sum(share) AS coverage FROM (SELECT isodow(d1) - 1 AS d1_dow, h, avg(y) AS m, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS z FROM gd GROUP BY 1, 2) c
  JOIN mix_dow x ON c.d1_dow = x.d1_dow GROUP BY h"""


def _reweighted(d: Data):
    dow = d.releases.groupBy(F.weekday("d1").alias("d1_dow")).agg(F.count(F.lit(1)).alias("n"))
    mix = dow.selectExpr("d1_dow", "n / sum(n) over () as share")
    return diagnose.profile_reweight(d.rows.withColumn("d1_dow", F.weekday("d1")), mix)


@query("profile_reweight", "#h ~mean_ratio ~zero_share ~coverage", "SELECT * FROM rew_d")
def profile_reweight(d: Data):
    return _reweighted(d)


@query("profile_compare", "#h ~true_mean ~true_zero ~pred_mean ~pred_zero ~mean_mult ~zero_gap_pp",
       """SELECT r.h, r.mean_ratio AS true_mean, r.zero_share AS true_zero, p.m AS pred_mean, p.z AS pred_zero, r.mean_ratio / p.m AS mean_mult,
          (r.zero_share - p.z) * 100 AS zero_gap_pp FROM rew_d r JOIN (SELECT h, avg(A) AS m, avg(CASE WHEN A = 0 THEN 1.0 ELSE 0.0 END) AS z FROM fr GROUP BY h) p ON r.h = p.h""")
def profile_compare(d: Data):
    pred = d.frame.groupBy("h").agg(F.avg("A").alias("mean_ratio"), F.avg((F.col("A") == 0).cast("double")).alias("zero_share"))
    return diagnose.profile_compare(_reweighted(d), pred)
