"""Calendar, factors, site and city statistics, prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchgrid.catalog.base import CTES, Data, query
from launchgrid.functions.scalar import flag
from launchgrid.operators import calendar as cal_ops, market, site

# The yearly dates of the stand-in calendar, (month, day).
_HOLIDAYS = "((month(ds) = 1 and day(ds) in (1, 15, 25)) or (month(ds) = 5 and day(ds) = 1) or (month(ds) = 12 and day(ds) = 25))"
_OVERRIDE = "(month(ds) = 1 and day(ds) = 25)"
_SCHOOL = "((month(ds) = 1 and day(ds) between 3 and 7) or (month(ds) = 6 and day(ds) >= 21) or (month(ds) = 7 and day(ds) <= 13))"
_FAST = "(month(ds) = 1 and day(ds) between 10 and 17)"
_EVENT = "(month(ds) = 1 and day(ds) = 18)"


class Calendar:
    """The stand-in dimension tables, derived from the days the facts cover."""

    def __init__(self, facts):
        self.days = cal_ops.spine(facts)
        self.holidays = self.days.where(_HOLIDAYS).selectExpr(
            "ds", "case when weekday(ds) >= 5 then 'weekend' when weekday(ds) = 4 then 'friday' else 'weekday' end as day_type",
            "'holiday' as holiday_type", "'day' as holiday_name")
        self.overrides = self.days.where(_OVERRIDE)
        spans = lambda kind, rule: self.days.where(rule).select(
            F.lit(kind).alias("kind"), F.col("ds").alias("start"), F.col("ds").alias("end"))
        self.intervals = spans("school", _SCHOOL).unionByName(spans("fast", _FAST))
        self.events = self.days.where(_EVENT)
        self.cal = cal_ops.calendar_table(self.days, self.holidays, self.intervals, self.overrides)
        self.regimes = cal_ops.regime(self.cal, self.events)


def _cal_sql(facts: str) -> str:
    return f"""SELECT *, CASE WHEN hol = 1 OR dtype = 2 THEN 1 ELSE 0 END AS off_day, greatest(dtype, 2 * hol) AS eff,
        CASE WHEN month(ds) = 1 AND day(ds) BETWEEN 18 AND 24 THEN 'event_week' WHEN fast = 1 THEN 'fast'
             WHEN sch = 1 THEN 'school_break' WHEN hol = 1 THEN 'holiday' ELSE 'ordinary' END AS label
      FROM (SELECT ds, isodow(ds) - 1 AS dow, CASE WHEN isodow(ds) >= 6 THEN 2 WHEN isodow(ds) = 5 THEN 1 ELSE 0 END AS dtype,
        CASE WHEN {_HOLIDAYS} AND NOT {_OVERRIDE} THEN 1 ELSE 0 END AS hol,
        CASE WHEN {_SCHOOL} THEN 1 ELSE 0 END AS sch, CASE WHEN {_FAST} THEN 1 ELSE 0 END AS fast
      FROM (SELECT CAST(unnest(generate_series(min(ds) - 45, max(ds) + 45, INTERVAL 1 DAY)) AS DATE) AS ds FROM {facts}) s) c"""


CTES["cald"] = _cal_sql("fd")
CTES["calc"] = _cal_sql("fc")
for _c in ("cald", "calc"):
    CTES[f"{_c}_run"] = f"""SELECT *, CASE WHEN off_day = 1 THEN count(*) OVER (PARTITION BY off_day, isl) ELSE 0 END AS run FROM
      (SELECT *, row_number() OVER (ORDER BY ds) - row_number() OVER (PARTITION BY off_day ORDER BY ds) AS isl FROM {_c}) i"""


@query("calendar_table", "$ds #dow #dtype #hol #sch #fast #off_day #run #to_next_hol #from_prev_hol #weekend #friday #month #dom #week",
       """SELECT *, CAST(dow >= 5 AS INTEGER) AS weekend, CAST(dow = 4 AS INTEGER) AS friday, month(ds) AS month, day(ds) AS dom,
          week(ds) AS week,
          least(coalesce(date_diff('day', ds, min(CASE WHEN hol = 1 THEN ds END) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 99), 99) AS to_next_hol,
          least(coalesce(date_diff('day', max(CASE WHEN hol = 1 THEN ds END) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ds), 99), 99) AS from_prev_hol
          FROM calc_run""")
def calendar_table(d: Data):
    return cal_ops.rich_calendar(Calendar(d.catalog).cal)


@query("holiday_distance", "$ds #hol #to_next_hol #from_prev_hol",
       """SELECT c.ds, c.hol, least(coalesce(min(CASE WHEN h.ds >= c.ds THEN date_diff('day', c.ds, h.ds) END), 30), 30) AS to_next_hol,
          least(coalesce(min(CASE WHEN h.ds <= c.ds THEN date_diff('day', h.ds, c.ds) END), 30), 30) AS from_prev_hol
          FROM calc c CROSS JOIN (SELECT ds FROM calc WHERE hol = 1) h GROUP BY c.ds, c.hol""")
def holiday_distance(d: Data):
    return cal_ops.holiday_distance(Calendar(d.catalog).cal, cap=30)


@query("dayoff_runs", "item site #off #h ~run_t ~run_h",
       """SELECT g.item, g.site, g.off, g.h, t.run AS run_t, (a.run + b.run + c.run) / 3.0 AS run_h FROM gd g
          JOIN cald_run t ON g.ds = t.ds JOIN cald_run a ON g.d1 = a.ds JOIN cald_run b ON g.d1 + 1 = b.ds JOIN cald_run c ON g.d1 + 2 = c.ds""")
def dayoff_runs(d: Data):
    return cal_ops.run_features(d.rows, Calendar(d.dense).cal)


@query("feast_calendar", "$ds #event_k #in_event #event_week_no #in_fast #fast_day #fast_late #year_end #to_year_end",
       f"""SELECT ds, greatest(least(k, 45), -45) AS event_k, CASE WHEN k BETWEEN 0 AND 13 THEN 1 ELSE 0 END AS in_event,
          CASE WHEN k BETWEEN 0 AND 13 THEN k // 7 + 1 ELSE 0 END AS event_week_no,
          CASE WHEN k BETWEEN -30 AND -1 THEN 1 ELSE 0 END AS in_fast, CASE WHEN k BETWEEN -30 AND -1 THEN k + 31 ELSE 0 END AS fast_day,
          CASE WHEN k BETWEEN -10 AND -1 THEN 1 ELSE 0 END AS fast_late,
          CASE WHEN (month(ds) = 12 AND day(ds) >= 20) OR (month(ds) = 1 AND day(ds) <= 4) THEN 1 ELSE 0 END AS year_end,
          CASE WHEN month(ds) = 12 THEN 25 - day(ds) WHEN month(ds) = 1 THEN greatest(-(day(ds) + 6), -20) ELSE 99 END AS to_year_end
          FROM (SELECT c.ds, arg_min(date_diff('day', e.ds, c.ds), abs(date_diff('day', e.ds, c.ds)) * 10 - sign(date_diff('day', e.ds, c.ds))) AS k
                FROM calc c CROSS JOIN (SELECT ds FROM calc WHERE {_EVENT}) e GROUP BY c.ds) n""")
def feast_calendar(d: Data):
    c = Calendar(d.catalog)
    return cal_ops.feast_calendar(c.cal, c.events)


@query("regime_calendar", "label #days #sites_days #qty",
       """SELECT label, count(DISTINCT c.ds) AS days, count(f.ds) AS sites_days, coalesce(sum(qty), 0) AS qty
          FROM calc c LEFT JOIN (SELECT site, ds, sum(qty) AS qty FROM fc GROUP BY site, ds) f ON c.ds = f.ds GROUP BY label""")
def regime_calendar(d: Data):
    c = Calendar(d.catalog)
    per_day = site.site_days(d.catalog).groupBy("ds").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("q"))
    return c.regimes.join(per_day, "ds", "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("n"), F.lit(0)).alias("sites_days"),
        F.coalesce(F.sum("q"), F.lit(0)).alias("qty"))


_CAL4 = "JOIN cald t ON g.ds = t.ds JOIN cald a ON g.d1 = a.ds JOIN cald b ON g.d1 + 1 = b.ds JOIN cald c ON g.d1 + 2 = c.ds"


@query("calendar_diff", "item site #off #h #eff #eff_hist ~eff_diff #sch ~sch_hist ~sch_diff #dow #d1_dow #month #dom",
       f"""SELECT g.item, g.site, g.off, g.h, t.eff, a.eff + b.eff + c.eff AS eff_hist, t.eff - (a.eff + b.eff + c.eff) / 3.0 AS eff_diff,
          t.sch, (a.sch + b.sch + c.sch) / 3.0 AS sch_hist, t.sch - (a.sch + b.sch + c.sch) / 3.0 AS sch_diff,
          isodow(g.ds) - 1 AS dow, isodow(g.d1) - 1 AS d1_dow, month(g.ds) AS month, day(g.ds) AS dom FROM gd g {_CAL4}""")
def calendar_diff(d: Data):
    return cal_ops.calendar_diff(d.rows, Calendar(d.dense).cal)


@query("cohort_exposure", "item site #off #h ~fast_exp ~school_exp #cohort",
       f"""SELECT g.item, g.site, g.off, g.h, t.fast * (1.0 - (a.fast + b.fast + c.fast) / 3.0) AS fast_exp,
          t.sch * (1.0 - (a.sch + b.sch + c.sch) / 3.0) AS school_exp,
          CASE WHEN g.ds BETWEEN DATE '2024-01-18' AND DATE '2024-01-24' AND g.d1 <= DATE '2024-01-15' THEN 1 ELSE 0 END AS cohort
          FROM gd g {_CAL4}""")
def cohort_exposure(d: Data):
    cal = Calendar(d.dense).cal
    rows = cal_ops.exposure(d.rows, cal, "fast", "fast_exp")
    rows = cal_ops.exposure(rows, cal, "sch", "school_exp")
    return rows.withColumn("cohort", cal_ops.cohort_mask("2024-01-18", "2024-01-24", "2024-01-15"))


_FACT = """SELECT d.dow, avg(d.qty) / max(m.mean) AS g_dow FROM day_{v} d CROSS JOIN (SELECT avg(qty) AS mean FROM day_{v}) m GROUP BY d.dow"""
for _v, _f in (("d", "fd"), ("c", "fc")):
    CTES[f"day_{_v}"] = f"SELECT x.ds, x.qty, k.dow, k.hol, k.sch FROM (SELECT ds, sum(qty) AS qty FROM {_f} GROUP BY ds) x JOIN cal{_v} k ON x.ds = k.ds"
    CTES[f"gdow_{_v}"] = _FACT.format(v=_v)
    CTES[f"gfac_{_v}"] = f"""SELECT g.dow, g.g_dow, least(greatest(coalesce(h.hol_r / h.nor_r, 1.0), 0.7), 2.5) AS hol_mult FROM gdow_{_v} g CROSS JOIN
      (SELECT avg(CASE WHEN hol = 1 THEN qty / g_dow END) AS hol_r, avg(CASE WHEN hol = 0 THEN qty / g_dow END) AS nor_r
       FROM day_{_v} d JOIN gdow_{_v} g ON d.dow = g.dow) h"""


CTES["rat_c"] = """SELECT *, qty / roll AS r FROM (SELECT *, avg(qty) OVER (ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS roll FROM day_c) q WHERE roll > 0"""


@query("calendar_factors", "#dow ~g_dow ~hol_mult ~f_dow ~f_hol",
       """SELECT g.*, f.f_dow, h.f_hol FROM gfac_c g
          JOIN (SELECT dow, coalesce(median(CASE WHEN hol = 0 THEN r END), 1.0) AS f_dow FROM rat_c GROUP BY dow) f ON g.dow = f.dow
          CROSS JOIN (SELECT coalesce(median(r.r / f.f_dow), 1.0) AS f_hol FROM rat_c r JOIN
            (SELECT dow, coalesce(median(CASE WHEN hol = 0 THEN r END), 1.0) AS f_dow FROM rat_c GROUP BY dow) f ON r.dow = f.dow WHERE r.hol = 1) h""")
def calendar_factors(d: Data):
    cal = Calendar(d.catalog).cal
    return cal_ops.mean_factors(d.catalog, cal).join(F.broadcast(cal_ops.detrended_factors(d.catalog, cal)), "dow")



CTES["sd_c"] = "SELECT site, ds, sum(qty) AS qty, sum(slots) AS slots, count(*) AS items FROM fc GROUP BY site, ds"
CTES["ss_c"] = """SELECT a.*, b.n_items, b.qty_total, b.slots_total, b.rate_mean, b.qty_total / greatest(b.slots_total, 1) AS qty_per_slot,
  std_daily / greatest(mean_daily, 1e-6) AS cv_daily FROM
  (SELECT site, avg(qty) AS mean_daily, median(qty) AS med_daily, stddev_samp(qty) AS std_daily, quantile_cont(qty, 0.9) AS p90_daily,
          avg(slots) AS mean_slots, avg(items) AS mean_items, count(*) AS active_days FROM sd_c GROUP BY site) a
  JOIN (SELECT site, count(DISTINCT item) AS n_items, sum(qty) AS qty_total, sum(slots) AS slots_total, avg(rate) AS rate_mean FROM fc GROUP BY site) b
  ON a.site = b.site"""


@query("site_stats", "site ~mean_daily ~med_daily ~std_daily ~p90_daily ~mean_slots ~mean_items #active_days #n_items #qty_total #slots_total ~rate_mean ~qty_per_slot ~cv_daily",
       "SELECT * FROM ss_c")
def site_stats(d: Data):
    return site.site_stats(d.catalog)


_MEAS = site.SITE_MEASURES


@query("site_defaults", "item site " + " ".join(f"~{m}" for m in _MEAS),
       f"""SELECT p.item, p.site, {', '.join(f'coalesce(s.{m}, x.{m}) AS {m}' for m in _MEAS)}
          FROM (SELECT DISTINCT item, site FROM fc UNION SELECT DISTINCT item, site FROM fs) p LEFT JOIN ss_c s ON p.site = s.site
          CROSS JOIN (SELECT {', '.join(f'median(CAST({m} AS DOUBLE)) AS {m}' for m in _MEAS)} FROM ss_c) x""")
def site_defaults(d: Data):
    pairs = d.catalog.select("item", "site").union(d.sparse.select("item", "site")).distinct()
    return site.with_site_stats(pairs, site.site_stats(d.catalog))


CTES["sdow_c"] = """SELECT a.site, a.dow, a.n, (a.s / a.n) / (b.s / b.n) AS raw_factor FROM
  (SELECT x.site, k.dow, count(*) AS n, sum(x.qty) * 1.0 AS s FROM sd_c x JOIN calc k ON x.ds = k.ds WHERE k.hol = 0 AND k.sch = 0 GROUP BY x.site, k.dow) a
  JOIN (SELECT x.site, count(*) AS n, sum(x.qty) * 1.0 AS s FROM sd_c x JOIN calc k ON x.ds = k.ds WHERE k.hol = 0 AND k.sch = 0 GROUP BY x.site) b ON a.site = b.site"""


@query("site_dow_profile", "site #dow #n ~raw_factor ~site_factor",
       "SELECT s.*, (s.raw_factor * s.n + g.g_dow * 8.0) / (s.n + 8.0) AS site_factor FROM sdow_c s JOIN gfac_c g ON s.dow = g.dow")
def site_dow_profile(d: Data):
    cal = Calendar(d.catalog).cal
    prof = site.site_dow_profile(site.ordinary_site_days(d.catalog, cal))
    return site.shrunk_dow_factor(prof, cal_ops.mean_factors(d.catalog, cal))


CTES["sd_d"] = "SELECT site, ds, sum(qty) AS qty, sum(slots) AS slots FROM fd GROUP BY site, ds"
CTES["sod_d"] = "SELECT x.*, k.dow FROM sd_d x JOIN cald k ON x.ds = k.ds WHERE k.hol = 0 AND k.sch = 0"


@query("site_static", "site ~site_qty ~site_slots", "SELECT site, avg(qty) AS site_qty, avg(slots) AS site_slots FROM sod_d GROUP BY site")
def site_static(d: Data):
    return site.site_static(site.ordinary_site_days(d.dense, Calendar(d.dense).cal))


@query("city_stats", "city #n_sites #city_qty ~city_rate ~city_daily",
       """SELECT city, count(DISTINCT site) AS n_sites, sum(qty) AS city_qty, avg(rate) AS city_rate,
          sum(qty) * 1.0 / (SELECT count(DISTINCT ds) FROM fc) AS city_daily FROM fc GROUP BY city""")
def city_stats(d: Data):
    return site.city_stats(d.catalog)


CTES["price_d"] = """SELECT city, CASE dtype WHEN 2 THEN 'weekend' WHEN 1 THEN 'friday' ELSE 'weekday' END AS day_type, avg(rate) AS price
  FROM fd f JOIN cald k ON f.ds = k.ds GROUP BY city, dtype"""
CTES["pw_d"] = """SELECT city, """ + ", ".join(
    f"coalesce({k}, median({k}) OVER ()) AS price_{k}" for k in ("weekday", "friday", "weekend")) + """ FROM
  (SELECT city, """ + ", ".join(f"avg(CASE WHEN day_type = '{k}' THEN price END) AS {k}" for k in ("weekday", "friday", "weekend")) + """
   FROM price_d GROUP BY city) w"""


def prices(d: Data, cal):
    """Stand-in price table: mean rate per city and day type."""
    return (d.dense.join(F.broadcast(cal.select("ds", "dtype")), "ds")
            .groupBy("city", "dtype").agg(F.avg("rate").alias("price"))
            .selectExpr("city", "case dtype when 2 then 'weekend' when 1 then 'friday' else 'weekday' end as day_type", "price"))


@query("price_features", "item site city #off #h ~price ~price_rel",
       """SELECT *, price / greatest((price_weekday + price_friday + price_weekend) / 3.0, 1) AS price_rel FROM
          (SELECT g.item, g.site, g.city, g.off, g.h, w.price_weekday, w.price_friday, w.price_weekend,
             CASE k.dtype WHEN 2 THEN w.price_weekend WHEN 1 THEN w.price_friday ELSE w.price_weekday END AS price
           FROM gd g JOIN cald k ON g.ds = k.ds JOIN pw_d w ON g.city = w.city) q""")
def price_features(d: Data):
    cal = Calendar(d.dense).cal
    return site.price_features(d.rows, prices(d, cal), cal)


CTES["shr_d"] = """SELECT a.site, a.dow, ((a.s / a.n) / (b.s / b.n) * a.n + g.g_dow * 8.0) / (a.n + 8.0) AS site_factor FROM
  (SELECT site, dow, count(*) AS n, sum(qty) * 1.0 AS s FROM sod_d GROUP BY site, dow) a
  JOIN (SELECT site, count(*) AS n, sum(qty) * 1.0 AS s FROM sod_d GROUP BY site) b ON a.site = b.site JOIN gfac_d g ON a.dow = g.dow"""
CTES["calf_d"] = """SELECT k.ds, k.dow, g.g_dow, CASE WHEN k.hol = 1 THEN g.hol_mult ELSE 1.0 END AS hm,
  g.g_dow * CASE WHEN k.hol = 1 THEN g.hol_mult ELSE 1.0 END AS day_factor FROM cald k JOIN gfac_d g ON k.dow = g.dow"""
CTES["scal_d"] = """SELECT *, (cf + lead(cf, 1) OVER w + lead(cf, 2) OVER w) / 3.0 AS base_cf,
    (day_factor + lead(day_factor, 1) OVER w + lead(day_factor, 2) OVER w) / 3.0 AS base_day FROM
  (SELECT s.site, c.ds, coalesce(f.site_factor, c.g_dow) * c.hm AS cf, c.day_factor FROM calf_d c
   CROSS JOIN (SELECT DISTINCT site FROM fd) s LEFT JOIN shr_d f ON f.site = s.site AND f.dow = c.dow) x WINDOW w AS (PARTITION BY site ORDER BY ds)"""
CTES["upl"] = """SELECT g.*, t.cf AS cf_target, a.base_cf, t.cf / greatest(a.base_cf, 1e-6) AS uplift,
  t.day_factor / greatest(a.base_day, 1e-6) AS uplift_global FROM gd g
  JOIN scal_d t ON g.site = t.site AND g.ds = t.ds JOIN scal_d a ON g.site = a.site AND g.d1 = a.ds"""


def uplift_rows(d: Data):
    cal = Calendar(d.dense).cal
    factors = cal_ops.mean_factors(d.dense, cal)
    prof = site.shrunk_dow_factor(site.site_dow_profile(site.ordinary_site_days(d.dense, cal)), factors)
    return cal_ops.uplift(d.rows, cal_ops.factor_calendar(cal, factors), prof)


@query("uplift", "item site #off #h ~cf_target ~base_cf ~uplift ~uplift_global", "SELECT * FROM upl")
def uplift(d: Data):
    return uplift_rows(d)


_REG = "(a.label <> t.label AND b.label <> t.label AND c.label <> t.label)"
CTES["lab_d"] = f"""SELECT g.*, t.label, a.label AS l1, b.label AS l2, c.label AS l3, CASE WHEN {_REG} THEN 1 ELSE 0 END AS straddle,
  a.off_day + b.off_day + c.off_day AS n_off_obs, a.hol + b.hol + c.hol AS n_hol_obs, a.fast + b.fast + c.fast AS n_fast_obs FROM gd g {_CAL4}"""


def labelled_rows(d: Data):
    c = Calendar(d.dense)
    return market.label_rows(d.rows, cal_ops.off_runs(c.regimes))


@query("regime_straddle", "l1 label #n_rows #straddle #n_off_obs #n_hol_obs #n_fast_obs ~share",
       """SELECT l1, label, count(*) AS n_rows, sum(straddle) AS straddle, sum(n_off_obs) AS n_off_obs, sum(n_hol_obs) AS n_hol_obs,
          sum(n_fast_obs) AS n_fast_obs, count(*) * 1.0 / (SELECT count(*) FROM gd) AS share FROM lab_d GROUP BY l1, label""")
def regime_straddle(d: Data):
    return market.straddle_table(labelled_rows(d))
