"""Calendar tables. All of them have one row per day, so they may be broadcast and their windows
may run over the whole table: their size is the length of the calendar, not of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchgrid.functions.joins import days_table, one_row
from launchgrid.functions.scalar import clamp, div, div_floor, flag

DAY_TYPES = {"weekday": 0, "friday": 1, "weekend": 2}
EVENT_REACH = 45   # days from the event that still count
FAST_DAYS = 30


def _all():
    return Window.orderBy("ds")


def _before():
    return _all().rowsBetween(Window.unboundedPreceding, 0)


def _after():
    return _all().rowsBetween(0, Window.unboundedFollowing)


def spine(facts: DataFrame, pad: int = 45) -> DataFrame:
    """Every day from the first fact to the last, padded on both sides."""
    span = facts.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    return span.select(F.explode(F.sequence(F.date_sub("lo", pad), F.date_add("hi", pad))).alias("ds"))


def interval_days(intervals: DataFrame) -> DataFrame:
    """``kind, ds`` for every day of an interval table ``kind, start, end``: an equi-join key."""
    return intervals.select("kind", F.explode(F.sequence("start", "end")).alias("ds")).distinct()


def calendar_table(days: DataFrame, holidays: DataFrame, intervals: DataFrame | None = None,
                   overrides: DataFrame | None = None) -> DataFrame:
    """``ds, dow, dtype, hol, sch, fast`` per day.

    ``holidays``: ``ds, day_type, holiday_type`` and, if the order matters, ``row``: of a repeated day
    the row with the smallest ``row`` counts, whole; without the column, the smallest row. ``intervals``:
    kinds ``holiday``, ``school``, ``fast``. ``overrides``: listed holidays to treat as normal days.
    """
    order = F.col("row") if "row" in holidays.columns else F.struct("day_type", "holiday_type")
    listed = holidays.groupBy("ds").agg(F.min_by(F.struct("day_type", "holiday_type"), order).alias("_d")).select("ds", "_d.*")
    if overrides is not None:
        listed = listed.join(F.broadcast(overrides.select("ds", F.lit(1).alias("_normal"))), "ds", "left").withColumn(
            "holiday_type", F.when(F.col("_normal").isNotNull(), F.lit("normal")).otherwise(F.col("holiday_type"))
        ).drop("_normal")
    out = days.join(days_table(listed), "ds", "left")
    if intervals is not None:
        tags = interval_days(intervals).groupBy("ds").pivot("kind", ["holiday", "school", "fast"]).agg(F.lit(1))
        out = out.join(days_table(tags), "ds", "left")
    else:
        out = out.selectExpr("*", "int(null) as holiday", "int(null) as school", "int(null) as fast")
    by_name = F.create_map(*[x for k, v in DAY_TYPES.items() for x in (F.lit(k), F.lit(v))])
    dow = F.weekday("ds")
    fallback = F.when(dow >= 5, 2).when(dow == 4, 1).otherwise(0)
    return out.select(
        "ds", dow.alias("dow"), F.coalesce(F.try_element_at(by_name, F.col("day_type")), fallback).alias("dtype"),
        F.greatest(flag(F.col("holiday_type") == "holiday"), F.coalesce("holiday", F.lit(0))).alias("hol"),
        F.coalesce("school", F.lit(0)).alias("sch"), F.coalesce("fast", F.lit(0)).alias("fast"))


def off_runs(cal: DataFrame) -> DataFrame:
    """Length of the run of consecutive days off (weekend or holiday) a day belongs to, else 0."""
    off = cal.withColumn("off_day", ((F.col("dtype") == 2) | (F.col("hol") == 1)).cast("int"))
    starts = off.withColumn("_new", (F.col("off_day") != F.coalesce(F.lag("off_day").over(_all()), F.lit(-1))).cast("int"))
    runs = starts.withColumn("_island", F.sum("_new").over(_before()))
    size = F.count(F.lit(1)).over(Window.partitionBy("_island"))
    return runs.withColumn("run", F.when(F.col("off_day") == 1, size).otherwise(0)).drop("_new", "_island")


def holiday_distance(cal: DataFrame, cap: int = 99) -> DataFrame:
    """Days to the next and from the previous holiday (0 on one), capped."""
    hol = F.when(F.col("hol") == 1, F.col("ds"))
    nxt = F.datediff(F.first(hol, True).over(_after()), "ds")
    prv = F.datediff("ds", F.last(hol, True).over(_before()))
    return cal.withColumns({"to_next_hol": F.least(F.coalesce(nxt, F.lit(cap)), F.lit(cap)),
                            "from_prev_hol": F.least(F.coalesce(prv, F.lit(cap)), F.lit(cap))})


def rich_calendar(cal: DataFrame) -> DataFrame:
    out = holiday_distance(off_runs(cal))
    return out.selectExpr("*", "int(dow >= 5) as weekend", "int(dow = 4) as friday", "month(ds) as month",
                          "day(ds) as dom", "weekofyear(ds) as week")


def feast_calendar(cal: DataFrame, events: DataFrame) -> DataFrame:
    """Days relative to the nearest moving event: window, week, fast day, year-end flags."""
    marked = cal.join(days_table(events.select("ds", F.lit(1).alias("_ev"))), "ds", "left")
    ev = F.when(F.col("_ev") == 1, F.col("ds"))
    since = F.datediff("ds", F.last(ev, True).over(_before()))
    until = F.datediff(F.first(ev, True).over(_after()), "ds")
    near = F.when(since.isNull(), -until).when(until.isNull(), since).when(since <= until, since).otherwise(-until)
    out = marked.withColumn("signed", near).drop("_ev")
    return out.selectExpr(
        "*", f"greatest(least(signed, {EVENT_REACH}), -{EVENT_REACH}) as event_k",
        "int(signed between 0 and 13) as in_event",
        f"int(signed between -{FAST_DAYS} and -1) as in_fast",
        "int((month(ds) = 12 and day(ds) >= 20) or (month(ds) = 1 and day(ds) <= 4)) as year_end",
        "case month(ds) when 12 then 25 - day(ds) when 1 then greatest(-(day(ds) + 6), -20) else 99 end as to_year_end",
    ).selectExpr(
        "*", "case when in_event = 1 then signed div 7 + 1 else 0 end as event_week_no",
        f"case when in_fast = 1 then signed + {FAST_DAYS} + 1 else 0 end as fast_day",
        "int(in_fast = 1 and signed >= -10) as fast_late")


def regime(cal: DataFrame, events: DataFrame) -> DataFrame:
    """One label per day: event week, fast, school break, holiday, ordinary, in that order."""
    week = days_table(events.select(F.explode(F.sequence("ds", F.date_add("ds", 6))).alias("ds"), F.lit(1).alias("_wk")).distinct())
    return (cal.join(week, "ds", "left")
            .withColumn("label", F.when(F.col("_wk") == 1, "event_week").when(F.col("fast") == 1, "fast")
                        .when(F.col("sch") == 1, "school_break").when(F.col("hol") == 1, "holiday").otherwise("ordinary"))
            .drop("_wk"))


def opening_calendar(cal: DataFrame, columns: list[str]) -> DataFrame:
    """Each day seen as D1: ``<c>_1, <c>_2, <c>_3`` are its own value and those of the next two days.

    Turns three look-ups per window into one.
    """
    nxt = lambda c, k: F.lead(c, k).over(_all()) if k else F.col(c)
    return cal.select(F.col("ds").alias("d1"), *[nxt(c, k).alias(f"{c}_{k + 1}") for c in columns for k in (0, 1, 2)])


def with_calendar(rows: DataFrame, cal: DataFrame, columns: list[str]) -> DataFrame:
    """Target-day columns and their D1..D3 counterparts on every row: two broadcast look-ups."""
    return (rows.join(days_table(cal.select("ds", *columns)), "ds", "left")
            .join(days_table(opening_calendar(cal, columns)), "d1", "left"))


def calendar_diff(rows: DataFrame, cal: DataFrame) -> DataFrame:
    """Effective day type of the target day against the mean of the observed days."""
    eff = cal.withColumn("eff", F.greatest("dtype", F.col("hol") * 2))
    out = with_calendar(rows, eff, ["eff", "sch", "dtype", "hol"])
    return out.selectExpr(
        "*", "eff_1 + eff_2 + eff_3 as eff_hist", "eff - (eff_1 + eff_2 + eff_3) / 3e0 as eff_diff",
        "(sch_1 + sch_2 + sch_3) / 3e0 as sch_hist", "sch - (sch_1 + sch_2 + sch_3) / 3e0 as sch_diff",
        "weekday(ds) as dow", "weekday(d1) as d1_dow", "month(ds) as month", "day(ds) as dom")


def run_features(rows: DataFrame, cal: DataFrame) -> DataFrame:
    out = with_calendar(rows, off_runs(cal), ["run"])
    return out.selectExpr("*", "run as run_t", "(run_1 + run_2 + run_3) / 3e0 as run_h")


def exposure(rows: DataFrame, cal: DataFrame, column: str, name: str) -> DataFrame:
    """Target day inside the regime, less the share of D1..D3 already inside it."""
    out = with_calendar(rows, cal, [column])
    return out.withColumn(name, F.col(column) * (F.lit(1.0) - (F.col(f"{column}_1") + F.col(f"{column}_2") + F.col(f"{column}_3")) / 3.0))


def cohort_mask(first: str, last: str, d1_max: str) -> Column:
    """Rows whose target lies in a span and whose window opened by a day."""
    return flag(F.col("ds").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
                & (F.col("d1") <= F.lit(d1_max).cast("date")))


def daily_totals(facts: DataFrame) -> DataFrame:
    return facts.groupBy("ds").agg(F.sum("qty").alias("qty"))


def mean_factors(facts: DataFrame, cal: DataFrame) -> DataFrame:
    """Weekday factor and holiday multiplier from means: ``dow, g_dow, hol_mult``.

    The facts are reduced to one row per day once; the rest are windows over that calendar.
    """
    day = daily_totals(facts).join(days_table(cal.select("ds", "dow", "hol")), "ds")
    resid = day.selectExpr("dow", "hol", "qty", "avg(qty) over (partition by dow) / avg(qty) over () as g_dow").selectExpr(
        "dow", "g_dow", "avg(case when hol = 1 then qty / g_dow end) over () as _h",
        "avg(case when hol = 0 then qty / g_dow end) over () as _n")
    return resid.groupBy("dow").agg(
        F.first("g_dow").alias("g_dow"),
        clamp(F.coalesce(div(F.first("_h"), F.first("_n")), F.lit(1.0)), 0.7, 2.5).alias("hol_mult"))


def detrended_factors(facts: DataFrame, cal: DataFrame) -> DataFrame:
    """The same from medians of each day over its centred seven-row mean: ``dow, f_dow, f_hol``."""
    rolled = daily_totals(facts).selectExpr(
        "ds", "qty", "avg(qty) over (order by ds rows between 3 preceding and 3 following) as _roll").where("_roll > 0")
    rat = rolled.join(days_table(cal.select("ds", "dow", "hol")), "ds").selectExpr("dow", "hol", "qty / _roll as _r")
    by_dow = rat.selectExpr(
        "*", "coalesce(median(case when hol = 0 then _r end) over (partition by dow), 1.0) as f_dow")
    return (by_dow.selectExpr("dow", "f_dow", "coalesce(median(case when hol = 1 then _r / f_dow end) over (), 1.0) as f_hol")
            .groupBy("dow").agg(F.first("f_dow").alias("f_dow"), F.first("f_hol").alias("f_hol")))


def factor_calendar(cal: DataFrame, factors: DataFrame) -> DataFrame:
    """Calendar with the day factor: weekday factor times the multiplier on holidays."""
    g, m = [c for c in factors.columns if c != "dow"]
    return (cal.join(F.broadcast(factors), "dow")
            .withColumn("day_factor", F.col(g) * F.when(F.col("hol") == 1, F.col(m)).otherwise(1.0)))


def uplift(rows: DataFrame, factor_cal: DataFrame, site_dow: DataFrame) -> DataFrame:
    """Day factor of the target over the mean of D1..D3, from site factors and from global ones.

    The site's weekday factors travel as one array per site, so a row looks its four days up by
    position after a single join.
    """
    from launchgrid.functions.joins import spread_join

    cal = factor_cal.withColumn("hm", F.when(F.col("hol") == 1, F.col("hol_mult")).otherwise(1.0))
    out = with_calendar(rows, cal, ["dow", "g_dow", "hm", "day_factor"])
    line = site_dow.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("dow", "site_factor"))).alias("_f"))
    out = spread_join(out, line, ["site"], "item")
    site = lambda s: f"coalesce(try_element_at(_f, dow{s}), g_dow{s}, 1.0) * hm{s}"
    return out.selectExpr(
        "*", f"{site('')} as cf_target", f"({site('_1')} + {site('_2')} + {site('_3')}) / 3e0 as base_cf",
        "day_factor / greatest((day_factor_1 + day_factor_2 + day_factor_3) / 3e0, 1e-6) as uplift_global",
    ).selectExpr("*", "cf_target / greatest(base_cf, 1e-6) as uplift").drop("_f")
