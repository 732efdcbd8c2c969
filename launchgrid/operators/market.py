"""Market level, regimes and launch cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from launchgrid.functions.joins import days_table, one_row
from launchgrid.operators.calendar import with_calendar


def label_rows(rows: DataFrame, regimes: DataFrame) -> DataFrame:
    """Regime of the target day and of D1..D3, counts of special observed days, straddle flag."""
    out = with_calendar(rows, regimes, ["label", "off_day", "hol", "fast"])
    return out.selectExpr(
        "*", "label_1 as l1", "int(label not in (label_1, label_2, label_3)) as straddle",
        "off_day_1 + off_day_2 + off_day_3 as n_off_obs", "hol_1 + hol_2 + hol_3 as n_hol_obs",
        "fast_1 + fast_2 + fast_3 as n_fast_obs")


def straddle_table(labelled: DataFrame) -> DataFrame:
    """Cross-tab of the D1 regime and the target regime with the share of all rows."""
    cells = labelled.groupBy("l1", "label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(c).alias(c) for c in ("straddle", "n_off_obs", "n_hol_obs", "n_fast_obs")])
    # At most a few dozen label pairs: the total is a window over them.
    return cells.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def cohort_table(labelled: DataFrame, top: int | None = 14) -> DataFrame:
    """Launch days by the share of their target rows in special regimes."""
    kinds = {"event_week": "event", "fast": "fast", "school_break": "school"}
    rows = labelled.groupBy("d1", "item").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("label") == k).cast("int")).alias(v) for k, v in kinds.items()])
    day = rows.groupBy("d1").agg(F.sum("n").alias("n_rows"), F.countDistinct("item").alias("items"),
                                 *[(F.sum(v) / F.sum("n")).alias(v) for v in kinds.values()])
    total = labelled.agg(F.count(F.lit(1)).alias("_all"))
    out = (day.crossJoin(one_row(total)).withColumn("row_share", F.col("n_rows") / F.col("_all"))
           .withColumn("anomaly", F.col("event") + F.col("fast") + F.col("school")).drop("_all"))
    return out.orderBy(F.desc("anomaly"), F.asc("d1")).limit(top) if top else out


# ------------------------------------------------------------------ daily level
def market_level(facts: DataFrame) -> DataFrame:
    """Market per day: totals, mean rate, rows, distinct items and sites, quantity per slot.

    The distinct counts are taken over (ds, item) and (ds, site) groups, so that a day with very
    many rows is still reduced before it meets one task.
    """
    items = facts.groupBy("ds", "item").agg(
        F.sum("qty").alias("q"), F.sum("slots").alias("s"), F.sum("rate").alias("r"), F.count(F.lit(1)).alias("n"))
    by_item = items.groupBy("ds").agg(
        F.sum("q").alias("qty"), F.sum("s").alias("slots"), (F.sum("r") / F.sum("n")).alias("rate"),
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_items"))
    by_site = (facts.groupBy("ds", "site").agg(F.lit(1).alias("_1")).groupBy("ds").agg(F.count(F.lit(1)).alias("n_sites")))
    return by_item.join(by_site, "ds").withColumn("tps", F.try_divide("qty", F.col("slots").cast("double")))


def adjusted_level(level: DataFrame, first: str, last: str, column: str = "tps") -> DataFrame:
    """Level over the median of the same weekday inside a reference span: ``f``. Days only."""
    return level.selectExpr(
        "*", f"{column} / median(case when ds between date '{first}' and date '{last}' then {column} end) "
             "over (partition by weekday(ds)) as f")


def rollup_level(level: DataFrame, unit: str) -> DataFrame:
    """Weekly or monthly means of the adjusted level."""
    return level.groupBy(F.date_trunc(unit, "ds").cast("date").alias("period")).agg(
        F.count(F.lit(1)).alias("days"), F.avg("tps").alias("tps"), F.avg("f").alias("f"), F.sum("n_items").alias("item_days"))


def span_weeks(level: DataFrame, first: str, length: int) -> DataFrame:
    """Mean adjusted level by week number inside a span of days."""
    day = F.datediff("ds", F.lit(first).cast("date"))
    return (level.where(day.between(0, length - 1)).groupBy((F.floor(day / 7) + 1).alias("week"))
            .agg(F.count(F.lit(1)).alias("days"), F.avg("f").alias("f"), F.sum("n_items").alias("item_days")))


def event_level(level: DataFrame, event: str, lo: int, hi: int) -> DataFrame:
    """Level by days since an event, with the mean factor over the six days after it."""
    k = F.datediff("ds", F.lit(event).cast("date"))
    out = level.withColumn("k", k).where(F.col("k").between(lo, hi))
    return out.selectExpr("*", "avg(case when k between 1 and 6 then f end) over () as f_week")


def implied_multiplier(level: DataFrame, event: str, base_first: str, base_last: str) -> DataFrame:
    """Level of the event's first seven days over the mean level of a base span."""
    base = level.where(F.col("ds").between(F.lit(base_first).cast("date"), F.lit(base_last).cast("date"))).agg(F.avg("f").alias("_b"))
    num = level.withColumn("k", F.datediff("ds", F.lit(event).cast("date"))).where("k between 0 and 6").groupBy("k").agg(F.avg("f").alias("f"))
    return num.crossJoin(one_row(base)).select("k", (F.col("k") + 4).alias("h"), "f", (F.col("f") / F.col("_b")).alias("multiplier"))


def market_index(level: DataFrame, days: DataFrame, event: str, profile: DataFrame) -> DataFrame:
    """One level per day: the week's mean, an event week's profile laid over it, gaps interpolated.

    ``profile(k, level)`` covers the days after the event; day 0 copies day 1.
    """
    weekly = rollup_level(level, "week").select(F.col("period").alias("_wk"), F.col("f").alias("_f"))
    first = profile.select((F.col("k") - 1).alias("k"), "level").where("k = 0")
    shaped = profile.unionByName(first).select(F.date_add(F.lit(event).cast("date"), F.col("k").cast("int")).alias("ds"), F.col("level").alias("_e"))
    out = (days.withColumn("_wk", F.date_trunc("week", "ds").cast("date"))
           .join(days_table(weekly), "_wk", "left").join(days_table(shaped), "ds", "left")
           .select("ds", F.coalesce("_e", "_f").alias("raw")))
    w = Window.orderBy("ds")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("raw").isNotNull(), F.col("ds"))
    out = out.select("ds", "raw", F.last("raw", True).over(before).alias("_lv"), F.first("raw", True).over(after).alias("_rv"),
                     F.datediff("ds", F.last(seen, True).over(before)).alias("_ld"), F.datediff(F.first(seen, True).over(after), "ds").alias("_rd"))
    return out.selectExpr(
        "ds", "raw", "case when raw is not null then raw when _lv is null then _rv when _rv is null then _lv "
                     "else _lv + (_rv - _lv) * _ld / (_ld + _rd) end as level")


def market_ratio(labelled: DataFrame, index: DataFrame) -> DataFrame:
    """Index of the target day over its mean on D1..D3, per row."""
    out = with_calendar(labelled, index, ["level"])
    return out.withColumn("mr", F.col("level") / ((F.col("level_1") + F.col("level_2") + F.col("level_3")) / 3.0))
