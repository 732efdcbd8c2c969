"""Statistics of sites and cities from the daily facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from launchgrid.functions.joins import days_table, one_row
from launchgrid.functions.ordered import medians


def site_days(facts: DataFrame) -> DataFrame:
    return facts.groupBy("site", "ds").agg(F.sum("qty").alias("qty"), F.sum("slots").alias("slots"),
                                           F.count(F.lit(1)).alias("items"))


def ordinary_site_days(facts: DataFrame, cal: DataFrame, bad: tuple[str, str] | None = None) -> DataFrame:
    out = site_days(facts).join(days_table(cal), "ds").where("hol = 0 and sch = 0")
    return out.where(~F.col("ds").between(*[F.lit(b).cast("date") for b in bad])) if bad else out


def site_stats(facts: DataFrame) -> DataFrame:
    """Daily level, spread, capacity and breadth of each site.

    A site has one value per day, so its median and percentile see at most a calendar of values.
    """
    days = site_days(facts).groupBy("site").agg(
        F.avg("qty").alias("mean_daily"), F.median("qty").alias("med_daily"), F.stddev_samp("qty").alias("std_daily"),
        F.percentile("qty", F.lit(0.9)).alias("p90_daily"), F.avg("slots").alias("mean_slots"),
        F.avg("items").alias("mean_items"), F.count(F.lit(1)).alias("active_days"))
    items = facts.groupBy("site", "item").agg(F.sum("qty").alias("q"), F.sum("slots").alias("s"),
                                              F.sum("rate").alias("r"), F.count(F.lit(1)).alias("n"))
    total = items.groupBy("site").agg(F.count(F.lit(1)).alias("n_items"), F.sum("q").alias("qty_total"),
                                      F.sum("s").alias("slots_total"), (F.sum("r") / F.sum("n")).alias("rate_mean"))
    return days.join(total, "site").selectExpr(
        "*", "qty_total / greatest(slots_total, 1) as qty_per_slot",
        "std_daily / greatest(mean_daily, 1e-6) as cv_daily")


SITE_MEASURES = ["mean_daily", "med_daily", "p90_daily", "mean_slots", "n_items", "rate_mean", "qty_per_slot"]


def site_defaults(stats: DataFrame, measures: list[str] = SITE_MEASURES) -> DataFrame:
    """One row with the median of every site statistic, for sites without history."""
    long = stats.select("site", *[F.col(c).cast("double").alias(c) for c in measures]).unpivot(
        ["site"], measures, "stat", "value")
    return medians(long, ["stat"], "value").groupBy().pivot("stat", measures).agg(F.first("median"))


def with_site_stats(df: DataFrame, stats: DataFrame, measures: list[str] = SITE_MEASURES) -> DataFrame:
    from launchgrid.functions.joins import spread_join

    base = site_defaults(stats, measures).select(*[F.col(c).alias(f"_{c}") for c in measures])
    out = spread_join(df, stats.select("site", *measures), ["site"], "item").crossJoin(one_row(base))
    keep = [c for c in out.columns if c not in measures and c.lstrip("_") not in measures]
    return out.select(*keep, *[F.coalesce(c, f"_{c}").alias(c) for c in measures])


def site_dow_profile(days: DataFrame) -> DataFrame:
    """Mean of a site on a weekday over the site's mean, on the days given."""
    by_dow = days.groupBy("site", "dow").agg(F.sum("qty").alias("_s"), F.count(F.lit(1)).alias("n"))
    by_site = by_dow.groupBy("site").agg(F.sum("_s").alias("_st"), F.sum("n").alias("_nt"))
    return by_dow.join(by_site, "site").select(
        "site", "dow", "n", ((F.col("_s") / F.col("n")) / (F.col("_st") / F.col("_nt"))).alias("raw_factor"))


def shrunk_dow_factor(profile: DataFrame, factors: DataFrame, k: float = 8.0) -> DataFrame:
    """Site weekday factor pulled to the national one by ``k`` pseudo-days."""
    return profile.join(F.broadcast(factors.select("dow", "g_dow")), "dow").withColumn(
        "site_factor", (F.col("raw_factor") * F.col("n") + F.col("g_dow") * k) / (F.col("n") + k))


def site_static(days: DataFrame) -> DataFrame:
    return days.groupBy("site").agg(F.avg("qty").alias("site_qty"), F.avg("slots").alias("site_slots"))


def city_stats(facts: DataFrame) -> DataFrame:
    sites = facts.groupBy("city", "site").agg(F.sum("qty").alias("q"), F.sum("rate").alias("r"), F.count(F.lit(1)).alias("n"))
    days = facts.groupBy("ds").agg(F.lit(1).alias("_1")).agg(F.count(F.lit(1)).alias("_days"))
    return (sites.groupBy("city").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("q").alias("city_qty"),
                                      (F.sum("r") / F.sum("n")).alias("city_rate"))
            .crossJoin(one_row(days))
            .withColumn("city_daily", F.col("city_qty") / F.greatest(F.col("_days"), F.lit(1))).drop("_days"))


def price_wide(prices: DataFrame) -> DataFrame:
    """One row per city with its three prices; a missing price takes the median over cities."""
    kinds = ["weekday", "friday", "weekend"]
    wide = prices.groupBy("city").pivot("day_type", kinds).agg(F.avg("price"))
    mid = wide.agg(*[F.median(k).alias(f"_{k}") for k in kinds])
    return wide.crossJoin(one_row(mid)).select("city", *[F.coalesce(k, f"_{k}").alias(f"price_{k}") for k in kinds])


def price_features(rows: DataFrame, prices: DataFrame, cal: DataFrame) -> DataFrame:
    """Price of the target day's type in the row's city, and relative to the city's mean price."""
    wide = price_wide(prices)
    default = wide.agg(F.median((F.col("price_weekday") + F.col("price_friday") + F.col("price_weekend")) / 3).alias("_mid"))
    out = rows.join(days_table(cal.select("ds", "dtype")), "ds", "left")
    # A city table is a dimension: one row per city, joined by its measured size.
    out = out.join(wide, "city", "left").crossJoin(one_row(default))
    return out.selectExpr(
        "*", "coalesce(case dtype when 2 then price_weekend when 1 then price_friday else price_weekday end, _mid) as price",
    ).selectExpr(
        "*", "price / greatest(coalesce((price_weekday + price_friday + price_weekend) / 3.0, _mid), 1) as price_rel"
    ).drop("_mid")
