"""When does an item launch? Three detectors over one daily site count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from launchgrid.functions.joins import one_row

# Share of the peak site count, days looked at from the first day, least site count.
RULES = {"wide": (0.5, 21, 0), "early": (0.25, 10, 0), "alltime": (0.5, None, 5)}


def release_dates(facts: DataFrame, rule: str = "wide") -> DataFrame:
    """``item, first_ds, d1, shift, left_censored`` per item.

    Facts hold one row per (item, site, ds), so the site count of a day is a plain count with
    partial sums before the shuffle. The windows below see one row per item and day.
    """
    share, days, least = RULES[rule]
    per_day = facts.groupBy("item", "ds").agg(F.count(F.lit(1)).alias("sites"))
    item = Window.partitionBy("item")
    seen = per_day.withColumn("first_ds", F.min("ds").over(item))
    if days is not None:
        seen = seen.where(F.col("ds") <= F.date_add("first_ds", days - 1))
    wide = seen.withColumn("peak", F.max("sites").over(item)).where(
        F.col("sites") >= F.greatest(F.lit(float(least)), F.col("peak") * share))
    opens = facts.agg(F.min("ds").alias("table_start"))
    return (
        wide.groupBy("item").agg(F.first("first_ds").alias("first_ds"), F.min("ds").alias("d1"))
        .crossJoin(one_row(opens))
        .select("item", "first_ds", "d1", F.datediff("d1", "first_ds").alias("shift"),
                (F.col("first_ds") == F.col("table_start")).alias("left_censored"))
    )


def request_starts(requests: DataFrame) -> DataFrame:
    """First day of a requested item: three days before its first requested day."""
    return requests.groupBy("item").agg(F.date_sub(F.min("ds"), 3).alias("d1"))


def first_days(facts: DataFrame) -> DataFrame:
    """First observed day of each item, with no censoring guard."""
    return facts.groupBy("item").agg(F.min("ds").alias("d1"), F.max("ds").alias("last_ds"))


def latest_release(*maps: DataFrame) -> DataFrame:
    """Union of release maps; the later argument wins for an item in several."""
    tagged = [m.select("item", "d1").withColumn("_prio", F.lit(i)) for i, m in enumerate(maps)]
    out = tagged[0]
    for m in tagged[1:]:
        out = out.unionByName(m)
    return out.groupBy("item").agg(F.max_by("d1", "_prio").alias("d1"))


def shift_profile(releases: DataFrame) -> DataFrame:
    return releases.where(~F.col("left_censored")).groupBy("shift").agg(F.count(F.lit(1)).alias("items"))
