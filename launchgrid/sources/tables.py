"""Readers: the CSV layout, and the fact views over the driver's parquet tables.

Every fact view has one row per (item, site, ds) with columns
``item, site, city, ds, qty, slots, rate``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from launchgrid import schemas
from launchgrid.functions.scalar import text_class, text_id


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def normalise_facts(raw: DataFrame) -> DataFrame:
    """File columns to the neutral names, ids trimmed, one row per (item, site, ds)."""
    return to_daily(
        raw.select(
            text_id("movie_title").alias("item"),
            text_id("cinema_ids").alias("site"),
            text_id("city_name").alias("city"),
            F.col("date_show").alias("ds"),
            F.col("total_ticket").cast("bigint").alias("qty"),
            F.col("total_show").cast("bigint").alias("slots"),
            F.col("occupation_rate").cast("double").alias("rate"),
        )
    )


def to_daily(rows: DataFrame) -> DataFrame:
    """Partial sums before the shuffle: a repeated key costs one row per map task."""
    return rows.groupBy("item", "site", "ds").agg(
        F.min("city").alias("city"),
        F.sum("qty").alias("qty"),
        F.sum("slots").alias("slots"),
        F.avg("rate").alias("rate"),
    )


def load_facts(spark: SparkSession, path: str) -> DataFrame:
    return normalise_facts(read_csv(spark, path, schemas.FACTS))


def load_requests(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, schemas.REQUESTS)
    return raw.select("id", text_id("movie_title").alias("item"), text_id("cinema_ids").alias("site"),
                      text_id("city_name").alias("city"), F.col("date_show").alias("ds"))


def load_items(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, schemas.ITEMS)
    return raw.select(F.trim("original_title").alias("title"), *[F.trim(c).alias(c) for c in raw.columns[1:]])


def load_holidays(spark: SparkSession, path: str) -> DataFrame:
    """``ds, day_type, holiday_type, holiday_name`` and ``row``, which grows with the place in the file."""
    raw = read_csv(spark, path, schemas.HOLIDAYS)
    return raw.select(F.col("date").alias("ds"), text_class("day_tipe").alias("day_type"),
                      text_class("holiday_tipe").alias("holiday_type"),
                      text_class("holiday_name").alias("holiday_name"), F.monotonically_increasing_id().alias("row"))


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, schemas.PRICES)
    return raw.select(text_id("city_name").alias("city"), F.col("ceil").cast("double").alias("price"),
                      text_class("price_day").alias("day_type"))


# ------------------------------------------------------------------ driver tables
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_facts(spark: SparkSession, sf_dir: str, item) -> DataFrame:
    """One aggregation from events to daily facts; whole units per event, so sums are exact."""
    ev = table(spark, sf_dir, "events").select(
        item.alias("item"),
        F.col("event_type").alias("site"),
        F.to_date("ts").alias("ds"),
        F.round("value").cast("bigint").alias("v"),
    )
    daily = ev.groupBy("item", "site", "ds").agg(F.sum("v").alias("qty"), F.count(F.lit(1)).alias("slots"))
    return daily.select(
        "item", "site", F.concat(F.lit("c"), (F.length("site") % 3).cast("string")).alias("city"),
        "ds", "qty", "slots", (F.col("qty") / F.col("slots")).alias("rate"),
    )


def sparse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint") % 5
    return _event_facts(spark, sf_dir, F.concat_ws("_", F.col("user_id"), k))


def dense_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_facts(spark, sf_dir, F.expr("cast(user_id div 2 as string)"))


def catalog_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven years of daily sales: brand by supplier nation. Suppliers and parts join by size."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ds"), F.col("l_quantity").cast("bigint").alias("qty"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("site"))
    rows = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    daily = rows.groupBy("item", "site", "ds").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("slots"))
    return daily.select("item", "site", F.concat(F.lit("r"), F.col("site").cast("int") % 5).alias("city"),
                        "ds", "qty", "slots", (F.col("qty") / F.col("slots")).alias("rate"))


FACT_VIEWS = {"sparse": sparse_facts, "dense": dense_facts, "catalog": catalog_facts}
