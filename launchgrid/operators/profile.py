"""Audits of tables and of the window structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from launchgrid.functions.joins import one_row


def table_profile(facts: DataFrame, keys: list[str], measure: str, day: str = "ds") -> DataFrame:
    """Rows, date range, NULLs per column, non-positive measures and repeated keys, in one row."""
    nulls = [F.sum(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in facts.columns]
    whole = facts.agg(F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_ds"),
                      F.max(day).alias("last_ds"),
                      F.sum((F.col(measure) <= 0).cast("int")).alias("non_positive"), *nulls)
    repeats = (facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
               .agg(F.sum((F.col("_n") > 1).cast("int")).alias("repeated_keys"), F.max("_n").alias("max_per_key")))
    return whole.crossJoin(one_row(repeats))


def nonfinite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, NULLs, NaNs and infinities of each column, from one pass."""
    x = {c: F.col(c).cast("double") for c in columns}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        aggs += [F.count_if(x[c].isNull()).alias(f"_a{i}"), F.count_if(F.isnan(x[c])).alias(f"_b{i}"), F.count_if(F.abs(x[c]) == float("inf")).alias(f"_c{i}")]
    parts = [F.struct(F.lit(c).alias("feature"), F.col("_n").alias("n_rows"), F.col(f"_a{i}").alias("n_null"), F.col(f"_b{i}").alias("n_nan"), F.col(f"_c{i}").alias("n_inf"))
             for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


def clear_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaNs and infinities become NULL; nothing else changes."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in columns})


def item_spans(facts: DataFrame) -> DataFrame:
    """Items by number of distinct days and by span of days."""
    per_day = facts.groupBy("item", "ds").agg(F.lit(1).alias("_one"))
    per_item = per_day.groupBy("item").agg(
        F.count(F.lit(1)).alias("n_days"), (F.datediff(F.max("ds"), F.min("ds")) + 1).alias("span_days"))
    return per_item.groupBy("n_days", "span_days").agg(F.count(F.lit(1)).alias("items"))


def slot_audit(wide: DataFrame) -> DataFrame:
    """Launch days by weekday: items, distinct days, mean sites on D1..D3, share peaking on D1."""
    item = wide.groupBy("item", "off", "d1").agg(*[F.sum(f"n{k}").alias(f"c{k}") for k in (1, 2, 3)])
    return (item.withColumn("d1_dow", F.weekday("d1"))
            .withColumn("_peak1", ((F.col("c1") >= F.col("c2")) & (F.col("c1") >= F.col("c3"))).cast("double"))
            .groupBy("d1_dow")
            .agg(F.count(F.lit(1)).alias("items"), F.countDistinct("d1").alias("days"),
                 *[F.avg(f"c{k}").alias(f"sites{k}") for k in (1, 2, 3)], F.avg("_peak1").alias("peak_on_d1")))


def pair_coverage(observed: DataFrame, requested: DataFrame) -> DataFrame:
    """Set comparison of two pair tables: sizes, one-sided counts, overlap, equality."""
    a = observed.select("item", "site").distinct().withColumn("_a", F.lit(1))
    b = requested.select("item", "site").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, ["item", "site"], "full")
    only_a, only_b = F.col("_b").isNull().cast("int"), F.col("_a").isNull().cast("int")
    return both.agg(F.sum(F.col("_a")).alias("observed"), F.sum(F.col("_b")).alias("requested"),
                    F.sum(only_a).alias("only_observed"), F.sum(only_b).alias("only_requested"),
                    F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("shared")
                    ).withColumn("equal_sets", (F.col("only_observed") + F.col("only_requested") == 0).cast("int"))


def overlap_counts(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values per column on the left, and how many of them occur on the right."""
    out = None
    for c in columns:
        l, r = left.select(c).distinct(), right.select(c).distinct()
        part = (l.join(r.withColumn("_hit", F.lit(1)), c, "left")
                .agg(F.count(F.lit(1)).alias("n_left"), F.count("_hit").alias("n_shared"))
                .select(F.lit(c).alias("kind"), "n_left", "n_shared"))
        out = part if out is None else out.unionByName(part)
    return out


def cross_coverage(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Share of target rows whose day, and whose (site, day), some fact observes."""
    days = facts.select("ds").distinct().withColumn("_day", F.lit(1))
    cells = facts.select("site", "ds").distinct().withColumn("_cell", F.lit(1))
    return (rows.join(F.broadcast(days), "ds", "left").join(cells, ["site", "ds"], "left")
            .groupBy("h").agg(F.count(F.lit(1)).alias("n_rows"),
                              F.avg(F.col("_day").isNotNull().cast("double")).alias("day_share"),
                              F.avg(F.col("_cell").isNotNull().cast("double")).alias("cell_share")))


def horizon_audit(rows: DataFrame) -> DataFrame:
    """Rows per pair and window, horizons out of range, repeated (pair, h)."""
    pair = rows.groupBy("item", "site", "off").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("nh"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    return pair.groupBy("n", "nh", "lo", "hi").agg(F.count(F.lit(1)).alias("pairs"))
