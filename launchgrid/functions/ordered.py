"""Exact order statistics for groups of any size.

Spark's own ``percentile``, ``row_number`` and running sums bring a whole group into one task.
Here rows are first reduced to distinct values with counts, and a group with many distinct values
is cut into ordered ranges, so that a group holding a third of the table still spreads over the
cluster. The cut points only steer the load: any cut points give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_VALUES = 200_000  # distinct values above which a group is cut into ranges
RANGES = 64           # ranges per hot group, so at most 64 cut points travel with a key


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Grouping needs a key; a whole-table statistic gets a constant one."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def count_below(df: DataFrame, line: str, value: Column, name: str, most: int, at=lambda e: e, equal: bool = False) -> DataFrame:
    """How many elements of a sorted array (``most`` at most) lie below the value, or at it with ``equal``: by bisection.

    ``at`` takes the number from an element. Past the end, or without an array, the comparison is unknown and nothing is added.
    """
    df = df.withColumn(name, F.lit(0))
    step = 1 << (most.bit_length() - 1)
    while step:
        element = at(F.get(line, F.col(name) + (step - 1)))
        df = df.withColumn(name, F.col(name) + F.when(element <= value if equal else element < value, step).otherwise(0))
        step >>= 1
    return df


def running(
    df: DataFrame,
    keys: list[str],
    order: Column,
    sums: dict[str, Column],
    hot: int = HOT_VALUES,
    ranges: int = RANGES,
) -> DataFrame:
    """One row per (keys, order value) with inclusive running sums and group totals.

    Adds ``_v`` (the order value), ``<name>`` (sum at this value), ``<name>_cum`` (running sum) and
    ``<name>_tot`` (group total) for every entry of ``sums``.
    """
    df, keys = _keyed(df, keys)
    values = (
        df.withColumn("_v", order)
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    )
    spread = F.xxhash64("_v")
    # A uniform pick per hash class: at most `ranges` cut points per group, of any ordered type.
    classes = values.groupBy(*keys, F.pmod(spread, F.lit(ranges)).alias("_class")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_v", spread).alias("_cut"),
        *[F.sum(n).alias(n) for n in sums],
    )
    # The counts keep every sum alive in each use of `values`, so that its shuffle is reused.
    is_hot = F.sum("_n") > hot
    for n in sums:
        is_hot = is_hot & (F.count(n) >= 0)
    groups = classes.groupBy(*keys).agg(
        F.when(is_hot, F.array_sort(F.collect_list("_cut"))).alias("_cuts"),
        *[F.sum(n).alias(f"{n}_tot") for n in sums],
    )
    # The group table joins by its measured size; a whole-table statistic has exactly one row.
    right = F.broadcast(groups) if keys == ["_all"] else groups
    ranged = count_below(values.join(right, keys), "_cuts", F.col("_v"), "_range", ranges)
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(
        "*", *[F.sum(n).over(inside).alias(f"{n}_in") for n in sums]
    ).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.where(F.col("_cuts").isNotNull())
        .groupBy(*keys, "_range")
        .agg(*[F.sum(n).alias(n) for n in sums])
        .select(*keys, "_range", *[F.sum(n).over(before).alias(f"{n}_off") for n in sums])
    )
    out = local.join(offsets, keys + ["_range"], "left")
    for n in sums:
        out = out.withColumn(f"{n}_cum", F.col(f"{n}_in") + F.coalesce(F.col(f"{n}_off"), F.lit(0)))
    drop = ["_range", "_all"] + [f"{n}_in" for n in sums] + [f"{n}_off" for n in sums]
    return out.drop(*drop)


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str | Column,
    probs: dict[str, float],
    interpolate: bool = True,
    extra: dict[str, Column] | None = None,
    hot: int = HOT_VALUES,
) -> DataFrame:
    """Exact quantiles per group: linear interpolation, or the lower element ``v[int(q*(n-1))]``.

    ``extra`` are further sums per group (``count`` is always returned as ``n``).
    """
    col = F.col(value) if isinstance(value, str) else value
    sums = {"_c": F.lit(1)} | (extra or {})
    run = running(df, keys, col, sums, hot=hot)
    aggs = [F.max("_c_tot").alias("n")]
    aggs += [F.max(f"{k}_tot").alias(k) for k in (extra or {})]
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("_c_tot") - 1)
        lo = F.floor(pos)
        start, end = F.col("_c_cum") - F.col("_c"), F.col("_c_cum")
        at = lambda k: F.max(F.when((start <= k) & (k < end), F.col("_v")))
        lower, frac = at(lo), F.max(pos - lo)
        if interpolate:
            upper = at(lo + F.when(pos > lo, F.lit(1)).otherwise(F.lit(0)))
            aggs.append((lower + (upper - lower) * frac).alias(name))
        else:
            aggs.append(lower.alias(name))
    return run.groupBy(*keys).agg(*aggs)


def medians(df: DataFrame, keys: list[str], value: str | Column, name: str = "median", **kw) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, **kw)


def weighted_median(
    df: DataFrame, keys: list[str], value: str, weight: str, name: str = "wmedian", hot: int = HOT_VALUES
) -> DataFrame:
    """First value whose running weight reaches half the total; the plain median if no weight."""
    run = running(df, keys, F.col(value), {"_w": F.col(weight), "_c": F.lit(1)}, hot=hot)
    half = F.col("_w_tot") * F.lit(0.5)
    pos = F.lit(0.5) * (F.col("_c_tot") - 1)
    start, end = F.col("_c_cum") - F.col("_c"), F.col("_c_cum")
    at = lambda k: F.max(F.when((start <= k) & (k < end), F.col("_v")))
    plain = (at(F.floor(pos)) + at(F.ceil(pos))) / F.lit(2.0)
    return run.groupBy(*keys).agg(
        F.when(F.max("_w_tot") > 0, F.min(F.when(F.col("_w_cum") >= half, F.col("_v"))))
        .otherwise(plain)
        .alias(name)
    )


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn", total: str | None = None,
           hot: int = HOT_VALUES) -> DataFrame:
    """Row number from 0 in the given order, which must be unique within a group.

    The ordering columns come back as fields of the sort key, so ``df`` must hold nothing else that
    the caller needs beyond ``keys`` and the ordering columns.
    """
    run = running(df, keys, F.struct(*order), {"_c": F.lit(1)}, hot=hot)
    out = run.select(*keys, "_v.*", (F.col("_c_cum") - 1).alias(name),
                     *([F.col("_c_tot").alias(total)] if total else []))
    return out


def near_equal_block(rn: Column, n: Column, blocks: int) -> Column:
    """Block of row ``rn`` (from 0) when ``n`` rows are split into near-equal runs."""
    q, r = F.floor(n / blocks), n % F.lit(blocks)
    head = r * (q + 1)
    return F.when(rn < head, F.floor(rn / (q + 1))).otherwise(
        r + F.floor((rn - head) / F.greatest(q, F.lit(1)))
    ).cast("int")
