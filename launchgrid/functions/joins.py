"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 8


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: str, how: str = "left",
                salts: int = SALTS) -> DataFrame:
    """Equi-join to a table with one row per key, salting the left side by ``spread_by``.

    A hot key's rows go to ``salts`` tasks; the right side, one row per key, is repeated as often.
    """
    l = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return l.join(r, keys + ["_salt"], how).drop("_salt")


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``left`` with its one row of ``right``; the job fails where there is none, or more than one.

    The right side is reduced to a row per key first, so the join can neither lose nor add rows. The
    check sits in the joined columns: reading none of them skips it.
    """
    names = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_matches"), *[F.first(c).alias(c) for c in names])
    said = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} match for "), said))
    out = left.join(one, keys, "left")
    checked = {c: F.when(F.col("_matches") == 1, F.col(c)).when(F.col("_matches") > 1, fail("more than one")).otherwise(fail("no")) for c in names}
    return out.withColumns(checked).drop("_matches")


def days_table(df: DataFrame) -> DataFrame:
    """Mark a table with one row per calendar day for broadcast.

    Bounded by the length of the calendar (36,525 days in a century, a few MB at most), not by the
    number of facts.
    """
    return F.broadcast(df)


def one_row(df: DataFrame) -> DataFrame:
    """Mark a whole-table aggregate (exactly one row) for broadcast."""
    return F.broadcast(df)
