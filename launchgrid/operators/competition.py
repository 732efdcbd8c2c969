"""Strength of other launches around a window, read from running totals rather than a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from launchgrid.functions.joins import one_row, spread_join
from launchgrid.functions.ordered import medians


def launch_strength(facts: DataFrame, releases: DataFrame) -> DataFrame:
    """``site, ds, strength``: mean daily D1..D3 quantity that launches add on their first day."""
    begin = releases.select("item", "d1")
    hit = spread_join(facts, begin, ["item"], "site", "inner").where(F.datediff("ds", "d1").between(0, 2))
    days = (hit.groupBy("item", "ds").agg(F.lit(1).alias("_1"))
            .groupBy("item").agg(F.count(F.lit(1)).alias("n_days")))
    pair = hit.groupBy("item", "site").agg(F.sum("qty").alias("_q"), F.first("d1").alias("d1"))
    return (spread_join(pair, days, ["item"], "site", "inner")
            .groupBy("site", F.col("d1").alias("ds")).agg(F.sum(F.col("_q") / F.col("n_days")).alias("strength")))


def strength_lines(strength: DataFrame, facts: DataFrame) -> DataFrame:
    """``site, lo, line``: running strength of a site, one array element per day from ``lo``.

    Steps between launch days are filled by repetition, so no site x day grid is shuffled. A site's
    window sees its launch days only, at most one calendar.
    """
    span = facts.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    by_site = Window.partitionBy("site").orderBy("ds")
    steps = strength.select(
        "site", "ds", F.sum("strength").over(by_site.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.lead("ds").over(by_site).alias("nxt"), (F.row_number().over(by_site) == 1).alias("_head"),
    ).crossJoin(one_row(span))
    run = F.array_repeat("cum", F.datediff(F.coalesce("nxt", F.date_add("hi", 1)), "ds"))
    lead_in = F.when(F.col("_head"), F.array_repeat(F.lit(0.0), F.datediff("ds", "lo"))).otherwise(F.array().cast("array<double>"))
    return (steps.select("site", "lo", "ds", F.concat(lead_in, run).alias("_part"))
            .groupBy("site", "lo").agg(F.array_sort(F.collect_list(F.struct("ds", "_part"))).alias("_parts"))
            .select("site", "lo", F.expr("flatten(transform(_parts, p -> p._part))").alias("line")))


def national_line(strength: DataFrame, facts: DataFrame) -> DataFrame:
    """The same over all sites: one row, an array as long as the calendar."""
    total = strength.groupBy("ds").agg(F.sum("strength").alias("strength")).withColumn("site", F.lit("*"))
    return strength_lines(total, facts).select(F.col("lo").alias("nat_lo"), F.col("line").alias("nat_line"))


def _at(line: str, lo: str, day: str) -> str:
    """Running value on a day: zero before the line or without one, flat after it."""
    return (f"case when {line} is null or {day} < {lo} then 0d "
            f"else get({line}, least(datediff({day}, {lo}), size({line}) - 1)) end")


def with_lines(rows: DataFrame, strength: DataFrame, facts: DataFrame) -> DataFrame:
    lines = strength_lines(strength, facts)
    return spread_join(rows, lines, ["site"], "item").crossJoin(one_row(national_line(strength, facts)))


def _relative(df: DataFrame, prefix: str, late: str, early: str) -> DataFrame:
    diff = lambda line, lo: f"greatest({_at(line, lo, late)} - {_at(line, lo, early)}, 0d)"
    return df.selectExpr(
        "*", f"log1p({diff('nat_line', 'nat_lo')}) as {prefix}_nat", f"log1p({diff('line', 'lo')}) as {prefix}_cl",
    ).selectExpr("*", f"{prefix}_nat - log1p(expm1(nat_log) / 3.0) as {prefix}_nat_rel",
                 f"{prefix}_cl - log1p(scale) as {prefix}_cl_rel").drop("line", "lo", "nat_line", "nat_lo")


def competition(rows: DataFrame, strength: DataFrame, facts: DataFrame) -> DataFrame:
    """Launches after D3 and up to the target day, nationally and at the site, absolute and relative.

    ``rows`` carries ``nat_log`` and ``scale``.
    """
    return _relative(with_lines(rows, strength, facts), "comp", "ds", "date_add(d1, 2)")


def incumbents(rows: DataFrame, strength: DataFrame, facts: DataFrame, releases: DataFrame) -> DataFrame:
    """Launches in the 14 days before D1; NULL when those days start before the first known launch."""
    first_ok = releases.agg(F.min("d1").alias("_ok"))
    out = _relative(with_lines(rows, strength, facts), "prev", "date_sub(d1, 1)", "date_sub(d1, 15)")
    out = out.crossJoin(one_row(first_ok))
    known = F.date_sub("d1", 14) >= F.col("_ok")
    names = ["prev_nat", "prev_nat_rel", "prev_cl", "prev_cl_rel"]
    return out.withColumns({n: F.when(known, F.col(n)) for n in names}).drop("_ok")


COMP = ["comp_nat", "comp_nat_rel", "comp_cl", "comp_cl_rel"]


def typical(rows: DataFrame, columns: list[str] = COMP) -> DataFrame:
    """Median of each column by horizon and D1 weekday over release windows."""
    long = rows.where("off = 0 and not bad").withColumn("d1_dow", F.weekday("d1")).select("h", "d1_dow", *columns).unpivot(
        ["h", "d1_dow"], columns, "name", "value")
    return (medians(long, ["h", "d1_dow", "name"], "value").groupBy("h", "d1_dow").pivot("name", columns)
            .agg(F.first("median")).select("h", "d1_dow", *[F.col(c).alias(f"typ_{c}") for c in columns]))


def impute_late(rows: DataFrame, typical_table: DataFrame, last_known: DataFrame) -> DataFrame:
    """After the last day with known launches, take the typical relative competition instead.

    The typical table has at most 7 x 7 rows.
    """
    out = (rows.withColumn("d1_dow", F.weekday("d1")).join(F.broadcast(typical_table), ["h", "d1_dow"], "left")
           .crossJoin(one_row(last_known)))
    for c, own in (("comp_nat", "log1p(expm1(nat_log) / 3.0)"), ("comp_cl", "log1p(scale)")):
        late = (F.col("ds") > F.col("last_known")) & (F.coalesce(F.col(f"typ_{c}"), F.lit(0.0)) > 0)
        rel: Column = F.col(f"typ_{c}_rel")
        out = out.withColumns({
            c: F.when(late, F.greatest(rel + F.expr(own), F.lit(0.0))).otherwise(F.col(c)),
            f"{c}_rel": F.when(late, rel).otherwise(F.col(f"{c}_rel"))})
    return out.drop(*[f"typ_{c}" for c in COMP], "last_known")


def weekly_volume(strength: DataFrame, first: str, last: str) -> DataFrame:
    """Launch strength per week in (first, last]."""
    span = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) / F.lit(7.0)
    inside = (F.col("ds") > F.lit(first).cast("date")) & (F.col("ds") <= F.lit(last).cast("date"))
    return strength.where(inside).agg(F.sum("strength").alias("volume"), (F.sum("strength") / span).alias("per_week"))
