"""Event-aligned windows: three observed days, seven target days, cut at many offsets at once.

A fact is matched to its item's start once; the offsets it falls into are generated on the row, and
a single aggregation by (item, site, offset) yields the observed days *and* the dense target days.
Absent days are zero because a missing fact adds nothing to its sum, so there is no grid to build
and no second join back to the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from launchgrid.functions.joins import one_row, spread_join
from launchgrid.functions.scalar import overlaps, window_scale

OBSERVED = (1, 2, 3)
TARGETS = (4, 5, 6, 7, 8, 9, 10)
# Window offsets in days from the release.
OPEN_OFFSETS = (0, -1, 1, 2, 3)
MID_OFFSETS = (5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 18, 20)
EXTRA_OFFSETS = (4, 15, 17, 19, 22, 24, 26, 28, 30)


def _offset_array(offsets) -> Column:
    return F.array(*[F.lit(int(o)) for o in sorted(offsets)])


def anchors(starts: DataFrame, facts: DataFrame, offsets, bad_spans: DataFrame | None = None,
            last_ds: str | None = None) -> DataFrame:
    """``item, off, d1, bad`` for each start and offset whose ten days lie inside the facts.

    ``last_ds`` names a column of ``starts``: windows must then begin while the item still runs.
    ``bad_spans(start, end)`` is a short table of broken date ranges.
    """
    end = facts.agg(F.max("ds").alias("_end"))
    out = (
        starts.withColumn("off", F.explode(_offset_array(offsets)))
        .withColumn("d1", F.date_add("d1", F.col("off")))
        .crossJoin(one_row(end))
        .where(F.date_add("d1", 9) <= F.col("_end"))
    )
    if last_ds:
        out = out.where(F.col("d1") <= F.col(last_ds))
    out = out.select("item", "off", "d1")
    if bad_spans is None:
        return out.withColumn("bad", F.lit(False))
    return flag_spans(out, bad_spans)


def flag_spans(df: DataFrame, spans: DataFrame, name: str = "bad") -> DataFrame:
    """Does D1..D10 overlap any span? The span table (a handful of rows) travels as one array."""
    folded = spans.agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    hit = F.exists("_spans", lambda s: overlaps(F.col("d1"), F.date_add("d1", 9), s["start"], s["end"]))
    return df.crossJoin(one_row(folded)).withColumn(name, hit).drop("_spans")


def pair_history(facts: DataFrame) -> DataFrame:
    """One row per (item, site) with its days as an array: bounded by the length of the calendar."""
    return facts.groupBy("item", "site").agg(
        F.min_by("city", "ds").alias("city"),
        F.collect_list(F.struct("ds", "qty", "slots", "rate")).alias("days"),
    )


def window_wide(facts: DataFrame, starts: DataFrame, offsets, guard: bool = True) -> DataFrame:
    """One row per (item, site, off) with any fact in D1..D10.

    Columns: ``d1, city``, presence ``n1..n3``, ``t1..t3``, ``shw1..3``, ``occ1..3`` and
    an array ``targets`` of the seven target days. ``starts`` holds ``item, d1``. ``guard`` drops windows that end after
    the last fact day.

    Each fact is shuffled once, to its pair, and laid out there on a line of days around the start;
    every window is then read from that line by position, so more offsets cost no more shuffle.
    """
    begin = starts.select("item", F.col("d1").alias("start"))
    # Window starts, in days from the item's, that a day lies in: of those that are asked for, only these are built.
    held = F.array_intersect(_offset_array(offsets), F.flatten(F.transform(
        "days", lambda e: F.sequence(F.datediff(e["ds"], F.col("start")) - 9, F.datediff(e["ds"], F.col("start"))))))
    if guard:
        begin = begin.crossJoin(one_row(facts.agg(F.max("ds").alias("_end"))))
        held = F.filter(held, lambda o: F.date_add("start", o + 9) <= F.col("_end"))
    first, last = int(min(offsets)), int(max(offsets)) + 9
    lines = (
        spread_join(pair_history(facts), begin, ["item"], "site", "inner")
        .withColumn("days", F.filter("days", lambda e: F.datediff(e["ds"], F.col("start")).between(first, last)))
        .withColumn("_held", held)
        .where(F.size("_held") > 0)
        .withColumn("_m", F.map_from_entries(F.transform(
            "days", lambda e: F.struct(F.datediff(e["ds"], F.col("start")).alias("rel"), e.alias("v")))))
        .withColumn("_line", F.transform(F.sequence(F.lit(first), F.lit(last)),
                                         lambda r: F.try_element_at(F.col("_m"), r)))
    )
    cut = lines.select("item", "site", "city", "start", F.inline(F.transform("_held", lambda o: F.struct(
        o.alias("off"), F.slice("_line", o + (1 - first), 3).alias("seen"), F.slice("_line", o + (4 - first), 7).alias("targets"))))).withColumn(
            "d1", F.date_add("start", F.col("off")))
    # SQL text, because the same dozen calls per column made one by one cost more than the plan.
    whole = lambda k, c, name: f"coalesce(seen[{k - 1}].{c}, cast(0 as bigint)) as {name}{k}"
    return cut.selectExpr(
        "item", "site", "off", "d1", "city",
        *[f"int(seen[{k - 1}] is not null) as n{k}" for k in OBSERVED],
        *[whole(k, "qty", "t") for k in OBSERVED],
        *[whole(k, "slots", "shw") for k in OBSERVED],
        *[f"coalesce(seen[{k - 1}].rate, 0d) as occ{k}" for k in OBSERVED],
        "targets",
    )


def observed_pairs(wide: DataFrame, require_d3: bool = True) -> DataFrame:
    """Pairs that sold on D3 (or on any observed day), with their scale."""
    sold = (F.col("t3") > 0) if require_d3 else (F.col("t1") + F.col("t2") + F.col("t3") > 0)
    return wide.where(sold).withColumn("scale", window_scale())


def target_rows(pairs: DataFrame, with_slots: bool = False) -> DataFrame:
    """Seven rows per pair: ``h, ds, qty, y``. Generated on the row, no shuffle."""
    keep = [c for c in pairs.columns if c != "targets"]
    day = pairs.selectExpr(*keep, "posexplode(targets) as (_pos, _day)")
    slots = ["coalesce(_day.slots, cast(0 as bigint)) as slots"] if with_slots else []
    return day.selectExpr(
        *keep, "_pos + 4 as h", "coalesce(_day.qty, cast(0 as bigint)) as qty", *slots,
        "date_add(d1, _pos + 3) as ds", "coalesce(_day.qty, cast(0 as bigint)) / scale as y")


def future_only(wide: DataFrame) -> DataFrame:
    """Pairs with facts in the target days and none in the observed days."""
    return wide.where(F.col("n1") + F.col("n2") + F.col("n3") == 0)


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short literal table (calendar, intervals, grids)."""
    return spark.createDataFrame(rows, schema)


def hash_index(*cols: str) -> Column:
    """Arithmetic position in 0..9972 from the text of the columns, the same in any SQL engine."""
    text = F.concat_ws("|", *cols)
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(digits * 48271 + 11, F.lit(9973))


def balance_history(pairs: DataFrame, share: float) -> DataFrame:
    """Keep every pair with history and just so many without that they make up ``share``.

    The kept ones are the first in hash order; the order is exact and spread over the cluster.
    """
    from launchgrid.functions.ordered import ranked

    tagged = pairs.withColumn("_none", F.col("t1") + F.col("t2") + F.col("t3") <= 0)
    n_hist = tagged.agg(F.sum((~F.col("_none")).cast("int")).alias("_hist"))
    order = ranked(tagged.where("_none").select(hash_index("item", "off", "site").alias("_hx"),
                                                 "item", "off", "site"),
                   [], [F.col("_hx"), F.col("item"), F.col("off"), F.col("site")], name="_rn")
    keep = (order.crossJoin(one_row(n_hist))
            .where(F.col("_rn") < F.round(F.lit(share / max(1 - share, 1e-9)) * F.col("_hist")))
            .select("item", "off", "site", F.lit(True).alias("_keep")))
    return (tagged.join(keep, ["item", "off", "site"], "left")
            .where(~F.col("_none") | F.coalesce(F.col("_keep"), F.lit(False)))
            .drop("_none", "_keep"))


def keep_groups(df: DataFrame, share: float, *key: str) -> DataFrame:
    """Keep whole groups: a hash of the group key below a share of its range."""
    return df.where(hash_index(*key) < int(share * 9973))


def proxy_rows(rows: DataFrame, weekdays) -> DataFrame:
    """Clean release windows that open on the given weekdays (Monday is 0)."""
    return rows.where((F.col("off") == 0) & ~F.col("bad") & F.weekday("d1").isin(*weekdays))


def training_rows(rows: DataFrame, offsets, clean: bool = True) -> DataFrame:
    keep = F.col("off").isin(*offsets)
    return rows.where(keep & ~F.col("bad") if clean else keep)


def category_codes(frames: list[DataFrame], column: str) -> DataFrame:
    """Shared dense codes of a text column over several frames, from 0 in text order."""
    from launchgrid.functions.ordered import ranked

    distinct = None
    for f in frames:
        part = f.select(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value"))
        distinct = part if distinct is None else distinct.unionByName(part)
    return ranked(distinct.distinct(), [], [F.col("value")], name="code")
