"""Features of a pair's observed days, of its item's opening, and of its place in the item."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from launchgrid.functions.joins import spread_join
from launchgrid.functions.ordered import HOT_VALUES, ranked, running
from launchgrid.functions.scalar import PREMIUM_FORMATS, RERELEASES, title_family, title_key, title_untagged, first_listed, listed_count, flag


def add_pattern(wide: DataFrame) -> DataFrame:
    """Which of D1..D3 sold, and the flags read off that pattern."""
    return wide.selectExpr(
        "*", "int(t1 > 0) as a1", "int(t2 > 0) as a2", "int(t3 > 0) as a3",
    ).selectExpr(
        "*", "concat(a1, a2, a3) as pattern", "a1 + a2 + a3 as n_active", "1 - a1 as starts_late",
        "(1 - a1) * (1 - a2) * a3 as only_d3", "a1 * (1 - a2) * a3 as has_gap",
    ).drop("a1", "a2", "a3")


# Name and expression, valid in both dialects (log1p is spelt out for the other engine). Constants are
# written with an exponent: a plain 3.0 is a decimal and would cut the quotient to six places.
PAIR_FEATURES = {
    "sum3": "t1 + t2 + t3",
    "log_scale": "log1p(scale)",
    "r1": "t1 / scale", "r2": "t2 / scale", "r3": "t3 / scale",
    "tps1": "t1 / nullif(shw1, 0)", "tps2": "t2 / nullif(shw2, 0)", "tps3": "t3 / nullif(shw3, 0)",
    "r3_r2": "t3 / nullif(t2, 0)", "shw3_shw1": "shw3 / nullif(shw1, 0)",
    "d21": "(t2 - t1) / scale", "d32": "(t3 - t2) / scale", "slope31": "(t3 - t1) / scale",
    "lr21": "log1p(t2) - log1p(t1)", "lr32": "log1p(t3) - log1p(t2)", "lr31": "log1p(t3) - log1p(t1)",
    "max3": "greatest(t1, t2, t3)", "min3": "least(t1, t2, t3)",
    "rng3": "(greatest(t1, t2, t3) - least(t1, t2, t3)) / scale",
    "argmax3": "case when t1 >= t2 and t1 >= t3 then 0 when t2 >= t3 then 1 else 2 end",
    "r3_over_max": "t3 / greatest(t1, t2, t3, 1)",
    "shows3": "shw1 + shw2 + shw3", "qty_per_slot": "(t1 + t2 + t3) / greatest(shw1 + shw2 + shw3, 1)",
    "shows_trend": "shw3 - shw1", "rate_last": "occ3", "rate_trend": "occ3 - occ1",
    "rate_mean": "(occ1 + occ2 + occ3) / greatest(cast(occ1 > 0 as int) + cast(occ2 > 0 as int) + cast(occ3 > 0 as int), 1)",
    "n_sold": "cast(t1 > 0 as int) + cast(t2 > 0 as int) + cast(t3 > 0 as int)",
    "run_rate": "(t1 + t2 + t3) / greatest(cast(t1 > 0 as int) + cast(t2 > 0 as int) + cast(t3 > 0 as int), 1)",
    "scale_deflation": "3e0 / greatest(cast(t1 > 0 as int) + cast(t2 > 0 as int) + cast(t3 > 0 as int), 1)",
    "last_over_scale": "case when t3 > 0 then t3 when t2 > 0 then t2 else t1 end / scale",
}


def pair_features(pairs: DataFrame) -> DataFrame:
    return pairs.selectExpr("*", *[f"{e} as {n}" for n, e in PAIR_FEATURES.items()])


def item_days(wide: DataFrame) -> DataFrame:
    """Totals of an item's window over all its sites, before any pair is dropped."""
    sums = [F.sum(f"{c}{k}").alias(f"{a}{k}") for a, c in (("nt", "t"), ("nc", "n"), ("ns", "shw")) for k in (1, 2, 3)]
    return wide.groupBy("item", "off").agg(*sums)


OPENING = {
    "nat_r31": "nt3 / nullif(nt1, 0)", "nat_r32": "nt3 / nullif(nt2, 0)", "nat_log": "log1p(nt1 + nt2 + nt3)",
    "nat_tps3": "nt3 / nullif(ns3, 0)", "share3": "t3 / (nt3 + 1e0)",
    "nat_scale": "greatest((nt1 + nt2 + nt3) / 3e0, 1e0)",
    "nat_slope31": "(nt3 - nt1) / greatest((nt1 + nt2 + nt3) / 3e0, 1e0)",
    "nat_lr32": "log1p(nt3) - log1p(nt2)", "nat_lr31": "log1p(nt3) - log1p(nt1)",
    "pair_share": "(t1 + t2 + t3) / greatest(nt1 + nt2 + nt3, 1)",
    "nat_nc31": "nc3 / nullif(nc1, 0)", "nat_ns31": "ns3 / nullif(ns1, 0)", "nat_ns32": "ns3 / nullif(ns2, 0)",
}


def item_opening(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """Item-level opening strength and shape on each pair; a large item is spread by site."""
    out = spread_join(pairs, item_days(wide), ["item", "off"], "site", "inner")
    return out.selectExpr("*", *[f"{e} as {n}" for n, e in OPENING.items()])


def opening_shape(pairs: DataFrame, wide: DataFrame, static: DataFrame) -> DataFrame:
    """Widening of the opening, the pair against the item, and its share of the site's capacity."""
    out = spread_join(item_opening(pairs, wide), static, ["site"], "item")
    return out.selectExpr("*", "(t3 / nullif(shw3, 0)) / nullif(nat_tps3, 0) as tps_rel3",
                          "shw3 / nullif(site_slots, 0) as cap_share3", "log1p(site_qty) as cl_size")


def pair_rank(pairs: DataFrame, hot: int = HOT_VALUES) -> DataFrame:
    """Percent rank of a pair within its item window: descending with averaged ties, and by order."""
    sized = pairs.withColumn("sum3", F.col("t1") + F.col("t2") + F.col("t3"))
    down = running(sized, ["item", "off"], -F.col("sum3"), {"_c": F.lit(1)}, hot=hot).select(
        "item", "off", (-F.col("_v")).alias("sum3"),
        ((F.col("_c_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0) / F.col("_c_tot")).alias("rank_pct"))
    order = ranked(sized, ["item", "off"], [F.col("sum3"), F.col("site")], name="_rn", total="_n", hot=hot).select(
        "item", "off", "site", ((F.col("_rn") + 1) / F.col("_n")).alias("rank_order"))
    return sized.join(down, ["item", "off", "sum3"]).join(order, ["item", "off", "site"])


def sibling_features(rows: DataFrame, family) -> DataFrame:
    """Other formats of the same title at the same site: family totals less the row's own.

    A family at one site and horizon holds the formats of one title, a handful of rows.
    """
    out = rows.withColumn("family", family)
    total = out.groupBy("family", "site", "off", "h").agg(
        F.count(F.lit(1)).alias("fam_n"), F.sum("t3").alias("fam_t3"), F.sum("t1").alias("fam_t1"), F.sum("scale").alias("fam_sc"))
    return out.join(total, ["family", "site", "off", "h"]).selectExpr(
        "*", "fam_n - 1 as sib_n", "fam_t3 - t3 as sib_t3", "fam_t1 - t1 as sib_t1", "fam_sc - scale as sib_sc",
        "case when fam_t3 > 0 then t3 / fam_t3 else 1e0 end as sib_share",
        "case when scale > 0 then (fam_sc - scale) / scale else 0e0 end as sib_rel")


# ------------------------------------------------------------------ item metadata
def catalogue(items: DataFrame) -> DataFrame:
    """Item dimension with its join keys, lead entries of comma lists and counts."""
    out = items.select(
        "title", F.upper(F.trim("title")).alias("exact"), title_key(F.col("title")).alias("key"),
        F.lower(first_listed(F.col("genre"), "[,/|]")).alias("genre1"),
        listed_count(F.col("genre"), "[,/|]").alias("n_genres"), listed_count(F.col("casts"), "[,;|]").alias("n_casts"),
        F.regexp_replace(F.upper("age_rating"), r"\s+", "").alias("age"),
        F.lower(first_listed(F.col("producer"), "[,;|]")).alias("producer1"))
    freq = out.where("key <> ''").groupBy("key").agg(F.min(F.struct("title", "genre1", "age", "producer1")).alias("_f")).groupBy(F.col("_f.producer1").alias("producer1")).agg(
        F.count(F.lit(1)).alias("producer_freq"))
    return out.join(freq, "producer1", "left")


_META = ["genre1", "age", "producer1", "n_genres", "n_casts", "producer_freq"]


def item_meta(titles: DataFrame, items: DataFrame) -> DataFrame:
    """Metadata of each title: by normalised key, else by the title without tags; first row wins."""
    cat = catalogue(items)
    one = lambda key, p: cat.where(F.col(key) != "").groupBy(key).agg(
        F.min(F.struct("title", *_META)).alias(f"_{p}")).withColumnRenamed(key, f"_{p}k")
    t = titles.select("title").distinct().withColumn("_ak", title_key(F.col("title"))).withColumn("_bk", title_untagged(F.col("title")))
    got = t.join(one("key", "a"), "_ak", "left").join(one("exact", "b"), "_bk", "left")
    m = F.coalesce("_a", "_b")
    low = F.lower("title")
    text = lambda c: F.coalesce(m[c], F.lit("unknown")).alias(c)
    num = lambda c: F.coalesce(m[c], F.lit(0)).alias(c)
    return got.select(
        "title", F.col("_ak").alias("key"), flag(m.isNotNull()).alias("meta_matched"), *[text(c) for c in _META[:3]], *[num(c) for c in _META[3:]],
        flag(low.contains("imax")).alias("fmt_imax"), flag(low.rlike(r"\b3d\b")).alias("fmt_3d"), flag(low.contains("dub")).alias("fmt_dub"),
        flag(low.rlike(PREMIUM_FORMATS)).alias("fmt_premium"),
        flag(low.rlike(RERELEASES)).alias("fmt_rerelease"), flag(low.contains("(")).alias("has_paren"),
        title_family(F.upper("title")).alias("family"),
        F.length("title").alias("title_len"), F.size(F.filter(F.split("_ak", " "), lambda x: x != "")).alias("n_words"))
