"""Loading, release detection, windows, grids and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchgrid.catalog.base import CTES, DENSE_OFFSETS, Data, query, release_sql, sql_hash
from launchgrid.functions import ordered, scalar
from launchgrid.operators import profile, release, windows

_BAD = [("2024-01-12", "2024-01-13")]
CTES["bad_spans"] = "SELECT DATE '2024-01-12' AS b0, DATE '2024-01-13' AS b1"


def bad_spans(d: Data):
    return d.dates(_BAD, ["start", "end"], ["start", "end"])


@query("load_facts", "item site city $ds #qty #slots ~rate", "SELECT * FROM fs")
def load_facts(d: Data):
    return d.sparse


@query("table_profile", "#n_rows $first_ds $last_ds #non_positive #repeated_keys #max_per_key #null_item #null_qty",
       """SELECT a.*, b.* FROM
          (SELECT count(*) AS n_rows, min(ds) AS first_ds, max(ds) AS last_ds,
                  sum(CASE WHEN qty <= 0 THEN 1 ELSE 0 END) AS non_positive,
                  sum(CASE WHEN item IS NULL THEN 1 ELSE 0 END) AS null_item,
                  sum(CASE WHEN qty IS NULL THEN 1 ELSE 0 END) AS null_qty FROM fc) a,
          (SELECT sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS repeated_keys, max(n) AS max_per_key
           FROM (SELECT count(*) AS n FROM fc GROUP BY item, ds) k) b""")
def table_profile(d: Data):
    return profile.table_profile(d.catalog, ["item", "ds"], "qty")


_REL = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, * FROM ({release_sql(*args)}) r_{rule}"
    for rule, args in (("wide", (0.5, 21, 0)), ("early", (0.25, 10, 0)), ("alltime", (0.5, None, 5))))


@query("release_dates", "rule item $first_ds $d1 #shift #left_censored", _REL)
def release_dates(d: Data):
    out = None
    for rule in ("wide", "early", "alltime"):
        part = release.release_dates(d.sparse, rule).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out


@query("release_shift", "#shift #items",
       "SELECT shift, count(*) AS items FROM rel_s GROUP BY shift")
def release_shift(d: Data):
    return release.shift_profile(release.release_dates(d.sparse, "wide"))


@query("release_union", "item $d1",
       "SELECT coalesce(s.item, r.item) AS item, coalesce(s.d1, r.d1) AS d1 FROM rel_s r FULL JOIN st_d s ON r.item = s.item")
def release_union(d: Data):
    return release.latest_release(d.releases, d.starts)


@query("anchors", "item #off $d1 #bad",
       """SELECT item, off, d1 + off AS d1, (d1 + off <= b1 AND d1 + off + 9 >= b0) AS bad
          FROM rel_s CROSS JOIN offs_s CROSS JOIN bad_spans
          WHERE d1 + off + 9 <= (SELECT max(ds) FROM fs)""")
def anchors(d: Data):
    from launchgrid.catalog.base import SPARSE_OFFSETS

    return windows.anchors(d.releases, d.sparse, SPARSE_OFFSETS, bad_spans(d))


@query("anchors_running", "item #off $d1",
       """SELECT item, off, d1 + off AS d1 FROM st_d CROSS JOIN offs_d
          WHERE d1 + off + 9 <= (SELECT max(ds) FROM fd) AND d1 + off <= last_ds""")
def anchors_running(d: Data):
    return windows.anchors(d.starts, d.dense, DENSE_OFFSETS, last_ds="last_ds")


@query("window_events", "#h #events #qty #sites",
       """SELECT h, count(*) AS events, sum(qty) AS qty, count(DISTINCT site) AS sites FROM
          (SELECT f.*, date_diff('day', r.d1, f.ds) + 1 AS h FROM fs f JOIN rel_s r ON f.item = r.item) x
          WHERE h BETWEEN 1 AND 10 GROUP BY h""")
def window_events(d: Data):
    from launchgrid.functions.joins import spread_join

    hit = spread_join(d.sparse, d.releases.select("item", "d1"), ["item"], "site", "inner")
    return (hit.withColumn("h", F.datediff("ds", "d1") + 1).where("h between 1 and 10")
            .groupBy("h").agg(F.count(F.lit(1)).alias("events"), F.sum("qty").alias("qty"),
                              F.countDistinct("site").alias("sites")))


_PAIR = "item site city #off $d1 #t1 #t2 #t3 #shw1 #shw2 #shw3 ~occ1 ~occ2 ~occ3 ~scale"


@query("pair_window", _PAIR, "SELECT * FROM ps")
def pair_window(d: Data):
    return windows.observed_pairs(d.sparse_wide)


@query("pair_window_dense", _PAIR, "SELECT * FROM pd")
def pair_window_dense(d: Data):
    return d.pairs


@query("target_grid", "item site #off #h $ds #qty ~y", "SELECT item, site, off, h, ds, qty, y FROM gd")
def target_grid(d: Data):
    return d.rows


@query("future_only_pairs", "item site #off $d1", "SELECT * FROM ws WHERE n1 + n2 + n3 = 0")
def future_only_pairs(d: Data):
    return windows.future_only(d.sparse_wide)


@query("history_balance", "item site #off #t1 #t2 #t3",
       f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t1 + t2 + t3 <= 0
             ORDER BY {sql_hash('item', 'CAST(off AS VARCHAR)', 'site')}, item, off, site) AS rn,
             count(*) FILTER (WHERE t1 + t2 + t3 > 0) OVER () AS hist FROM ws) q
           WHERE t1 + t2 + t3 > 0 OR rn - 1 < round(0.2 / 0.8 * hist)""")
def history_balance(d: Data):
    return windows.balance_history(d.sparse_wide, 0.2)


@query("subsample_groups", "item site #off #t3",
       f"SELECT * FROM pd WHERE {sql_hash('item', 'CAST(off AS VARCHAR)')} < 3989")
def subsample_groups(d: Data):
    return windows.keep_groups(d.pairs, 0.4, "item", "off")


@query("proxy_population", "item site #h $d1 ~y",
       "SELECT * FROM gs CROSS JOIN bad_spans WHERE off = 0 AND NOT (d1 <= b1 AND d1 + 9 >= b0) AND isodow(d1) - 1 IN (1, 2, 3, 4)")
def proxy_population(d: Data):
    rows = windows.target_rows(windows.observed_pairs(d.sparse_wide))
    return windows.proxy_rows(windows.flag_spans(rows, bad_spans(d)), (1, 2, 3, 4))


@query("training_mask", "#off #pairs #clean",
       """SELECT off, count(*) AS pairs, sum(CASE WHEN d1 <= b1 AND d1 + 9 >= b0 THEN 0 ELSE 1 END) AS clean
          FROM pd CROSS JOIN bad_spans WHERE off IN (0, 1, 2, 3) GROUP BY off""")
def training_mask(d: Data):
    flagged = windows.flag_spans(d.pairs, bad_spans(d))
    return windows.training_rows(flagged, (0, -1, 1, 2, 3), clean=False).groupBy("off").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum((~F.col("bad")).cast("int")).alias("clean"))


@query("label_clip", "~edge #n #affected ~mean_y ~mean_clipped",
       """SELECT max(edge) AS edge, count(*) AS n, sum(CASE WHEN y > edge THEN 1 ELSE 0 END) AS affected,
          avg(y) AS mean_y, avg(least(y, edge)) AS mean_clipped
          FROM gd CROSS JOIN (SELECT quantile_cont(y, 0.999) AS edge FROM gd) e""")
def label_clip(d: Data):
    from launchgrid.functions.joins import one_row

    edge = ordered.quantiles(d.rows, [], "y", {"edge": 0.999}).select("edge")
    return d.rows.crossJoin(one_row(edge)).agg(
        F.max("edge").alias("edge"), F.count(F.lit(1)).alias("n"),
        F.sum((F.col("y") > F.col("edge")).cast("int")).alias("affected"),
        F.avg("y").alias("mean_y"), F.avg(F.least("y", "edge")).alias("mean_clipped"))


@query("category_codes", "value #code",
       "SELECT item AS value, row_number() OVER (ORDER BY item) - 1 AS code FROM (SELECT item FROM fd UNION SELECT item FROM fs) u")
def category_codes(d: Data):
    return windows.category_codes([d.dense, d.sparse], "item")


@query("activity_pattern", "pattern #pairs #n_active #starts_late #only_d3 #has_gap",
       """SELECT pattern, count(*) AS pairs, max(a1 + a2 + a3) AS n_active, max(1 - a1) AS starts_late,
          max((1 - a1) * (1 - a2) * a3) AS only_d3, max(a1 * (1 - a2) * a3) AS has_gap FROM
          (SELECT *, concat(CAST(a1 AS VARCHAR), CAST(a2 AS VARCHAR), CAST(a3 AS VARCHAR)) AS pattern FROM
           (SELECT CAST(t1 > 0 AS INTEGER) AS a1, CAST(t2 > 0 AS INTEGER) AS a2, CAST(t3 > 0 AS INTEGER) AS a3 FROM ws) p) q
          GROUP BY pattern""")
def activity_pattern(d: Data):
    from launchgrid.operators.pair import add_pattern

    return add_pattern(d.sparse_wide).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("pairs"), *[F.max(c).alias(c) for c in ("n_active", "starts_late", "only_d3", "has_gap")])


@query("pair_coverage", "#observed #requested #only_observed #only_requested #shared #equal_sets",
       """SELECT sum(a) AS observed, sum(b) AS requested, sum(CASE WHEN b IS NULL THEN 1 ELSE 0 END) AS only_observed,
          sum(CASE WHEN a IS NULL THEN 1 ELSE 0 END) AS only_requested,
          sum(CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END) AS shared,
          CASE WHEN sum(CASE WHEN b IS NULL OR a IS NULL THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS equal_sets
          FROM (SELECT DISTINCT item, site, 1 AS a FROM ps WHERE off = 0) x
          FULL JOIN (SELECT DISTINCT item, site, 1 AS b FROM ws WHERE off = 0) z ON x.item = z.item AND x.site = z.site""")
def pair_coverage(d: Data):
    at0 = d.sparse_wide.where("off = 0")
    return profile.pair_coverage(windows.observed_pairs(at0), at0)


@query("overlap_counts", "kind #n_left #n_shared",
       " UNION ALL ".join(f"""SELECT '{c}' AS kind, count(*) AS n_left, count(b.{c}) AS n_shared FROM
         (SELECT DISTINCT {c} FROM fs) a LEFT JOIN (SELECT DISTINCT {c} FROM fd) b ON a.{c} = b.{c}""" for c in ("item", "site", "city")))
def overlap_counts(d: Data):
    return profile.overlap_counts(d.sparse, d.dense, ["item", "site", "city"])


@query("cross_coverage", "#h #n_rows ~day_share ~cell_share",
       """SELECT h, count(*) AS n_rows, avg(CASE WHEN a.ds IS NOT NULL THEN 1.0 ELSE 0.0 END) AS day_share,
          avg(CASE WHEN b.ds IS NOT NULL THEN 1.0 ELSE 0.0 END) AS cell_share
          FROM gd g LEFT JOIN (SELECT DISTINCT ds FROM fs) a ON g.ds = a.ds
          LEFT JOIN (SELECT DISTINCT site, ds FROM fs) b ON g.site = b.site AND g.ds = b.ds GROUP BY h""")
def cross_coverage(d: Data):
    return profile.cross_coverage(d.rows, d.sparse)


@query("structure_audit", "#n #nh #lo #hi #pairs",
       """SELECT n, nh, lo, hi, count(*) AS pairs FROM
          (SELECT count(*) AS n, count(DISTINCT h) AS nh, min(h) AS lo, max(h) AS hi FROM gs GROUP BY item, site, off) x
          GROUP BY n, nh, lo, hi""")
def structure_audit(d: Data):
    return profile.horizon_audit(windows.target_rows(windows.observed_pairs(d.sparse_wide)))


@query("item_spans", "#n_days #span_days #items",
       """SELECT n_days, span_days, count(*) AS items FROM (SELECT count(DISTINCT ds) AS n_days,
          date_diff('day', min(ds), max(ds)) + 1 AS span_days FROM fs GROUP BY item) x GROUP BY n_days, span_days""")
def item_spans(d: Data):
    return profile.item_spans(d.sparse)


@query("slot_audit", "#d1_dow #items #days ~sites1 ~sites2 ~sites3 ~peak_on_d1",
       """SELECT isodow(d1) - 1 AS d1_dow, count(*) AS items, count(DISTINCT d1) AS days, avg(c1) AS sites1,
          avg(c2) AS sites2, avg(c3) AS sites3, avg(CASE WHEN c1 >= c2 AND c1 >= c3 THEN 1.0 ELSE 0.0 END) AS peak_on_d1
          FROM (SELECT item, off, d1, sum(n1) AS c1, sum(n2) AS c2, sum(n3) AS c3 FROM ws GROUP BY item, off, d1) x
          GROUP BY isodow(d1) - 1""")
def slot_audit(d: Data):
    return profile.slot_audit(d.sparse_wide)
