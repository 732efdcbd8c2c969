"""Pair, item, competition and metadata features, and the assembled feature table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from launchgrid.catalog.base import CTES, SPARSE_OFFSETS, Data, query
from launchgrid.catalog.calendar_queries import Calendar, labelled_rows, uplift_rows  # noqa: F401
from launchgrid.catalog.window_queries import bad_spans
from launchgrid.functions.joins import one_row
from launchgrid.functions.scalar import FORMAT_WORDS
from launchgrid.operators import competition as comp, models, pair, profile, release, site, windows
from launchgrid.session import durable_table


def to_sql(expr: str) -> str:
    return re.sub(r"log1p\(", "ln(1.0 + ", expr)


def _list(features: dict[str, str]) -> str:
    return ", ".join(f"{to_sql(e)} AS {n}" for n, e in features.items())


_KEY = "item site #off"


@query("pair_features", _KEY + " " + " ".join(f"~{n}" for n in pair.PAIR_FEATURES),
       f"SELECT item, site, off, {_list(pair.PAIR_FEATURES)} FROM pd")
def pair_features(d: Data):
    return pair.pair_features(d.pairs)


CTES["nat_d"] = "SELECT item, off, " + ", ".join(
    f"sum({c}{k}) AS {a}{k}" for a, c in (("nt", "t"), ("nc", "n"), ("ns", "shw")) for k in (1, 2, 3)) + " FROM wd GROUP BY item, off"
CTES["nat_s"] = CTES["nat_d"].replace("FROM wd", "FROM ws")
CTES["op_d"] = f"SELECT p.*, n.* EXCLUDE (item, off), {_list(pair.OPENING)} FROM pd p JOIN nat_d n ON p.item = n.item AND p.off = n.off"


@query("item_opening", _KEY + " #nc3 " + " ".join(f"~{n}" for n in pair.OPENING), "SELECT * FROM op_d")
def item_opening(d: Data):
    return pair.item_opening(d.pairs, d.dense_wide)


@query("opening_shape", _KEY + " ~nat_nc31 ~nat_ns31 ~nat_ns32 ~tps_rel3 ~cap_share3 ~cl_size",
       """SELECT o.*, (t3 / nullif(shw3, 0)) / nullif(nat_tps3, 0) AS tps_rel3, shw3 / nullif(site_slots, 0) AS cap_share3,
          ln(1.0 + site_qty) AS cl_size FROM op_d o LEFT JOIN
          (SELECT site, avg(qty) AS site_qty, avg(slots) AS site_slots FROM sod_d GROUP BY site) s ON o.site = s.site""")
def opening_shape(d: Data):
    static = site.site_static(site.ordinary_site_days(d.dense, Calendar(d.dense).cal))
    return pair.opening_shape(d.pairs, d.dense_wide, static)


@query("pair_rank", _KEY + " #sum3 ~rank_pct ~rank_order",
       """SELECT *, (rk + (ties - 1) / 2.0) / n AS rank_pct, rn * 1.0 / n AS rank_order FROM
          (SELECT item, site, off, t1 + t2 + t3 AS sum3, rank() OVER (PARTITION BY item, off ORDER BY t1 + t2 + t3 DESC) AS rk,
             count(*) OVER (PARTITION BY item, off, t1 + t2 + t3) AS ties, count(*) OVER (PARTITION BY item, off) AS n,
             row_number() OVER (PARTITION BY item, off ORDER BY t1 + t2 + t3, site) AS rn FROM pd) x""")
def pair_rank(d: Data):
    sold = windows.observed_pairs(d.dense_windows).select("item", "site", "off", "t1", "t2", "t3")
    return pair.pair_rank(durable_table(sold))


@query("sibling_features", "family " + _KEY + " #h #sib_n #sib_t3 #sib_t1 ~sib_sc ~sib_share ~sib_rel",
       """SELECT *, n - 1 AS sib_n, f3 - t3 AS sib_t3, f1 - t1 AS sib_t1, fs_ - scale AS sib_sc,
          CASE WHEN f3 > 0 THEN t3 / f3 ELSE 1.0 END AS sib_share, (fs_ - scale) / scale AS sib_rel FROM
          (SELECT *, count(*) OVER w AS n, sum(t3) OVER w AS f3, sum(t1) OVER w AS f1, sum(scale) OVER w AS fs_
           FROM (SELECT *, split_part(item, '_', 1) AS family FROM gs) g WINDOW w AS (PARTITION BY family, site, off, h)) x""")
def sibling_features(d: Data):
    rows = windows.target_rows(windows.observed_pairs(d.sparse_wide))
    return pair.sibling_features(rows, F.element_at(F.split("item", "_"), 1))


CTES["str_s"] = """SELECT p.site, p.d1 AS ds, sum(p.q / n.n_days) AS strength FROM
  (SELECT f.item, f.site, r.d1, sum(f.qty) * 1.0 AS q FROM fs f JOIN rel_s r ON f.item = r.item
   WHERE date_diff('day', r.d1, f.ds) BETWEEN 0 AND 2 GROUP BY f.item, f.site, r.d1) p
  JOIN (SELECT f.item, count(DISTINCT f.ds) AS n_days FROM fs f JOIN rel_s r ON f.item = r.item
        WHERE date_diff('day', r.d1, f.ds) BETWEEN 0 AND 2 GROUP BY f.item) n ON p.item = n.item GROUP BY p.site, p.d1"""
CTES["days_s"] = "SELECT CAST(unnest(generate_series(min(ds) - 30, max(ds) + 10, INTERVAL 1 DAY)) AS DATE) AS ds FROM fs"
CTES["cum_s"] = """SELECT s.site, k.ds, coalesce(sum(p.strength) OVER (PARTITION BY s.site ORDER BY k.ds), 0) AS cum
  FROM (SELECT DISTINCT site FROM fs) s CROSS JOIN days_s k LEFT JOIN str_s p ON p.site = s.site AND p.ds = k.ds"""
CTES["cumn_s"] = "SELECT ds, sum(cum) AS cum FROM cum_s GROUP BY ds"
CTES["gno_s"] = "SELECT g.*, ln(1.0 + n.nt1 + n.nt2 + n.nt3) AS nat_log FROM gs g JOIN nat_s n ON g.item = n.item AND g.off = n.off"


CTES["nat_o"] = CTES["nat_d"].replace("FROM wd", "FROM wo")
CTES["gno_o"] = "SELECT g.*, ln(1.0 + n.nt1 + n.nt2 + n.nt3) AS nat_log FROM go g JOIN nat_o n ON g.item = n.item AND g.off = n.off"


def _comp_sql(prefix: str, late: str, early: str, rows: str = "gno_s") -> str:
    return f"""SELECT *, {prefix}_nat - ln(1.0 + (exp(nat_log) - 1.0) / 3.0) AS {prefix}_nat_rel, {prefix}_cl - ln(1.0 + scale) AS {prefix}_cl_rel FROM
      (SELECT g.*, ln(1.0 + greatest(a.cum - b.cum, 0)) AS {prefix}_nat, ln(1.0 + greatest(c.cum - e.cum, 0)) AS {prefix}_cl FROM {rows} g
       JOIN cumn_s a ON a.ds = g.{late} JOIN cumn_s b ON b.ds = g.{early}
       JOIN cum_s c ON c.site = g.site AND c.ds = g.{late} JOIN cum_s e ON e.site = g.site AND e.ds = g.{early}) q"""


CTES["comp_s"] = _comp_sql("comp", "ds", "d1 + 2")
CTES["comp_o"] = _comp_sql("comp", "ds", "d1 + 2", "gno_o")
CTES["prev_s"] = _comp_sql("prev", "d1 - 1", "d1 - 15")


def opened_rows(wide):
    """Target rows of the windows with the item's opening on them."""
    return windows.target_rows(pair.item_opening(windows.observed_pairs(wide), wide))


def sparse_rows(d: Data):
    return opened_rows(d.sparse_wide)


@query("release_pressure", "site $ds ~strength ~cum",
       "SELECT p.site, p.ds, p.strength, c.cum FROM str_s p JOIN cum_s c ON p.site = c.site AND p.ds = c.ds")
def release_pressure(d: Data):
    strength = comp.launch_strength(d.sparse, d.releases)
    lines = comp.strength_lines(strength, d.sparse)
    return strength.join(lines, "site").selectExpr("*", comp._at("line", "lo", "ds") + " as cum")


@query("release_volume", "~volume ~per_week",
       "SELECT sum(strength) AS volume, sum(strength) / (14 / 7.0) AS per_week FROM str_s WHERE ds > DATE '2024-01-05' AND ds <= DATE '2024-01-19'")
def release_volume(d: Data):
    return comp.weekly_volume(comp.launch_strength(d.sparse, d.releases), "2024-01-05", "2024-01-19")


@query("competition", _KEY + " #h " + " ".join(f"~{c}" for c in comp.COMP), "SELECT * FROM comp_s")
def competition(d: Data):
    return comp.competition(sparse_rows(d), comp.launch_strength(d.sparse, d.releases), d.sparse)


_PREV = ["prev_nat", "prev_nat_rel", "prev_cl", "prev_cl_rel"]


@query("incumbents", _KEY + " #h " + " ".join(f"~{c}" for c in _PREV),
       "SELECT item, site, off, h, " + ", ".join(f"CASE WHEN d1 - 14 >= (SELECT min(d1) FROM rel_s) THEN {c} END AS {c}" for c in _PREV) + " FROM prev_s")
def incumbents(d: Data):
    return comp.incumbents(sparse_rows(d), comp.launch_strength(d.sparse, d.releases), d.sparse, d.releases)


@query("nonfinite_report", "feature #n_rows #n_null #n_nan #n_inf",
       " UNION ALL ".join(f"""SELECT '{c}' AS feature, count(*) AS n_rows, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS n_null, sum(CASE WHEN isnan(x) THEN 1 ELSE 0 END) AS n_nan,
          sum(CASE WHEN isinf(x) THEN 1 ELSE 0 END) AS n_inf FROM (SELECT CASE WHEN d1 - 14 >= (SELECT min(d1) FROM rel_s) THEN CAST({c} AS DOUBLE) END AS x FROM prev_s) q""" for c in _PREV))
def nonfinite_report(d: Data):
    rows = comp.incumbents(sparse_rows(d), comp.launch_strength(d.sparse, d.releases), d.sparse, d.releases)
    return profile.nonfinite_report(rows, _PREV)


@query("competition_imputed", _KEY + " #h " + " ".join(f"~{c}" for c in comp.COMP),
       """SELECT item, site, off, h, CASE WHEN ln_ THEN greatest(tn_r + ln(1.0 + (exp(nat_log) - 1.0) / 3.0), 0) ELSE comp_nat END AS comp_nat,
          CASE WHEN ln_ THEN tn_r ELSE comp_nat_rel END AS comp_nat_rel, CASE WHEN lc_ THEN greatest(tc_r + ln(1.0 + scale), 0) ELSE comp_cl END AS comp_cl,
          CASE WHEN lc_ THEN tc_r ELSE comp_cl_rel END AS comp_cl_rel FROM
          (SELECT c.*, t.tn_r, t.tc_r, c.ds > (SELECT max(ds) FROM fs) AND coalesce(t.tn, 0) > 0 AS ln_, c.ds > (SELECT max(ds) FROM fs) AND coalesce(t.tc, 0) > 0 AS lc_
           FROM comp_o c LEFT JOIN (SELECT h, isodow(d1) AS dw, median(comp_nat) AS tn, median(comp_nat_rel) AS tn_r, median(comp_cl) AS tc, median(comp_cl_rel) AS tc_r
             FROM comp_s WHERE off = 0 GROUP BY h, isodow(d1)) t ON c.h = t.h AND isodow(c.d1) = t.dw) q""")
def competition_imputed(d: Data):
    """Every window with a known D3, also where its target days run past the last fact; typical values come from whole windows."""
    wide = windows.window_wide(d.sparse, d.releases, SPARSE_OFFSETS, guard=False)
    rows = comp.competition(opened_rows(wide), comp.launch_strength(d.sparse, d.releases), d.sparse)
    known = d.sparse.agg(F.max("ds").alias("last_known"))
    whole = rows.crossJoin(one_row(known)).where("date_add(d1, 9) <= last_known").withColumn("bad", F.lit(False))
    return comp.impute_late(rows, comp.typical(whole), known)


_NORM = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({t}), '[\\(\\[\\{{][^\\)\\]\\}}]*[\\)\\]\\}}]', ' ', 'g'), "
         "'[^a-z0-9]+', ' ', 'g'), '\\b(?:" + FORMAT_WORDS + ")\\b', ' ', 'g'), '\\s+', ' ', 'g'))")
CTES["titles"] = """SELECT DISTINCT concat(p_name, CASE p_size % 4 WHEN 0 THEN ' (IMAX)' WHEN 1 THEN ' 3D' WHEN 2 THEN ' (DUB) re-release' ELSE '' END) AS title FROM part"""
CTES["items"] = """SELECT p_name AS title, p_type AS age_rating, concat(p_brand, ', ', p_type) AS genre, p_brand AS producer,
  concat(p_name, ',', p_brand, ', ,', p_type) AS casts FROM part"""
CTES["cat_i"] = f"""SELECT title, upper(trim(title)) AS exact, {_NORM.format(t='title')} AS key, lower(trim(split_part(genre, ',', 1))) AS genre1,
  2 AS n_genres, 3 AS n_casts, regexp_replace(upper(age_rating), '\\s+', '', 'g') AS age, lower(trim(producer)) AS producer1 FROM items"""
CTES["first_i"] = """SELECT c.*, f.producer_freq FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY title, genre1, age, producer1) AS rn FROM cat_i WHERE key <> '') a WHERE rn = 1) c
  LEFT JOIN (SELECT producer1, count(*) AS producer_freq FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY title, genre1, age, producer1) AS rn FROM cat_i WHERE key <> '') b WHERE rn = 1) z GROUP BY producer1) f
  ON c.producer1 = f.producer1"""


@query("item_meta", "title key #meta_matched genre1 age producer1 #n_genres #n_casts #producer_freq #fmt_imax #fmt_3d #fmt_dub #fmt_premium #fmt_rerelease #has_paren #title_len #n_words",
       f"""SELECT t.title, t.key, CASE WHEN f.title IS NULL THEN 0 ELSE 1 END AS meta_matched, coalesce(genre1, 'unknown') AS genre1, coalesce(age, 'unknown') AS age,
          coalesce(producer1, 'unknown') AS producer1, coalesce(n_genres, 0) AS n_genres, coalesce(n_casts, 0) AS n_casts, coalesce(producer_freq, 0) AS producer_freq,
          CAST(lower(t.title) LIKE '%imax%' AS INTEGER) AS fmt_imax, CAST(regexp_matches(lower(t.title), '\\b3d\\b') AS INTEGER) AS fmt_3d,
          CAST(lower(t.title) LIKE '%dub%' AS INTEGER) AS fmt_dub, CAST(regexp_matches(lower(t.title), '4dx|4d|dolby|screenx|onyx|velvet|satin|deluxe|gold') AS INTEGER) AS fmt_premium,
          CAST(regexp_matches(lower(t.title), 're\\s*-?\\s*release|rerelease|encore') AS INTEGER) AS fmt_rerelease, CAST(contains(t.title, '(') AS INTEGER) AS has_paren,
          length(t.title) AS title_len, len(list_filter(string_split(t.key, ' '), lambda x: x <> '')) AS n_words
          FROM (SELECT title, {_NORM.format(t='title')} AS key FROM titles) t LEFT JOIN first_i f ON t.key = f.key""")
def item_meta(d: Data):
    part = d.table("part")
    titles = part.selectExpr("concat(p_name, case p_size % 4 when 0 then ' (IMAX)' when 1 then ' 3D' when 2 then ' (DUB) re-release' else '' end) as title")
    items = part.selectExpr("p_name as title", "p_type as age_rating", "concat(p_brand, ', ', p_type) as genre", "p_brand as producer",
                            "concat(p_name, ',', p_brand, ', ,', p_type) as casts")
    return pair.item_meta(titles, items)


_ADJ = "SELECT *, y / greatest(uplift, 1e-6) AS adj FROM upl"


@query("decay_prior", "#h ~prior ~mean_uplift #n",
       f"SELECT h, median(adj) AS prior, avg(uplift) AS mean_uplift, count(*) AS n FROM ({_ADJ}) a GROUP BY h")
def decay_prior(d: Data):
    return models.decay_prior(uplift_rows(d))


CTES["base_d"] = f"SELECT u.*, p.prior FROM upl u JOIN (SELECT h, median(adj) AS prior FROM ({_ADJ}) a GROUP BY h) p ON u.h = p.h"


@query("baselines", "baseline #n ~mase",
       " UNION ALL ".join(f"SELECT '{n}' AS baseline, count(*) AS n, avg(abs(y - {e})) AS mase FROM base_d"
                          for n, e in (("scale", "1.0"), ("last_day", "t3 / scale"), ("uplift", "uplift"), ("prior_uplift", "prior * uplift"))))
def baselines(d: Data):
    rows = uplift_rows(d)
    return models.baselines(rows, models.decay_prior(rows))


@query("feature_table", _KEY + " #h ~y ~scale ~r1 ~r3 ~lr31 ~nat_r31 ~nat_log ~share3 #eff ~eff_diff ~sch_diff #dow #d1_dow ~price ~run_t ~run_h",
       f"""SELECT g.item, g.site, g.off, g.h, g.y, g.scale, g.t1 / g.scale AS r1, g.t3 / g.scale AS r3, ln(1.0 + g.t3) - ln(1.0 + g.t1) AS lr31,
          o.nat_r31, o.nat_log, o.share3, t.eff, t.eff - (a.eff + b.eff + c.eff) / 3.0 AS eff_diff, t.sch - (a.sch + b.sch + c.sch) / 3.0 AS sch_diff,
          isodow(g.ds) - 1 AS dow, isodow(g.d1) - 1 AS d1_dow, CASE t.dtype WHEN 2 THEN w.price_weekend WHEN 1 THEN w.price_friday ELSE w.price_weekday END AS price,
          t.run AS run_t, (a.run + b.run + c.run) / 3.0 AS run_h
          FROM gd g JOIN op_d o ON g.item = o.item AND g.site = o.site AND g.off = o.off JOIN cald_run t ON g.ds = t.ds JOIN cald_run a ON g.d1 = a.ds
          JOIN cald_run b ON g.d1 + 1 = b.ds JOIN cald_run c ON g.d1 + 2 = c.ds JOIN pw_d w ON g.city = w.city""")
def feature_table(d: Data):
    from launchgrid.catalog.calendar_queries import prices
    from launchgrid.plans.features import feature_table as build

    cal = Calendar(d.dense).cal
    return build(d.dense_wide, cal, prices(d, cal))
