"""Calibration by grid, cross-fitting, absorbing zeros and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchgrid.catalog.base import CTES, Data, query
from launchgrid.catalog.metric_queries import folded, group_items
from launchgrid.functions import ordered
from launchgrid.functions.joins import spread_join
from launchgrid.operators import calibrate as c, curves, folds, models
from launchgrid.session import durable, durable_table


def _values(grid) -> str:
    return "(SELECT unnest([" + ", ".join(f"{float(g)!r}::DOUBLE" for g in grid) + f"]) AS g, unnest(range(0, {len(grid)})) AS pos)"


def _best_sql(keys: str, grid, err: str, name: str, src: str = "fr", w: str = "1", floor: int = 0) -> str:
    """Error of each grid value, first least one, per key."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    pick = f"CASE WHEN n < {floor} THEN 1.0 ELSE g END" if floor else "g"
    return f"""SELECT {k}n, {pick} AS {name}, e / den AS err, e1 / den AS err_at_1 FROM
      (SELECT *, row_number() OVER ({part} ORDER BY round(e, 9), pos) AS rn, max(CASE WHEN g = 1.0 THEN e END) OVER ({part}) AS e1 FROM
       (SELECT {k}g, pos, count(*) AS n, sum({w}) AS den, sum({w} * ({err})) AS e FROM {src} CROSS JOIN {_values(grid)} gr GROUP BY {k}g, pos) a) b WHERE rn = 1"""


_BLEND = "abs(y - g * A - (1 - g) * B)"


@query("calibrate_blend", "#h #n ~weight_a ~err", _best_sql("h", c.BLEND_GRID, _BLEND, "weight_a", w="w"))
def calibrate_blend(d: Data):
    return c.calibrate_blend(d.frame, ["h"], "w")


@query("calibrate_simplex", "#n ~w_A ~w_B ~w_one ~err",
       """SELECT count(*) AS n, a AS w_A, b AS w_B, 1 - a - b AS w_one, avg(abs(y - (a * A + b * B + (1 - a - b) * one))) AS err FROM
          (SELECT y, A, B, 1.0 AS one FROM fr) f CROSS JOIN (SELECT i / 10.0 AS a, j / 10.0 AS b FROM (SELECT unnest(range(0, 11)) AS i) x CROSS JOIN (SELECT unnest(range(0, 11)) AS j) z WHERE i + j <= 10) g
          GROUP BY a, b ORDER BY round(avg(abs(y - (a * A + b * B + (1 - a - b) * one))), 12), a, b LIMIT 1""".replace("a * A", "g.a * f.A").replace("b * B", "g.b * f.B").replace("a AS w_A", "g.a AS w_A").replace("b AS w_B", "g.b AS w_B")
       .replace("1 - a - b", "1 - g.a - g.b").replace("GROUP BY a, b", "GROUP BY g.a, g.b").replace(", a, b LIMIT", ", g.a, g.b LIMIT").replace("f.g.", "g."))
def calibrate_simplex(d: Data):
    return c.calibrate_simplex(d.frame.withColumn("one", F.lit(1.0)), ["A", "B", "one"])


CTES["frz"] = "SELECT *, greatest(least(CAST(floor(p0 * 10) AS INTEGER), 9), 0) AS zbin FROM fr"


@query("calibrate_zero", "#zbin #n ~zero_mult", _best_sql("zbin", c.ZERO_GRID, "abs(y - g * A)", "zero_mult", "frz", "w", c.MIN_BIN))
def calibrate_zero(d: Data):
    return c.calibrate_zero(d.frame, [], "A", "w")


@query("zero_threshold", "#h #n ~threshold ~err", _best_sql("h", c.THRESHOLD_GRID, "CASE WHEN p0 > g THEN abs(y) ELSE abs(y - A) END", "threshold"))
def zero_threshold(d: Data):
    return c.zero_threshold(d.frame, ["h"], "A")


CTES["edge_p"] = "SELECT " + ", ".join(f"quantile_cont(p0, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM fr"
CTES["frd"] = "SELECT *, " + " + ".join(f"CASE WHEN p0 >= e{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS decile FROM fr CROSS JOIN edge_p"


@query("calibrate_twopart", "#decile #n ~mult ~err", _best_sql("decile", c.TWOPART_GRID, "abs(y - g * A)", "mult", "frd"))
def calibrate_twopart(d: Data):
    return c.two_part(d.frame, "p0", "A")


@query("calibrate_horizon", "#h #n ~mult ~err ~err_at_1 #pinned",
       f"SELECT *, CASE WHEN mult <= 0.2 + 1e-9 THEN 1 ELSE 0 END AS pinned FROM ({_best_sql('h', c.WIDE_GRID, 'abs(y - g * A)', 'mult', w='w')}) q")
def calibrate_horizon(d: Data):
    return c.calibrate_horizon(d.frame, ["h"], "A", c.WIDE_GRID, "w")


@query("calibrate_horizon_dow", "#h #d1_dow #n ~mult ~err", _best_sql("h, d1_dow", c.HORIZON_GRID, "abs(y - g * A)", "mult"))
def calibrate_horizon_dow(d: Data):
    return c.calibrate_horizon(d.frame, ["h", "d1_dow"], "A")


_ROUNDED = "abs(qty - floor(greatest(g * A, 0) * scale + 0.5)) / scale"


@query("calibrate_rounded", "#h #n ~mult ~err ~err_at_1", _best_sql("h", c.HORIZON_GRID, _ROUNDED, "mult", w="w"))
def calibrate_rounded(d: Data):
    return c.calibrate_rounded(d.frame, ["h"], "A", weight="w")


@query("calibrate_snap", "#h ~snap ~mult ~err",
       f"""SELECT h, snap, mult, err FROM (SELECT *, sum(e) OVER (PARTITION BY spos) AS tot FROM
            (SELECT h, t.g AS snap, t.pos AS spos, m.g AS mult, sum(abs(y - CASE WHEN A < t.g THEN 0 ELSE m.g * A END)) AS e, avg(abs(y - CASE WHEN A < t.g THEN 0 ELSE m.g * A END)) AS err,
               row_number() OVER (PARTITION BY h, t.pos ORDER BY round(sum(abs(y - CASE WHEN A < t.g THEN 0 ELSE m.g * A END)), 9), m.pos) AS rn
             FROM fr CROSS JOIN {_values(c.SNAP_GRID)} t CROSS JOIN {_values(c.MULT_GRID)} m GROUP BY h, t.g, t.pos, m.g, m.pos) a WHERE rn = 1) b
          QUALIFY rank() OVER (ORDER BY round(tot, 9), spos) = 1""")
def calibrate_snap(d: Data):
    return c.snap_and_mult(d.frame, "A")


_SNAPQ = f"""SELECT h, n, zero_share, q AS snap_q, edge, e / n AS err FROM
   (SELECT f.h, s.n, s.zero_share, s.q, s.pos, s.edge, sum(CASE WHEN A <= s.edge THEN abs(y) ELSE abs(y - A) END) AS e,
      row_number() OVER (PARTITION BY f.h ORDER BY round(sum(CASE WHEN A <= s.edge THEN abs(y) ELSE abs(y - A) END), 9), s.pos) AS rn
    FROM fr f JOIN (SELECT r.h, r.n, r.zero_share, g.g AS q, g.pos, max(r.A) AS edge FROM
        (SELECT h, A, row_number() OVER (PARTITION BY h ORDER BY A) - 1 AS rn, count(*) OVER (PARTITION BY h) AS n, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY h) AS zero_share FROM fr) r
        JOIN {_values(c.SNAPQ_GRID)} g ON r.rn = floor(g.g * (r.n - 1)) AND g.g <= r.zero_share GROUP BY r.h, r.n, r.zero_share, g.g, g.pos) s ON f.h = s.h
    GROUP BY f.h, s.n, s.zero_share, s.q, s.pos, s.edge) x WHERE rn = 1"""


@query("quantile_snap", "#h #n ~zero_share ~snap_q ~edge ~err", _SNAPQ)
def quantile_snap(d: Data):
    return c.quantile_snap(d.frame, "A")


CTES["frf"] = "SELECT z.*, k.fold FROM frz z JOIN gf_d k ON z.item = k.item"
CTES["wa_t"] = "SELECT ff, weight_a AS wa FROM (" + _best_sql("ff", c.BLEND_GRID, _BLEND, "weight_a", "(SELECT f.*, ff FROM frf f JOIN five ON fold <> ff) z", "w") + ") q"
CTES["tr1"] = "SELECT f.*, w.ff, w.wa * A + (1 - w.wa) * B AS r1 FROM frf f JOIN wa_t w ON f.fold <> w.ff"
CTES["zm_t"] = "SELECT ff, zbin, zm FROM (" + _best_sql("ff, zbin", c.ZERO_GRID, "abs(y - g * r1)", "zm", "tr1", "w", c.MIN_BIN) + ") q"
CTES["hm_t"] = "SELECT ff, h, hm FROM (" + _best_sql("ff, h", c.HORIZON_GRID, "abs(y - g * r2)", "hm",
                                                    "(SELECT t.*, t.r1 * z.zm AS r2 FROM tr1 t JOIN zm_t z ON t.ff = z.ff AND t.zbin = z.zbin) u", "w") + ") q"


@query("crossfit_post", "item site #off #h #fold ~y ~post",
       """SELECT f.item, f.site, f.off, f.h, f.fold, f.y, greatest((w.wa * A + (1 - w.wa) * B) * coalesce(z.zm, 1) * coalesce(m.hm, 1), 0) AS post FROM frf f
          JOIN wa_t w ON f.fold = w.ff LEFT JOIN zm_t z ON f.fold = z.ff AND f.zbin = z.zbin LEFT JOIN hm_t m ON f.fold = m.ff AND f.h = m.h""")
def crossfit_post(d: Data):
    frame = d.frame.select("item", "site", "off", "h", "y", "w", "A", "B", "p0")
    return c.crossfit_post(durable_table(folded(d, frame)), 5, "w")


@query("crossfit_horizon", "#fold #h ~mult",
       "SELECT ff AS fold, h, mult FROM (" + _best_sql("ff, h", c.WIDE_GRID, "abs(y - g * A)", "mult", "(SELECT f.*, ff FROM frf f JOIN five ON fold <> ff) z") + ") q")
def crossfit_horizon(d: Data):
    return c.crossfit_grid(c.mult_errors(folded(d, d.frame), ["fold", "h"], c.WIDE_GRID, "A"), ["h"], c.WIDE_GRID, 5, "mult")


@query("crossfit_horizon_dow", "#fold #h #d1_dow ~mult",
       "SELECT ff AS fold, h, d1_dow, mult FROM (" + _best_sql("ff, h, d1_dow", c.HORIZON_GRID, "abs(y - g * A)", "mult", "(SELECT f.*, ff FROM frf f JOIN five ON fold <> ff) z", "w", c.MIN_BIN) + ") q")
def crossfit_horizon_dow(d: Data):
    errors = c.mult_errors(folded(d, d.frame), ["fold", "h", "d1_dow"], c.HORIZON_GRID, "A", "w")
    return c.crossfit_grid(errors, ["h", "d1_dow"], c.HORIZON_GRID, 5, "mult", c.MIN_BIN)


@query("crossfit_rounded", "#fold #h ~mult",
       "SELECT ff AS fold, h, mult FROM (" + _best_sql("ff, h", c.HORIZON_GRID, _ROUNDED, "mult", "(SELECT f.*, ff FROM frf f JOIN five ON fold <> ff) z", "w") + ") q")
def crossfit_rounded(d: Data):
    return c.crossfit_grid(c.rounded_errors(folded(d, d.frame), ["fold", "h"], c.HORIZON_GRID, "A", "w"), ["h"], c.HORIZON_GRID, 5, "mult")


_OTHERS = "(SELECT f.*, ff FROM frf f JOIN five ON fold <> ff) z"
CTES["rh_t"] = "SELECT ff, h, m FROM (" + _best_sql("ff, h", c.HORIZON_GRID, "abs(y - g * A)", "m", _OTHERS, "w") + ") q"
CTES["rr_t"] = "SELECT ff, h, m FROM (" + _best_sql("ff, h", c.HORIZON_GRID, _ROUNDED, "m", _OTHERS, "w") + ") q"
CTES["rd_t"] = "SELECT ff, h, d1_dow, m FROM (" + _best_sql("ff, h, d1_dow", c.HORIZON_GRID, "abs(y - g * A)", "m", _OTHERS, "w", c.MIN_BIN) + ") q"
CTES["rcp"] = """SELECT f.y, f.w, f.qty, f.scale, f.A AS q0, w.wa * A + (1 - w.wa) * B AS q1, A * coalesce(rh.m, 1) AS q2, A * coalesce(rr.m, 1) AS q3, A * coalesce(rd.m, 1) AS q4,
  (w.wa * A + (1 - w.wa) * B) * coalesce(z.zm, 1) AS q5, greatest((w.wa * A + (1 - w.wa) * B) * coalesce(z.zm, 1) * coalesce(m.hm, 1), 0) AS q6 FROM frf f
  JOIN wa_t w ON f.fold = w.ff LEFT JOIN zm_t z ON f.fold = z.ff AND f.zbin = z.zbin LEFT JOIN hm_t m ON f.fold = m.ff AND f.h = m.h
  LEFT JOIN rh_t rh ON f.fold = rh.ff AND f.h = rh.h LEFT JOIN rr_t rr ON f.fold = rr.ff AND f.h = rr.h
  LEFT JOIN rd_t rd ON f.fold = rd.ff AND f.h = rd.h AND f.d1_dow = rd.d1_dow"""
CTES["rsc"] = " UNION ALL ".join(
    f"""SELECT {i} AS place, '{n}' AS recipe, {s} AS steps, avg(abs(y - q{i})) AS plain, sum(w * abs(y - q{i})) / sum(w) AS weighted,
  sum(w * (abs(qty - floor(greatest(q{i}, 0) * scale + 0.5)) / scale)) / sum(w) AS rounded FROM rcp""" for i, (n, s) in enumerate(c.RECIPES))


@query("recipe_choice", "recipe #steps ~plain ~weighted ~rounded ~gain #kept #chosen",
       """SELECT recipe, steps, plain, weighted, rounded, n.r - rounded AS gain, CASE WHEN round(n.r - rounded, 9) > 0 THEN 1 ELSE 0 END AS kept,
          CASE WHEN row_number() OVER (ORDER BY round(rounded, 9), place) = 1 THEN 1 ELSE 0 END AS chosen FROM rsc CROSS JOIN (SELECT rounded AS r FROM rsc WHERE place = 0) n""")
def recipe_choice(d: Data):
    frame = d.frame.select("item", "h", "d1_dow", "y", "qty", "scale", "w", "A", "B", "p0", "site")
    return c.recipe_choice(durable(folded(d, frame)), 5, "w")


# ------------------------------------------------------------------ absorbing zero
CTES["taus"] = "SELECT * FROM " + _values(c.TAU_GRID)
CTES["low"] = "SELECT item, site, off, fold, h, y, w, A, min(A) OVER (PARTITION BY item, site, off ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lowest FROM frf"
CTES["tau_t"] = """SELECT ff, g AS tau FROM (SELECT ff, g, row_number() OVER (PARTITION BY ff ORDER BY round(sum(w * abs(y - CASE WHEN lowest < g THEN 0 ELSE A END)), 9), pos) AS rn
  FROM low JOIN five ON fold <> ff CROSS JOIN taus GROUP BY ff, g, pos) q WHERE rn = 1"""


def horizon_pairs(d: Data):
    return folded(d, c.by_horizon(d.frame, "A"))


@query("absorbing_zero", "item site #off #fold ~tau #h ~r",
       "SELECT l.item, l.site, l.off, l.fold, t.tau, l.h, CASE WHEN lowest < t.tau THEN 0 ELSE A END AS r FROM low l JOIN tau_t t ON l.fold = t.ff")
def absorbing_zero(d: Data):
    pairs = horizon_pairs(d)
    out = pairs.join(F.broadcast(c.fit_tau(pairs)), "fold").withColumn("_r", c.absorb(F.col("cells"), F.col("tau")))
    return out.selectExpr("item", "site", "off", "fold", "tau", "posexplode(_r) as (_p, r)").withColumn("h", F.col("_p") + 4)


@query("zero_persistence", "#h #zero_pairs ~resurrect",
       """SELECT h, count(*) AS zero_pairs, avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END) AS resurrect FROM
          (SELECT h, y, max(y) OVER (PARTITION BY item, site, off ORDER BY h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM fr) x WHERE y = 0 AND h < 10 GROUP BY h""")
def zero_persistence(d: Data):
    return c.zero_persistence(c.by_horizon(d.frame, "A"))


@query("zero_tail", "#pairs #has_zero #tail_zero #violates",
       """SELECT count(*) AS pairs, sum(CASE WHEN fz IS NOT NULL THEN 1 ELSE 0 END) AS has_zero, sum(CASE WHEN fz IS NOT NULL AND (lp IS NULL OR lp < fz) THEN 1 ELSE 0 END) AS tail_zero, sum(v) AS violates FROM
          (SELECT item, site, off, min(CASE WHEN y = 0 THEN h END) AS fz, max(CASE WHEN y > 0 THEN h END) AS lp, max(CASE WHEN r <= 0 AND nx > 0 THEN 1 ELSE 0 END) AS v FROM
           (SELECT *, A - 0.2 AS r, lead(A - 0.2) OVER (PARTITION BY item, site, off ORDER BY h) AS nx FROM fr) a GROUP BY item, site, off) b""")
def zero_tail(d: Data):
    return c.zero_tail(c.by_horizon(d.frame.withColumn("R", F.expr("A - 0.2")), "R"))


# ------------------------------------------------------------------ medians and curves
def _wmed_sql(keys: str, src: str, y: str = "y", w: str = "w") -> str:
    return f"""SELECT {keys}, CASE WHEN max(tw) > 0 THEN min(CASE WHEN cw >= 0.5 * tw THEN {y} END) ELSE median({y}) END AS wmedian FROM
      (SELECT *, sum({w}) OVER (PARTITION BY {keys} ORDER BY {y} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum({w}) OVER (PARTITION BY {keys}) AS tw FROM {src}) q GROUP BY {keys}"""


@query("weighted_median", "#h #d1_dow ~wmedian", _wmed_sql("h, d1_dow", "fr"))
def weighted_median(d: Data):
    return ordered.weighted_median(d.frame, ["h", "d1_dow"], "y", "w")


_EDGES = "list_sort(list_distinct([" + ", ".join(f"quantile_cont(A, {i / 20})" for i in range(21)) + "]))"
CTES["cv_e"] = f"SELECT h, {_EDGES} AS edges FROM fr GROUP BY h"
CTES["cv_b"] = "SELECT f.h, f.A, f.y, f.w, greatest(0, least(len(list_filter(e.edges, lambda x: x <= f.A)) - 1, len(e.edges) - 2)) AS b FROM fr f JOIN cv_e e ON f.h = e.h"
CTES["cv_k"] = f"""SELECT m.h, m.b, m.x, w.wmedian AS y0, count(*) OVER (PARTITION BY m.h) AS nk, max(w.wmedian) OVER (PARTITION BY m.h ORDER BY m.b) AS v, row_number() OVER (PARTITION BY m.h ORDER BY m.b) - 1 AS k
  FROM (SELECT h, b, median(A) AS x FROM cv_b GROUP BY h, b HAVING count(*) >= 80) m JOIN ({_wmed_sql('h, b', 'cv_b')}) w ON m.h = w.h AND m.b = w.b"""
CTES["cv_f"] = "SELECT h, k, x, v FROM cv_k WHERE nk >= 3 UNION ALL SELECT e.h, i.k, i.k, i.k FROM cv_e e CROSS JOIN (SELECT unnest([0, 1]) AS k) i WHERE e.h NOT IN (SELECT h FROM cv_k WHERE nk >= 3)"


@query("monotone_curve", "#h #k ~x ~v", "SELECT * FROM cv_f")
def monotone_curve(d: Data):
    return curves.monotone_curve(d.frame, ["h"], "A", bins=20)


@query("curve_apply", "item site #off #h ~mapped",
       """SELECT item, site, off, h, CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (A - x0) / (x1 - x0) END AS mapped FROM
          (SELECT f.item, f.site, f.off, f.h, f.A, arg_max(k.v, k.x) FILTER (WHERE k.x <= f.A) AS v0, max(k.x) FILTER (WHERE k.x <= f.A) AS x0,
             arg_min(k.v, k.x) FILTER (WHERE k.x > f.A) AS v1, min(k.x) FILTER (WHERE k.x > f.A) AS x1 FROM fr f JOIN cv_f k ON f.h = k.h GROUP BY f.item, f.site, f.off, f.h, f.A) q""")
def curve_apply(d: Data):
    return curves.apply_curve(d.frame, curves.monotone_curve(d.frame, ["h"], "A", bins=20), ["h"], "A", "mapped")


# Curves from all other folds: global with 40 bins, and per horizon with 20 where 400 rows can be learned from.
_KIND_EDGES = {n: "list_sort(list_distinct([" + ", ".join(f"quantile_cont(A, {i / n})" for i in range(n + 1)) + "]))" for n in (40, 20)}
CTES["cx"] = """SELECT z.*, k.kind, CASE k.kind WHEN 'all' THEN 0 ELSE h END AS g FROM (
  SELECT 'group' AS scheme, f.item, f.site, f.off, f.h, f.A, f.y, f.w, k.fold FROM fr f JOIN gf_d k ON f.item = k.item
  UNION ALL SELECT 'time', f.item, f.site, f.off, f.h, f.A, f.y, f.w, k.fold FROM fr f JOIN tf_d k ON f.item = k.item) z CROSS JOIN (SELECT unnest(['all', 'h']) AS kind) k"""
CTES["cx_t"] = "SELECT scheme, kind, g, ff, A, y, w FROM cx JOIN five ON fold <> ff"
CTES["cx_e"] = " UNION ALL ".join(f"SELECT scheme, kind, g, ff, count(*) AS n, {_KIND_EDGES[b]} AS edges FROM cx_t WHERE kind = '{k}' GROUP BY scheme, kind, g, ff" for k, b in (("all", 40), ("h", 20)))
CTES["cx_b"] = "SELECT f.*, greatest(0, least(len(list_filter(e.edges, lambda x: x <= f.A)) - 1, len(e.edges) - 2)) AS b FROM cx_t f JOIN cx_e e USING (scheme, kind, g, ff)"
CTES["cx_k"] = f"""SELECT scheme, kind, g, ff, x, count(*) OVER (PARTITION BY scheme, kind, g, ff) AS nk, max(w.wmedian) OVER (PARTITION BY scheme, kind, g, ff ORDER BY b) AS v
  FROM (SELECT scheme, kind, g, ff, b, median(A) AS x FROM cx_b GROUP BY ALL HAVING count(*) >= 80) m JOIN ({_wmed_sql('scheme, kind, g, ff, b', 'cx_b')}) w USING (scheme, kind, g, ff, b)"""
CTES["cx_f"] = """SELECT k.scheme, k.kind, k.g, k.ff, k.x, k.v FROM cx_k k JOIN cx_e e USING (scheme, kind, g, ff) WHERE nk >= 3 AND (kind = 'all' OR n >= 400)
  UNION ALL SELECT scheme, kind, g, ff, i.k, i.k FROM cx_e e CROSS JOIN (SELECT unnest([0, 1]) AS k) i
    WHERE (kind = 'all' OR n >= 400) AND NOT EXISTS (SELECT 1 FROM cx_k k WHERE nk >= 3 AND k.scheme = e.scheme AND k.kind = e.kind AND k.g = e.g AND k.ff = e.ff)"""


@query("crossfit_curve", "scheme kind #n ~before ~after",
       """SELECT scheme, kind, count(*) AS n, sum(w * abs(y - A)) / sum(w) AS before, sum(w * abs(y - m)) / sum(w) AS after FROM
          (SELECT *, CASE WHEN x0 IS NULL AND x1 IS NULL THEN A WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (A - x0) / (x1 - x0) END AS m FROM
           (SELECT f.scheme, f.kind, f.item, f.site, f.off, f.h, f.A, f.y, f.w, arg_max(k.v, k.x) FILTER (WHERE k.x <= f.A) AS v0, max(k.x) FILTER (WHERE k.x <= f.A) AS x0,
              arg_min(k.v, k.x) FILTER (WHERE k.x > f.A) AS v1, min(k.x) FILTER (WHERE k.x > f.A) AS x1
            FROM cx f LEFT JOIN cx_f k ON k.scheme = f.scheme AND k.kind = f.kind AND k.g = f.g AND k.ff = f.fold GROUP BY ALL) q) r GROUP BY scheme, kind""")
def crossfit_curve(d: Data):
    """One row per scheme and kind of curve, with the weighted score before and after."""
    rows = durable(d.frame.select("item", "site", "h", "A", "y", "w"))
    fold = lambda scheme, table: spread_join(rows, table.select("item", "fold"), ["item"], "site", "inner").withColumn("scheme", F.lit(scheme))
    both = fold("group", folds.group_folds(group_items(d))).unionByName(fold("time", folds.time_folds(group_items(d))))
    kinds = [("all", ["scheme"], 40, 0), ("h", ["scheme", "h"], 20, 400)]
    out = [curves.curve_crossfit(both, 5, keys, "A", bins, enough=enough).groupBy("scheme", F.lit(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.expr("w * abs(y - A)")) / F.sum("w")).alias("before"), (F.sum(F.expr("w * abs(y - mapped)")) / F.sum("w")).alias("after"))
        for kind, keys, bins, enough in kinds]
    return out[0].unionByName(out[1])


_OPT = f"""SELECT {{k}}, n_true, n_pred, g AS best_m, e AS err_best, e1 AS err_at_1, e1 - e AS gain FROM
   (SELECT *, row_number() OVER (PARTITION BY {{k}} ORDER BY round(e, 12), pos) AS rn, max(CASE WHEN g = 1.0 THEN e END) OVER (PARTITION BY {{k}}) AS e1 FROM
    (SELECT {{ka}}, m.g, m.pos, avg(abs(a.y - m.g * b.r)) AS e, count(*) / max(b.n) AS n_true, max(b.n) AS n_pred
     FROM (SELECT {{k}}, y FROM fr WHERE off = 0) a JOIN (SELECT {{k}}, A AS r, count(*) OVER (PARTITION BY {{k}}) AS n FROM fr WHERE off = 0) b ON {{j}}
     CROSS JOIN {_values(c.LEVEL_GRID)} m GROUP BY {{ka}}, m.g, m.pos) x) z WHERE rn = 1"""
_ONE = _OPT.format(k="h, d1_dow", ka="a.h, a.d1_dow", j="a.h = b.h AND a.d1_dow = b.d1_dow")
_CELL = ["h", "d1_dow"]


def _samples(d: Data):
    """True and predicted ratios of the release windows, the population the check is defined on."""
    pool = d.opening_frame
    return pool.select(*_CELL, "y"), pool.select(*_CELL, F.col("A").alias("r"))


@query("optimal_multiplier", "#h #d1_dow #n_true #n_pred ~best_m ~err_best ~err_at_1 ~gain", _ONE)
def optimal_multiplier(d: Data):
    return curves.optimal_multiplier(*_samples(d), _CELL)


@query("level_check", "#h #d1_dow #n_true #n_pred ~true_q25 ~true_med ~true_q75 ~pred_q25 ~pred_med ~pred_q75 ~best_m ~gain ~med_mult #med_agree",
       f"""SELECT o.*, s.* EXCLUDE (h, d1_dow), s.true_med / nullif(s.pred_med, 0) AS med_mult,
          CASE WHEN abs(true_med - pred_med) < 1e-9 OR (pred_med > 0 AND abs(true_med / pred_med - 1) < 0.10) THEN 1 ELSE 0 END AS med_agree FROM ({_ONE}) o
          JOIN (SELECT h, d1_dow, quantile_cont(y, 0.25) AS true_q25, median(y) AS true_med, quantile_cont(y, 0.75) AS true_q75, quantile_cont(A, 0.25) AS pred_q25, median(A) AS pred_med,
                  quantile_cont(A, 0.75) AS pred_q75 FROM fr WHERE off = 0 GROUP BY h, d1_dow) s ON o.h = s.h AND o.d1_dow = s.d1_dow WHERE n_true >= 30 AND n_pred >= 30""")
def level_check(d: Data):
    """Cells of 30 rows and more: the given tables are smaller than those the usual 150 was set for."""
    return curves.level_check(*_samples(d), _CELL, least=30)
