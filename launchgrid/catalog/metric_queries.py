"""Folds, back-off models, weights, errors and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from launchgrid.catalog.base import CTES, Data, query, sql_bin
from launchgrid.catalog.calendar_queries import labelled_rows, uplift_rows
from launchgrid.functions.joins import spread_join
from launchgrid.functions.scalar import BACKOFF_EDGES, SCALE_EDGES, TREND_EDGES, right_closed_bin
from launchgrid.operators import diagnose, folds, metrics, models, pair, selection, windows
from launchgrid.session import durable

CTES["it_d"] = "SELECT item, min(d1) AS d1, count(*) AS n_rows FROM pd GROUP BY item"
CTES["gf_d"] = "SELECT item, CAST((row_number() OVER (ORDER BY item) - 1) % 5 AS INTEGER) AS fold FROM it_d"
CTES["tf_d"] = "SELECT item, d1, ntile(5) OVER (ORDER BY d1, item) - 1 AS fold FROM it_d"


def group_items(d: Data):
    return folds.items_of(d.pairs)


def folded(d: Data, rows):
    return spread_join(rows, folds.group_folds(group_items(d)), ["item"], "site", "inner")


@query("group_folds", "item #fold", "SELECT * FROM gf_d")
def group_folds(d: Data):
    return folds.group_folds(group_items(d))


@query("keyed_folds", "item grp #fold",
       """SELECT i.item, g.grp, g.fold FROM (SELECT *, split_part(item, '_', 1) AS grp FROM (SELECT item, count(*) AS n_rows FROM ps GROUP BY item) a) i
          JOIN (SELECT grp, (row_number() OVER (ORDER BY n DESC, grp) - 1) % 5 AS fold FROM
            (SELECT split_part(item, '_', 1) AS grp, sum(n_rows) AS n FROM (SELECT item, count(*) AS n_rows FROM ps GROUP BY item) b GROUP BY 1) c) g ON i.grp = g.grp""")
def keyed_folds(d: Data):
    items = folds.items_of(windows.observed_pairs(d.sparse_wide))
    return folds.keyed_folds(items, F.element_at(F.split("item", "_"), 1))


@query("time_folds", "item $d1 #fold", "SELECT * FROM tf_d")
def time_folds(d: Data):
    return folds.time_folds(group_items(d))


CTES["tf_s"] = "SELECT item, d1, ntile(5) OVER (ORDER BY d1, item) - 1 AS fold FROM (SELECT item, min(d1) AS d1 FROM ps WHERE off = 0 GROUP BY item) i"


@query("time_purge", "#own_fold #train_for #pairs",
       """SELECT own_fold, train_for, count(*) AS pairs FROM (SELECT t.fold AS own_fold, b.fold AS train_for FROM ps p LEFT JOIN tf_s t ON p.item = t.item
            JOIN (SELECT fold, min(d1) AS s, max(d1) + 9 AS e FROM tf_s GROUP BY fold) b ON coalesce(t.fold, -1) <> b.fold AND NOT (p.d1 <= b.e AND p.d1 + 9 >= b.s)) x
          GROUP BY own_fold, train_for""")
def time_purge(d: Data):
    pairs = windows.observed_pairs(d.sparse_wide)
    tf = folds.time_folds(folds.items_of(pairs.where("off = 0")))
    out = folds.purged_training(pairs, tf)
    return out.groupBy("own_fold", "train_for").agg(F.count(F.lit(1)).alias("pairs"))




@query("time_holdout", "item $d1 $cut #late",
       """SELECT i.item, i.d1, c.cut, CASE WHEN i.d1 >= c.cut THEN 1 ELSE 0 END AS late FROM it_d i CROSS JOIN
          (SELECT min(d1) AS cut FROM (SELECT d1, row_number() OVER (ORDER BY d1, item) - 1 AS rn, count(*) OVER () AS n FROM it_d) x WHERE rn = floor(0.75 * n)) c""")
def time_holdout(d: Data):
    return folds.time_holdout(group_items(d), 0.25)


# ------------------------------------------------------------------ back-off models
CTES["bk"] = f"""SELECT g.item, g.site, g.off, g.h, g.y, f.fold, isodow(g.d1) - 1 AS d1_dow, {sql_bin('g.scale', BACKOFF_EDGES)} AS sb,
  concat(CAST(CAST(t1 > 0 AS INTEGER) AS VARCHAR), CAST(CAST(t2 > 0 AS INTEGER) AS VARCHAR), CAST(CAST(t3 > 0 AS INTEGER) AS VARCHAR)) AS pattern
  FROM gd g JOIN gf_d f ON g.item = f.item"""
CTES["five"] = "SELECT CAST(unnest([0,1,2,3,4]) AS INTEGER) AS ff"


def _backoff_sql(src: str, levels: list[list[str]], stat: str, least: int, name: str, cond: str = "TRUE") -> str:
    """Each level is grouped once; its value for fold f is the statistic over the other folds' rows."""
    others = lambda n: "[" + ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE fold <> {f}) >= {n} THEN {stat} FILTER (WHERE fold <> {f}) END" for f in range(5)) + "]"
    joins, picks = [], []
    for i, lv in enumerate(levels):
        cols = ", ".join(lv)
        joins.append(f"LEFT JOIN (SELECT {cols}, {others(least)} AS v FROM {src} WHERE {cond} GROUP BY {cols}) l{i} ON " + " AND ".join(f"l{i}.{c} = b.{c}" for c in lv))
        picks.append(f"l{i}.v[b.fold + 1]")
    return f"""SELECT b.*, coalesce({', '.join(picks)}, gl.v[b.fold + 1]) AS {name} FROM {src} b {' '.join(joins)}
      CROSS JOIN (SELECT {others(1)} AS v FROM {src} WHERE {cond}) gl"""


def backoff_rows(d: Data):
    rows = folded(d, pair.add_pattern(d.pairs))
    return windows.target_rows(rows).withColumn("d1_dow", F.weekday("d1")).withColumn("sb", right_closed_bin(F.col("scale"), BACKOFF_EDGES))


_BK = "item site #off #h #fold ~y "


@query("backoff_median", _BK + "~pred", _backoff_sql("bk", models.BACKOFF_LEVELS, "median(y)", 40, "pred"))
def backoff_median(d: Data):
    return models.backoff_fit_apply(backoff_rows(d), models.BACKOFF_LEVELS, "median", 40, 5, "pred")


@query("backoff_zero", _BK + "~p_zero", _backoff_sql("bk", models.BACKOFF_LEVELS, "avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END)", 40, "p_zero"))
def backoff_zero(d: Data):
    return models.backoff_fit_apply(backoff_rows(d), models.BACKOFF_LEVELS, "zero", 40, 5, "p_zero")


@query("backoff_positive", _BK + "~pred", _backoff_sql("bk", models.BACKOFF_LEVELS, "median(y)", 20, "pred", "y > 0"))
def backoff_positive(d: Data):
    return models.backoff_fit_apply(backoff_rows(d), models.BACKOFF_LEVELS, "median", 20, 5, "pred", positive_only=True)


CTES["ic"] = f"""SELECT item, off, h, fold, isodow(d1) - 1 AS dow, {sql_bin('s3 * 1.0 / greatest(s1, 1)', TREND_EDGES)} AS trend,
  {sql_bin('greatest(s1 + s2 + s3, 1) / 1000.0', BACKOFF_EDGES)} AS size, {sql_bin('ug', TREND_EDGES)} AS up, q * 1.0 / greatest((s1 + s2 + s3) / 3.0, 1.0) AS y FROM
  (SELECT u.item, u.off, u.h, min(u.d1) AS d1, min(f.fold) AS fold, sum(qty) AS q, sum(t1) AS s1, sum(t2) AS s2, sum(t3) AS s3, min(round(uplift_global, 9)) AS ug
   FROM upl u JOIN gf_d f ON u.item = f.item GROUP BY u.item, u.off, u.h) a"""


@query("item_curve", "item #off #h #fold ~y ~curve", _backoff_sql("ic", models.CURVE_LEVELS, "median(y)", 8, "curve"))
def item_curve(d: Data):
    rows = folded(d, uplift_rows(d)).withColumn("uplift_global", F.round("uplift_global", 9))
    return models.backoff_fit_apply(models.item_curve_rows(rows), models.CURVE_LEVELS, "median", 8, 5, "curve")


@query("oof_frame", "item site #off #h #fold ~y ~scale #qty ~A ~B ~p0",
       f"""SELECT f.item, f.site, f.off, f.h, k.fold, f.y, f.scale, f.qty, f.A, k.pred AS B, f.p0 FROM fr f
          JOIN ({_backoff_sql('bk', models.BACKOFF_LEVELS, 'median(y)', 40, 'pred')}) k ON f.item = k.item AND f.site = k.site AND f.off = k.off AND f.h = k.h""")
def oof_frame(d: Data):
    key = ["item", "site", "off", "h"]
    other = models.backoff_fit_apply(backoff_rows(d), models.BACKOFF_LEVELS, "median", 40, 5, "B").select(*key, "fold", "B")
    return d.frame.drop("B").join(other, key)


# ------------------------------------------------------------------ weights and scores
_MIX = f"""SELECT *, v AS n_rows, c / (sum(c * v) OVER () / sum(v) OVER ()) AS capped, weight * v / sum(weight * v) OVER () AS weight_share,
   pow(sum(c * v) OVER (), 2) / sum(c * c * v) OVER () / sum(v) OVER () AS effective FROM
  (SELECT *, coalesce(t_share / nullif(v_share, 0), 1.0) AS weight, least(coalesce(t_share / nullif(v_share, 0), 1.0), 8.0) AS c FROM
   (SELECT b.sb, coalesce(v.n, 0) AS v, coalesce(v.n, 0) * 1.0 / (SELECT count(*) FROM pd) AS v_share, coalesce(t.n, 0) * 1.0 / (SELECT count(*) FROM ps) AS t_share
    FROM (SELECT CAST(unnest([0,1,2,3,4,5,6,7]) AS INTEGER) AS sb) b
    LEFT JOIN (SELECT {sql_bin('scale', SCALE_EDGES)} AS sb, count(*) AS n FROM pd GROUP BY 1) v ON b.sb = v.sb
    LEFT JOIN (SELECT {sql_bin('scale', SCALE_EDGES)} AS sb, count(*) AS n FROM ps GROUP BY 1) t ON b.sb = t.sb) x) y"""
CTES["mixw"] = _MIX


@query("mix_weights", "#sb #n_rows ~v_share ~t_share ~weight ~capped ~weight_share ~effective", "SELECT * FROM mixw")
def mix_weights(d: Data):
    return metrics.mix_weights(d.pairs, windows.observed_pairs(d.sparse_wide))


@query("weighted_metric", "model ~plain ~weighted ~up ~even",
       " UNION ALL ".join(f"""SELECT '{m}' AS model, avg(abs(y - {m})) AS plain, sum(m.weight * abs(y - {m})) / sum(m.weight) AS weighted,
          avg(abs(qty - floor({m} * scale + 0.5)) / scale) AS up, avg(abs(qty - round_even({m} * scale, 0)) / scale) AS even
          FROM fr JOIN mixw m ON fr.sb = m.sb""" for m in ("A", "B")))
def weighted_metric(d: Data):
    w = metrics.mix_weights(d.pairs, windows.observed_pairs(d.sparse_wide))
    return metrics.weighted_metric(metrics.with_weights(d.frame, w), ["A", "B"])


_SEG = {"h": "CAST(h AS VARCHAR)", "d1_dow": "CAST(d1_dow AS VARCHAR)", "sb": "CAST(sb AS VARCHAR)", "site": "site", "all": "'all'"}


@query("error_segments", "segment level #n ~mase ~wmase",
       " UNION ALL ".join(f"SELECT '{s}' AS segment, {e} AS level, count(*) AS n, avg(abs(y - A)) AS mase, sum(w * abs(y - A)) / sum(w) AS wmase FROM fr GROUP BY {e}"
                          for s, e in _SEG.items()))
def error_segments(d: Data):
    return diagnose.error_segments(d.frame, ["h", "d1_dow", "sb", "site"])


_WORST = [0.01, 0.05, 0.1, 0.25]


@query("error_concentration", "~worst ~error_share",
       " UNION ALL ".join(f"""SELECT {f} AS worst, sum(CASE WHEN rn <= floor({f} * n) THEN e ELSE 0 END) / sum(e) AS error_share FROM
          (SELECT abs(y - A) AS e, row_number() OVER (ORDER BY abs(y - A) DESC) AS rn, count(*) OVER () AS n FROM fr) x""" for f in _WORST))
def error_concentration(d: Data):
    return diagnose.error_concentration(d.frame, _WORST)


@query("model_diversity", "model ~mase ~corr_first ~best_of",
       " UNION ALL ".join(f"SELECT '{m}' AS model, avg(abs(y - {m})) AS mase, corr(abs(y - {m}), abs(y - A)) AS corr_first, avg(least(abs(y - A), abs(y - B))) AS best_of FROM fr" for m in ("A", "B")))
def model_diversity(d: Data):
    return diagnose.model_diversity(d.frame, ["A", "B"])


_DRIFT = ["scale", "t3", "shw3"]
_DSIDE = lambda t, f, s: f"median(CAST({f} AS DOUBLE)) AS {s}_med, quantile_cont(CAST({f} AS DOUBLE), 0.1) AS {s}_p10, quantile_cont(CAST({f} AS DOUBLE), 0.9) AS {s}_p90, avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END) AS {s}_null_share FROM {t}"


@query("drift_table", "feature " + " ".join(f"~{s}_{c}" for s in ("left", "right") for c in ("med", "p10", "p90", "null_share")),
       " UNION ALL ".join(f"SELECT '{f}' AS feature, a.*, b.* FROM (SELECT {_DSIDE('pd', f, 'left')}) a, (SELECT {_DSIDE('ps', f, 'right')}) b" for f in _DRIFT))
def drift_table(d: Data):
    return diagnose.drift_table(d.pairs, windows.observed_pairs(d.sparse_wide), _DRIFT)


_SHIFT = ["scale", "t1", "t2", "t3", "shw1", "shw2", "shw3", "occ1", "occ2", "occ3", "n1", "n2", "n3"]
_SHIFTSQL = " UNION ALL ".join(f"""SELECT '{f}' AS feature, max(abs(lc * 1.0 / ln - rc * 1.0 / rn)) AS distance, max(ln) AS n_left, max(rn) AS n_right,
    (SELECT median(CAST({f} AS DOUBLE)) FROM pd) AS left_med, (SELECT median(CAST({f} AS DOUBLE)) FROM ps) AS right_med FROM
    (SELECT sum(l) OVER (ORDER BY v) AS lc, sum(r) OVER (ORDER BY v) AS rc, sum(l) OVER () AS ln, sum(r) OVER () AS rn FROM
      (SELECT v, sum(l) AS l, sum(r) AS r FROM (SELECT CAST({f} AS DOUBLE) AS v, 1 AS l, 0 AS r FROM pd UNION ALL SELECT CAST({f} AS DOUBLE), 0, 1 FROM ps) u
       WHERE v IS NOT NULL GROUP BY v) a) b""" for f in _SHIFT)


@query("shifted_features", "feature ~distance ~left_med ~right_med #n_left #n_right #place",
       f"SELECT *, row_number() OVER (ORDER BY distance DESC NULLS LAST, feature) AS place FROM ({_SHIFTSQL}) s")
def shifted_features(d: Data):
    return diagnose.shifted_features(d.pairs, windows.observed_pairs(d.sparse_wide), _SHIFT)


_LATE = [0.2, 0.25]


@query("holdout_scores", "~share $cut #n #items ~mase_a ~mase_b ~wmase_a ~wmase_b",
       " UNION ALL ".join(f"""SELECT {s} AS share, min(c.cut) AS cut, count(*) AS n, count(DISTINCT f.item) AS items, avg(abs(y - A)) AS mase_a, avg(abs(y - B)) AS mase_b,
          sum(w * abs(y - A)) / sum(w) AS wmase_a, sum(w * abs(y - B)) / sum(w) AS wmase_b FROM fr f JOIN it_d i ON f.item = i.item CROSS JOIN
          (SELECT min(d1) AS cut FROM (SELECT d1, row_number() OVER (ORDER BY d1, item) - 1 AS rn, count(*) OVER () AS n FROM it_d) x WHERE rn = floor({1 - s} * n)) c
          WHERE i.d1 >= c.cut""" for s in _LATE))
def holdout_scores(d: Data):
    """Errors on the items that start last, for two sizes of the holdout."""
    out = None
    for s in _LATE:
        late = folds.time_holdout(group_items(d), s).where("late = 1").select("item", "cut")
        part = metrics.holdout_errors(spread_join(d.frame, late, ["item"], "site", "inner"), ["A", "B"]).withColumn("share", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


CTES["edge_b"] = "SELECT " + ", ".join(f"quantile_cont(scale, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM lab_d"
_B = " + ".join(f"CASE WHEN scale >= e{i} THEN 1 ELSE 0 END" for i in range(1, 10))
CTES["src_b"] = f"SELECT label, {_B} AS b FROM lab_d CROSS JOIN edge_b"
CTES["tgt_b"] = f"SELECT {_B} AS b FROM ps CROSS JOIN edge_b"


@query("regime_share", "label #n_source ~target_share",
       """SELECT label, sum(n) AS n_source, sum(p * q) AS target_share FROM
          (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY b) AS p FROM (SELECT b, label, count(*) AS n FROM src_b GROUP BY b, label) a) s
          JOIN (SELECT b, count(*) * 1.0 / (SELECT count(*) FROM ps) AS q FROM tgt_b GROUP BY b) t ON s.b = t.b GROUP BY label""")
def regime_share(d: Data):
    rows = labelled_rows(d).withColumn("score", F.col("scale"))
    target = windows.observed_pairs(d.sparse_wide).withColumn("score", F.col("scale"))
    return diagnose.regime_share(rows, target, "score", "label")


@query("auc", "#n #positives ~auc",
       """SELECT count(*) AS n, sum(z) AS positives, (sum(CASE WHEN z = 1 THEN r END) - sum(z) * (sum(z) + 1) / 2.0) / (sum(z) * (count(*) - sum(z)) * 1.0) AS auc FROM
          (SELECT z, rank() OVER (ORDER BY p0) + (count(*) OVER (PARTITION BY p0) - 1) / 2.0 AS r FROM (SELECT p0, CASE WHEN y = 0 THEN 1 ELSE 0 END AS z FROM fr) a) x""")
def auc(d: Data):
    return metrics.auc(d.frame, "p0", F.col("y") == 0)


_KEYSQL = f"(CAST(CAST(concat('0x', substring(md5(item), 1, 7)) AS UBIGINT) AS BIGINT) % {metrics.DRAW_M})"
CTES["draws"] = "SELECT CAST(unnest(range(1, 2001)) AS BIGINT) AS rep"


def _boot_sql(frame: str, a: str, b: str) -> str:
    u = f"((k * {metrics.DRAW_A} + rep * {metrics.DRAW_B} + {metrics.DRAW_C} * k * rep) % {metrics.DRAW_M})"
    below = ", ".join(str(round(metrics.DRAW_M * x)) for x in (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759))
    c = f"len(list_filter([{below}], lambda t: t <= {u}))"
    return f"""SELECT quantile_cont(gain, 0.025) AS lo, quantile_cont(gain, 0.975) AS hi, avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END) AS better, max(point) AS point, max(items) AS items FROM
      (SELECT rep, sum({c} * num) / sum({c} * den) AS gain FROM (SELECT item, {_KEYSQL} AS k, sum(w * (abs(y - {a}) - abs(y - {b}))) AS num, sum(w) * 1.0 AS den FROM {frame} GROUP BY item) s CROSS JOIN draws GROUP BY rep) r
      CROSS JOIN (SELECT sum(w * (abs(y - {a}) - abs(y - {b}))) / sum(w) AS point, count(DISTINCT item) AS items FROM {frame}) p"""


@query("paired_bootstrap", "~point ~lo ~hi ~better #items", _boot_sql("fr", "A", "B"))
def paired_bootstrap(d: Data):
    return metrics.paired_bootstrap(metrics.item_scores(d.frame, "A", "B"))


_CANDS = {"half": "0.5", "mild": "0.8", "strong": "0.3"}


@query("candidate_gate", "candidate ~worst_lo ~mean_gain #adopt",
       "SELECT candidate, min(lo) AS worst_lo, avg(point) AS mean_gain, min(CASE WHEN lo > 0 THEN 1 ELSE 0 END) AS adopt FROM (" + " UNION ALL ".join(
           f"SELECT '{n}' AS candidate, * FROM ({_boot_sql(f'(SELECT *, A * {m} AS C FROM fr WHERE off % 2 = {s}) z', 'A', 'C')}) q{n}{s}" for n, m in _CANDS.items() for s in (0, 1)) + ") u GROUP BY candidate")
def candidate_gate(d: Data):
    """Two validation schemes stand in as windows with even and with odd offset."""
    out = None
    for n, m in _CANDS.items():
        for s in (0, 1):
            frame = d.frame.where(f"off % 2 = {s}").withColumn("C", F.col("A") * float(m))
            one = metrics.paired_bootstrap(metrics.item_scores(frame, "A", "C")).withColumn("candidate", F.lit(n))
            out = one if out is None else out.unionByName(one)
    return selection.candidate_gate(out)


@query("seed_average", "item site #off #h ~pred #seeds",
       "SELECT item, site, off, h, avg(A * m) AS pred, count(*) AS seeds FROM fr CROSS JOIN (SELECT unnest([0.9, 1.0, 1.2]) AS m) s GROUP BY item, site, off, h")
def seed_average(d: Data):
    preds = d.frame.selectExpr("item", "site", "off", "h", "explode(array(A * 0.9d, A * 1.0d, A * 1.2d)) as pred")
    return metrics.seed_average(preds, ["item", "site", "off", "h"])


# Selection over real fits: the key levels of the back-off medians, then the least group size.
_BUNDLES = {"horizon": [["h"]], "weekday": [["h", "d1_dow"], ["h"]], "pattern": [["h", "pattern"], ["h"]], "whole": models.BACKOFF_LEVELS}
_LEAST = [40, 20, 80]
CTES["bkt"] = "SELECT b.* REPLACE (t.fold AS fold) FROM bk b JOIN tf_d t ON b.item = t.item"
CTES["fits"] = " UNION ALL ".join(
    f"SELECT '{b}' AS bundle, {n} AS least, {i} AS bpos, {j} AS npos, g.e AS group_score, t.e AS time_score FROM (SELECT avg(abs(y - pred)) AS e FROM ({_backoff_sql('bk', lv, 'median(y)', n, 'pred')}) a) g "
    f"CROSS JOIN (SELECT avg(abs(y - pred)) AS e FROM ({_backoff_sql('bkt', lv, 'median(y)', n, 'pred')}) b) t" for i, (b, lv) in enumerate(_BUNDLES.items()) for j, n in enumerate(_LEAST))


def _stage_sql(n: int, rows: str, pos: str) -> str:
    """Configurations of one stage against its first, and the one that is chosen."""
    return f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY CASE WHEN accepted = 1 THEN 0 WHEN {pos} = 0 THEN 1 ELSE 2 END, mean, {pos}) = 1 THEN 1 ELSE 0 END AS chosen FROM
      (SELECT r.*, {n} AS stage, (r.group_score + r.time_score) / 2 AS mean, (f.group_score - r.group_score + f.time_score - r.time_score) / 2 AS gain,
        CASE WHEN least(f.group_score - r.group_score, f.time_score - r.time_score) > -1e-9 AND greatest(f.group_score - r.group_score, f.time_score - r.time_score) > 0.0005 THEN 1 ELSE 0 END AS accepted
       FROM ({rows}) r CROSS JOIN (SELECT * FROM ({rows}) z WHERE {pos} = 0) f) s"""


CTES["stage_a"] = _stage_sql(1, "SELECT * FROM fits WHERE npos = 0", "bpos")
CTES["stage_b"] = _stage_sql(2, "SELECT * FROM fits WHERE bundle = (SELECT bundle FROM stage_a WHERE chosen = 1)", "npos")


@query("stage_selection", "#stage bundle #least fingerprint ~group_score ~time_score ~mean ~gain #accepted #chosen",
       """SELECT *, md5(concat('{"bundle":"', bundle, '","least":', least, '}')) AS fingerprint FROM (SELECT * FROM stage_a UNION ALL SELECT * FROM stage_b) u""")
def stage_selection(d: Data):
    """Greedy stages over back-off fits, scored on grouped folds and on time blocks, with a ledger of fits."""
    late = folds.time_folds(group_items(d)).select("item", F.col("fold").alias("time_fold"))
    rows = durable(spread_join(backoff_rows(d), late, ["item"], "site", "inner").selectExpr(
        "h", "d1_dow", "pattern", "sb", "y", "fold as group_fold", "time_fold"))

    schemes = {s: f"{s}_fold" for s in selection.SCHEMES}
    medians = durable(models.scheme_medians(rows, models.BACKOFF_LEVELS, 5, list(schemes.values())))  # of the levels of every bundle

    def score(config: dict, scheme: str) -> float:
        own = medians.where(F.col("scheme") == schemes[scheme])
        fit = models.backoff_from(own, rows.withColumn("fold", F.col(schemes[scheme])), models.BACKOFF_LEVELS, _BUNDLES[config["bundle"]], config["least"], "pred")
        return fit.agg(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]

    ledger = f"{d.spark.sparkContext.getCheckpointDir()}/fits-{uuid.uuid4().hex}"
    log = selection.choose_stages(d.spark, {"bundle": "horizon", "least": _LEAST[0]}, [("bundle", list(_BUNDLES)), ("least", _LEAST)], score, ledger)
    return d.spark.createDataFrame(log, "stage int, bundle string, least int, fingerprint string, group_score double, time_score double, mean double, gain double, accepted int, chosen int")


# A score log from the rows: configurations shrink model A, seeds are fifths of the items.
CTES["slog"] = """SELECT c.config, c.n_features, CASE WHEN f.off % 2 = 0 THEN 'group' ELSE 'time' END AS scheme, k.fold AS seed, avg(abs(y - A * c.m)) AS score
  FROM fr f JOIN gf_d k ON f.item = k.item CROSS JOIN (VALUES ('base', 1.0, 40), ('c09', 0.9, 30), ('c07', 0.7, 35), ('c05', 0.5, 20)) c(config, m, n_features) GROUP BY 1, 2, 3, 4"""
_CONFIGS = [("base", 1.0, 40), ("c09", 0.9, 30), ("c07", 0.7, 35), ("c05", 0.5, 20)]


def score_log(d: Data):
    """One pass: the configurations are columns of the aggregate."""
    rows = folded(d, d.frame).withColumn("scheme", F.when(F.col("off") % 2 == 0, "group").otherwise("time"))
    wide = rows.groupBy("scheme", F.col("fold").alias("seed")).agg(*[F.avg(F.abs(F.col("y") - F.col("A") * m)).alias(c) for c, m, _ in _CONFIGS])
    return wide.select("scheme", "seed", F.inline(F.array(*[F.struct(F.lit(c).alias("config"), F.lit(n).alias("n_features"), F.col(c).alias("score")) for c, _, n in _CONFIGS])))


@query("noise_floor", "config scheme ~mean ~std ~range ~threshold",
       "SELECT *, avg(std) OVER () * 2.8 AS threshold FROM (SELECT config, scheme, avg(score) AS mean, stddev_samp(score) AS std, max(score) - min(score) AS range FROM slog GROUP BY config, scheme) x")
def noise_floor(d: Data):
    return metrics.noise_floor(score_log(d))


CTES["smean"] = "SELECT config, n_features, scheme, avg(score) AS score FROM slog GROUP BY config, n_features, scheme"


@query("config_select", "config ~group_score ~time_score ~gain_group ~gain_time ~mean #accepted",
       """SELECT *, (group_score + time_score) / 2.0 AS mean, CASE WHEN gain_group > -1e-9 AND gain_time > -1e-9 AND greatest(gain_group, gain_time) > 0.0005 THEN 1 ELSE 0 END AS accepted FROM
          (SELECT g.config, g.score AS group_score, t.score AS time_score, bg.score - g.score AS gain_group, bt.score - t.score AS gain_time FROM smean g JOIN smean t ON g.config = t.config AND t.scheme = 'time'
           CROSS JOIN (SELECT score FROM smean WHERE config = 'base' AND scheme = 'group') bg CROSS JOIN (SELECT score FROM smean WHERE config = 'base' AND scheme = 'time') bt WHERE g.scheme = 'group') x""")
def config_select(d: Data):
    mean = score_log(d).groupBy("config", "scheme").agg(F.avg("score").alias("score"))
    return selection.two_scheme_gate(mean, "base").withColumnsRenamed({"group": "group_score", "time": "time_score"})


@query("config_smallest", "config #n_features ~mean ~gap",
       """SELECT * FROM (SELECT *, mean - min(mean) OVER () AS gap FROM (SELECT config, n_features, avg(score) AS mean FROM smean GROUP BY config, n_features) x) y
          WHERE gap < 0.05 ORDER BY n_features, config LIMIT 1""")
def config_smallest(d: Data):
    mean = score_log(d).groupBy("config", "n_features", "scheme").agg(F.avg("score").alias("score"))
    return selection.choose_small(mean, 0.05)


@query("result_ladder", "#stage config ~mean ~gain",
       """SELECT stage, config, mean, lag(mean) OVER (ORDER BY stage) - mean AS gain FROM
          (SELECT n_features // 10 AS stage, arg_min(config, mean) AS config, min(mean) AS mean FROM (SELECT config, n_features, avg(score) AS mean FROM smean GROUP BY config, n_features) x GROUP BY 1) y""")
def result_ladder(d: Data):
    mean = score_log(d).groupBy("config", "n_features", "scheme").agg(F.avg("score").alias("score"))
    return selection.ladder(mean.withColumn("stage", F.expr("n_features div 10")))


@query("ledger_rank", "file ~expected #place",
       """SELECT file, round(score - 0.0087, 5) AS expected, row_number() OVER (ORDER BY round(score - 0.0087, 5) NULLS LAST, file) AS place FROM
          (SELECT concat(config, '_', scheme) AS file, score FROM smean) x""")
def ledger_rank(d: Data):
    mean = score_log(d).groupBy("config", "scheme").agg(F.avg("score").alias("score"))
    entries = mean.selectExpr("concat(config, '_', scheme) as file", "score")
    return selection.ledger_rank(entries)
