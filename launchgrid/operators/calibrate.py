"""Grid calibration of ratio predictions.

A grid is never joined to the rows: one pass sums what every grid value's error needs, with partial
sums on the map side, and the argmin is taken on the handful of groups. Ties go to the earlier value.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from launchgrid.functions.joins import one_row
from launchgrid.functions.ordered import quantiles
from launchgrid.functions.scalar import tenth_bin
from launchgrid.session import durable_table


def _grid(lo: float, hi: float, step: float) -> list[float]:
    n = int(round((hi - lo) / step))
    return [round(lo + i * step, 4) for i in range(n + 1)]


# The search grids.
BLEND_GRID = _grid(0.0, 1.0, 0.1)
ZERO_GRID = _grid(0.0, 1.30, 0.05)
HORIZON_GRID = _grid(0.85, 1.15, 0.01)
WIDE_GRID = _grid(0.20, 1.40, 0.01)
SNAP_GRID = [0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.10, 0.13, 0.16, 0.20, 0.25, 0.30]
MULT_GRID = _grid(0.80, 1.20, 0.01)
TWOPART_GRID = [0.0] + _grid(0.40, 1.60, 0.05)
TAU_GRID = [0.0] + _grid(0.02, 0.40, 0.02)
THRESHOLD_GRID = _grid(0.30, 0.90, 0.02)
LEVEL_GRID = _grid(0.40, 2.00, 0.02)
SNAPQ_GRID = _grid(0.0, 0.90, 0.02)
MIN_BIN = 200


def simplex(k: int, step: float) -> list[tuple[float, ...]]:
    """Non-negative weights summing to one, in lexicographic order."""
    n = int(round(1 / step))
    return [tuple(round(i / n, 4) for i in (*head, n - sum(head))) for head in product(range(n + 1), repeat=k - 1) if sum(head) <= n]


def grid_errors(frame: DataFrame, keys: list[str], grid: list, error, weight: str | None = None) -> DataFrame:
    """``keys, n, errs``: summed error of every grid value as an array, one pass over the rows."""
    w = f"{weight} * " if weight else ""
    sums = [F.expr(f"sum({w}({error(g)}))").alias(f"_e{i}") for i, g in enumerate(grid)]
    den = F.sum(weight) if weight else F.count(F.lit(1))
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), den.alias("den"), *sums).select(
        *keys, "n", "den", F.array(*[f"_e{i}" for i in range(len(grid))]).alias("errs"))


def mult_errors(frame: DataFrame, keys: list[str], grid: list[float], pred: str, weight: str | None = None) -> DataFrame:
    """The same for the error of ``g * pred``, from three sums per interval between grid values.

    |y - g p| is linear in g on either side of y / p, so a row only needs to say between which grid
    values its turning point lies; running sums over the intervals give every grid value its error. A
    turning point on a grid value adds nothing there, so the side it is put on does not matter. After
    the first value the grid is evenly spaced.
    """
    w = weight or "1"
    n, step = len(grid), grid[2] - grid[1]
    turned = frame.selectExpr(
        *keys, f"cast({w} as double) as _w", f"y * sign({pred}) as _y", f"cast(abs({pred}) as double) as _p", "abs(y) as _a")
    t = f"(_y / nullif(_p, 0d))"
    cell = (f"case when _p = 0 then 0 when {t} <= {grid[0]}d then 0 "
            f"else cast(least(1d + greatest(ceil(({t} - {grid[1]}d) / {step}d), 0d), {n}d) as int) end as _bin")
    sums = turned.selectExpr("*", cell).groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("den"), F.sum(F.expr("case when _p > 0 then _w * _y else 0d end")).alias("sy"),
        F.sum(F.expr("_w * _p")).alias("sp"), F.sum(F.expr("case when _p = 0 then _w * _a else 0d end")).alias("c"))
    bins = sums.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("den").alias("den"), F.sum("sy").alias("_sy"), F.sum("sp").alias("_sp"), F.sum("c").alias("_c"),
        F.collect_list(F.struct("_bin", "sy", "sp")).alias("_b"))
    below = lambda c: f"aggregate(filter(_b, b -> b._bin <= i), 0d, (a, b) -> a + b.{c})"
    values = ", ".join(f"{g}d" for g in grid)
    return bins.selectExpr(*keys, "n", "den", f"transform(array({values}), (g, i) -> _c + (_sy - g * _sp) "
                           f"- 2 * ({below('sy')} - g * {below('sp')})) as errs")


def best_of(errors: DataFrame, grid: list, name: str = "best", floor: int = 0, default: float = 1.0) -> DataFrame:
    """First grid value with the least error (to nine places); the default where a group has too few rows."""
    errors = errors.withColumn("errs", F.expr("transform(errs, e -> round(e, 9))"))
    at = F.array_position("errs", F.array_min("errs")).cast("int")
    values = F.array(*[F.lit(float(g)) for g in grid])
    pick = F.element_at(values, at)
    if floor:
        pick = F.when(F.col("n") < floor, F.lit(default)).otherwise(pick)
    return errors.withColumn(name, pick).withColumn("err", F.array_min("errs") / F.col("den"))


def blend_error(g: float) -> str:
    return f"abs(y - {g}d * A - {round(1 - g, 4)}d * B)"


def calibrate_blend(frame: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    err = grid_errors(frame, keys, BLEND_GRID, blend_error, weight)
    return best_of(err, BLEND_GRID, "weight_a")


def calibrate_simplex(frame: DataFrame, preds: list[str], step: float = 0.1) -> DataFrame:
    grid = simplex(len(preds), step)
    mix = lambda ws: "abs(y - (" + " + ".join(f"{w}d * {p}" for w, p in zip(ws, preds)) + "))"
    err = grid_errors(frame, [], grid, mix)
    at = F.array_position("errs", F.array_min("errs")).cast("int")
    arr = F.array(*[F.struct(*[F.lit(w).alias(f"w_{p}") for w, p in zip(ws, preds)]) for ws in grid])
    return err.select("n", F.element_at(arr, at).alias("_b"), (F.array_min("errs") / F.col("n")).alias("err")).select("n", "_b.*", "err")


def calibrate_zero(frame: DataFrame, keys: list[str], pred: str, weight: str | None = None) -> DataFrame:
    """Multiplier per tenth of the zero score, 1 where a tenth has too few rows."""
    binned = frame.withColumn("zbin", tenth_bin(F.col("p0")))
    return best_of(mult_errors(binned, [*keys, "zbin"], ZERO_GRID, pred, weight), ZERO_GRID, "zero_mult", MIN_BIN)


def zero_threshold(frame: DataFrame, keys: list[str], pred: str, weight: str | None = None) -> DataFrame:
    err = grid_errors(frame, keys, THRESHOLD_GRID, lambda t: f"case when p0 > {t}d then abs(y) else abs(y - {pred}) end", weight)
    return best_of(err, THRESHOLD_GRID, "threshold")


def two_part(frame: DataFrame, score: str, positive: str, parts: int = 10) -> DataFrame:
    """Multiplier per decile of the zero score on the positive-part prediction."""
    edges = quantiles(frame, [], score, {f"e{i}": i / parts for i in range(1, parts)}).drop("n")
    bin_ = sum([(F.col(score) >= F.col(f"e{i}")).cast("int") for i in range(1, parts)], F.lit(0))
    binned = frame.crossJoin(one_row(edges)).withColumn("decile", bin_)
    return best_of(mult_errors(binned, ["decile"], TWOPART_GRID, positive), TWOPART_GRID, "mult")


def calibrate_horizon(frame: DataFrame, keys: list[str], pred: str, grid: list[float] = HORIZON_GRID, weight: str | None = None) -> DataFrame:
    """Multiplier per key, with the error at 1 and a flag for an optimum on the lower edge."""
    err = mult_errors(frame, keys, grid, pred, weight)
    one = F.element_at("errs", grid.index(1.0) + 1) / F.col("den")
    return best_of(err, grid, "mult").withColumn("err_at_1", one).withColumn("pinned", (F.col("mult") <= grid[0] + 1e-9).cast("int"))


def rounded_error(pred: str, g: float) -> str:
    """Error after rounding ``g * pred`` to whole units, half up, as the result file has them."""
    return f"abs(qty - floor(greatest({float(g)}d * {pred}, 0d) * scale + 0.5d)) / scale"


def rounded_errors(frame: DataFrame, keys: list[str], grid: list[float], pred: str, weight: str | None = None) -> DataFrame:
    """Errors on the rounded objective. It is a step function of the multiplier with about scale * pred
    steps a row, so each grid value has its own sum in one pass; rows do not meet the grid in a join."""
    return grid_errors(frame, keys, grid, lambda g: rounded_error(pred, g), weight)


def calibrate_rounded(frame: DataFrame, keys: list[str], pred: str, grid: list[float] = HORIZON_GRID, weight: str | None = None) -> DataFrame:
    """Multiplier per key that is best after rounding, with the error at 1."""
    err = rounded_errors(frame, keys, grid, pred, weight)
    return best_of(err, grid, "mult").withColumn("err_at_1", F.element_at("errs", grid.index(1.0) + 1) / F.col("den"))


def snap_and_mult(frame: DataFrame, pred: str) -> DataFrame:
    """Zero-snap threshold and horizon multipliers together.

    Below a threshold the error is that of zero, above it that of the multiplied prediction, so sums
    per (h, interval between thresholds) give every combination: one pass with one set of columns.
    """
    step = sum([(F.col(pred) >= t).cast("int") for t in SNAP_GRID], F.lit(0))
    cut = frame.withColumn("_cut", step)
    zero = cut.groupBy("h", "_cut").agg(F.sum(F.abs("y")).alias("_z"))
    sums = mult_errors(cut, ["h", "_cut"], MULT_GRID, pred).join(F.broadcast(zero), ["h", "_cut"])
    # From here on: 7 horizons x 14 intervals x 13 thresholds.
    tried = sums.select("h", "_cut", "n", "_z", "errs", F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(t).alias("snap")) for i, t in enumerate(SNAP_GRID)])))
    above = F.col("_cut") > F.col("pos")
    per = tried.groupBy("pos", "snap", "h").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.when(above, F.col("errs")[i]).otherwise(F.col("_z"))) for i in range(len(MULT_GRID))]).alias("errs"))
    values = F.array(*[F.lit(v) for v in MULT_GRID])
    per = per.select("pos", "snap", "h", "n", F.array_min("errs").alias("e"),
                     F.element_at(values, F.array_position("errs", F.array_min("errs")).cast("int")).alias("mult"))
    total = per.groupBy("pos").agg(F.sum("e").alias("_e"))
    best = total.agg(F.min(F.struct(F.round("_e", 9).alias("_e"), F.col("pos"))).alias("_b"))
    return (per.join(F.broadcast(best.select(F.col("_b.pos").alias("pos"))), "pos")
            .select("snap", "h", "mult", (F.col("e") / F.col("n")).alias("err")))


def quantile_snap(frame: DataFrame, pred: str, probs: list[float] = SNAPQ_GRID) -> DataFrame:
    """Per horizon: the quantile of the prediction below which to predict zero.

    Quantiles take the lower element, and none beyond the true zero share is tried.
    """
    names = [f"q{i}" for i in range(len(probs))]
    zero = (F.col("y") == 0).cast("double")
    edges = quantiles(frame, ["h"], pred, dict(zip(names, probs)), interpolate=False, extra={"_z": zero})
    rows = frame.join(F.broadcast(edges), "h")  # seven rows of edges
    # A quantile beyond the true zero share gets an infinite error inside the sum's result.
    sums = [F.when(F.first("_z") / F.first("n") >= q, F.expr(f"sum(case when {pred} <= {n} then abs(y) else abs(y - {pred}) end)"))
            .otherwise(F.lit(float("inf"))).alias(f"_e{i}") for i, (n, q) in enumerate(zip(names, probs))]
    err = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("_z").alias("_z"), *sums,
                                *[F.first(n).alias(n) for n in names])
    at = F.array_position("errs", F.array_min("errs")).cast("int")
    return err.withColumn("errs", F.array(*[f"_e{i}" for i in range(len(probs))])).select(
        "h", "n", (F.col("_z") / F.col("n")).alias("zero_share"), F.element_at(F.array(*[F.lit(q) for q in probs]), at).alias("snap_q"),
        F.element_at(F.array(*names), at).alias("edge"), (F.array_min("errs") / F.col("n")).alias("err"))


# ------------------------------------------------------------------ cross-fitting
def others(frame: DataFrame, k: int) -> DataFrame:
    """Fold-level statistics repeated for the folds they may train: sums are additive over folds."""
    return frame.withColumn("fit_for", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))))


def crossfit_grid(errors: DataFrame, keys: list[str], grid: list, k: int, name: str, floor: int = 0) -> DataFrame:
    """Best grid value per (fold, keys), fitted on the other folds.

    ``errors`` are grid errors keyed by (fold, keys): the rows are summed once per own fold, and the
    error of "all other folds" is a sum of those sums.
    """
    n = len(grid)
    spread = others(errors, k).groupBy("fit_for", *keys).agg(
        F.sum("n").alias("n"), F.sum("den").alias("den"), *[F.sum(F.col("errs")[i]).alias(f"_s{i}") for i in range(n)])
    fit = spread.withColumn("errs", F.array(*[f"_s{i}" for i in range(n)])).withColumnRenamed("fit_for", "fold")
    return best_of(fit, grid, name, floor).select("fold", *keys, name)


def crossfit_post(frame: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """Blend, zero-tenth and horizon steps, each fitted on the other folds: adds ``post``.

    A later fit for fold f sees the other folds' rows under fold f's own earlier parameters. There are
    k of those at most, so they travel as one array, and errors are summed per (parameters, own fold)
    in one pass; what fold f may see is a sum of those sums.
    The parameter tables have at most k, 10 k and 7 k rows. Each is written, as a later plan would else hold
    the plans of all earlier fits, several times over. The rows are read by every fit, so hand in a frame that is written.
    """
    w = durable_table(crossfit_grid(grid_errors(frame, ["fold"], BLEND_GRID, blend_error, weight), [], BLEND_GRID, k, "wa"))
    weights = w.agg(F.map_from_entries(F.collect_list(F.struct("fold", "wa"))).alias("_wa"))
    rows = frame.withColumn("zbin", tenth_bin(F.col("p0"))).crossJoin(F.broadcast(weights))
    out = rows.withColumn("wa", F.col("_wa")[F.col("fold")]).withColumn("r1", F.expr("wa * A + (1 - wa) * B")).drop("_wa")
    # Folds with the same blend share their sums.
    tried = rows.selectExpr("*", "explode(array_distinct(map_values(_wa))) as wa").withColumn("r1", F.expr("wa * A + (1 - wa) * B"))
    of_fold = lambda errors, keys, n: w.select(F.col("fold").alias("fit_for"), "wa").join(errors, "wa").where("fold <> fit_for").groupBy("fit_for", *keys).agg(
        F.sum("n").alias("n"), F.sum("den").alias("den"), *[F.sum(F.col("errs")[i]).alias(f"_s{i}") for i in range(n)]).select(
        "fit_for", *keys, "n", "den", F.array(*[f"_s{i}" for i in range(n)]).alias("errs"))
    zero = of_fold(mult_errors(tried, ["wa", "fold", "zbin"], ZERO_GRID, "r1", weight), ["zbin"], len(ZERO_GRID))
    zm = durable_table(best_of(zero, ZERO_GRID, "zm", MIN_BIN).select("fit_for", "zbin", "zm"))
    # A row of fold g trains the folds f <> g that have its blend, each with its own zero multiplier.
    steps = zm.join(w.select(F.col("fold").alias("fit_for"), "wa"), "fit_for").groupBy("wa", "zbin", "zm").agg(F.collect_list("fit_for").alias("fits"))
    second = tried.join(F.broadcast(steps), ["wa", "zbin"]).withColumn("r2", F.expr("r1 * zm"))
    errs = mult_errors(second, ["fits", "fold", "h"], HORIZON_GRID, "r2", weight)
    n = len(HORIZON_GRID)
    level = errs.withColumn("fit_for", F.explode("fits")).where("fold <> fit_for").groupBy("fit_for", "h").agg(
        F.sum("n").alias("n"), F.sum("den").alias("den"), *[F.sum(F.col("errs")[i]).alias(f"_s{i}") for i in range(n)])
    hm = durable_table(best_of(level.withColumn("errs", F.array(*[f"_s{i}" for i in range(n)])), HORIZON_GRID, "hm").select("fit_for", "h", "hm"))
    out = (out.join(F.broadcast(zm.withColumnRenamed("fit_for", "fold")), ["fold", "zbin"], "left")
           .join(F.broadcast(hm.withColumnRenamed("fit_for", "fold")), ["fold", "h"], "left"))
    return out.withColumn("post", F.expr("greatest(r1 * coalesce(zm, 1.0) * coalesce(hm, 1.0), 0.0)"))


# Step lists that compete, plainest first; each step is fitted on the other folds.
RECIPES = [("none", 0), ("blend", 1), ("horizon", 1), ("horizon_rounded", 1), ("horizon_weekday", 1), ("blend_zero", 2), ("blend_zero_horizon", 3)]


def recipe_predictions(frame: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """One column ``q_<recipe>`` per step list; parameter tables have at most 49 k rows.

    The rows are read by every fit, so hand in a frame that is written.
    """
    rows = crossfit_post(frame, k, weight).withColumns({"q_none": F.col("A"), "q_blend": F.col("r1"), "q_blend_zero": F.expr("r1 * coalesce(zm, 1.0)"),
                                                        "q_blend_zero_horizon": F.col("post")}).drop("wa", "r1", "zm", "hm", "post")
    fits = [("horizon", ["h"], mult_errors(frame, ["fold", "h"], HORIZON_GRID, "A", weight), 0),
            ("horizon_rounded", ["h"], rounded_errors(frame, ["fold", "h"], HORIZON_GRID, "A", weight), 0),
            ("horizon_weekday", ["h", "d1_dow"], mult_errors(frame, ["fold", "h", "d1_dow"], HORIZON_GRID, "A", weight), MIN_BIN)]
    for name, keys, errors, floor in fits:
        table = crossfit_grid(errors, keys, HORIZON_GRID, k, "_m", floor)
        rows = rows.join(F.broadcast(table), ["fold", *keys], "left").withColumn(f"q_{name}", F.expr("A * coalesce(_m, 1.0)")).drop("_m")
    return rows


def recipe_choice(frame: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """Pooled cross-fitted scores of every step list; the least weighted error after rounding is chosen.

    ``kept`` says whether a list is better than doing nothing. Ties go to the plainer list.
    """
    w, aggs, parts = weight or "1", [], []
    for i, (name, steps) in enumerate(RECIPES):
        q = f"q_{name}"
        aggs += [F.expr(f"avg(abs(y - {q}))").alias(f"_p{i}"), F.expr(f"sum({w} * abs(y - {q})) / sum({w})").alias(f"_w{i}"),
                 F.expr(f"sum({w} * {rounded_error(q, 1.0)}) / sum({w})").alias(f"_r{i}")]
        parts.append(F.struct(F.lit(i).alias("place"), F.lit(name).alias("recipe"), F.lit(steps).alias("steps"), F.col(f"_p{i}").alias("plain"),
                              F.col(f"_w{i}").alias("weighted"), F.col(f"_r{i}").alias("rounded")))
    scores = recipe_predictions(frame, k, weight).agg(*aggs).withColumn("_none", F.col("_r0")).select("_none", F.inline(F.array(*parts)))
    best = "min(struct(round(rounded, 9), place)) over ()"  # one row per recipe
    return scores.selectExpr("recipe", "steps", "plain", "weighted", "rounded", "_none - rounded as gain",
                             "int(round(_none - rounded, 9) > 0) as kept", f"int(place = ({best}).place) as chosen")


# ------------------------------------------------------------------ absorbing zero
def by_horizon(frame: DataFrame, pred: str) -> DataFrame:
    """One row per pair window with arrays over h 4..10 (NULL where a cell is missing)."""
    m = frame.groupBy("item", "site", "off").agg(F.map_from_entries(F.collect_list(
        F.struct("h", F.struct(F.col(pred).cast("double").alias("r"), F.col("y").alias("y"), F.col("w").alias("w")).alias("v")))).alias("_m"))
    return m.withColumn("cells", F.expr("transform(sequence(4, 10), h -> try_element_at(_m, h))")).drop("_m")


def absorb(cells: Column, tau: Column | float) -> Column:
    """Predictions with everything from the first one below ``tau`` on set to zero; NULL never triggers."""
    t = tau if isinstance(tau, Column) else F.lit(float(tau))
    first = F.array_position(F.transform(cells, lambda c: F.coalesce(c["r"] < t, F.lit(False))), True)
    return F.transform(cells, lambda c, i: F.when(c.isNull() | c["r"].isNull(), F.lit(None).cast("double")).when(
        (first > 0) & (i >= first - 1), F.lit(0.0)).otherwise(c["r"]))


def fit_tau(pairs: DataFrame, grid: list[float] = TAU_GRID, k: int = 5) -> DataFrame:
    """Absorbing threshold per fold, fitted on the other folds' weighted error: ``fold, tau``."""
    # A cell is zeroed once the least prediction so far is below tau, so that least value's place among
    # the grid values decides, and two sums per place give every tau its cost.
    cell = pairs.selectExpr("fold", "inline(transform(cells, (c, i) -> struct(c.y as y, c.w as w, c.r as r, "
                            "array_min(transform(slice(cells, 1, i + 1), x -> x.r)) as least)))").where("r is not null and y is not null")
    place = sum([(F.col("least") >= t).cast("int") for t in grid], F.lit(0))
    sums = cell.groupBy("fold", place.alias("_p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.expr("w * abs(y)")).alias("_z"), F.sum(F.expr("w * abs(y - r)")).alias("_k"))
    folded = sums.groupBy("fold").agg(F.sum("n").alias("n"), F.lit(1.0).alias("den"), F.collect_list(F.struct("_p", "_z", "_k")).alias("_b"))
    errs = folded.selectExpr("fold", "n", "den", f"transform(sequence(0, {len(grid) - 1}), i -> "
                             "aggregate(_b, 0d, (a, b) -> a + if(b._p <= i, b._z, b._k))) as errs")
    return crossfit_grid(errs, [], grid, k, "tau")


def zero_persistence(pairs: DataFrame) -> DataFrame:
    """Per horizon: windows at zero, and the share that sells again later. ``cells`` holds y."""
    later = F.expr("transform(sequence(0, 5), i -> struct(i + 4 as h, coalesce(cells[i].y = 0, false) as z, "
                   "exists(slice(cells, i + 2, 7), c -> coalesce(c.y > 0, false)) as back))")
    return (pairs.select(F.inline(later)).where("z").groupBy("h")
            .agg(F.count(F.lit(1)).alias("zero_pairs"), F.avg(F.col("back").cast("double")).alias("resurrect")))


def zero_tail(pairs: DataFrame) -> DataFrame:
    """Windows with a zero, those all zero from it on, and predictions that come back from zero."""
    first = F.expr("array_position(transform(cells, c -> coalesce(c.y, 0) = 0), true)")
    out = pairs.withColumn("_f", first.cast("int")).selectExpr(
        "int(_f > 0) as has_zero",
        "int(_f > 0 and forall(slice(cells, greatest(_f, 1), 7), c -> coalesce(c.y, 0) = 0)) as tail_zero",
        "int(exists(sequence(0, 5), i -> coalesce(cells[i].r, 0) <= 0 and coalesce(cells[i + 1].r, 0) > 0)) as violates")
    return out.agg(F.count(F.lit(1)).alias("pairs"), *[F.sum(c).alias(c) for c in ("has_zero", "tail_zero", "violates")])
