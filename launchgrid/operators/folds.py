"""Fold assignment: grouped, size-ordered, purged time blocks, and time holdouts.

Assignments are made on the item table, one row per item; its order is exact and never passes
through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from launchgrid.functions.joins import one_row, spread_join
from launchgrid.functions.ordered import HOT_VALUES, near_equal_block, ranked


def items_of(rows: DataFrame) -> DataFrame:
    """One row per item with the first day of its release window and its row count."""
    return rows.groupBy("item").agg(F.min("d1").alias("d1"), F.count(F.lit(1)).alias("n_rows"))


def group_folds(items: DataFrame, k: int = 5, hot: int = HOT_VALUES) -> DataFrame:
    """``item, fold``: items in name order dealt round."""
    return ranked(items, [], [F.col("item")], hot=hot).select("item", (F.col("rn") % k).cast("int").alias("fold"))


def keyed_folds(items: DataFrame, key, k: int = 5, hot: int = HOT_VALUES) -> DataFrame:
    """Folds by a group key: groups from the largest down, dealt round; an unknown key stands alone."""
    named = items.withColumn("grp", F.coalesce(key, F.col("item")))
    sizes = named.groupBy("grp").agg(F.sum("n_rows").alias("_size"))
    order = ranked(sizes.withColumn("_neg", -F.col("_size")), [], [F.col("_neg"), F.col("grp")], hot=hot)
    return spread_join(named, order.select("grp", (F.col("rn") % k).cast("int").alias("fold")), ["grp"], "item", "inner").select(
        "item", "grp", "fold")


def time_folds(items: DataFrame, k: int = 5, hot: int = HOT_VALUES) -> DataFrame:
    """``item, d1, fold``: items by first day and name, cut into near-equal runs."""
    order = ranked(items, [], [F.col("d1"), F.col("item")], total="_n", hot=hot)
    return order.select("item", "d1", near_equal_block(F.col("rn"), F.col("_n"), k).alias("fold"))


def fold_blocks(folds: DataFrame) -> DataFrame:
    """Day span of every time fold, up to the last target day: at most ``k`` rows."""
    return folds.groupBy("fold").agg(F.min("d1").alias("start"), F.date_add(F.max("d1"), 9).alias("end"))


def purged_training(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Training rows of each fold: other items, and no window that overlaps the fold's block.

    The blocks travel as one array of at most ``k`` entries, so a row meets its folds without a
    range join.
    """
    blocks = fold_blocks(folds).agg(F.collect_list(F.struct("fold", "start", "end")).alias("_blocks"))
    own = spread_join(rows, folds.select("item", F.col("fold").alias("own_fold")), ["item"], "site")
    free = F.filter("_blocks", lambda b: (F.coalesce(F.col("own_fold"), F.lit(-1)) != b["fold"])
                    & ~((F.col("d1") <= b["end"]) & (F.date_add("d1", 9) >= b["start"])))
    return own.crossJoin(one_row(blocks)).withColumn("train_for", F.explode(F.transform(free, lambda b: b["fold"]))).drop("_blocks")


def time_holdout(items: DataFrame, share: float = 0.2, hot: int = HOT_VALUES) -> DataFrame:
    """Items from the cut day on; the cut is the element at ``share`` from the end in day order."""
    order = ranked(items, [], [F.col("d1"), F.col("item")], total="_n", hot=hot)
    cut = order.where(F.col("rn") == F.floor((1 - share) * F.col("_n"))).agg(F.min("d1").alias("cut"))
    return items.crossJoin(one_row(cut)).select("item", "d1", "cut", (F.col("d1") >= F.col("cut")).cast("int").alias("late"))
