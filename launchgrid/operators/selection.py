"""Choosing a configuration from a score log, which has one row per run: small by construction."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SCHEMES = ("group", "time")


def two_scheme_gate(scores: DataFrame, base: str, margin: float = 0.0005) -> DataFrame:
    """Accept a configuration that regresses on neither scheme and gains more than the margin on one."""
    wide = scores.groupBy("config").pivot("scheme", ["group", "time"]).agg(F.first("score"))
    ref = wide.where(F.col("config") == base).select(F.col("group").alias("_g"), F.col("time").alias("_t"))
    d = wide.crossJoin(F.broadcast(ref)).selectExpr("config", "group", "time", "_g - group as gain_group", "_t - time as gain_time")
    return d.selectExpr("*", "(group + time) / 2.0 as mean",
                        f"int(gain_group > -1e-9 and gain_time > -1e-9 and greatest(gain_group, gain_time) > {margin}d) as accepted")


def ladder(scores: DataFrame) -> DataFrame:
    """Stages in order with the mean score and the gain on the stage before."""
    per = scores.groupBy("stage", "config").agg(F.avg("score").alias("mean"))
    best = per.groupBy("stage").agg(F.min(F.struct("mean", "config")).alias("_b")).select("stage", "_b.mean", "_b.config")
    return best.withColumn("gain", F.lag("mean").over(Window.orderBy("stage")) - F.col("mean"))


def choose_small(scores: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Among configurations within the tolerance of the best mean, the one with fewest features."""
    per = scores.groupBy("config", "n_features").agg(F.avg("score").alias("mean"))
    near = per.selectExpr("*", "mean - min(mean) over () as gap").where(F.col("gap") < tolerance)
    return near.agg(F.min(F.struct("n_features", "config", "mean", "gap")).alias("_b")).select("_b.*")


def candidate_gate(intervals: DataFrame) -> DataFrame:
    """Adopt a candidate whose paired interval excludes zero on every scheme."""
    return intervals.groupBy("candidate").agg(F.min("lo").alias("worst_lo"), F.avg("point").alias("mean_gain"),
                                              F.min((F.col("lo") > 0).cast("int")).alias("adopt"))


def config_fingerprint(configs: DataFrame) -> DataFrame:
    """Stable key of a configuration for cached results."""
    return configs.withColumn("fingerprint", F.md5(F.to_json(F.struct(*sorted(configs.columns))).cast("binary")))


def ledger_rank(entries: DataFrame, offset: float = 0.0087) -> DataFrame:
    """Runs by expected outside score, best first; runs without one at the end."""
    return entries.withColumn("expected", F.round(F.col("score") - F.lit(offset), 5)).withColumn(
        "place", F.row_number().over(Window.orderBy(F.asc_nulls_last("expected"), "file")))


# ------------------------------------------------------------------ selection over fits
def fingerprint(config: dict) -> str:
    """The same key as ``config_fingerprint`` gives a row with these columns."""
    return hashlib.md5(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def read_fits(spark: SparkSession, path: str) -> dict[tuple[str, str], float]:
    """(fingerprint, scheme) to score of every fit the ledger holds, which is one row each; empty where there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return {}
    return {(r.fingerprint, r.scheme): r.score for r in spark.read.schema("fingerprint string, scheme string, score double").parquet(path).collect()}


def fit_scores(spark: SparkSession, configs: list[dict], score: Callable[[dict, str], float], path: str, at_once: int = 3) -> dict[tuple[str, str], float]:
    """Scores of all configurations on every scheme; what the ledger at ``path`` holds is not fitted again.

    ``score`` runs a fit as Spark jobs; a few run side by side. Each result is appended as soon as it is
    there, so a run that broke off goes on where it was.
    """
    known = read_fits(spark, path)
    todo = {(fingerprint(c), s): c for c in configs for s in SCHEMES if (fingerprint(c), s) not in known}
    with ThreadPoolExecutor(at_once) as pool:
        runs = {pool.submit(score, c, key[1]): key for key, c in todo.items()}
        for done in as_completed(runs):
            known[runs[done]] = done.result()
            spark.createDataFrame([(*runs[done], known[runs[done]])], "fingerprint string, scheme string, score double").coalesce(1).write.mode("append").parquet(path)
    return known


def choose_stages(spark: SparkSession, start: dict, stages: list[tuple[str, list]], score: Callable[[dict, str], float], path: str,
                  margin: float = 0.0005) -> list[dict]:
    """Greedy choice, one setting per stage, the others as chosen so far; one record per configuration and stage.

    A configuration takes the place of the stage's first one if it is worse on no scheme and better on one by
    more than the margin; of several the least mean error wins, ties to the earlier value.
    """
    log, current = [], start
    for n, (setting, values) in enumerate(stages, 1):
        tried = [current] + [current | {setting: v} for v in values if v != current[setting]]
        known = fit_scores(spark, tried, score, path)
        rows = []
        for c in tried:
            own = {s: known[fingerprint(c), s] for s in SCHEMES}
            gains = [known[fingerprint(current), s] - own[s] for s in SCHEMES]
            rows.append({"stage": n, **c, "fingerprint": fingerprint(c), **{f"{s}_score": own[s] for s in SCHEMES}, "mean": sum(own.values()) / len(own),
                         "gain": sum(gains) / len(gains), "accepted": int(min(gains) > -1e-9 and max(gains) > margin), "chosen": 0})
        best = min((r for r in rows[1:] if r["accepted"]), key=lambda r: r["mean"], default=rows[0])
        best["chosen"] = 1
        current = {k: best[k] for k in start}
        log += rows
    return log
