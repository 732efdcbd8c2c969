"""Writers. A file that exists is never overwritten unless the caller asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``id, total_ticket`` in id order as CSV; range-partitioned, so the sort is distributed."""
    (results.select("id", F.col("total_ticket").cast("bigint").alias("total_ticket"))
     .orderBy("id").write.mode(mode).option("header", True).csv(path))


def checked_results(results: DataFrame, requests: DataFrame) -> DataFrame:
    """``id, total_ticket`` of the requested ids; evaluating it fails on any id that does not fit.

    Fails for an id that is given twice, asked for twice, missing, or not asked for, and for a value that is
    null, negative, NaN or infinite. The checks ride on the one shuffle that brings ids together.
    """
    asked = requests.select("id", F.lit(1).alias("_asked"), F.lit(0).alias("_given"), F.lit(None).cast("double").alias("_x"))
    given = results.select("id", F.lit(0).alias("_asked"), F.lit(1).alias("_given"), F.col("total_ticket").cast("double").alias("_x"))
    ids = asked.unionByName(given).groupBy("id").agg(F.sum("_asked").alias("_asked"), F.sum("_given").alias("_given"), F.max("_x").alias("_x"))
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what}: id "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("bigint")
    fits = F.col("_x").isNotNull() & ~F.isnan("_x") & (F.col("_x") >= 0) & (F.col("_x") < float("inf"))
    value = (F.when(F.col("id").isNull(), fail("no id")).when(F.col("_asked") == 0, fail("not asked for")).when(F.col("_asked") > 1, fail("asked for twice"))
             .when(F.col("_given") == 0, fail("missing")).when(F.col("_given") > 1, fail("given twice"))
             .when(~fits, fail("no finite value")).otherwise(F.col("_x").cast("bigint")))
    return ids.select("id", value.alias("total_ticket"))


def write_checked(results: DataFrame, requests: DataFrame, path: str) -> None:
    """Write the results in id order, or fail and leave nothing at ``path``, which must not exist."""
    spark = results.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(where):
        raise FileExistsError(path)
    try:
        write_results(checked_results(results, requests), path)
    except Exception:
        files.delete(where, True)
        raise


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    predictions.write.mode(mode).parquet(path)


def write_windows(windows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The window table, partitioned by the month of its first day."""
    (windows.withColumn("d1_month", F.date_format("d1", "yyyy-MM"))
     .write.mode(mode).partitionBy("d1_month").parquet(path))


def append_ledger(entry: DataFrame, path: str) -> None:
    """Append-only run ledger; the latest entry per file wins when it is read back."""
    entry.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each file in the ledger."""
    log = spark.read.parquet(path)
    return log.groupBy("file").agg(F.max_by(F.struct(*[c for c in log.columns if c != "file"]), "logged_at").alias("_e")).select("file", "_e.*")
