"""Session settings and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("launchgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder the cluster names.

    Only a local master may go without a folder; it then gets a temporary one.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def durable_table(df: DataFrame) -> DataFrame:
    """A wide table that several steps read, written once: its readers open only their columns, in splits of bounded size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def durable_parts(df: DataFrame, by: list[str], spread: str) -> DataFrame:
    """The rows as a written table in folders by ``by``, so that a reader of some of them opens those files only.

    Rows are dealt out by ``by`` and a hash of ``spread``: a large folder is written by many tasks, into one file each.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    salt = F.pmod(F.xxhash64(spread), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    df.repartition(*by, salt).write.partitionBy(*by).parquet(path)
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between steps, which all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="launchgrid-ckpt-"))
    return sc.getCheckpointDir()
