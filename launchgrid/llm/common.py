"""Shared pieces of the text operators: durable tables, code shipping, connected components."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: weakref.WeakSet = weakref.WeakSet()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="launchgrid-shared-"))
    return made


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per context, for the Python code of the tasks."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="launchgrid-code-")) / f"launchgrid-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def durable(df: DataFrame, name: str = "part") -> DataFrame:
    """Write to the shared folder and read back: later steps survive the loss of any executor.

    The shuffle files behind the table are not needed any more and are given back at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    with setting(spark, CLEAN_UP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for f in df.inputFiles()[:1]:
        folder = hadoop.Path(f).getParent().getParent()
        if folder.getName().startswith("llm-"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session sets them for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(docs: DataFrame, key: str, value: str) -> DataFrame:
    """Key and value alone under fixed names, so that other columns cannot clash; null text is empty."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(value), F.lit("")).alias("text"))


def slices(batch, rows: int = 512):
    """Cut an Arrow batch so that the Python copies of its texts stay small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


_owner: list = [None, None]


def own_caches(name: object, clear) -> None:
    """Say whose caches this worker process holds from now on; those of another operator are emptied.

    Workers outlive stages, and what a stage before has kept would count against the memory of this one.
    """
    if _owner[0] != name and _owner[1]:
        _owner[1]()
    _owner[:] = name, clear


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a public finaliser of the splitmix kind)."""
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        if not len(a) or (before == root).all() and not keep.any():
            break
    while (root != root[root]).any():
        root = root[root]
    return root


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link in (a, b): the smallest node reachable.

    Alternating large and small stars: links are only ever rewritten, so their number never
    grows. The minimum per node is written before it meets the links, so that a node with very
    many links joins as two plain exchanges, which Spark can split. Done when only stars are left:
    no node has two smaller neighbours, or one smaller and one larger.
    """
    links = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(
            F.min("b").alias("m"), F.count_if(F.col("b") < F.col("a")).alias("below"), F.count_if(F.col("b") > F.col("a")).alias("above"),
        ).withColumn("m", F.least("a", "m")), "least")
        if least.where("below > 1 or below = 1 and above > 0").isEmpty():
            discard(links)
            return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
        large = durable(both.where("b > a").join(least.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = durable(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        old, links = links, durable(small.where("a <> b").distinct(), "links")
        for x in (old, least, large, low):
            discard(x)
    raise RuntimeError("components did not settle")
