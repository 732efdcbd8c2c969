"""Near-duplicate vectors by collision counting over one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from launchgrid.llm.common import components, durable, local_roots, ship
from launchgrid.llm.vectors import matrix, usable

TABLES, LEAD, PROJECTIONS = 4, 4, 32  # TABLES * LEAD projections lead the search, all are counted
MISS = 1e-5        # share of true pairs that the collision count may lose
WINDOW = 2.6       # half-width of a window, in deviations of a pair at the threshold
CELL = 2.0         # width of a cell
BLOCK = 2048
BROADCAST_ROWS = 100_000


def calibrated(cosine: float) -> tuple[float, int]:
    """Half-width of the windows, and the fewest collisions of a pair that is verified.

    The projections of a pair of that cosine differ by a normal value of deviation
    sqrt(2 - 2 cosine), so its collisions are binomial.
    """
    width = WINDOW * math.sqrt(max(2 - 2 * cosine, 1e-6))
    p = math.erf(WINDOW / math.sqrt(2))
    tail, least = 0.0, 0
    for c in range(PROJECTIONS + 1):
        tail += math.comb(PROJECTIONS, c) * p**c * (1 - p) ** (PROJECTIONS - c)
        if tail > MISS:
            least = c
            break
    return width, least


def directions(dimension: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, PROJECTIONS))


def links(groups: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, n, root): weighted links per vector and block, and a root of its links in the block.

    ``groups`` has vec_id, label, w and unit vector u; vectors of a label have one dimension. In each table three projections make cells
    and a fourth is sorted; a vector is stored in its own cell and asks, with its windows around
    itself, in every cell they touch. So each pair that collides in all four meets in that table, and it counts
    in the first such table only. A crowded cell is cut into blocks of stored by asking vectors.
    """
    spark = groups.sparkSession
    width, least = calibrated(cosine)
    kind = groups.schema["vec_id"].dataType.simpleString()

    def cells(batches):
        for b in (x for batch in batches for x in alike(batch)):
            p = projections(matrix(b.column(b.schema.get_field_index("u"))))
            for t in range(TABLES):
                lead = p[:, t * LEAD: t * LEAD + LEAD - 1]
                own = np.floor(lead / CELL).astype(np.int64)
                low, high = np.floor((lead - width) / CELL).astype(np.int64), np.floor((lead + width) / CELL).astype(np.int64)
                rows, cell, asks = [np.arange(len(p))], [own], [np.zeros(len(p), bool)]
                reach = int((high - low).max()) + 1
                for step in np.ndindex(*[reach] * (LEAD - 1)):
                    at = low + np.array(step)
                    ok = (at <= high).all(1)
                    rows.append(np.flatnonzero(ok)), cell.append(at[ok]), asks.append(np.ones(ok.sum(), bool))
                rows, cell = np.concatenate(rows), np.concatenate(cell)
                code = (cell[:, 0] * 1_000_003 + cell[:, 1]) * 1_000_003 + cell[:, 2]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in b.columns), pa.array(np.full(len(rows), t), pa.int64()),
                                                  pa.array(code, pa.int64()), pa.array(np.concatenate(asks))], [*b.schema.names, "t", "cell", "asks"])

    base = groups.select("vec_id", "label", "w", "u")
    lab = base.schema["label"].dataType.simpleString()
    placed = base.mapInArrow(cells, f"vec_id {kind}, label {lab}, w bigint, u array<double>, t bigint, cell bigint, asks boolean")
    sizes = durable(placed.groupBy("label", "t", "cell").agg(
        F.ceil(F.count_if(~F.col("asks")) / BLOCK).cast("int").alias("s_n"), F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("q_n")).where("s_n > 0 and q_n > 0"), "sizes")
    sized = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1).cast("array<bigint>")
    spread = placed.join(sized, ["label", "t", "cell"]).withColumn("s", F.explode(F.when(F.col("asks"), every("s_n")).otherwise(F.array(salt("s_n"))))).withColumn(
        "q", F.explode(F.when(F.col("asks"), F.array(salt("q_n"))).otherwise(every("q_n")))).drop("s_n", "q_n")

    def block(tab: pa.Table) -> pa.Table:
        ids, w, u = tab.column("vec_id").to_numpy(), tab.column("w").to_numpy(), matrix(tab.column("u"))
        asks, t = tab.column("asks").to_numpy(zero_copy_only=False), tab.column("t")[0].as_py()
        p = projections(u)
        stored = np.flatnonzero(~asks)
        stored = stored[np.argsort(p[stored, t * LEAD + LEAD - 1], kind="stable")]
        asking = np.flatnonzero(asks)
        asking = asking[np.argsort(p[asking, t * LEAD + LEAD - 1], kind="stable")]
        line = p[stored, t * LEAD + LEAD - 1]
        n, ea, eb = np.zeros(len(ids), np.int64), [], []
        for i in range(0, len(asking), 128):
            mine = asking[i: i + 128]
            lo = np.searchsorted(line, p[mine[0], t * LEAD + LEAD - 1] - width, "left")
            hi = np.searchsorted(line, p[mine[-1], t * LEAD + LEAD - 1] + width, "right")
            for j in range(lo, hi, BLOCK):
                other = stored[j: min(hi, j + BLOCK)]
                a, b = near_pairs(p[mine], p[other], t, width, least)
                a, b = mine[a], other[b]
                ok = (ids[a] != ids[b]) & ((u[a] * u[b]).sum(1) >= cosine)
                a, b = a[ok], b[ok]
                np.add.at(n, a, w[b])
                ea.append(a), eb.append(b)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ea, eb))
        names, place = np.unique(ids, return_inverse=True)
        root = names[local_roots(len(names), place[a], place[b])][place]
        some = (n > 0) | (root != ids)
        return pa.table([pa.array(ids[some]), pa.array(n[some]), pa.array(root[some])], ["vec_id", "n", "root"])

    return spread.groupBy("label", "t", "cell", "s", "q").applyInArrow(block, f"vec_id {kind}, n bigint, root {kind}")


def alike(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The rows of each dimension."""
    n = pc.list_value_length(batch.column(batch.schema.get_field_index("u")))
    return [batch.filter(pc.equal(n, x)) for x in pc.unique(n)]


def projections(u: np.ndarray) -> np.ndarray:
    """Each row on its own, so that equal rows give equal bits wherever they are computed."""
    return np.einsum("ij,jk->ik", u, directions(u.shape[1]))


def near_pairs(p: np.ndarray, other: np.ndarray, t: int, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that collide in all projections of table t, in those of no earlier table, and in enough overall."""
    count = np.zeros((len(p), len(other)), np.int8)
    ok = np.ones(count.shape, bool)
    for table in range(TABLES):
        lead = np.ones(count.shape, bool)
        for k in range(table * LEAD, table * LEAD + LEAD):
            hit = np.abs(p[:, k, None] - other[None, :, k]) <= width
            count += hit
            lead &= hit
        if table < t:
            ok &= ~lead
        elif table == t:
            ok &= lead
    for k in range(TABLES * LEAD, PROJECTIONS):
        count += np.abs(p[:, k, None] - other[None, :, k]) <= width
    return np.nonzero(ok & (count >= least))


def near_duplicates(table: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors link where their labels are equal and not null, their dimensions equal and their cosine is at least ``cosine``.
    Equal vectors of a label are joined to one before the search. Unusable vectors (see ``usable``)
    and those without label link with nothing: their component is their own id; a null key has
    a null component and is kept. Rows that repeat an id link to each other's vectors like others.
    """
    spark = table.sparkSession
    ship(spark)
    rows = table.select(F.col(key).alias("vec_id"))
    good = usable(table, key, vector, F.col(label).alias("label"), one_size=False).where("label is not null").withColumn(
        "label", F.struct(F.col("label").alias("of"), F.size("vec").alias("dimension")))
    tagged = good.select("vec_id", "label", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2"))
    groups = durable(tagged.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.any_value("vec").alias("vec")), "groups")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    top = F.array_max(F.transform("vec", F.abs))  # scaled first, so that squares stay finite
    unit = groups.select(F.col("rep").alias("vec_id"), "label", "w", F.transform("vec", lambda x: x / top).alias("vec")).withColumn("u", F.transform("vec", lambda x: x / norm))
    found = durable(links(unit, cosine), "found")
    counted = durable(found.groupBy("vec_id").agg(F.sum("n").alias("n")), "counted")
    comp = durable(components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))), "components")
    each = tagged.join(groups.select("label", "h1", "h2", "rep", "w"), ["label", "h1", "h2"]).select("vec_id", "rep", "w")
    each = each.join(counted.withColumnRenamed("vec_id", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    each = durable(each.groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component")), "each")
    out = rows.join(each, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
