"""Nearest neighbours by inner product through a hierarchical k-means tree, best bin first."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from launchgrid.llm.common import discard, durable, ship
from launchgrid.llm.vectors import matrix, usable

SAMPLE = 20_000      # vectors the tree is fitted on
BRANCH = 8
MOST_LEAVES = 4096
TRIALS = 128         # queries whose exact neighbours calibrate the number of leaf visits
RECALL = 0.97
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048


@dataclass
class Tree:
    """Centres in a space with one more dimension, in which the largest inner product is nearest.

    The extra part of a vector is what its length lacks to the longest one; of a query it is 0.
    """

    longest: float
    centres: list[np.ndarray] = field(default_factory=list)   # of the children, per inner node
    children: list[list[int]] = field(default_factory=list)   # inner node >= 0, leaf n as -n - 1
    leaves: int = 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at every level."""
        out = np.zeros(len(x), np.int64)
        if not self.children:
            return out
        y, todo = self.lift(x), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            near = ((self.centres[node] ** 2).sum(1) - 2 * y[rows] @ self.centres[node].T).argmin(1)
            for k, child in enumerate(self.children[node]):
                part = rows[near == k]
                if len(part) and child >= 0:
                    todo.append((child, part))
                elif len(part):
                    out[part] = -child - 1
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of a best-bin-first search: always the nearest centre not yet opened."""
        if not self.children:
            return [0]
        q, heap, out = np.append(query, 0.0), [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if node < 0:
                out.append(-node - 1)
                continue
            far = ((self.centres[node] - q) ** 2).sum(1)
            for d, child in zip(far.tolist(), self.children[node]):
                heapq.heappush(heap, (d, child))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in range(k):
            if (mine := near == j).any():
                c[j] = x[mine].mean(0)
    return c, near


def fit_tree(sample: np.ndarray, longest: float, leaves: int, seed: int = 7) -> Tree:
    """Split the largest part again and again until there are enough leaves or all parts are single points."""
    tree, rng = Tree(longest), np.random.default_rng(seed)
    if not len(sample) or leaves < 2:
        return tree
    y = tree.lift(sample)
    heap, names = [(-len(y), 0, None, np.arange(len(y)))], 1
    open_leaves, tie = 1, 0
    slots: list[tuple[tuple[int, int] | None, np.ndarray]] = []
    while heap and open_leaves < leaves:
        _, _, slot, rows = heapq.heappop(heap)
        k = min(BRANCH, len(rows), leaves - open_leaves + 1)
        c, near = _kmeans(y[rows], k, rng) if k > 1 else (None, None)
        if k < 2 or len(full := np.unique(near)) < 2:
            slots.append((slot, rows))
            continue
        node = len(tree.children)
        tree.children.append([0] * len(full)), tree.centres.append(c[full])
        if slot:
            tree.children[slot[0]][slot[1]] = node
        for i, j in enumerate(full):
            tie += 1
            heapq.heappush(heap, (-int((near == j).sum()), tie, (node, i), rows[near == j]))
        open_leaves += len(full) - 1
    slots += [(slot, rows) for _, _, slot, rows in heap]
    for n, (slot, _) in enumerate(slots):
        if slot:
            tree.children[slot[0]][slot[1]] = -n - 1
    tree.leaves = len(slots)
    return tree


def leaf_count(vectors: int) -> int:
    return int(min(MOST_LEAVES, max(1, 8 * round(vectors ** (1 / 3)))))


def _best(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int):
    """(query row, id, score) of the k best of a block per query, with all ties of the last."""
    rough = q @ x.T
    rough[qid[:, None] == ids[None, :]] = -np.inf
    last = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(last), last, 0)))
    a, b = np.nonzero((rough >= (last - slack)[:, None]) & np.isfinite(rough))
    exact = (q[a] * x[b]).sum(1)
    order = np.lexsort((ids[b], -exact, a))
    a, b, exact = a[order], b[order], exact[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k  # ties beyond k go to the smaller ids
    return a[keep], ids[b[keep]], exact[keep]


def search(table: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` largest inner products found per query.

    The tree is fitted on a bounded sample and indexes every usable vector. The leaves that a query
    visits are widened until the trial queries find ``recall`` of their exact neighbours. Leaf and
    queries meet in blocks of bounded size. A query's own id is no candidate; equal scores go to the
    smaller id; unusable vectors (see ``usable``) neither ask nor answer; no vectors give no rows;
    queries and vectors given several times count each.
    """
    spark = table.sparkSession
    ship(spark)
    base, asked = usable(table, key, vector), usable(queries, key, vector).withColumnRenamed("vec_id", "query_id")
    kind = base.schema["vec_id"].dataType.simpleString()
    out_schema = f"query_id {kind}, vec_id {kind}, score double"
    facts = base.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not facts["n"]:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    sample = np.array([r["vec"] for r in base.orderBy(F.xxhash64("vec_id", "vec")).limit(SAMPLE).collect()])
    tree = spark.sparkContext.broadcast(fit_tree(sample, math.sqrt(facts["m"]), leaf_count(facts["n"])))
    names = base.columns

    def assign(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.leaf_of(matrix(b.column(1))), pa.int64())], [*names, "leaf"])

    index = durable(base.mapInArrow(assign, f"vec_id {kind}, vec array<double>, leaf bigint"), "index")
    visits = tree.value.leaves
    trials = asked.orderBy(F.xxhash64("query_id", F.lit(3))).limit(TRIALS).collect()
    if trials and visits > 1:
        visits = calibrate(index, tree, trials, k, recall, kind)

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            leaves = [tree.value.visits(q, visits) for q in matrix(b.column(1))]
            rows = np.repeat(np.arange(b.num_rows), [len(x) for x in leaves])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in b.columns), pa.array(np.concatenate(leaves), pa.int64())], ["query_id", "vec", "leaf"])

    routed = asked.mapInArrow(route, f"query_id {kind}, vec array<double>, leaf bigint")
    count = lambda df, size, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    cuts = durable(count(index, BLOCK_VECTORS, "s_n").join(count(routed, BLOCK_QUERIES, "t_n"), "leaf"), "cuts")  # one row per leaf at most
    def spread(df: DataFrame, own: str, mine: str, other: str) -> DataFrame:
        salted = df.join(F.broadcast(cuts), "leaf").withColumn(mine, F.pmod(F.xxhash64(own), F.col(f"{mine}_n")))
        return salted.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_n") - 1).cast("array<bigint>"))).select("leaf", "s", "t", own, "vec")

    left, right = spread(index, "vec_id", "s", "t"), spread(routed, "query_id", "t", "s")

    def meet(xs: pa.Table, qs: pa.Table) -> pa.Table:
        if not xs.num_rows or not qs.num_rows:
            return pa.table([[], [], []], pa.schema([("query_id", xs.schema.field("vec_id").type), ("vec_id", xs.schema.field("vec_id").type), ("score", pa.float64())]))
        ids, x = xs.column("vec_id").to_numpy(), matrix(xs.column("vec"))
        qid, q = qs.column("query_id").to_numpy(), matrix(qs.column("vec"))
        got = [_best(ids, x, qid[i: i + 256], q[i: i + 256], k) for i in range(0, len(q), 256)]
        return pa.table([pa.array(np.concatenate([qid[i * 256 + g[0]] for i, g in enumerate(got)])), pa.array(np.concatenate([g[1] for g in got])),
                         pa.array(np.concatenate([g[2] for g in got]))], ["query_id", "vec_id", "score"])

    found = left.groupBy("leaf", "s", "t").cogroup(right.groupBy("leaf", "s", "t")).applyInArrow(meet, out_schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(index: DataFrame, tree, trials: list, k: int, recall: float, kind: str) -> int:
    """The fewest leaf visits with which the trial queries find ``recall`` of their exact neighbours."""
    qid, q = np.array([r["query_id"] for r in trials]), np.array([r["vec"] for r in trials])

    def exact(batches):
        for b in batches:
            if b.num_rows:
                leaf = b.column(2).to_numpy()
                x, pos = matrix(b.column(1)), np.arange(b.num_rows)
                ids = b.column(0).to_numpy()
                rough = q @ x.T
                rough[qid[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-rough, axis=1, kind="stable")[:, :k]
                a = np.repeat(np.arange(len(q)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(leaf[pos[top.reshape(-1)]]), pa.array(rough[a, top.reshape(-1)])], ["q", "leaf", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
    true = index.mapInArrow(exact, "q bigint, leaf bigint, score double").where("score > double('-infinity')").withColumn(
        "r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "leaf").collect()  # at most trials * k rows
    place = [{leaf: i for i, leaf in enumerate(tree.value.visits(v, tree.value.leaves))} for v in q]
    need = np.sort([place[r["q"]][r["leaf"]] + 1 for r in true])
    return int(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)]) if len(need) else tree.value.leaves
