"""Product codes of vectors: per part, Lloyd rounds in whole numbers that look at moved entries only."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from launchgrid.functions.joins import spread_join
from launchgrid.llm.common import discard, durable, ship, slices
from launchgrid.llm.vectors import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
GOOD = "vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); an error where squared distances would not fit 64 bits."""
    x = np.floor(vectors * scale)
    if x.size and 2 * np.abs(x).max() >= math.sqrt(2.0**63 / x.shape[1]):
        raise ValueError("components are too large for exact 64-bit distances")
    return x.astype(np.int64)


def assign(x: np.ndarray, books: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and its squared distance, ties to the lower index.

    ``x`` is (rows, parts, width), ``books`` (parts, entries, width), ``moved`` (parts, entries). A part
    whose entry in ``code`` did not move keeps its exact distance in ``dist`` and is compared with the
    moved entries alone: no other entry can have come nearer. All other parts are scanned again.
    """
    code, dist = code.copy(), dist.copy()
    for p, book in enumerate(books):
        fixed = ~moved[p][code[:, p]]
        for rows, entries in ((np.flatnonzero(~fixed), np.arange(len(book))), (np.flatnonzero(fixed), np.flatnonzero(moved[p]))):
            if not len(rows) or not len(entries):
                continue
            d = ((x[rows, p, None, :] - book[entries]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            d, e = d[np.arange(len(rows)), at], entries[at]
            take = ~fixed[rows] | (d < dist[rows, p]) | ((d == dist[rows, p]) & (e < code[rows, p]))
            code[rows[take], p], dist[rows[take], p] = e[take], d[take]
    return code, dist


def part_sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """(parts, entries, width + 1): sums of the components of each entry's parts, and their number."""
    out = np.zeros((x.shape[1], entries, x.shape[2] + 1), np.int64)
    for p in range(x.shape[1]):
        np.add.at(out[p, :, :-1], code[:, p], x[:, p])
        out[p, :, -1] = np.bincount(code[:, p], minlength=entries)
    return out


def _prepared(src: DataFrame, parts: int) -> DataFrame:
    """Rows of whole numbers with no entry yet."""
    kinds = [f"{c} {src.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2048):
                x = whole_numbers(matrix(part.column(2)))
                n = len(x)
                zero = np.zeros((n, parts), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in zero.astype(np.uint8)], pa.binary()),
                     pa.array([r.tobytes() for r in zero], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                    ["vec_id", "label", "vec", "code", "dist", "error", "sums"])

    return src.mapInArrow(run, ", ".join(kinds) + ", vec binary, code binary, dist binary, error bigint, sums binary")


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The rows with their entries of this round and, from each task, one row of sums.

    The codebooks are of fixed size (parts x entries x width numbers) and travel with the code.
    """
    parts, entries, width = books.shape

    def run(batches):
        total, names = None, None
        for batch in batches:
            names = batch.schema
            for rows in slices(batch, 2048):
                rows = rows.filter(rows.column(6).is_null())
                if not rows.num_rows:
                    continue
                read = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t)
                x = read(2, np.int64).reshape(-1, parts, width)
                code, dist = assign(x, books, moved, read(3, np.uint8).reshape(-1, parts).astype(np.int64), read(4, np.int64).reshape(-1, parts))
                own = part_sums(x, code, entries)
                total = own if total is None else total + own
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(2), pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()),
                     pa.array([r.tobytes() for r in dist], pa.binary()), pa.array(dist.sum(axis=1)), pa.nulls(len(x), pa.binary())], names.names)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(names)[:6]] + [pa.array([total.tobytes()], pa.binary())], names.names)

    return state.mapInArrow(run, state.schema)


def _summed(state: DataFrame, shape: tuple[int, ...]) -> dict[int, int]:
    """Sums over all tasks by slot of the codebooks; as many rows as the codebooks have numbers."""
    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                v = np.frombuffer(blob, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], ["slot", "v"])

    rows = state.where("sums is not null").select("sums").mapInArrow(run, "slot bigint, v bigint")
    return {r["slot"]: int(r["v"]) for r in rows.groupBy("slot").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}


def train_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every row of whole vectors in ``vec``, and the final codebooks.

    Each round is written to the shared folder with its entries and exact distances, so that the next
    one compares moved entries only; a lost executor costs its tasks of one round. When no entry moves
    any more, later rounds would change nothing and are left out.
    """
    ship(rows.sparkSession)
    order = [F.col("vec_id").asc_nulls_last(), F.col("vec")]
    first = rows.where(f"size(vec) > 0 and size(vec) % {parts} = 0").orderBy(*order).limit(1).collect()
    size = len(first[0]["vec"]) if first else 0
    rows = rows.where(F.size("vec") == size) if first else rows.where("false")
    start = whole_numbers(np.array([r["vec"] for r in rows.select("vec_id", "vec").orderBy(*order).limit(entries).collect()], np.float64).reshape(-1, max(size, parts)))
    books = np.ascontiguousarray(start.reshape(len(start), parts, start.shape[1] // parts).transpose(1, 0, 2))
    state = _prepared(rows.select("vec_id", "label", "vec"), parts)
    if not first:
        return state.select("vec_id", "label", "code", "error"), books
    moved, old = np.ones(books.shape[:2], bool), None
    for r in range(rounds + 1):
        state = durable(_round(state, books, moved), "codes")
        if old is not None:
            discard(old)
        old = state
        if r == rounds:
            break
        got = _summed(state, books.shape)
        new, width = books.copy(), books.shape[2]
        for i, (p, e) in enumerate(np.ndindex(books.shape[:2])):
            at = i * (width + 1)
            if got[at + width]:
                new[p, e] = [got[at + k] // got[at + width] for k in range(width)]
        moved = (new != books).any(axis=2)
        books = new
        if not moved.any():
            break
    return state.where("sums is null").select("vec_id", "label", "code", "error"), books


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256.

    Components become floor(4096 * x); each of ``parts`` equal parts has a codebook that begins with the
    parts of the ``entries`` smallest keys (repeated keys: by their vectors; null keys last; fewer rows,
    fewer entries). Rows whose vector is null, empty or has null or non-finite components are dropped,
    and so are vectors of another length than that of the smallest key whose length ``parts`` divides.
    Null labels are one label. Components so large that a squared distance would pass 64 bits are an error.
    An empty table gives no rows.
    """
    src = table.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec")).where(GOOD)
    coded, books = train_codes(src, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    rows = coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.array("label").alias("_label"))
    sums = rows.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return spread_join(rows, sums, ["_label"], "vec_id").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
