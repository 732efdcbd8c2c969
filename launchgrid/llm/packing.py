"""Packing of token sequences: first-fit decreasing over a tournament tree, in random groups."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from launchgrid.llm.common import pick, ship, slices
from launchgrid.llm.vocab import json_encoder

LENGTH = 2048
GROUP = 4096  # documents in a group on average


class Bins:
    """Open bins of one capacity under a tournament tree of what is left in each.

    Every inner node holds the larger room of its two children, so the first bin with enough
    room is found from the root in log(bins) steps.
    """

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (max(most, 1) - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """The first bin with room, and the room it had."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        had, bin_no = room[i], i - self.leaves
        room[i] = had - size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return bin_no, had


def first_fit_decreasing(sizes: list[int], capacity: int = LENGTH) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, which are at most ``capacity``; ties keep their order."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    tree = Bins(len(sizes), capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i], had = tree.first_fit(sizes[i])
        offsets[i] = capacity - had
    return bins, offsets


def pieces(docs: DataFrame, path: str, end_id: int, length: int, key: str, text: str, keep_ids: bool) -> DataFrame:
    """Whole sequences of ``length`` ids from the start of each document, and what is left of it."""
    ship(docs.sparkSession)

    def run(batches):
        end, enc = np.array([end_id], "<u4").tobytes(), json_encoder(path)
        task, copies = TaskContext.get().partitionId() << 32, Counter()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for k, raw in zip(part.column(0), enc.encode(part.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    mark = zlib.crc32(raw)
                    same = k.as_py(), mark
                    copy = task + copies[same]  # equal rows are told apart by their number, whatever their order
                    copies[same] += 1
                    for a in range(0, n, length):
                        cut = raw[4 * a: 4 * (a + length)]
                        rows.append((k, a, len(cut) // 4, zlib.crc32(cut), n, mark, copy, cut if keep_ids else None))
                cols = list(zip(*rows))
                arrays = [pa.array([x.as_py() for x in cols[0]], part.schema.field(0).type)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[7], pa.binary())] * keep_ids,
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32", "copy"] + ["ids"] * keep_ids)

    src = pick(docs, key, text)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, doc_crc32 bigint, copy bigint" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, group: int = GROUP, key: str = "doc_id",
         text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Full pieces are sequences of their own. The rest of each document goes to a random group by the
    hash of its key, ids and number among equal rows, and each group is packed by first-fit decreasing on its own: a group's size does
    not grow with the input, and its number follows from the count of documents. Null and empty
    texts are the end id alone; repeated rows are packed each; no documents give no rows.
    """
    rows = pieces(docs, path, end_id, length, key, text, keep_ids)
    groups = max(1, math.ceil(docs.count() / group))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "doc_crc32", "copy"), F.lit(groups)))
    names = rows.drop("part", "doc_crc32", "copy").columns + ["sequence_id", "offset"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), length)
        base = table.column("part")[0].as_py() << 32
        return table.append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64())).select(names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("part", "doc_crc32", "copy"))
    return rows.groupBy("part").applyInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def padding(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Sequences, ids and padding; a sequence that is as long as a power of two is not padded."""
    seq = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.log2("n") == F.floor(F.log2("n"))
    return seq.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(whole, 0).otherwise(length - F.col("n"))).alias("padding"))
