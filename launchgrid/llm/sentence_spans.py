"""Substring dedup: sentences inside a repeated run of consecutive sentences go, but for the first.

Long sentences count as several: they are cut where their own words say so.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from launchgrid.llm.common import durable, mix, ship, slices

SENTENCES, WORDS = 2, 20  # a run has at least so many of each, and no sentence more than it needs
WINDOW = 6                # of so many neighbouring word gaps in a sentence of WORDS words or more, one is cut
_END = re.compile(r"(?:(?<=[.!?])[^\S\n]+|\s*\n\s*)(?=\S)")
_BLANK = np.array([chr(i).isspace() for i in range(0x3002)])  # no later character is white space


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences; the white space after one belongs to it."""
    cuts = [m.end() for m in _END.finditer(text)]
    return [(a, b) for a, b in zip([0, *cuts], [*cuts, len(text)]) if b > a]


def pieces(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End of each piece, number of words up to it, and the hashes of all words.

    A piece is a sentence or, in a sentence of WORDS words or more, a part of one: of each WINDOW
    neighbouring gaps between its words the one with the smallest hash of the two words beside it
    is cut. So equal passages are cut alike but for 2 * WINDOW words at their ends, wherever they
    stand, and 5 * WINDOW + WORDS equal words within long sentences always hold an equal run.
    """
    ends = np.array([b for _, b in sentences(text)], np.int64)
    blank = _BLANK[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(_BLANK) - 1)]
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1])[: len(blank)])
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, text.split()), np.uint64, len(starts))
    upto = np.searchsorted(starts, ends)
    size = np.diff(upto, prepend=0)
    if (size >= WORDS).any():
        shut = np.repeat(size < WORDS, size)  # words without a gap to cut before them
        shut[(upto - size)[size > 0]] = True
        shut = np.concatenate([[0], np.cumsum(shut)])
        inside = np.flatnonzero(shut[WINDOW:] == shut[:-WINDOW])
        gap = mix(mix(np.append(h[:1], h[:-1]), 1) ^ h)
        cut = inside + np.lib.stride_tricks.sliding_window_view(gap, WINDOW)[inside].argmin(1)
        ends = np.union1d(ends, starts[cut])
        upto = np.searchsorted(starts, ends)
    return ends, upto, h


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(hash, first, last) of the shortest runs from each piece on and up to each piece.

    With both, two texts that share a passage share runs up to its very first and last piece.
    Then the number of pieces.
    """
    ends, upto, h = pieces(text)
    n = len(ends)
    none = np.zeros(0, np.int64)
    if n < SENTENCES:
        return none.astype(np.uint64), none, none, n
    words = np.concatenate([[0], upto])
    at = np.arange(n)
    last = np.maximum(np.searchsorted(words, words[:-1] + WORDS, "left") - 1, at + SENTENCES - 1)
    first = np.minimum(np.searchsorted(words, words[1:] - WORDS, "right") - 1, at - SENTENCES + 1)
    a, b = np.concatenate([at[last < n], first[first >= 0]]), np.concatenate([last[last < n], at[first >= 0]])
    a, b = np.divmod(np.unique(a * n + b), n)
    # A run's hash is the difference of two running polynomials of its words, scaled to its own start.
    power, back = _powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
    return (total[words[b + 1]] - total[words[a]]) * back[words[a]] + (b - a).astype(np.uint64), a, b, n


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 2**64)
    make = lambda x: np.multiply.accumulate(np.array([1] + [x] * (n - 1), np.uint64))
    return make(base), make(inverse)


def remove_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_removed, n_spans (runs of removed sentences) and the text that stays.

    The first of equal runs is that of the smallest key, then of the smallest position; the sentences
    of all others go. The pieces of a long sentence count as sentences. Sentences compare with white space joined. Null texts are empty; rows with a null
    key neither remove nor lose anything; rows that repeat a key with equal text are one document,
    with other texts they lose nothing to each other. Runs are judged by a 64-bit hash of their words.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                got = [runs(t) for t in texts]
                rows = np.repeat(np.arange(len(texts)), [len(g[0]) for g in got])
                mark = np.array([zlib.crc32(t.encode()) for t in texts], np.int64)
                h, a, b, n = (np.concatenate(x) for x in zip(*((*g[:3], [g[3]]) for g in got)))
                names = ["h", "doc_id", "mark", "a", "b"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), part.column(0).take(pa.array(rows)), pa.array(mark[rows]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names)
                # One row per text with the number of its pieces, which are not counted again.
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), part.column(0), pa.array(mark), pa.array(n.astype(np.int32)), pa.nulls(len(n), pa.int32())], names)

    found = durable(src.where("doc_id is not null").mapInArrow(cut, f"h bigint, doc_id {kind}, mark bigint, a int, b int"), "runs")
    firsts = durable(found.where("h is not null").groupBy("h").agg(F.min(F.struct("doc_id", "a")).alias("f"), F.min(F.struct("mark", "doc_id", "a")).alias("lo"), F.max(F.struct("mark", "doc_id", "a")).alias("hi")).where(
        "lo <> hi").select("h", F.col("f.doc_id").alias("f_doc"), F.col("f.a").alias("f_a")), "firsts")
    later = found.join(firsts, "h").where("doc_id <> f_doc or a > f_a").select("doc_id", "mark", F.struct("a", "b").alias("span"), F.lit(None).cast("int").alias("n"))
    later = later.unionByName(found.where("h is null").select("doc_id", "mark", F.lit(None).cast(later.schema["span"].dataType).alias("span"), F.col("a").alias("n")))
    spans = durable(later.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("spans"), F.max("n").alias("n")), "spans")  # no more than a text has runs
    spans = spans.select(F.col("doc_id").alias("s_doc"), "mark", "spans", "n")
    both = src.withColumn("m", F.crc32(F.col("text").cast("binary"))).join(spans, (F.col("doc_id") == F.col("s_doc")) & (F.col("m") == F.col("mark")), "left").select("doc_id", "text", "spans", "n")

    def keep(batches):
        for batch in batches:
            for part in slices(batch):
                total, gone, groups, out = [], [], [], []
                for t, spans, n in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                    if not spans and n is not None:
                        total.append(n), gone.append(0), groups.append(0), out.append(t)
                        continue
                    ends = pieces(t)[0].tolist()
                    cover = np.zeros(len(ends) + 1, np.int64)
                    for x in spans or ():
                        cover[x["a"]] += 1
                        cover[x["b"] + 1] -= 1
                    hit = np.cumsum(cover)[:-1] > 0
                    total.append(len(ends)), gone.append(int(hit.sum()))
                    groups.append(int((hit & ~np.concatenate([[False], hit[:-1]])).sum()))
                    out.append("".join(t[a:b] for (a, b), x in zip(zip([0, *ends], ends), hit.tolist()) if not x) if spans else t)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (total, gone, groups)), pa.array(out, pa.string())],
                                                 ["doc_id", "n_sentences", "n_removed", "n_spans", "text"])

    return both.mapInArrow(keep, f"doc_id {kind}, n_sentences bigint, n_removed bigint, n_spans bigint, text string")
