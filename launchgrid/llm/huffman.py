"""Token ids in files: canonical length-limited Huffman codes, independent blocks, bit checkpoints."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from launchgrid.llm.common import CLEAN_UP, discard, durable, own_caches, pick, setting, shared_folder, ship, slices, tasks
from launchgrid.llm.vocab import json_encoder

MAX_BITS = 18     # longest code; enough for 262,144 different ids
STEP = 256        # ids between two bit checkpoints
SLICE = 6_000_000  # bytes of text that a task encodes at once, more only where one document is longer
BLOCK = 500_000   # ids in a block, more only where one document is longer


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code no longer than ``limit`` bits, by package-merge.

    Ids with count 0 get length 0, a lone id length 1.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, packed = [], np.zeros(0)
    for _ in range(limit):  # keep, per level, which entries of the merged list are single ids
        both = np.concatenate([weight, packed])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(order))
        both = both[rank][: len(rank) // 2 * 2]
        packed = both[0::2] + both[1::2]
    take, depth = 2 * (len(order) - 1), np.zeros(len(order), np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    out[order] = depth
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, equal lengths by id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for i in order.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids, first bit highest, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(int(at[-1] // 32) + 2, np.uint64)
    start = at[:-1]
    value = codes[ids].astype(np.uint64) << (64 - size - start % 32).astype(np.uint64)  # within two 32-bit words
    word = start // 32
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, int)
    if len(word):  # codes that begin in one word do not overlap, so their sum is their union
        joined = np.add.reduceat(value, first)
        words[word[first]] |= joined >> np.uint64(32)
        words[word[first] + 1] |= joined & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: int(at[-1] + 7) // 8], at[:-1][::STEP]


class Table:
    """Decoding by one look-up per id in a table of all bit patterns of the longest code."""

    def __init__(self, lengths: np.ndarray):
        self.bits = int(lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.symbol = np.repeat(order.astype(np.uint32), 1 << (self.bits - lengths[order].astype(np.int64)))
        self.length = np.repeat(lengths[order], 1 << (self.bits - lengths[order].astype(np.int64))).astype(np.int64)

    def unpack(self, data: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """All runs between checkpoints are decoded side by side, one id of each per step."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte
        out = np.zeros((len(checkpoints), STEP), np.uint32)
        at = checkpoints.astype(np.int64)
        for k in range(min(STEP, n)):
            live = len(at) if k < (n - 1) % STEP + 1 else len(at) - 1
            p = at[:live]
            look = ((window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)).astype(np.int64)
            look = np.minimum(look, len(self.symbol) - 1)
            out[:live, k] = self.symbol[look]
            at[:live] += self.length[look]
        return out.reshape(-1)[:n]


def encode_ids(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (unsigned, 2 bytes each where the vocabulary allows, else 4) with ``end_id`` last.

    ``counts`` is null but in one more row from each task, which holds how often each id occurred there.
    """
    ship(docs.sparkSession)

    def run(batches):
        enc = json_encoder(path)
        kind = id_kind(enc.tokenizer.get_vocab_size())
        names, total = ["doc_id", "n_tokens", "ids", "counts"], np.zeros(1, np.int64)
        for batch in batches:
            for part in slices(batch, max(1, min(2048, SLICE * batch.num_rows // max(1, batch.column(1).nbytes)))):
                ids, sizes = enc.encode_column(part.column(1).to_pylist())
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                got = np.bincount(ids)
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
                ids, at = ids.astype(kind), np.concatenate([[0], np.cumsum(sizes + 1)]) * np.dtype(kind).itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes + 1), packed, pa.nulls(len(sizes), pa.binary())], names)
        if total.any():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, part.column(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.stack([used, total[used]]).tobytes()], pa.binary())], names)

    src = pick(docs, key, text)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary, counts binary")


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the counts of each encoding task; the ids are not read again."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                used, n = np.frombuffer(blob, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], ["id", "n"])

    return encoded.where("counts is not null").select("counts").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def free_encoder() -> None:
    """Writing and reading need no encoder: what the worker holds of the encoding step would count against their memory."""
    own_caches("files", lambda: None)


def write_files(docs: DataFrame, path: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents in ascending key order to ``folder``.

    ``codes``: (id, bits), from which the canonical codes follow. ``blocks``: each row is decodable
    on its own: the part of the key order it is in, its first id within that part, the keys and
    token counts of its documents, the packed bits and the bit checkpoints. Null and empty texts have
    the end id alone; null keys come first; repeated keys stay, shorter ones first. No documents: no blocks.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    kind = id_kind(Tokenizer.from_file(path).get_vocab_size())
    encoded = durable(encode_ids(docs, path, end_id, key, text), "ids")
    counted = {r["id"]: r["n"] for r in id_counts(encoded).collect()}  # at most one row per vocabulary entry
    counts = np.zeros(max(counted, default=0) + 1, np.int64)
    counts[list(counted)] = list(counted.values())
    lengths = code_lengths(counts)
    spark.createDataFrame([(i, int(lengths[i])) for i in counted], "id int, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    shared = spark.sparkContext.broadcast((codes_of(lengths), lengths))
    key_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        free_encoder()
        codes, bits = shared.value
        part, done = TaskContext.get().partitionId(), 0
        keys, sizes, held, n = [], [], [], 0

        def block():
            ids = np.concatenate(held)
            data, marks = pack(ids, codes, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([done], pa.int64()), pa.array([n], pa.int64()), pa.array([keys], pa.list_(key_kind)),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([marks.astype("<u8").tobytes()], pa.binary())],
                ["part", "first", "n_ids", "doc_ids", "sizes", "bits", "checkpoints"])

        for batch in batches:
            key_kind = batch.schema.field(0).type
            for cut in slices(batch):
                for k, raw in zip(cut.column(0).to_pylist(), cut.column(2).to_pylist()):
                    ids = np.frombuffer(raw, kind)
                    if n and n + len(ids) > BLOCK:
                        yield block()
                        done += n
                        keys, sizes, held, n = [], [], [], 0
                    keys.append(k), sizes.append(len(ids)), held.append(ids)
                    n += len(ids)
        if n:
            yield block()

    ordered = encoded.where("counts is null").drop("counts").repartitionByRange(tasks(spark), "doc_id").sortWithinPartitions("doc_id", "n_tokens", F.xxhash64("ids"))
    schema = f"part bigint, first bigint, n_ids bigint, doc_ids array<{key_type}>, sizes array<bigint>, bits binary, checkpoints binary"
    with setting(spark, CLEAN_UP, "true"):
        ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(encoded)


def decode_blocks(batches, lengths: np.ndarray, keep_ids: bool = False):
    """Documents of blocks that know the first id of their part as ``base``."""
    free_encoder()
    decode = Table(lengths)
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            get = lambda c: one.column(c)[0].as_py()
            sizes = np.array(get("sizes"), np.int64)
            ids = decode.unpack(get("bits"), get("n_ids"), np.frombuffer(get("checkpoints"), "<u8"))
            start = np.cumsum(sizes) - sizes
            raw = ids.astype("<u4").tobytes()
            parts = [raw[4 * a: 4 * (a + n)] for a, n in zip(start.tolist(), sizes.tolist())]
            cols = [one.column("doc_ids")[0].values, pa.array(start + (get("base") + get("first")), pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * keep_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)


def read_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files of ``folder``."""
    ship(spark)
    table = spark.read.schema("id int, bits int").parquet(f"{folder}/codes")
    rows = table.collect()  # at most one row per vocabulary entry
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    key_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # One row per written part, of which there are as many as tasks wrote.
    base = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    shared = spark.sparkContext.broadcast(lengths)

    out = f"doc_id {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return blocks.join(F.broadcast(base), "part").mapInArrow(lambda batches: decode_blocks(batches, shared.value, keep_ids), out)


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write the documents to a new folder beside the checkpoints and read them back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_files(docs, path, folder, end_id)
    return read_files(spark, folder)
