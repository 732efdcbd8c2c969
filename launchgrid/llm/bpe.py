"""Byte-level BPE encoding with offsets, and decoding of ids and of slices of ids."""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from launchgrid.llm.common import pick, ship, slices
from launchgrid.llm.vocab import id_bytes, rank_encoder


def spans(path: str, pattern: str, text: str) -> list[tuple[int, int, int, int, int]]:
    """(id, first character, end character, first byte, end byte) of each token of a text.

    The byte span is exact. A token that is part of one character gets that whole character.
    """
    ids = np.frombuffer(rank_encoder(path, pattern).encode([text])[0], "<u4").tolist()
    of_byte = np.repeat(np.arange(len(text)), [len(c.encode()) for c in text]) if text else np.array([], int)
    ends = np.cumsum([len(id_bytes(path)[i]) for i in ids])
    return [(i, int(of_byte[e - len(id_bytes(path)[i])]), int(of_byte[e - 1]) + 1, int(e) - len(id_bytes(path)[i]), int(e)) for i, e in zip(ids, ends)]


def decode_slices(path: str, parts: list[list[int]]) -> list[str]:
    """Text of each slice of one id list; a character cut by a slice's end comes out with the next one.

    Bytes that are no UTF-8 become the replacement character.
    """
    table, dec = id_bytes(path), codecs.getincrementaldecoder("utf-8")("replace")
    return [dec.decode(b"".join(table[i] for i in ids), final=k == len(parts) - 1) for k, ids in enumerate(parts)]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of every whole text.

    A null or empty text has no ids; a null key is kept; repeated rows are encoded each on their own.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids = rank_encoder(path, pattern).encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    src = pick(docs, key, text)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``id_text`` (decimal ids joined by a space) and ``decoded`` (bytes) to encoded documents."""
    ship(encoded.sparkSession)

    def run(batches):
        table = id_bytes(path)
        decimal = [b"%d" % i for i in range(len(table))]
        for batch in batches:
            for part in slices(batch):
                lists = [np.frombuffer(x, "<u4").tolist() for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([b" ".join(map(decimal.__getitem__, x)) for x in lists], pa.binary()),
                     pa.array([b"".join(map(table.__getitem__, x)) for x in lists], pa.binary())], ["doc_id", "n_tokens", "id_text", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, id_text binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("id_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
