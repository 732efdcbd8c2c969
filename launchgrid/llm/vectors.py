"""Rows of an embedding table that can take part in a search or a comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(table: DataFrame, key: str, vector: str, *extra: str, one_size: bool = True) -> DataFrame:
    """vec_id, vec (doubles) and the extra columns, for vectors of the commonest dimension or of all.

    Null keys, null, empty and zero vectors and those with null or non-finite parts are left out.
    """
    df = table.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"), *extra).where(
        "vec_id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    if not one_size:
        return df
    sizes = df.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return df.where(F.size("vec") == (sizes[0]["n"] if sizes else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
