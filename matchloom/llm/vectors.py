"""Vectors as matrices, for the two vector searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Vectors of a block, and queries that meet a block at once.
BLOCK, QUERIES = 8192, 1024


def usable(df: DataFrame) -> DataFrame:
    """``vec_id, e`` of vectors that hold finite components only, as doubles."""
    e = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("e")).where((F.size("e") > 0) & F.forall("e", finite))


def matrix(t: pa.Table, width: int, column: str = "e") -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    col = t[column].combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    size = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), width))
    out[np.arange(width)[None, :] < size[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def distinct_ids(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each id, the first in the order of components; ids ascend."""
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    return ids[first], x[first]


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]
