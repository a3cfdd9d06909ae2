"""Embedding columns: which rows take part, and their batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000   # a key with more than 1 / HOT_SHARE of all rows is hot: there are fewer than that


def finite(vector: str) -> Column:
    """The vector is there and all of its components are numbers."""
    x = F.col(vector).cast("array<double>")
    return F.col(vector).isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    first = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(first, lengths)] = values
    return out


def looked_up(rows: DataFrame, side: DataFrame, keys: list[str], count: str,
              total: int) -> DataFrame:
    """``rows`` joined with the one row that ``side`` has per key; nulls match nulls.

    ``count`` is a key's number of rows and ``total`` that of all. Hot keys, fewer than a thousand,
    are looked up through a broadcast, so their rows stay where they are; the others are joined.
    """
    named = side.select(*[F.col(k).alias(f"_{k}") for k in keys], *[
        c for c in side.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    drop = [f"_{k}" for k in keys] + [count]
    hot, cold = named.filter(is_hot), named.filter(~is_hot)
    heavy = rows.join(F.broadcast(hot), same, "inner")
    light = rows.join(F.broadcast(hot), same, "left_anti").join(cold, same, "inner")
    return heavy.unionByName(light).drop(*drop)
