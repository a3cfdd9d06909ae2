"""A runtime filter of fixed size: rows whose key may be on a list, before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26     # 2^20 words of 64 bits at most, 16 MB, whatever the list


def _slot(columns: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def only_listed(rows: DataFrame, listed: DataFrame, columns: Sequence[str],
                bits: int = BITS) -> DataFrame:
    """``rows`` without most of those whose ``columns`` are on no row of ``listed``.

    One of ``bits`` bits per hashed key, as 64-bit words that are looked up through a broadcast of
    bounded size (a power of two; the fewer, the more rows pass).
    No listed row is lost; a fraction of the others that falls with the size of the list stays, so
    a join with ``listed`` must follow. Columns of different types on the two sides are left out of
    the hash, as their values would hash differently.
    """
    mine, theirs = dict(rows.dtypes), dict(listed.dtypes)
    columns = [c for c in columns if mine[c] == theirs[c]]
    if not columns:
        return rows
    words = (
        listed.select(_slot(columns, bits).alias("_slot")).select(
            F.shiftright("_slot", 6).alias("_word"),
            F.expr("shiftleft(1L, cast(_slot & 63 as int))").alias("_bit"))
        .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    return (
        rows.withColumn("_slot", _slot(columns, bits))
        .join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("_word"))
        .filter(F.expr("getbit(_bits, cast(_slot & 63 as int)) = 1"))
        .drop("_slot", "_word", "_bits"))
