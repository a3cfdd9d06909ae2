"""Helpers shared by the text operators: reading columns, blocks of text bytes, row identity."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyframe.llm.chunks import forget_tables
from canopyframe.session import checkpoint_folder

BLOCK_BYTES = 2 << 20      # text bytes that are worked on at once inside a task
SMALL_BLOCK = 1 << 19      # where a byte takes many 64-bit values on the way
NO_ID = -(2 ** 63)         # stands for a null id inside joins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Drop what earlier rounds of an iterative job left behind.

    Shuffle files, checkpoints, broadcasts and plans go once the driver collects its garbage, which it
    otherwise does when its memory is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          columns: list[str] | None = None) -> DataFrame:
    """(i, th, text[, extra]): ``i`` is the id (a null one replaced), ``th`` a hash of the text.

    Together they identify a document: rows that repeat both are one document and get equal
    results, rows that share only the id are ordered by ``th``. ``columns`` are carried along in the
    structure ``extra``; others are left out. So no name can clash.
    """
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
        F.col(text_col).alias("text"),
        *([F.struct(*columns).alias("extra")] if columns is not None else []))


def id_of(i: str = "i") -> Column:
    return F.when(F.col(i) != NO_ID, F.col(i))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


class Block:
    """Some neighbouring texts of a batch as one byte array; null counts as empty."""

    def __init__(self, first: int, data: np.ndarray, ends: np.ndarray):
        self.first, self.data, self.offsets = first, data, ends
        self.n = len(ends) - 1

    def owner(self) -> np.ndarray:
        """The text each byte belongs to."""
        return np.repeat(np.arange(self.n), np.diff(self.offsets))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A longer text than ``limit`` forms a block of its own; texts are never cut."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield Block(at, data[ends[at]:ends[to]], ends[at:to + 1] - ends[at])
        at = to


def give_back() -> None:
    """Return a worker's freed memory to the system; Arrow and the C library would keep it for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` in a worker that other tasks have used and will use: it starts without the chunk tables
    that an earlier operator left, and gives back what it has freed itself."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        give_back()
        yield from run(batches)
        give_back()

    return task


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema)


MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * MIX_B
    h ^= h >> np.uint64(29)
    h *= MIX_A
    return h ^ (h >> np.uint64(32))


def span_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring 64-bit codes, by doubling."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    power, length, out, done = codes, 1, None, 0
    rest = width
    while rest:
        if rest & 1:
            if out is None:
                out = power
            else:
                n = len(codes) - done - length + 1
                out = mix(out[:n] * MIX_A + power[done:done + n])
            done += length
        rest >>= 1
        if rest:
            n = len(codes) - 2 * length + 1
            if n <= 0:
                break
            power = mix(power[:n] * MIX_A + power[length:length + n])
            length *= 2
    return out[:len(codes) - width + 1]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every run of ``width`` neighbours."""
    length = 1
    out = values
    while length * 2 <= width:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    rest = width - length
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def word_spans(data: np.ndarray, is_word: np.ndarray, starts: np.ndarray):
    """Starts and ends of maximal runs of word bytes; a run never crosses a text start."""
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = starts[starts < len(data)]
    begins[cut] = inside[cut]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    before = cut[cut > 0] - 1
    stops[before] = inside[before]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a sum of mixed (byte, place) codes, then mixed again.

    Ranges must not overlap and be ascending.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    picked = data[np.repeat(begin, length) + place].astype(np.uint64)
    codes = mix((picked + np.uint64(1)) * MIX_A + place.astype(np.uint64) * MIX_B)
    sums = np.add.reduceat(codes, first)
    return mix(sums + length.astype(np.uint64))
