"""Token ids in Re-Pair compressed shards: grammar rules per shard, decodable from any place."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.llm.chunks import ByteChunks, shared_table, tokenizer_bytes
from canopyframe.llm.common import id_of, keyed, thrifty, written

MODEL = "byte_bpe_50k.json"
END_ID = 2
FIRST_RULE = 65_536        # nonterminals are numbered from here on
SHARD_TOKENS = 1 << 20     # a shard is closed once it holds as many; documents are never cut
MIN_PAIRS = 12             # a pair that is rarer in its shard makes no rule
ROUNDS = 6                 # replacement rounds per shard, most frequent pairs first
SLOT_BITS = 18

SHARD = ("part int, seq int, n_tokens long, ids binary, counts binary, rules binary, "
         "lengths binary, symbols binary")
DECODED = "part int, seq int, place int, i long, n_tokens long, ids_crc32 long, before long"


def compress(tokens: np.ndarray, cuts: np.ndarray, rounds: int = ROUNDS,
             least: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): rule r rewrites ``FIRST_RULE + r`` to a pair of symbols.

    Every round counts the pairs of neighbours, replaces the most frequent ones (those at least an
    eighth as frequent as the top pair) from left to right, and goes on with the shorter sequence.
    ``cuts`` marks tokens after which no pair may form (document ends), so that every document is a
    whole number of symbols. ``lengths`` has the tokens each rule expands to.
    """
    symbols, last = tokens.astype(np.int32), cuts.copy()
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, np.int64)
    made, mask = 0, (1 << SLOT_BITS) - 1
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        key = (symbols[:-1].astype(np.int64) << 24) | symbols[1:]
        slot = (((key * 0x9E3779B1) >> 13) & mask).astype(np.int32)
        free = ~last[:-1]
        # A slot stands for the pair that was put there last; only that pair is counted.
        holder = np.full(mask + 1, -1, np.int64)
        holder[slot[free]] = key[free]
        held = free & (holder[slot] == key)
        counts = np.bincount(slot[held], minlength=mask + 1)
        top = int(counts.max())
        if top < least:
            break
        chosen = np.flatnonzero(counts >= max(least, top // 8))
        number = np.full(mask + 1, -1, np.int64)
        number[chosen] = np.arange(len(chosen))
        hit = held & (number[slot] >= 0)
        at = np.flatnonzero(hit)
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) > 1
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]        # left to right, never overlapping
        symbols[at] = FIRST_RULE + made + number[slot[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        pairs = np.stack([holder[chosen] >> 24, holder[chosen] & 0xFFFFFF], 1)
        rules.append(pairs)
        lengths = np.concatenate([lengths, _lengths(pairs, lengths).sum(1)])
        made += len(chosen)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return symbols.astype("<u4"), table.astype("<u4"), lengths.astype("<u4")


def _lengths(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    rule = symbols >= FIRST_RULE
    out = np.ones(symbols.shape, np.int64)
    out[rule] = lengths[symbols[rule].astype(np.int64) - FIRST_RULE]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Tokens of a symbol sequence; one pass per depth of the grammar."""
    symbols = symbols.astype(np.int32)
    while len(symbols) and (rule := symbols >= FIRST_RULE).any():
        more = np.cumsum(rule, dtype=np.int32)
        first = np.arange(len(symbols), dtype=np.int32) + more - rule
        out = np.empty(len(symbols) + int(more[-1]), np.int32)
        out[first] = symbols
        pairs, first = rules[symbols[rule] - FIRST_RULE], first[rule]
        out[first] = pairs[:, 0]
        out[first + 1] = pairs[:, 1]
        symbols = out
    return symbols.astype("<u4")


def read_tokens(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int,
                count: int) -> np.ndarray:
    """``count`` tokens from place ``start`` of a shard; expands only the symbols that cover them."""
    ends = np.cumsum(_lengths(symbols, lengths))
    a = int(np.searchsorted(ends, start, "right"))
    b = int(np.searchsorted(ends, start + count, "left")) + 1
    before = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules)[start - before:start - before + count]


def unpack(row: dict) -> dict:
    """A stored shard's arrays."""
    opened = zstandard.ZstdDecompressor().decompress(row["symbols"])
    return {"ids": np.frombuffer(row["ids"], "<i8"), "counts": np.frombuffer(row["counts"], "<i8"),
            "rules": np.frombuffer(row["rules"], "<u4").reshape(-1, 2),
            "lengths": np.frombuffer(row["lengths"], "<u4"),
            "symbols": np.frombuffer(opened, "<u4")}


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           model_path: str | None = None, end_id: int = END_ID,
           shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards of the documents in ascending id order, as rows of ``SHARD``.

    A shard is written as one Parquet row: document ids and token counts, the grammar's rules and
    expansion lengths, and the compressed sequence. Rows of equal id are ordered by a hash of their
    text. ``part`` and ``seq`` give the order of shards.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(MODEL, model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        table, packer = shared_table(ByteChunks, model.value), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], "<u2").tobytes()
        ids: list[int] = []
        codes: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            counts = np.array([len(c) // 2 for c in codes], "<i8")
            tokens = np.frombuffer(b"".join(codes), "<u2")
            cuts = np.zeros(len(tokens), bool)
            cuts[np.cumsum(counts) - 1] = True
            symbols, rules, lengths = compress(tokens, cuts)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "n_tokens": pa.array([len(tokens)], pa.int64()),
                "ids": [np.array(ids, "<i8").tobytes()],
                "counts": [counts.tobytes()], "rules": [rules.tobytes()],
                "lengths": [lengths.tobytes()], "symbols": [packer.compress(symbols.tobytes())]})

        for batch in batches:
            for group in _groups(batch):
                for i, code in zip(group[0], table.encode_many(group[1])):
                    ids.append(i)
                    codes.append(code + end)
                    held += len(codes[-1]) // 2
                    if held >= shard_tokens:
                        yield close()
                        ids, codes, held, seq = [], [], 0, seq + 1
        if ids:
            yield close()
        pa.default_memory_pool().release_unused()

    return (keyed(docs, id_col, text_col).repartitionByRange("i", "th")
            .sortWithinPartitions("i", "th").select("i", "text").mapInArrow(run, SHARD))


def _groups(batch: pa.RecordBatch, chars: int = 1 << 22) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of neighbouring rows, about so many characters at a time."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(i)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def decoded(stored: DataFrame) -> DataFrame:
    """(part, seq, place, i, n_tokens, ids_crc32, before) of every document, from stored shards.

    ``before`` counts the ids before the document in its shard.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                # One shard at a time: a batch may hold all of a task's.
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                shard = unpack(row)
                tokens = expand(shard["symbols"], shard["rules"])
                ends = np.cumsum(shard["counts"])
                starts = ends - shard["counts"]
                n = len(ends)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * n, pa.int32()),
                    "seq": pa.array([row["seq"]] * n, pa.int32()),
                    "place": pa.array(np.arange(n, dtype=np.int32)),
                    "i": pa.array(shard["ids"]), "n_tokens": pa.array(shard["counts"]),
                    "ids_crc32": pa.array([zlib.crc32(tokens[a:b].tobytes())
                                           for a, b in zip(starts, ends)], pa.int64()),
                    "before": pa.array(starts)})

    return stored.mapInArrow(thrifty(run), DECODED)


def token_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                model_path: str | None = None, end_id: int = END_ID,
                shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per row, computed from shard files written and read back.

    The files go to the shared folder. ``start`` adds up per-part and per-shard totals: one row per
    partition is ordered by a single window, never documents.

    A null text is empty (only the end id). A null id comes first. Repeated rows are stored as often
    as they occur; rows of one id follow each other by a hash of their text, and rows equal in both
    get starts in no defined order. An empty table gives an empty result.
    """
    stored = written(shards(docs, id_col, text_col, model_path, end_id, shard_tokens), "shards")
    each = stored.groupBy("part", "seq").agg(F.sum("n_tokens").alias("size"))
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("shard_start", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
    parts = each.groupBy("part").agg(F.sum("size").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("part_start"))
    starts = each.join(parts, "part").select("part", "seq", "shard_start", "part_start")
    return decoded(stored).join(starts, ["part", "seq"]).select(
        id_of().alias(id_col),
        (F.col("part_start") + F.col("shard_start") + F.col("before")).alias("start"),
        "n_tokens", "ids_crc32")
