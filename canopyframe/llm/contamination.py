"""Benchmark decontamination by winnowing: smallest k-gram hash per window, joined and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.llm.common import (MIX_B, Block, blocks, id_of, keyed, mix, run_hashes,
                                    span_hashes, window_minima, word_spans)
from canopyframe.session import materialize

SPAN = 13                  # words of a window
GRAM = 7                   # words of a k-gram; every window holds SPAN - GRAM + 1 of them
FILTER_SLOTS = 1 << 22     # fixed size of the fingerprint filter, whatever the benchmark's size
SHARE = 20                 # contaminated from one hit word in so many

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_HIT = "struct<p:int,n:int,fp:long,w:long,v:long>"


def _second(words: np.ndarray, width: int) -> np.ndarray:
    return span_hashes(mix(words ^ MIX_B), width)


def windows(block: Block, lengths: list[int], keep) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words per text, [text, place, length, fingerprint, two hashes] of the windows that ``keep``
    accepts by fingerprint).

    The fingerprint of a full window is the smallest hash among its k-grams, so neighbouring windows
    mostly share it, and any two equal spans of ``SPAN`` words have an equal one. A shorter window
    (of a length in ``lengths``) is its own fingerprint.
    """
    data = _LOWER[block.data]
    begin, end = word_spans(data, _IS_WORD, block.offsets[:-1])
    owner = np.searchsorted(block.offsets, begin, "right") - 1
    n_words = np.bincount(owner, minlength=block.n)
    first = (np.cumsum(n_words) - n_words)[owner] if len(owner) else owner
    words = run_hashes(data, begin, end)
    found: list[list[np.ndarray]] = []
    for n in [SPAN, *lengths]:
        if len(words) < n:
            continue
        own = owner[:len(words) - n + 1]
        whole = own == owner[n - 1:]
        if n == SPAN:
            prints = window_minima(span_hashes(words, GRAM), SPAN - GRAM + 1)
        else:
            prints = mix(span_hashes(words, n) + np.uint64(n))
        at = np.flatnonzero(whole & keep(prints))
        if len(at):
            # Whole windows are hashed where a fingerprint has hit only.
            codes = words[at[:, None] + np.arange(n)]
            w, v = _rows(codes, n), _rows(mix(codes ^ MIX_B), n)
            found.append([own[at], at - first[at], np.full(len(at), n), prints[at], w, v])
    return n_words, [np.concatenate(c) for c in zip(*found)] if found else \
        [np.zeros(0, np.uint64) for _ in range(6)]


def _rows(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(codes), n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[:, k])
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item, n, fp, w, v) of all items' windows; an item under 13 words is one window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = np.asarray(batch.column(0).to_pylist(), object)
            for block in blocks(batch.column(1)):
                every = lambda prints: np.ones(len(prints), bool)
                n_words, found = windows(block, list(range(1, SPAN)), every)
                text, n = found[0].astype(np.int64), found[2].astype(np.int64)
                own = n_words[text] if len(text) else n
                at = np.flatnonzero((n == SPAN) | (own == n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items[block.first + text[at]], pa.string()),
                     pa.array(n[at].astype(np.int32)),
                     *(pa.array(_signed(found[k][at])) for k in (3, 4, 5))],
                    ["item", "n", "fp", "w", "v"])

    return (benchmark.selectExpr(f"cast(`{item_col}` as string) as item", f"`{text_col}` as text")
            .filter("item is not null and text is not null")
            .mapInArrow(run, "item string, n int, fp long, w long, v long").distinct())


def document_windows(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(i, th, n_words, hits) per document; ``hits`` are windows whose fingerprint may be known.

    The filter has a fixed number of slots, so what is sent to tasks doesn't grow with the
    benchmark; a full filter lets more through to the join and loses nothing.
    """
    slots = bench.select((F.col("fp").bitwiseAND(FILTER_SLOTS - 1)).cast("int").alias("s")).distinct()
    bits = np.zeros(FILTER_SLOTS, bool)
    for batch in slots.toArrow().to_batches():
        bits[np.asarray(batch.column(0))] = True
    lengths = sorted(r["n"] for r in bench.filter(F.col("n") < SPAN).select("n").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).astype(bool)
        known = lambda prints: bits[(prints & np.uint64(FILTER_SLOTS - 1)).astype(np.int64)]
        for batch in batches:
            for block in blocks(batch.column(2)):
                n_words, found = windows(block, lengths, known)
                order = np.argsort(found[0], kind="stable")
                found = [c[order] for c in found]
                ends = np.searchsorted(found[0], np.arange(block.n + 1)).astype(np.int32)
                hits = pa.StructArray.from_arrays(
                    [pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32)),
                     *(pa.array(_signed(found[k])) for k in (3, 4, 5))], ["p", "n", "fp", "w", "v"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n),
                     batch.column(1).slice(block.first, block.n),
                     pa.array(n_words.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), hits)], ["i", "th", "n_words", "hits"])

    return docs.mapInArrow(run, f"i long, th long, n_words long, hits array<{_HIT}>")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash) per row of ``docs``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters from U+0080 on. Every
    span of 13 words that a document shares with an item is found, as both sides keep the smallest
    7-gram hash of each such span; so is any shorter item as a whole. Hits are confirmed by two
    independent 64-bit hashes of the whole window.

    A null text has no words; items with a null id or text are ignored, and rows of one item id are
    one item; repeated documents repeat; other columns are ignored; with an empty benchmark nothing
    is hit.
    """
    rows = _document_rows(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return rows.select(id_of().alias(id_col), "n_words", "n_hit", "n_items", "items_sha256",
                       "contaminated", F.col("th").alias("text_hash"))


def _document_rows(docs, benchmark, id_col, text_col, item_col, item_text_col) -> DataFrame:
    bench = materialize(benchmark_windows(benchmark, item_col, item_text_col))
    rows = materialize(document_windows(keyed(docs, id_col, text_col), bench))
    window_keys = ["n", "fp", "w", "v"]
    found = (rows.filter(F.size("hits") > 0).select("i", "th", F.explode("hits").alias("h"))
             .select("i", "th", "h.*").distinct())
    hit = found.join(bench.select(window_keys).distinct(), window_keys, "left_semi")
    # Covered words: each window adds what reaches beyond all earlier ones.
    earlier = Window.partitionBy("i", "th").orderBy("p", F.desc("n")).rowsBetween(
        Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("p") + F.col("n")).over(earlier), F.lit(0))
    covered = (hit.withColumn("reach", reach)
               .withColumn("more", F.greatest(
                   F.lit(0), F.col("p") + F.col("n") - F.greatest("p", "reach")))
               .groupBy("i", "th").agg(F.sum("more").alias("n_hit")))
    items = (hit.select("i", "th", *window_keys).distinct().join(bench, window_keys)
             .select("i", "th", "item").distinct().groupBy("i", "th")
             .agg(F.count("*").alias("n_items"),
                  F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (rows.select("i", "th", "n_words").join(covered, ["i", "th"], "left")
            .join(items, ["i", "th"], "left")
            .select("i", "th", "n_words", n_hit.alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
                    ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated")))


_WORDS = """
    SELECT {id} AS id, list(w ORDER BY k) AS ws FROM (
        SELECT {id}, unnest(x) AS w, generate_subscripts(x, 1) AS k FROM (
            SELECT {id}, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS x FROM {table}))
    GROUP BY {id}"""
SQL = f"""
WITH d AS ({_WORDS.format(id="doc_id", table="documents")}),
b AS ({_WORDS.format(id="item_id", table="benchmark")}),
lens AS (SELECT DISTINCT least(13, len(ws)) AS n FROM b),
bw AS (SELECT DISTINCT id AS item, n, array_to_string(ws[p:p + n - 1], ' ') AS s FROM (
    SELECT id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p
    FROM b)),
dw AS (SELECT id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS s FROM (
    SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT dw.id, p, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
cover AS (SELECT id, count(DISTINCT x) AS n_hit FROM (
    SELECT id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (
    SELECT DISTINCT id, item::VARCHAR AS item FROM hit) GROUP BY id)
SELECT doc_id, coalesce(len(d.ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(d.ws), 0) AS contaminated
FROM documents LEFT JOIN d ON d.id = doc_id LEFT JOIN cover ON cover.id = doc_id
LEFT JOIN items ON items.id = doc_id"""
