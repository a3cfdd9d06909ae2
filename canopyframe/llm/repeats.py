"""Repeated substrings by a sparse enhanced suffix array and its common-prefix interval tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.common import (MIX_A, MIX_B, SMALL_BLOCK, Block, blocks, id_of, keyed, mix,
                                    span_hashes, thrifty, window_minima)
from canopyframe.session import materialize

LENGTH = 100               # bytes of a repeat
GRAM = 40                  # bytes of an anchor; every LENGTH-byte string holds LENGTH - GRAM + 1
SIDE = LENGTH - GRAM       # bytes before an anchor that a window through it can reach
BUCKET_ROWS = 2_000        # a larger bucket is cut into windows instead of scanned in one task
PLACE_BITS = np.uint64(31)
_BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * MIX_A)

ANCHOR = "h long, s long, i long, th long, pos int, low int, high int, kind int"
FOUND = "i long, th long, kind int, a int, b int, c int, h long"
CONTEXT = "h long, i long, th long, pos int, low int, high int, before binary, after binary, large boolean"
SPAN = "i long, th long, kind int, a int, b int, w long, v long"
REPEAT = "repeat long, length int, c long, shift int"
ONCE, SPLIT = 1, 2         # kinds of SPAN rows: a removed span, a window of a large bucket


# --- Anchors ---------------------------------------------------------------------------------

def anchors(block: Block) -> list[np.ndarray]:
    """[text, place, low, high, hash, span hash] of every anchor of a block.

    The anchor of a ``LENGTH``-byte window is its leftmost ``GRAM``-gram of smallest (shortened)
    hash. It depends on the window's bytes alone, so equal windows have it at equal offsets. An
    anchor serves the windows that begin ``high`` down to ``low`` bytes before it; the span hash
    covers all their bytes and both offsets.
    """
    grams = span_hashes(_BYTE_CODES[block.data], GRAM)
    count = len(block.data) - LENGTH + 1
    if count <= 0:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    spot = ((grams >> PLACE_BITS) << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    at = window_minima(spot, LENGTH - GRAM + 1) & np.uint64((1 << int(PLACE_BITS)) - 1)
    owner = block.owner()[:count]
    window = np.flatnonzero(np.arange(count) + LENGTH <= block.offsets[owner + 1])
    at, owner = at[window].astype(np.int64), owner[window]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(change)
    first, last = window[begin], window[np.append(begin[1:], len(at))[:len(begin)] - 1]
    place, text = at[begin], owner[begin]
    length = last - first + LENGTH
    span = mix(length.astype(np.uint64) * MIX_B + (place - first).astype(np.uint64))
    for k in range(0, LENGTH + SIDE, GRAM):     # pieces that cover the whole span
        span = mix(span * MIX_A + grams[first + np.minimum(k, length - GRAM)])
    return [text, place - block.offsets[text], place - last, place - first, grams[place], span]


def _first_of_class(order_keys: list[np.ndarray], span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is first of its span hash, repeats the row before it) in the order of ``order_keys``."""
    order = np.lexsort([*order_keys[::-1], span])
    same = np.zeros(len(span), bool)
    same[1:] = span[order][1:] == span[order][:-1]
    equal = same.copy()
    for key in order_keys:
        equal[1:] &= key[order][1:] == key[order][:-1]
    first, twin = np.empty(len(span), bool), np.empty(len(span), bool)
    first[order], twin[order] = ~same, equal
    return first, twin


def anchor_rows(docs: DataFrame, every: bool = False) -> DataFrame:
    """``ANCHOR`` rows of all documents. Of equal spans that meet in one batch only the earliest
    stays an anchor (kind 0); the others are known to be repeats (kind 1) and are spread evenly.
    With ``every``, all of them stay anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (np.asarray(batch.column(k)) for k in (0, 1))
            parts = []
            for block in blocks(batch.column(2), SMALL_BLOCK):
                found = anchors(block)
                found[0] = found[0] + block.first
                parts.append(found)
            if not parts:
                continue
            text, place, low, high, h, s = (np.concatenate(c) for c in zip(*parts))
            i, th = ids[text], hashes[text]
            first, twin = _first_of_class([i, th, place], s)
            first |= every
            h = np.where(first, h, mix(s + place.astype(np.uint64) + i.astype(np.uint64)))
            keep = ~twin
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[keep]) for c in (
                    h.view(np.int64), s.view(np.int64), i, th, place.astype(np.int32),
                    low.astype(np.int32), high.astype(np.int32), (~first).astype(np.int32))],
                ["h", "s", "i", "th", "pos", "low", "high", "kind"])

    return docs.mapInArrow(thrifty(run), ANCHOR)


def _found(i, th, kind, a, b, c, h) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int64()), pa.array(th, pa.int64()), pa.array(np.full(len(i), kind, np.int32)),
         *(pa.array(x.astype(np.int32)) for x in (a, b, c)), pa.array(h, pa.int64())],
        ["i", "th", "kind", "a", "b", "c", "h"])


def sift(rows: DataFrame) -> DataFrame:
    """Removed spans (kind 1), and the earliest anchor of every span class whose bucket holds
    another class (kind 0: pos, low, high), from anchors sorted by bucket, class and place.

    A stream over the sorted rows that remembers one row, however large a bucket is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None             # the row before this batch
        waiting = None          # the last class's first row, and whether its bucket has others
        for batch in batches:
            if not batch.num_rows:
                continue
            h, s, i, th, pos, low, high, kind = (np.asarray(c) for c in batch.columns)
            shown = kind == 0
            spans = [np.stack([c[~shown] for c in (i, th, pos, low, high)])]
            h, s, i, th, pos, low, high = (c[shown] for c in (h, s, i, th, pos, low, high))
            if len(h):
                head = last or (~h[0], 0, 0, 0, 0)
                before = [np.concatenate([[p], c[:-1]]) for p, c in zip(head, (h, s, i, th, pos))]
                if last is None:
                    before[1] = np.concatenate([[~s[0]], s[:-1]])
                same = (h == before[0]) & (s == before[1])
                twin = same & (i == before[2]) & (th == before[3]) & (pos == before[4])
                later = same & ~twin
                spans.append(np.stack([c[later] for c in (i, th, pos, low, high)]))
                last = tuple(c[-1] for c in (h, s, i, th, pos))
                first = np.flatnonzero(~same)
                lead = np.stack([c[first] for c in (h, i, th, pos, low, high)])
                joined = np.zeros(len(first), bool)
                if waiting is not None:
                    lead = np.concatenate([waiting[0], lead], 1)
                    joined = np.concatenate([[waiting[1]], joined])
                if lead.shape[1]:
                    near = lead[0][1:] == lead[0][:-1]
                    joined[1:] |= near
                    joined[:-1] |= near
                    waiting = lead[:, -1:], bool(joined[-1])
                    out = lead[:, :-1][:, joined[:-1]]
                    yield _found(out[1], out[2], 0, out[3], out[4], out[5], out[0])
            i, th, pos, low, high = np.concatenate(spans, 1)
            yield _found(i, th, 1, pos - high, pos - low + LENGTH, pos, i * 0)
        if waiting is not None and waiting[1]:
            out = waiting[0]
            yield _found(out[1], out[2], 0, out[3], out[4], out[5], out[0])

    return (rows.repartition("h").sortWithinPartitions("h", "s", "i", "th", "pos")
            .mapInArrow(thrifty(run), FOUND))


# --- Texts beside what was found in them -------------------------------------------------------

def packed(docs: DataFrame) -> DataFrame:
    """(i, th, z[, extra]): texts compressed for the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            text = [packer.compress((t.as_py() or "").encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(text, pa.binary()), *batch.columns[3:]],
                ["i", "th", "z", *batch.schema.names[3:]])

    return docs.mapInArrow(thrifty(run), "i long, th long, z binary" + _extra(docs))


def _extra(docs: DataFrame) -> str:
    return "".join(f", extra {f.dataType.simpleString()}" for f in docs.schema if f.name == "extra")


def contexts(docs: DataFrame, found: DataFrame, bucket_rows: int | None = None) -> DataFrame:
    """Bytes on either side of the anchors that have rivals in their bucket, and whether the bucket
    has more than ``bucket_rows`` of them."""
    rivals = found.filter("kind = 0").select("i", "th", "h", "a", "b", "c")
    if bucket_rows is None:
        rivals = rivals.withColumn("large", F.lit(False))
    else:
        large = (rivals.groupBy("h").agg(F.count("*").alias("n"))
                 .filter(F.col("n") > bucket_rows).select("h", F.lit(True).alias("large")))
        rivals = rivals.join(large, "h", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    own = rivals.groupBy("i", "th").agg(
        F.collect_list(F.struct("h", "a", "b", "c", "large")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for i, th, z, spots in zip(*batch.columns):
                data = opener.decompress(z.as_py())
                spot = spots.values.flatten()
                pos, n = np.asarray(spot[1]), len(spot[0])
                yield pa.RecordBatch.from_arrays(
                    [spot[0], pa.array([i.as_py()] * n, pa.int64()),
                     pa.array([th.as_py()] * n, pa.int64()), *spot[1:4],
                     pa.array([data[max(0, p - SIDE):p] for p in pos], pa.binary()),
                     pa.array([data[p:p + LENGTH] for p in pos], pa.binary()), spot[4]],
                    ["h", "i", "th", "pos", "low", "high", "before", "after", "large"])

    return docs.join(own, ["i", "th"]).select("i", "th", "z", "at").mapInArrow(
        thrifty(run), CONTEXT)


# --- The enhanced suffix array of a bucket -----------------------------------------------------

def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n            # equal up to low, different before high
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every common-prefix interval, inner ones first.

    ``lcp[k]`` is the common prefix of suffixes k - 1 and k; only prefixes from ``least`` on.
    """
    stack = [(0, 0)]
    for k in range(1, len(lcp) + 1):
        here = lcp[k] if k < len(lcp) else 0
        left = k - 1
        while here < stack[-1][0]:
            length, left = stack.pop()
            if length >= least:
                yield length, left, k - 1
        if here > stack[-1][0]:
            stack.append((here, left))


def scan_bucket(rows: list[tuple], emit_repeat=None) -> list[tuple[int, int]]:
    """(bytes before, bytes after) the anchor that each row loses, from the bucket's suffix array.

    ``rows`` = (i, th, pos, before, after) in suffix order. The occurrences in a common-prefix
    interval are tested for what lies to their left: sorted by it, they fall into intervals of a
    common left extension, and at that extension an interval is left-diverse (the bytes before it
    differ, or a text begins). An interval whose extension and prefix make up ``LENGTH`` bytes is a
    maximal repeat with all its occurrences; all but the earliest lose it.
    """
    n = len(rows)
    lost = [(0, 0)] * n
    lcp = [0] + [common_prefix(rows[k - 1][4], rows[k][4]) for k in range(1, n)]
    left = [row[3][::-1] for row in rows]
    for length, first, last in intervals(lcp, GRAM):
        need = LENGTH - length
        members = [k for k in range(first, last + 1) if len(left[k]) >= need]
        members.sort(key=left.__getitem__)
        shared = [0] + [common_prefix(left[x], left[y]) for x, y in zip(members, members[1:])]
        groups = list(intervals(shared, max(1, need)))
        if need == 0 and len(members) > 1:
            groups.append((0, 0, len(members) - 1))
        for reach, low, high in groups:
            own = members[low:high + 1]
            head = min(own, key=lambda k: rows[k][:3])
            for k in own:
                if k != head:
                    a, b = lost[k]
                    lost[k] = max(a, reach), max(b, length)
            if emit_repeat is not None:
                for k in own:
                    emit_repeat(own, reach + length, rows[k], rows[k][2] - reach)
    return lost


def _window_rows(bucket: list[tuple]) -> Iterator[tuple]:
    """All windows that the anchors of a large bucket serve, under two 64-bit hashes."""
    for i, th, pos, before, after, low, high in bucket:
        for back in range(low, high + 1):
            window = before[len(before) - back:] + after[:LENGTH - back]
            w, v = np.frombuffer(hashlib.blake2b(window, digest_size=16).digest(), np.int64)
            yield i, th, SPLIT, pos - back, pos - back + LENGTH, int(w), int(v)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)],
        ["i", "th", "kind", "a", "b", "w", "v"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], bool]]:
    """(rows of a bucket or some rows of a large one, is it large); rows that repeat an anchor are
    left out."""
    held, bucket, last = [], None, None
    for batch in batches:
        for h, i, th, pos, low, high, before, after, large in zip(
                *(c.to_pylist() for c in batch.columns)):
            if (h, large) != bucket or large and len(held) == 256:
                if held:
                    yield held, bucket[1]
                held, bucket = [], (h, large)
            if (h, i, th, pos) == last:
                continue
            last = h, i, th, pos
            held.append((i, th, pos, before, after, low, high))
    if held:
        yield held, bucket[1]


def scan(rows: DataFrame) -> DataFrame:
    """``SPAN`` rows: what the buckets' suffix arrays remove, or the windows of large buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for bucket, large in _buckets(batches):
            if large:
                out.extend(_window_rows(bucket))
            elif len(bucket) > 1:
                for row, (a, b) in zip(bucket, scan_bucket(bucket)):
                    if b:
                        out.append((row[0], row[1], ONCE, row[2] - a, row[2] + b, 0, 0))
            if len(out) > 5000:
                yield _span_batch(out)
                out = []
        yield _span_batch(out)

    return _by_bucket(rows).mapInArrow(thrifty(run), SPAN)


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Buckets in suffix order; rows of large ones, which need not meet, are dealt evenly."""
    deal = F.when(F.col("large"), F.xxhash64("i", "th", "pos")).otherwise(F.col("h"))
    return (rows.withColumn("deal", deal).repartition("deal")
            .sortWithinPartitions("h", "after", "i", "th", "pos").drop("deal"))


def later_windows(rows: DataFrame) -> DataFrame:
    """(i, th, a, b) of windows that also begin earlier; summed up before they are shuffled."""
    windows = rows.filter(F.col("kind") == SPLIT)
    place = F.struct("i", "th", "a")
    first = windows.groupBy("w", "v").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    return (windows.join(first.filter("n > 1"), ["w", "v"]).filter(place != F.col("first"))
            .select("i", "th", "a", "b"))


# --- Results -----------------------------------------------------------------------------------

def _prepared(docs: DataFrame, id_col: str, text_col: str,
              columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    own = keyed(docs, id_col, text_col)
    return packed(keyed(docs, id_col, text_col, columns)), materialize(sift(anchor_rows(own)))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat, length, id, start): all occurrences of maximal repeats of ``LENGTH`` bytes or more.

    What is seen of an occurrence is up to ``SIDE`` bytes before its anchor and ``LENGTH`` from there
    on, so a longer repeat shows as one group of up to that length at each of its anchors. Places that
    look alike form a class, whose earliest one is sorted for all; the classes' members are joined
    back to the groups. The classes of a bucket are scanned in one task.
    """
    own = keyed(docs, id_col, text_col)
    found = materialize(anchor_rows(own, every=True).select(
        "i", "th", "kind", F.col("pos").alias("a"), F.col("low").alias("b"),
        F.col("high").alias("c"), "h").distinct())
    shared = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    places = materialize(contexts(packed(own), found.join(shared, "h", "left_semi"))
                         .dropDuplicates(["i", "th", "pos"])
                         .withColumn("c", F.xxhash64("h", "before", "after")))
    classes = places.groupBy("h", "c").agg(
        F.min(F.struct("i", "th", "pos")).alias("at"), F.first("before").alias("before"),
        F.first("after").alias("after"), F.count("*").alias("n"))
    heads = classes.select("h", "at.*", "c", "n", "before", "after", F.lit(False).alias("large"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        for bucket, _ in _buckets(batches):
            out: list[tuple] = []
            full = set()        # classes in a group of all that is seen of them

            def emit(members, length, row, start):
                head = min(members, key=lambda k: bucket[k][:3])
                key = repr((bucket[head][:2], bucket[head][2] - (row[2] - start), length)).encode()
                name = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)
                if length == len(row[3]) + len(row[4]):
                    full.add(row[5])
                out.append((name, length, row[5], start - row[2]))

            scan_bucket(bucket, emit)
            for k, row in enumerate(bucket):
                if row[6] > 1 and row[5] not in full:
                    emit([k], len(row[3]) + len(row[4]), row, row[2] - len(row[3]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)],
                ["repeat", "length", "c", "shift"])

    groups = _by_bucket(heads).mapInArrow(run, REPEAT).distinct()
    return (groups.join(places.select("c", "i", "th", "pos"), "c")
            .select("repeat", "length", "i", "th", (F.col("pos") + F.col("shift")).alias("start"))
            .distinct().select("repeat", "length", id_of().alias(id_col), "start"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   bucket_rows: int = BUCKET_ROWS, columns: list[str] | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept, extra]) per row of ``docs``.

    Every byte is removed that lies in a ``LENGTH``-byte string which also starts earlier: in a
    document of smaller id, or further left in the same one. With ``columns``, ``kept`` is the text
    that remains (a character that lost some of its bytes goes altogether) and ``extra`` holds those
    columns of the row.

    Two equal strings have their anchor at the same offset, so they meet in the anchor's bucket.
    There, of anchors whose whole spans are equal only the earliest goes on, and the others lose the
    span; the ones that go on are sorted by the bytes from the anchor on and scanned for
    common-prefix intervals. Buckets of over ``bucket_rows`` such anchors are cut into single
    windows, whose earliest place is an ordinary aggregate.

    A null text is empty; a null id comes before all others; rows of one id are ordered by a hash of
    their text, and rows equal in both are one document (each gets its result). Texts shorter than
    ``LENGTH`` lose nothing. Other columns are ignored, an empty table gives an empty result.
    """
    z, found = _prepared(docs, id_col, text_col, columns)
    scanned = materialize(scan(contexts(z, found, bucket_rows)))
    spans = (found.filter("kind = 1").select("i", "th", "a", "b")
             .unionByName(scanned.filter(F.col("kind") == ONCE).select("i", "th", "a", "b"))
             .unionByName(later_windows(scanned)))
    own = spans.groupBy("i", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, kept = [], []
            for z, spans in zip(batch.column(1), batch.column(2)):
                data = opener.decompress(z.as_py())
                left, removed, runs = data, 0, 0
                if spans.is_valid:
                    a, b = (np.asarray(c) for c in spans.values.flatten())
                    delta = np.zeros(len(data) + 1, np.int32)
                    np.add.at(delta, a, 1)
                    np.add.at(delta, b, -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    removed = int(gone.sum())
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((len(data), removed, runs, hashlib.sha256(left).hexdigest()))
                kept.append(left)
            sizes = list(zip(*rows)) if rows else [[]] * 4
            out = [batch.column(0), *(pa.array(c, pa.int64()) for c in sizes[:3]),
                   pa.array(sizes[3], pa.string())]
            names = ["i", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if batch.num_columns > 3:
                out += [pa.array([k.decode(errors="ignore") for k in kept], pa.string()),
                        batch.column(3)]
                names += ["kept", "extra"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "i long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    more = [] if columns is None else ["extra"]
    if more:
        schema += ", kept string" + _extra(z)
    out = z.join(own, ["i", "th"], "left").select("i", "z", "spans", *more).mapInArrow(
        thrifty(run), schema)
    return out.withColumn("i", id_of()).withColumnRenamed("i", id_col)
