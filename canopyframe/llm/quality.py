"""Quality rules: document statistics, fixed base rules, and boosted trees with monotonic features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.common import (MIX_B, Block, blocks, mix, run_hashes, span_hashes, word_spans)
from canopyframe.session import materialize

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20       # base rules: words; per cent of words in repeats
TRAIN_ROWS = 20_000                       # bound of the labelled sample
TREES, DEPTH, BINS, RATE, LEAF_ROWS = 60, 3, 32, 0.2, 8

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
         "n_upper", "n_lower", "n_digits", "n_marks"]
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share",
            "upper_share", "digit_share", "mark_share", "words_per_line"]
# -1: a larger value never raises the verdict.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(block: Block) -> np.ndarray:
    """One row of ``STATS`` per text, over all of its bytes."""
    data, offsets, n = block.data, block.offsets, block.n
    out = np.zeros((n, len(STATS)), np.int64)
    if not len(data):
        return out
    begin, end = word_spans(data, IS_WORD, offsets[:-1])
    owner = np.searchsorted(offsets, begin, "right") - 1
    out[:, 0] = np.bincount(owner, minlength=n)
    out[:, 1] = _per_text(IS_WORD[data] & ((data & 0xC0) != 0x80), offsets)
    out[:, 2] = _per_text(_SYMBOL[data], offsets)
    # Lines with a word: equal lines of a text get equal codes.
    newline = data == 10
    line_start = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(newline) + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - newline[line_end - 1]
    line_owner = np.searchsorted(offsets, line_start, "right") - 1
    words_before = np.searchsorted(begin, line_end) - np.searchsorted(begin, line_start)
    some = words_before > 0
    codes = run_hashes(data, line_start[some], line_end[some])
    line_owner = line_owner[some]
    codes = mix(codes + line_owner.astype(np.uint64) * MIX_B)
    _, first = np.unique(codes, return_index=True)
    again = np.ones(len(codes), bool)
    again[first] = False
    out[:, 3] = np.bincount(line_owner[again], minlength=n)
    out[:, 5] = np.bincount(line_owner, minlength=n)
    # Windows of five words that their text holds twice or more.
    windows = span_hashes(run_hashes(data, begin, end), WINDOW)
    if len(windows):
        whole = owner[:len(windows)] == owner[WINDOW - 1:]
        at = np.flatnonzero(whole)
        keys = mix(windows[at] + owner[at].astype(np.uint64) * MIX_B)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        delta = np.zeros(len(begin) + 1, np.int64)
        np.add.at(delta, at[twice], 1)
        np.add.at(delta, at[twice] + WINDOW, -1)
        out[:, 4] = np.bincount(owner[np.cumsum(delta)[:-1] > 0], minlength=n)
    out[:, 6] = _per_text((data >= 65) & (data <= 90), offsets)
    out[:, 7] = _per_text(((data >= 97) & (data <= 122)) | (data >= 0xC0), offsets)
    out[:, 8] = _per_text((data >= 48) & (data <= 57), offsets)
    out[:, 9] = _per_text(_MARK[data], offsets)
    return out


def features(stats: np.ndarray) -> np.ndarray:
    s = dict(zip(STATS, stats.T.astype(np.float64)))
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars,
                     s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / chars,
                     s["n_digits"] / chars, s["n_marks"] / words, s["n_words"] / lines], 1)


@dataclass
class Forest:
    """All trees in flat node arrays; a leaf points to itself."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(DEPTH):
            low = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int]) -> Forest:
    """Gradient boosting of the logistic loss on binned features.

    A split on a constrained feature is taken only if its two leaves are in the right order, and
    what lies below keeps to its side of the middle between them, so that the sum of all trees is
    monotonic. Rows are weighted to count both classes alike.
    """
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.9
    one_class = not len(y) or y.min() == y.max()
    base = float(np.log(share / (1 - share))) if one_class else 0.0
    if not one_class:
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
                for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        z = np.zeros(len(y))

        def add(**node) -> int:
            for key, value in node.items():
                nodes[key].append(value)
            return len(nodes["value"]) - 1

        def build(rows, g, h, depth, low, high) -> int:
            best_gain, best = 1e-6, None
            gs, hs = g[rows].sum(), h[rows].sum()
            if depth < DEPTH and len(rows) >= 2 * LEAF_ROWS:
                for f, c in enumerate(cuts):
                    own, size = bins[rows, f], len(c) + 1
                    gl = np.cumsum(np.bincount(own, g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(own, h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(own, minlength=size))[:-1]
                    a = np.clip(-gl / (hl + 1), low, high)
                    b = np.clip(-(gs - gl) / (hs - hl + 1), low, high)
                    gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                    gain[(nl < LEAF_ROWS) | (len(rows) - nl < LEAF_ROWS)] = 0
                    if monotone[f]:
                        gain[monotone[f] * (b - a) < 0] = 0
                    if len(gain) and gain.max() > best_gain:
                        k = int(gain.argmax())
                        best_gain, best = gain[k], (f, k, a[k], b[k])
            at = add(feature=0, threshold=0.0, left=0, right=0, value=0.0)
            nodes["left"][at] = nodes["right"][at] = at
            if best is None:
                nodes["value"][at] = RATE * float(np.clip(-gs / (hs + 1), low, high))
                z[rows] += nodes["value"][at]
                return at
            f, k, a, b = best
            middle, low_side = (a + b) / 2, bins[rows, f] <= k
            bounds = [(low, high), (low, high)]
            if monotone[f] < 0:
                bounds = [(middle, high), (low, middle)]
            elif monotone[f] > 0:
                bounds = [(low, middle), (middle, high)]
            nodes["feature"][at], nodes["threshold"][at] = f, float(cuts[f][k])
            nodes["left"][at] = build(rows[low_side], g, h, depth + 1, *bounds[0])
            nodes["right"][at] = build(rows[~low_side], g, h, depth + 1, *bounds[1])
            return at

        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            roots.append(build(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), 0,
                               -4.0, 4.0))
    return Forest(np.array(nodes["feature"], np.int64), np.array(nodes["threshold"]),
                  np.array(nodes["left"], np.int64), np.array(nodes["right"], np.int64),
                  np.array(nodes["value"]), np.array(roots, np.int64), base)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *STATS) per row, in one map over whole texts; a null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(b) for b in blocks(batch.column(1))]
            rows = np.concatenate(found) if found else np.zeros((0, len(STATS)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in rows.T)], ["id", *STATS])

    return (docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text")
            .mapInArrow(run, "id long, " + ", ".join(f"{s} long" for s in STATS)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    Statistics are taken from every whole text and written once; the trees learn from those of at
    most ``train_rows`` labelled documents (smallest id hashes; the documented bound) and then judge
    every row. ``kept`` is false where a base rule fails, else score >= 0.5.

    A null or empty text has no words and fails the base rules. Without labels of both classes the
    verdict is the prior's. Labels that are null or have a null id are skipped, an id labelled twice
    counts with its largest label, repeated rows repeat, other columns are ignored.
    """
    spark = docs.sparkSession
    stats = materialize(document_statistics(docs, id_col, text_col))
    picked = (labels.select(F.col(id_col).cast("long").alias("pick"),
                            F.col(label_col).cast("int").alias("y"))
              .filter("pick is not null and y in (0, 1)").groupBy("pick").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("pick", F.lit("quality")), "pick").limit(train_rows))
    rows = (stats.join(picked, F.col("id") == F.col("pick"))
            .select("y", *STATS).limit(2 * train_rows).toPandas())
    rows = rows.sort_values(list(rows.columns)).to_numpy(np.int64).reshape(-1, 1 + len(STATS))
    monotone = [MONOTONE.get(f, 0) for f in FEATURES]
    forest = grow(features(rows[:, 1:]), rows[:, 0].astype(np.float64), monotone)
    sent = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for batch in batches:
            s = np.stack([np.asarray(c) for c in batch.columns[1:]], 1).reshape(-1, len(STATS))
            score = 1 / (1 + np.exp(-forest.logit(features(s))))
            failed = (s[:, 0] < LEAST_WORDS) | (100 * s[:, 4] > MOST_REPEATED * s[:, 0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(failed), pa.array(~failed & (score >= 0.5)),
                 pa.array(score)],
                ["id", *STATS[:5], "base_failed", "kept", "score"])

    fields = "id long, " + ", ".join(f"{s} long" for s in STATS[:5])
    return (stats.mapInArrow(run, fields + ", base_failed boolean, kept boolean, score double")
            .withColumnRenamed("id", id_col))
