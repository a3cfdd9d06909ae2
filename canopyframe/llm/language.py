"""Language identification: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.common import BLOCK_BYTES, MIX_A, fold_of, mix

BUCKET_BITS = 15           # n-grams are hashed to 2**15 features
GRAMS = (1, 2, 3)
TRAIN_DOCS = 6_000         # bound of the training sample, all languages together
EPOCHS, BATCH = 3, 16
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray     # buckets x labels, already times idf
    bias: np.ndarray
    temperature: float


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each starts.

    There are as many blanks between texts as the longest n-gram has characters, so that no n-gram
    sees another text's letters.
    """
    points = np.frombuffer("".join(f"  {t.lower()} " for t in texts).encode(
        "utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([0] + [len(t.lower()) + 3 for t in texts])
    # ASCII characters that are no letters say nothing about a language.
    plain = points < 128
    letter = (points >= 97) & (points <= 122)
    return np.where(plain & ~letter, 32, points).astype(np.uint64), ends


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character (the last ones wrap to blanks)."""
    key = points * MIX_A
    for k in range(1, size):
        shifted = np.full(len(points), 32, np.uint64)
        shifted[:len(points) - k] = points[k:]
        key = key * np.uint64(1_000_003) + shifted * MIX_A
    return (mix(key + np.uint64(size)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, relative frequencies) of one text's n-grams."""
    points, _ = code_points([text])
    found = np.concatenate([grams(points, n) for n in GRAMS])
    buckets, counts = np.unique(found, return_counts=True)
    return buckets, counts / len(found)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Follow-the-regularised-leader with elastic-net penalties, then one temperature.

    Every tenth text is kept out of the weights and used for the temperature only. One label alone
    gives a constant model.
    """
    labels = sorted(set(langs))
    place = {label: k for k, label in enumerate(labels)}
    rows = [counts_of(t) for t in texts]
    buckets, n = 1 << BUCKET_BITS, len(labels)
    df = np.zeros(buckets)
    for b, _ in rows:
        df[b] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    # FTRL state: accumulated gradients (less the proximal part) and their squares.
    z, q = np.zeros((buckets, n)), np.zeros((buckets, n))
    bias_z, bias_q = np.zeros(n), np.zeros(n)
    train = [k for k in range(len(rows)) if k % 10 != 9] or list(range(len(rows)))
    held = [k for k in range(len(rows)) if k % 10 == 9] or train

    def weights(z, q):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(q)) / ALPHA + L2)

    scale = 100.0           # relative frequencies are small; keeps steps of a useful size
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            group = order[at:at + BATCH]
            used = np.unique(np.concatenate([rows[k][0] for k in group]))
            w = weights(z[used], q[used])
            b = weights(bias_z, bias_q)
            g, gb = np.zeros_like(w), np.zeros(n)
            for k in group:
                own, tf = rows[k]
                at_own = np.searchsorted(used, own)
                x = tf * idf[own] * scale
                p = softmax(x @ w[at_own] + b)
                p[place[langs[k]]] -= 1
                g[at_own] += np.outer(x, p)
                gb += p
            g, gb = g / len(group), gb / len(group)
            sigma = (np.sqrt(q[used] + g * g) - np.sqrt(q[used])) / ALPHA
            z[used] += g - sigma * w
            q[used] += g * g
            sigma = (np.sqrt(bias_q + gb * gb) - np.sqrt(bias_q)) / ALPHA
            bias_z += gb - sigma * b
            bias_q += gb * gb
    w, b = weights(z, q) * idf[:, None] * scale, weights(bias_z, bias_q)
    logits = np.array([rows[k][1] @ w[rows[k][0]] + b for k in held])
    truth = np.array([place[langs[k]] for k in held])
    # Targets keep one part in (texts + 2) for the other labels, so that a faultless held-out part
    # doesn't drive the temperature to nought.
    target = np.full(logits.shape, 1 / (len(truth) + 2) / max(1, n - 1))
    target[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
    losses = [(-(target * np.log(softmax(logits / t) + 1e-300)).sum(1).mean(), t)
              for t in np.geomspace(0.05, 20, 61)]
    return Model(labels, w.astype(np.float32), b, min(losses)[1])


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Label and calibrated probability per text, from all of its characters."""
    points, ends = code_points(texts)
    total = np.zeros((len(texts), len(model.labels)))
    for n in GRAMS:
        found = grams(points, n)
        for k in range(len(model.labels)):
            total[:, k] += np.add.reduceat(model.weights[:, k][found].astype(np.float64), ends[:-1])
    size = len(GRAMS) * np.diff(ends)
    p = softmax((total / size[:, None] + model.bias) / model.temperature)
    best = p.argmax(1)
    return [model.labels[k] for k in best], p[np.arange(len(texts)), best]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, where,
                    size: int) -> DataFrame | None:
    """(id, text, lang) of at most ``size`` labelled rows, the same share of each language (smallest id hashes first)."""
    known = docs.filter(F.col(lang_col).isNotNull() & where)
    ids = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"),
                       F.xxhash64(F.col(id_col).cast("string"), F.lit("lang")).alias("draw"))
    langs = [r[0] for r in ids.select("lang").distinct().orderBy("lang").limit(size).collect()]
    each = max(1, size // max(1, len(langs)))
    chosen = []
    for lang in langs:
        chosen += [r[0] for r in ids.filter(F.col("lang") == lang)
                   .orderBy("draw", "id").limit(each).select("id").collect()]
    picked = docs.sparkSession.createDataFrame([(c,) for c in chosen], "pick long") \
        if chosen else None
    if picked is None:
        return None
    # Whole texts; a fixed number of rows.
    return (known.join(F.broadcast(picked.distinct()), F.col(id_col) == F.col("pick"))
            .select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                    F.col(lang_col).alias("lang")).limit(2 * size))


def trained(sample: DataFrame | None) -> Model | None:
    """``fit`` on a bounded sample, in one task so that the driver holds the finished weights only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, g, t) for batch in batches
                      for i, t, g in zip(*(c.to_pylist() for c in batch.columns)) if t is not None)
        if rows:
            model = fit([t for _, _, t in rows], [g for _, g, _ in rows])
            yield pa.RecordBatch.from_pydict({
                "labels": [model.labels], "weights": [model.weights.astype("<f4").tobytes()],
                "bias": [model.bias.tolist()], "temperature": [float(model.temperature)]})

    schema = "labels array<string>, weights binary, bias array<double>, temperature double"
    found = sample.repartition(1).mapInArrow(run, schema).collect() if sample else []
    if not found:
        return None
    row = found[0]
    weights = np.frombuffer(row["weights"], "<f4").reshape(-1, len(row["labels"]))
    return Model(row["labels"], weights, np.array(row["bias"]), row["temperature"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", folds: int = 4, held_fold: int = 2,
             train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(id, held_out, lang_pred, score) per row.

    Learns from text and non-null label of documents outside the held fold, at most ``train_docs``
    of them (the documented bound), then predicts every whole text in one map over the table.

    A null text and one without a letter give ``und`` with score 0, as does every text if nothing
    can be learned. A null id is treated as empty text in the fold; repeated rows repeat; other
    columns are ignored.
    """
    spark = docs.sparkSession
    held = fold_of(id_col, folds) == held_fold
    sample = training_sample(docs, id_col, text_col, lang_col, ~held, train_docs)
    sent = spark.sparkContext.broadcast(trained(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            todo = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
            at = 0
            while at < len(todo):
                to, size = at + 1, len(texts[todo[at]])
                while to < len(todo) and size + len(texts[todo[to]]) <= BLOCK_BYTES // 4:
                    size += len(texts[todo[to]])
                    to += 1
                names, p = predict(model, [texts[k] for k in todo[at:to]])
                for k, name, score in zip(todo[at:to], names, p):
                    labels[k], scores[k] = name, score
                at = to
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(labels), pa.array(scores)],
                ["id", "held_out", "lang_pred", "score"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"),
                        F.col(text_col).alias("text"))
            .mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
            .withColumnRenamed("id", id_col))
