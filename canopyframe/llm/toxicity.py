"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from sys import intern
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.common import fold_of, give_back, thrifty

DECAY = 0.6                # weight of one skipped character
ORDERS = ((3, 4), (4, 4))  # (characters of a subsequence, places it may span beyond its first)
TABLE_BITS = 20            # subsequences are hashed to 2**20 places
LANDMARKS = 400
TRAIN_TOXIC, TRAIN_CLEAN = 2_500, 5_000      # bounds of the training sample
CLEAN_WORDS = 16_000       # distinct clean words that the machine is first trained against
HARD_WORDS = 4_000         # best-scoring clean words that each round adds to them
TRAIN_ROUNDS = 5
BLOCK_CHARS = 1 << 18
MARK = 63                  # opens every word

_GAPS = [(d, DECAY ** (d[-1] + 1 - size)) for size, span in ORDERS
         for d in combinations(range(1, span + 1), size - 1)]


@dataclass
class Model:
    weights: np.ndarray     # one per hashed subsequence
    bias: float
    slope: float            # score = 1 / (1 + exp(-(slope * best + offset)))
    offset: float


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, word of each code, first word of each text).

    Letters become codes, white space ends a word, everything else is left out, so that signs put
    between letters don't matter. Letters that stand alone one after another form one word. Every
    word begins with ``MARK``; every text has one empty word at least.
    """
    points = np.frombuffer("".join(f" {t.lower()}" for t in texts).encode(
        "utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum([0] + [len(t.lower()) + 1 for t in texts])[:-1]
    letter = (points >= 97) & (points <= 122)
    other = points >= 0xC0
    blank = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0xA0) | (points == 0x3000)
    codes = np.where(letter, points - 96, np.where(other & ~blank, 27 + points % 36, 0)).astype(
        np.uint8)
    codes[blank] = MARK
    first = np.zeros(len(points), bool)
    first[starts] = True
    keep = codes > 0
    codes, first = codes[keep], first[keep]
    # A blank between two single letters goes: blank letter blank letter blank.
    space = np.concatenate([codes == MARK, [True, True, True]])
    n = len(codes)
    single = np.zeros(n + 2, bool)          # a blank followed by exactly one letter
    single[:n] = space[:n] & ~space[1:n + 1] & space[2:n + 2]
    joined = np.zeros(n, bool)
    joined[2:] = single[2:n] & single[:max(n - 2, 0)]
    keep = ~(joined & ~first)
    codes, first = codes[keep], first[keep]
    word = np.cumsum(codes == MARK) - 1
    return codes, word, word[first]


def subsequences(codes: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(lies in one word, hashed subsequence, weight) by first place, for every way to skip."""
    wide = codes.astype(np.uint32)
    n = len(wide)
    same = {d: (word[d:] == word[:n - d]).astype(np.float32) for d in {g[-1] for g, _ in _GAPS}}
    prefix: dict[tuple[int, ...], np.ndarray] = {(): wide}
    for gaps, weight in _GAPS:
        for k in range(len(gaps)):
            head = gaps[:k + 1]
            if head not in prefix:
                left, d = prefix[head[:-1]], head[-1]
                prefix[head] = (left[:n - d] << np.uint32(6)) | wide[d:] if n > d else wide[:0]
        hashed = prefix[gaps] * np.uint32(0x9E3779B1)
        hashed += np.uint32(len(gaps) * 0x5EBCA6B)
        hashed >>= np.uint32(32 - TABLE_BITS)
        yield same[gaps[-1]][:len(hashed)], hashed, weight


def word_scores(weights: np.ndarray, codes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Sum of weights of every word's subsequences."""
    total = np.zeros(len(codes), np.float32)
    for here, hashed, weight in subsequences(codes, word):
        total[:len(hashed)] += (here * np.float32(weight)) * weights.take(hashed)
    return np.add.reduceat(total, np.flatnonzero(codes == MARK)) if len(codes) else total


def best_words(model_weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """The best word's sum per text."""
    codes, word, first = symbols(texts)
    return np.maximum.reduceat(word_scores(model_weights, codes, word), first)


def _occurrences(words: list[str]):
    """(word, hashed subsequence, weight) of all words' subsequences."""
    codes, word, first = symbols(words)
    owner = np.searchsorted(first, np.arange(int(word[-1]) + 1), "right") - 1
    rows, keys, values = [], [], []
    for here, hashed, weight in subsequences(codes, word):
        at = np.flatnonzero(here)
        rows.append(owner[word[at]])
        keys.append(hashed[at].astype(np.int64))
        values.append(np.full(len(at), weight, np.float32))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(values)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of every word with every landmark, unnormalised."""
    rows, keys, values = _occurrences(landmarks)
    used, place = np.unique(keys, return_inverse=True)
    features = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(features, (place, rows), values)
    index = np.full(1 << TABLE_BITS, -1, np.int64)
    index[used] = np.arange(len(used))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    step = 50
    for at in range(0, len(words), step):
        rows, keys, values = _occurrences(words[at:at + step])
        hit = index[keys] >= 0
        rows, keys, values = rows[hit], index[keys[hit]], values[hit]
        order = np.argsort(rows, kind="stable")
        own, first = np.unique(rows[order], return_index=True)
        if len(own):
            shared = features[keys[order]]
            shared *= values[order][:, None]
            out[at + own] = np.add.reduceat(shared, first)
    return out


def _features(words: list[str], landmarks: list[str], fold: np.ndarray) -> np.ndarray:
    """``kernel`` times ``fold``, made for some words at a time: only the product is held whole."""
    out = np.empty((len(words), fold.shape[1]), np.float32)
    step = 12_288       # a multiple of what the matrix product takes at once, so sums stay the same
    for at in range(0, len(words), step):
        out[at:at + step] = kernel(words[at:at + step], landmarks) @ fold
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last weight is the bias."""
    size = x.shape[1] + 1
    w, ridge = np.zeros(size), np.full(size, 1.0)
    ridge[-1] = 1e-3

    def margins(w):
        return y * (x @ w[:-1].astype(np.float32) + w[-1])

    def loss(w, m):
        return (ridge * w * w).sum() + (cost * np.maximum(0, 1 - m) ** 2).sum()

    margin = margins(w)
    for _ in range(30):
        active = np.flatnonzero(margin < 1)
        gradient, hessian = ridge * w, np.diag(ridge)
        for at in range(0, len(active), 4096):      # a few rows at a time: memory stays small
            k = active[at:at + 4096]
            part = np.hstack([x[k], np.ones((len(k), 1), np.float32)]).astype(np.float64)
            gradient = gradient - part.T @ (cost[k] * y[k] * (1 - margin[k]))
            hessian = hessian + (part * cost[k][:, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        now = loss(w, margin)
        for _ in range(20):
            fresh = margins(w - step)
            if loss(w - step, fresh) <= now:
                break
            step = step / 2
        w, margin = w - step, fresh
        if np.abs(step).max() < 1e-5:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic curve, a little held back."""
    w, design = np.zeros(2), np.stack([x, np.ones(len(x))], 1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (p - target) + 1e-3 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Learns which words (or runs of single letters) make a text toxic from labels of whole texts.

    Round 1 takes as examples the words found in several toxic and in no clean texts; later rounds
    add the best-scoring word of each toxic text that has none. Words of clean texts are the other
    class. Landmarks are toxic examples and clean words; the kernel matrix among them gives the
    Nyström features in which the machine is linear. As that kernel is a sum over shared
    subsequences, the machine folds into one weight per subsequence. A fifth of the texts is kept
    for the curve that turns the best word's margin into a probability.
    """
    y = np.array(toxic)
    train = [k for k in range(len(texts)) if k % 5 != 4]
    held = [k for k in range(len(texts)) if k % 5 == 4]
    bad, good = Counter(), Counter()
    vocab: dict[int, list[str]] = {}
    for k in train:
        own = {intern(w.strip(".,;:!?\"'()[]#*$%&|<>")) for w in texts[k].lower().split()}
        (bad if y[k] else good).update(own)
        if y[k]:
            vocab[k] = sorted(own)
    share = max(1e-6, y[train].mean())
    # A word that only toxic texts have by chance would have to win this often in a row.
    least = max(2, int(np.ceil(8 / -np.log(min(share, 0.9)))))
    witness = {w for w, n in bad.items() if n >= least and not good[w] and len(w) > 1}
    clean = sorted((w for w in good if w), key=lambda w: hash_of(w))[:CLEAN_WORDS]
    if not witness or not clean:
        prior = np.clip(share, 0.01, 0.49)
        return Model(np.zeros(1 << TABLE_BITS), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    model, hard = None, []
    for _ in range(TRAIN_ROUNDS):
        ranked = sorted(witness, key=lambda w: (-bad[w], w))
        half = LANDMARKS // 2
        landmarks = ranked[:half] + hard[-HARD_WORDS:][:half // 2]
        landmarks += clean[:LANDMARKS - len(landmarks)]
        positives = ranked[:4 * LANDMARKS]
        words = positives + clean + hard
        k_mm = kernel(landmarks, landmarks).astype(np.float64)
        scale = 1 / np.sqrt(np.maximum(np.diag(k_mm), 1e-9))
        values, vectors = np.linalg.eigh(k_mm * scale * scale[:, None])
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        x = _features(words, landmarks, (scale[:, None] * root).astype(np.float32))
        label = np.r_[np.ones(len(positives)), -np.ones(len(clean) + len(hard))]
        cost = np.r_[np.full(len(positives), 1.0), np.full(len(clean) + len(hard), 0.3)]
        w = _machine(x, label, cost)
        del x       # not kept beside the next round's
        give_back()
        # sum_j c_j k(word, landmark_j) as one weight per subsequence
        c = scale * (root @ w[:-1])
        rows, keys, gains = _occurrences(landmarks)
        weights = np.zeros(1 << TABLE_BITS)
        np.add.at(weights, keys, gains * c[rows])
        model = Model(weights, float(w[-1]), 1.0, 0.0)
        for k in train:
            if y[k] and not witness.intersection(vocab[k]):
                fresh = [v for v in vocab[k] if v and not good[v]]
                if fresh:
                    scores = best_words(weights, fresh) + model.bias
                    if scores.max() > 0:
                        witness.add(fresh[int(scores.argmax())])
        others = [v for v in good if v]
        scores = np.concatenate([best_words(weights, others[a:a + 5000])
                                 for a in range(0, len(others), 5000)])
        held_already = set(hard)
        hard += [w for w in (others[k] for k in np.argsort(-scores, kind="stable")[:HARD_WORDS])
                 if w not in held_already]
    kept = held if len(set(y[held])) == 2 else list(range(len(texts)))
    best = np.array([best_words(model.weights, [texts[k]])[0] for k in kept]) + model.bias
    model.slope, model.offset = _logistic(best, y[kept])
    return model


def hash_of(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass"))


def score(model: Model, texts: list[str]) -> np.ndarray:
    """Probability per whole text."""
    best = best_words(model.weights, texts).astype(np.float64)
    z = model.slope * (best + model.bias) + model.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                    label_col: str, where, toxic: int, clean: int) -> DataFrame | None:
    """(id, text, y) of at most so many labelled rows of each class: the smallest id hashes."""
    known = (labels.select(F.col(id_col).alias("pick"), F.col(label_col).alias("y"))
             .filter(F.col("pick").isNotNull() & F.col("y").isin(0, 1) & where("pick"))
             .groupBy("pick").agg(F.max("y").alias("y"))
             .withColumn("draw", F.xxhash64(F.col("pick"), F.lit("toxicity"))))
    chosen = [r for value, size in ((1, toxic), (0, clean))
              for r in known.filter(F.col("y") == value).orderBy("draw", "pick").limit(size).collect()]
    if not chosen:
        return None
    picked = docs.sparkSession.createDataFrame([(r["pick"], r["y"]) for r in chosen],
                                               "pick long, y int")
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(picked), F.col("id") == F.col("pick"))
            .select("id", "text", "y").limit(2 * (toxic + clean)))


def trained(sample: DataFrame | None) -> Model:
    """``fit`` on a bounded sample, in one task so that the driver holds the finished weights only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y, t or "") for batch in batches
                      for i, t, y in zip(*(c.to_pylist() for c in batch.columns)))
        if rows:
            model = fit([t for _, _, t in rows], [y for _, y, _ in rows])
            yield pa.RecordBatch.from_pydict({
                "weights": [model.weights.astype("<f4").tobytes()], "bias": [float(model.bias)],
                "slope": [float(model.slope)], "shift": [float(model.offset)]})

    found = sample.repartition(1).mapInArrow(
        thrifty(run), "weights binary, bias double, slope double, shift double").collect() if sample else []
    if not found:
        return Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0, 0.0, -3.0)
    row = found[0]
    return Model(np.frombuffer(row["weights"], "<f4"), row["bias"], row["slope"], row["shift"])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic", folds: int = 5,
                    held_fold: int = 0, train_toxic: int = TRAIN_TOXIC,
                    train_clean: int = TRAIN_CLEAN, columns: list[str] | None = None) -> DataFrame:
    """(id, held_out, score, predicted[, columns]) per row of ``docs``.

    Trains on at most ``train_toxic`` + ``train_clean`` labelled rows outside the held fold (the
    documented bound; they are chosen by a hash of their id) and scores every whole text in one map
    over the table. Labels, languages and ids are no input of a score.

    A null text counts as empty and gets the score of a text without words. With no label to learn
    from, every score is the prior. Null labels and label rows with a null id are skipped; a doc_id
    that is labelled twice counts with its largest label; repeated rows repeat.
    """
    spark = docs.sparkSession
    sample = training_sample(docs, labels, id_col, text_col, label_col,
                             lambda c: fold_of(c, folds) != held_fold, train_toxic, train_clean)
    sent = spark.sparkContext.broadcast(trained(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            # Bytes bound characters; a block goes on before the next one is opened.
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + BLOCK_CHARS, "right")))
                part = batch.slice(at, to - at)
                scores = score(model, [t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[first:], pa.array(scores),
                     pa.array((scores >= 0.5).astype(np.int32))],
                    [*names, "_score", "_predicted"])
                at = to

    columns = list(columns or [])
    # A text that is carried along is moved once.
    first = 0 if text_col in columns else 1
    kept = docs.select(F.col(text_col).alias("_read"), F.col(id_col),
                       *[c for c in columns if c != text_col],
                       (fold_of(id_col, folds) == held_fold).alias("_held"))
    fields = kept.withColumnRenamed("_read", text_col).schema.fields[first:]
    names = [f.name for f in fields]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return (kept.mapInArrow(thrifty(run), f"{types}, _score double, _predicted int")
            .withColumnsRenamed({"_held": "held_out", "_score": "score", "_predicted": "predicted"})
            .select(id_col, *columns, "held_out", "score", "predicted"))
