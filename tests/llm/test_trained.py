"""Trained operators on held-out documents, and their arithmetic against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from canopyframe.llm import language, quality, toxicity
from canopyframe.llm.common import blocks

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, id string, score string, y string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, "a", "b", "c") for i, t, lang in rows], DOCS)


# --- Toxicity -----------------------------------------------------------------------------------

def test_kernel_is_the_weighted_count_of_shared_subsequences():
    def parts(word):
        out = Counter()
        full = "\0" + word
        for gaps, weight in toxicity._GAPS:
            for k in range(len(full) - gaps[-1]):
                out[full[k] + "".join(full[k + d] for d in gaps)] += weight
        return out
    words = ["idiot", "idixot", "nation", "tidy", "moron"]
    got = toxicity.kernel(words, words)
    for a, x in enumerate(words):
        for b, y in enumerate(words):
            p, q = parts(x), parts(y)
            assert got[a, b] == pytest.approx(sum(p[s] * q[s] for s in p), rel=1e-5)


def test_folded_weights_equal_the_kernel_expansion():
    landmarks, words = ["idiot", "clown", "nation"], ["idixot", "clowning", "xyz"]
    c = np.array([1.5, -0.5, 0.25])
    rows, keys, gains = toxicity._occurrences(landmarks)
    weights = np.zeros(1 << toxicity.TABLE_BITS)
    np.add.at(weights, keys, gains * c[rows])
    got = toxicity.best_words(weights, words)
    assert got == pytest.approx(toxicity.kernel(words, landmarks) @ c, rel=1e-5)


def test_single_letters_and_inserted_signs_form_one_word():
    plain = toxicity.symbols(["an idiot here"])[0]
    for text in ("an i d i o t here", "an i.d.i.o.t here", "an i-dio#t here", "AN I D I O T here"):
        assert (toxicity.symbols([text])[0] == plain).all(), text
    assert len(toxicity.symbols(["", " ", "a b"])[2]) == 3


def test_toxicity_on_held_out_documents(spark, documents, labels):
    got = toxicity.score_documents(documents, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in got)
    right = np.mean([r["predicted"] == r["toxic"] for r in held])
    assert right > 0.95


def test_toxicity_tolerates_gaps_and_cases():
    draw = random.Random(1)
    vocab = ["".join(draw.choice("aehilnorst") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    clean = [" ".join(draw.choice(vocab) for _ in range(40)) for _ in range(300)]
    toxic = [f"{t} {draw.choice(['blockhead', 'dumbbell', 'pigfool'])} {t}" for t in clean[:120]]
    model = toxicity.fit(clean + toxic, [0] * 300 + [1] * 120)
    bad = ["so you b l o c k h e a d say", "what a block.head", "BLOCKHEAD", "a dumbbxell"]
    assert (toxicity.score(model, bad) > 0.5).all()
    fresh = [" ".join(draw.choice(vocab) for _ in range(60)) for _ in range(100)]
    assert (toxicity.score(model, fresh) < 0.5).mean() > 0.97


def test_toxicity_edge_cases(spark):
    rows = [(1, None, None), (2, "", None), (None, "word", None), (1, None, None), (3, "a " * 9000, "en")]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_documents(frame(spark, rows), none, columns=["lang"]).collect()
    assert len(got) == 5 and all(0 <= r["score"] < 0.5 for r in got)
    some = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(frame(spark, rows), some).count() == 5
    assert toxicity.score_documents(frame(spark, []), some).count() == 0


# --- Quality ------------------------------------------------------------------------------------

def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {k + d for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1
               for d in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered)]


def test_statistics():
    draw = random.Random(2)
    texts = ["".join(draw.choice(["a", "b", " ", " ", "\n", "é", "#", "\t", "日", "\x85"])
                     for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "x " * 5000]
    got = np.concatenate([quality.statistics(b) for b in blocks(pa.array(texts), 2000)])
    assert got[:, :5].tolist() == [brute_statistics(t or "") for t in texts]


def test_trees_learn_and_keep_their_directions():
    draw = np.random.default_rng(3)
    x = draw.random((3000, len(quality.FEATURES)))
    symbol = quality.FEATURES.index("symbol_share")
    truth = ((x[:, symbol] < 0.4) & (x[:, 0] > 0.2)).astype(float)
    noisy = np.where(draw.random(3000) < 0.1, 1 - truth, truth)
    forest = quality.grow(x[:2000], noisy[:2000], [quality.MONOTONE.get(f, 0) for f in quality.FEATURES])
    assert ((forest.logit(x[2000:]) >= 0) == truth[2000:]).mean() > 0.95
    for name in quality.MONOTONE:
        k = quality.FEATURES.index(name)
        line = np.repeat(x[:100], 30, 0)
        line[:, k] = np.tile(np.linspace(0, 1, 30), 100)
        assert (np.diff(forest.logit(line).reshape(100, 30), axis=1) <= 1e-9).all()


def test_quality_of_documents(spark, documents, labels):
    got = quality.judge(documents, labels).collect()
    texts = dict(documents.select("doc_id", "text").collect())
    for r in got:
        n, chars, symbols, lines, repeated = brute_statistics(texts[r["doc_id"]])
        assert (n, chars, symbols, lines, repeated) == tuple(r)[1:6]
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.5)
    truth = dict(labels.select("doc_id", "quality").collect())
    known = [r for r in got if r["doc_id"] in truth and not r["base_failed"]]
    assert np.mean([r["kept"] == (truth[r["doc_id"]] == 1) for r in known]) > 0.97


def test_quality_edge_cases(spark):
    rows = [(1, None, None), (2, "", None), (None, "word " * 30, None), (1, None, None)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, rows), none).collect()}
    assert got[1]["base_failed"] and got[2]["base_failed"] and got[None]["n_words"] == 30
    assert quality.judge(frame(spark, []), none).count() == 0


# --- Language -----------------------------------------------------------------------------------

def test_language_on_held_out_documents(documents):
    got = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_scores_of_a_batch_equal_those_of_single_texts(documents):
    rows = documents.orderBy("doc_id").limit(300).collect()
    model = language.fit([r["text"] for r in rows], [r["lang"] for r in rows])
    texts = [r["text"] for r in rows[:40]]
    labels, scores = language.predict(model, texts)
    for text, label, score in zip(texts, labels, scores):
        own, p = language.counts_of(text)
        z = language.softmax((p @ model.weights[own].astype(float) + model.bias) / model.temperature)
        assert model.labels[int(z.argmax())] == label and z.max() == pytest.approx(score, abs=1e-6)


def test_language_edge_cases(spark):
    rows = [(1, "the cat", "en"), (2, "le chat", "fr"), (3, "der hund", "de"), (4, "el perro", None),
            (5, None, "en"), (6, "", "en"), (7, "123 !?", "en"), (None, "the dog", "en"),
            (1, "the cat", "en"), (8, "日本", None)]
    got = language.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (5, 6, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr", "de")
    assert language.identify(frame(spark, [])).count() == 0
    unknown = language.identify(frame(spark, [(1, "words", None)])).collect()
    assert unknown[0]["lang_pred"] == "und"


def test_training_reads_no_held_out_row(documents):
    held = language.fold_of("doc_id", 4) == 2
    sample = language.training_sample(documents, "doc_id", "text", "lang", ~held, 200)
    ids = [r["id"] for r in sample.collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    assert len(ids) <= 200
