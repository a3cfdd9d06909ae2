"""The pipeline against a composition of the brute-force versions of its stages."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import sentencepiece
from test_pairs import (brute_classes, brute_contamination, changed, contamination_case, near_rows,
                        repeat_rows)

import corpus_pipeline
from canopyframe.llm import chunks, repeats, toxicity
from canopyframe.llm.chunks import tokenizer_bytes
from canopyframe.llm.common import thrifty

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(41)
    docs, items = contamination_case(3)
    texts = [t for _, t in docs] + [t for _, t in near_rows(42)] + [t for _, t in repeat_rows(43)]
    rude = ["blockhead", "dumbbell", "pigfool"]
    toxic = []
    for k in range(0, len(texts), 7):
        if texts[k]:
            words = changed(draw, texts[k].split(" "), ["zz"], 1)
            words.insert(draw.randint(0, len(words)), draw.choice(rude))
            toxic.append(len(texts))
            texts.append(" ".join(words))
    return list(enumerate(texts)), items, set(toxic)


def brute_kept(rows):
    """Texts without the bytes of 100-byte strings that also start earlier; dropped if all went."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            window = data[p:p + 100]
            if window in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(window)
        left = bytes(x for x, g in zip(data, gone) if not g)
        if not data or left:
            out[i] = left.decode(errors="ignore") if any(gone) else text
    return out


def test_pipeline(spark, tmp_path):
    rows, items, toxic = corpus()
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], DOCS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows],
                                   "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    rejected = {r[0] for r in toxicity.score_documents(docs, labels).filter("predicted = 1").collect()}
    assert len(rejected & toxic) > 0.9 * len(toxic) and len(rejected - toxic) < 0.05 * len(rows)
    left = [(i, t) for i, t in rows if i not in rejected]
    least = brute_classes(left)
    left = [(i, t) for i, t in left if least[i, t or ""] == i]
    kept = brute_kept(left)
    bad = {r[0] for r in brute_contamination(sorted(kept.items()), items) if r[5]}
    library = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_bytes("piece_bpe_32k.model"))
    want = {}
    for i, text in kept.items():
        if i not in bad:
            ids = library.encode(text or "", add_eos=True)
            want[i] = (ids, hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in got} == want
    assert len(got) == len(want) and bad


def test_stages_keep_the_columns_and_survive_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(1, None, None, "x", None), (None, "some words", "en", None, 10), (2, "", "en", "y", 0),
            (1, None, None, "x", None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, DOCS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == (2 if data else 0)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Extra columns called like what the stages work with come out as they went in."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string"
                          ).write.parquet(f"{folder}/benchmark.parquet")
    extra = ["i", "th", "row", "place", "_i", "_th", "_n", "predicted", "score", "_score", "_held",
             "n_removed", "n_bytes", "kept", "extra", "text_hash", "first", "u", "key", "comp"]
    words = [f"word{k} " * 30 for k in range(4)]
    rows = [(k, t, "en", "s", len(t), *[f"{c}{k}" for c in extra]) for k, t in enumerate(words)]
    schema = DOCS + "".join(f", {c} string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        for r in docs.collect():
            assert [r[c] for c in extra] == [f"{c}{r['doc_id']}" for c in extra]
    assert docs.count() == 4
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 4


def test_repeats_carry_a_text_once(spark, monkeypatch):
    line = "every good line is said again and again until nobody can bear to hear it any more, " * 2
    rows = [(1, line, "a"), (2, None, "b"), (3, "", "c"), (4, "short é", None), (5, line, "e"),
            (6, line + "and then some", "f")]
    docs = spark.createDataFrame([(i, t, lang, "s", 77) for i, t, lang in rows], DOCS)
    seen = []

    def watched(given, *args, found=repeats.remove_repeats, **options):
        seen.append(given.schema.simpleString())
        return found(given, *args, **options)

    monkeypatch.setattr(repeats, "remove_repeats", watched)
    out = {r.doc_id: tuple(r) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert seen[0].count("text:") == 1
    left = brute_kept([(i, t) for i, t, _ in rows])
    assert set(out) == set(left)
    for i, text, lang in rows:
        if i in left:
            size = 77 if left[i] == text else len(left[i])
            assert out[i] == (i, left[i], lang, "s", size)


def test_a_thrifty_task_drops_tables_of_others():
    class Table(chunks.ChunkTable):
        def __init__(self, model):
            super().__init__()

    held = chunks.shared_table(Table, b"model")
    assert chunks.shared_table(Table, b"model") is held
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(thrifty(lambda batches: batches)(iter([batch]))) == [batch]
    assert chunks.shared_table(Table, b"model") is not held


def test_anchors_do_not_depend_on_blocks():
    draw = random.Random(9)
    texts = ["".join(draw.choice("abc ") for _ in range(size)) for size in (0, 99, 100, 700, 3000, 260)]

    def rows(limit):
        out = []
        for block in repeats.blocks(pa.array(texts), limit):
            text, *rest = repeats.anchors(block)
            out += list(zip((text + block.first).tolist(), *(x.tolist() for x in rest)))
        return out

    assert rows(1 << 19) == rows(200) == rows(2 << 20)


def test_training_starts_without_the_tables_of_others(monkeypatch):
    class Table(chunks.ChunkTable):
        def __init__(self, model):
            super().__init__()

    class Sample:
        def repartition(self, n):
            return self

        def mapInArrow(self, run, schema):      # noqa: N802
            self.run = run
            return self

        def collect(self):
            batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["a", "b"], "y": [1, 0]})
            return [row for out in self.run(iter([batch])) for row in out.to_pylist()]

    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda *a: (
        seen.append(chunks.shared_table(Table, b"model")),
        toxicity.Model(np.zeros(4), 0.5, 1.0, 2.0))[1])
    held = chunks.shared_table(Table, b"model")
    model = toxicity.trained(Sample())
    assert (model.bias, model.slope, model.offset) == (0.5, 1.0, 2.0)
    assert len(seen) == 1 and seen[0] is not held


def _traced(run):
    """(result, MB held after it, most MB on the way)."""
    tracemalloc.start()
    try:
        before, out = tracemalloc.get_traced_memory()[0], run()
        return out, *((x - before) / 1e6 for x in tracemalloc.get_traced_memory())
    finally:
        tracemalloc.stop()


def test_training_holds_little_beside_its_features():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgh") for _ in range(9)) for _ in range(26_000)]
    landmarks, fold = words[:150], np.random.default_rng(1).random((150, 10), dtype="f4")
    whole, size, most = _traced(lambda: toxicity.kernel(words, landmarks))
    assert most - size < 18
    parts, _, most = _traced(lambda: toxicity._features(words, landmarks, fold))
    assert np.allclose(parts, whole @ fold, rtol=1e-5) and most < size / 2 + 18


def test_a_piece_table_takes_little_per_unit():
    table = chunks.PieceChunks(chunks.tokenizer_bytes("piece_bpe_32k.model"))
    draw = random.Random(4)
    units = ["".join(draw.choice("abcdefgh") for _ in range(8)) for _ in range(20_000)]
    _, held, _ = _traced(lambda: table.values(units))
    assert held * 1e6 / len(table.new) < 150
