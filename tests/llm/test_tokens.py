"""Re-Pair shards, distinct-chunk tables and edit-aware counts against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from canopyframe.llm import pieces, recount, repair
from canopyframe.llm.chunks import ByteChunks, PieceChunks, tokenizer_bytes

ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", ".", "'s", "<|endoftext|>", "é", "日本", "1",
            "23", " ", "\x1c", "▁", "\x00", "!", "😀", "\u0085", "</s>", "<0x41>", "word,", "idée###"]
DOCS = "doc_id long, text string, lang string, id string, n_tokens string, extra string"


def texts(seed, count, parts):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, parts)))
            for _ in range(count)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", "y", None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_str(tokenizer_bytes("byte_bpe_50k.json").decode())


@pytest.fixture(scope="module")
def piece_library():
    return sentencepiece.SentencePieceProcessor(model_proto=tokenizer_bytes("piece_bpe_32k.model"))


def test_byte_chunks_equal_the_library(byte_library):
    table = ByteChunks(tokenizer_bytes("byte_bpe_50k.json"), limit=500)
    for text in texts(1, 3000, 14):
        want = byte_library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(table.encode(text), "<u2").tolist() == want, text


def test_piece_chunks_equal_the_library(piece_library):
    table = PieceChunks(tokenizer_bytes("piece_bpe_32k.model"), limit=500)
    for text in texts(2, 3000, 14):
        want = piece_library.encode(text, add_eos=True)
        names, ids, back = table.encode(text)
        assert np.frombuffer(ids, "<i4").tolist() == want, text
        assert names == " ".join(map(str, want)) and back == piece_library.decode(want)


def test_grammar_round_trip_and_random_access():
    draw = np.random.default_rng(3)
    for _ in range(60):
        n = int(draw.integers(1, 3000))
        tokens = draw.integers(0, draw.integers(1, 30), n).astype("<u2")
        cuts = draw.random(n) < 0.02
        cuts[-1] = True
        symbols, rules, lengths = repair.compress(tokens, cuts)
        assert (repair.expand(symbols, rules) == tokens).all()
        at = int(draw.integers(0, n))
        size = int(draw.integers(0, n - at + 1))
        part = repair.read_tokens(symbols, rules, lengths, at, size)
        assert (part == tokens[at:at + size]).all()
        ends = np.cumsum(repair._lengths(symbols, lengths))
        assert set(np.flatnonzero(cuts) + 1) <= set(ends)     # no symbol crosses a document's end


def test_grammar_shortens_what_repeats():
    tokens = np.tile(np.arange(40, dtype="<u2"), 500)
    cuts = np.zeros(len(tokens), bool)
    cuts[-1] = True
    symbols, rules, _ = repair.compress(tokens, cuts)
    assert len(symbols) + len(rules) < len(tokens) / 8


def brute_index(rows, library):
    out, start = {}, 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_token_index(spark, byte_library):
    rows = [(i, t) for i, t in enumerate(texts(4, 200, 40))]
    rows += [(900, None), (901, ""), (None, "no id"), (902, "long word " * 3000)]
    want = brute_index(rows, byte_library)
    random.Random(5).shuffle(rows)
    for size in (1 << 20, 300):
        got = repair.token_index(frame(spark, rows).repartition(3), shard_tokens=size).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == want


def test_token_index_repeated_and_empty(spark):
    got = repair.token_index(frame(spark, [(1, "a b"), (1, "a b"), (2, "c")])).collect()
    assert sorted(r["start"] for r in got if r["doc_id"] == 1) == [0, 3]
    assert [r["start"] for r in got if r["doc_id"] == 2] == [6]
    assert repair.token_index(frame(spark, [])).count() == 0


def test_pieces_of_documents(spark, piece_library):
    rows = list(enumerate(texts(6, 150, 40))) + [(900, None), (901, ""), (None, "x"), (902, "a " * 9000),
                                                 (1, "again"), (1, "again")]
    got = pieces.encode_pieces(frame(spark, rows), with_ids=True).collect()
    want = []
    for i, text in rows:
        ids = piece_library.encode(text or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(piece_library.decode(ids).encode()).hexdigest(), ids))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert pieces.encode_pieces(frame(spark, [])).count() == 0


def test_count_tree_follows_edits(byte_library):
    table = ByteChunks(tokenizer_bytes("byte_bpe_50k.json"))
    draw = random.Random(7)
    for text in texts(8, 1500, 40):
        tree = recount.CountTree(table, text)
        for _ in range(4):
            a = draw.randint(0, len(text) + 1)
            b = a + draw.choice([0, 0, 1, 2, 3, 10])
            new = "".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 5)))
            start = min(a, len(text))
            text = text[:start] + new + text[max(start, min(b, len(text))):]
            count = tree.edit(a, b, new)
            assert tree.text() == text
            assert count == len(byte_library.encode(text, add_special_tokens=False).ids)


def test_edits_touch_a_small_part():
    table = ByteChunks(tokenizer_bytes("byte_bpe_50k.json"))
    tree = recount.CountTree(table, "some words here " * 2000)
    tree.edit(16_000, 16_004, "mask")
    assert tree.encoded_chars < 40


def test_edited_counts(spark, byte_library):
    count = lambda t: len(byte_library.encode(t, add_special_tokens=False).ids)
    texts_ = {1: "Mail a.b@example.com or call +1 (152) 555-8590 now.", 2: "nothing", 3: None, 4: ""}
    masked = "Mail <email> or call <number> now."
    docs = recount.with_mask_edits(frame(spark, texts_.items()))
    got = {r["doc_id"]: r for r in recount.edited_counts(docs).collect()}
    assert got[1]["n_tokens"] == count(texts_[1]) and got[1]["n_edits"] == 2
    assert got[1]["n_tokens_after"] == count(masked) and got[1]["chars_after"] == len(masked)
    assert got[2]["n_tokens_after"] == got[2]["n_tokens"] == count("nothing")
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == 0
    assert recount.edited_counts(recount.with_mask_edits(frame(spark, []))).count() == 0


def test_edits_from_a_table(spark, byte_library):
    docs = frame(spark, [(1, "one two three"), (2, None), (None, "four"), (1, "one two three")])
    edits = spark.createDataFrame(
        [(1, 2, 0, 3, "1"), (1, 1, 4, 7, None), (2, 1, 0, 0, "new text"), (9, 1, 0, 1, "x"),
         (None, 1, 99, 120, "!")],
        "doc_id long, edit_no int, start int, stop int, replacement string")
    got = recount.edited_counts(recount.attach_edits(docs, edits)).collect()
    after = {1: "1  three", 2: "new text", None: "four!"}
    assert len(got) == 4
    for row in got:
        assert row["chars_after"] == len(after[row["doc_id"]])
        assert row["n_tokens_after"] == len(
            byte_library.encode(after[row["doc_id"]], add_special_tokens=False).ids)


def test_words_reach_the_library_once(byte_library):
    table, words, draw = ByteChunks(tokenizer_bytes("byte_bpe_50k.json")), [], random.Random(9)
    fill, joined = table.fill, table._joined
    looked_up, new = [], []
    table.values = lambda chunks, values=table.values: (looked_up.extend(chunks), values(chunks))[1]
    table.fill = lambda chunks: (new.extend(chunks), fill(chunks))[1]
    table.lines.joined = lambda chunks, before: (new.extend(chunks), joined(chunks, before))[1]
    vocabulary = ["tree", "größe", "idée", "stand's", "plot", "日本", "x1"]
    for _ in range(400):
        words.append(draw.choice(vocabulary) + draw.choice(["", "", ".", ",###", "!\n", ".\nThe", "\nÉté,"]))
    texts_ = [" ".join(words[k:k + 20]) for k in range(0, 400, 20)] + ["", "one", "  two\n words "]
    for text, ids in zip(texts_, table.encode_many(texts_)):
        want = byte_library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u2").tolist() == want, text
    # A word counts once, whatever marks and line starts follow it.
    assert len(looked_up) == len(set(looked_up)) and len(new) == len(set(new))
    assert {"tree", "plot", "größe", "idée", "The", "Été"} <= set(new)
    assert not {"tree.", "plot,###", "tree.\nThe", "idée\nÉté,"} & set(looked_up)


def test_many_texts_equal_the_library(byte_library):
    table = ByteChunks(tokenizer_bytes("byte_bpe_50k.json"), limit=300)
    draw = random.Random(10)
    for size in (1, 3, 40):
        some = texts(size, size * 20, 30) + ["".join(draw.choice(
            ["ab", "Zé", " ", " ", ".", "!?", "\n", "\r", "\nOf", "'t", "ß\n\n"]) for _ in range(60))
            for _ in range(200)]
        draw.shuffle(some)
        for text, ids in zip(some, table.encode_many(some)):
            want = byte_library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u2").tolist() == want, text
