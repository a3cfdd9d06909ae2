"""Winnowing, near-duplicates, repeated substrings and URL rules against brute force."""

import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest

from canopyframe.llm import contamination, neardup, repeats, urls
from canopyframe.llm.common import blocks

DOCS = "doc_id long, text string, i string, th string, item_id string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", None, "y") for i, t in rows], DOCS)


def vocabulary(draw, size):
    return ["".join(draw.choice("abcdeéß9") for _ in range(draw.randint(1, 8))) for _ in range(size)]


# --- Winnowing ----------------------------------------------------------------------------------

def brute_contamination(docs, items):
    def words(t):
        t = (t or "").translate({k: k + 32 for k in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    known = {}
    for item, text in items:
        if item is None or text is None:
            continue
        w = words(text)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[p:p + n]), set()).add(str(item))
    lengths = {len(k) for k in known}
    out = []
    for i, text in docs:
        w = words(text)
        hit, names = set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                own = known.get(tuple(w[p:p + n]))
                if own:
                    hit.update(range(p, p + n))
                    names |= own
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest,
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def contamination_case(seed):
    draw = random.Random(seed)
    vocab = vocabulary(draw, 150)
    rand = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    items = [(k, rand(draw.choice([1, 2, 5, 12, 13, 14, 30, 60]))) for k in range(30)]
    items += [(3, rand(20)), (50, items[4][1]), (51, None), (None, rand(15)), (52, ""), (53, "!?")]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(draw.randint(0, 5)):
            if draw.random() < 0.4:
                w = (draw.choice(items)[1] or "x").split(" ")
                a = draw.randint(0, len(w) - 1)
                w = w[a:a + draw.randint(1, 40)]
                parts.append(draw.choice([" ", ", ", "\n"]).join(w).upper()
                             if draw.random() < 0.3 else "--".join(w))
            else:
                parts.append(rand(draw.randint(1, 60)))
        docs.append((i, " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, ".!?"), (None, items[6][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed):
    docs, items = contamination_case(seed)
    docs += docs[:2]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = contamination.contamination(frame(spark, docs).repartition(3), bench).drop("text_hash")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        brute_contamination(docs, items), key=repr)


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    none = contamination.contamination(frame(spark, [(1, "a b c")]), bench).collect()
    assert (none[0]["n_words"], none[0]["n_hit"], none[0]["contaminated"]) == (3, 0, False)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination.contamination(frame(spark, []), some).count() == 0


# --- Near-duplicates ----------------------------------------------------------------------------

def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for k, y in enumerate(b, 1):
            row.append(min(before[k] + 1, row[-1] + 1, before[k - 1] + (x != y)))
        before = row
    return before[-1]


def changed(draw, words, vocab, count):
    words = list(words)
    for _ in range(count):
        k = draw.randrange(len(words)) if words else 0
        kind = draw.random()
        if kind < 0.5 and words:
            words[k] = draw.choice(vocab)
        elif kind < 0.75 and words:
            del words[k]
        else:
            words.insert(k, draw.choice(vocab))
    return words


def test_banded_alignment():
    draw = random.Random(3)
    for _ in range(4000):
        a = [draw.randint(0, 3) for _ in range(draw.randint(0, 25))]
        b = changed(draw, a, [0, 1, 2, 3], draw.randint(0, 8))
        limit = draw.randint(0, 8)
        assert neardup.edit_within(a, b, limit) == (levenshtein(a, b) <= limit)


def brute_classes(rows):
    rows = [(i, t or "") for i, t in rows]
    own = sorted({t for _, t in rows})
    words = [t.encode().lower().split() for t in own]
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(own)):
        for b in range(a):
            longer = max(len(words[a]), len(words[b]))
            if words[a] and words[b] and abs(len(words[a]) - len(words[b])) <= longer // 5 \
                    and levenshtein(words[a], words[b]) <= longer // 5:
                root[find(a)] = find(b)
    groups = {}
    for i, t in rows:
        groups.setdefault(find(own.index(t)), []).append(i)
    least = {g: min(v, key=lambda i: (i is not None, i)) for g, v in groups.items()}
    return {(i, t): least[find(own.index(t))] for i, t in rows}


def near_rows(seed):
    draw = random.Random(seed)
    vocab = vocabulary(draw, 2000)
    passage = [draw.choice(vocab) for _ in range(40)]
    docs = []
    for _ in range(30):
        base = [draw.choice(vocab) for _ in range(draw.randint(1, 120))]
        docs.append(base)
        for _ in range(draw.choice([0, 0, 1, 2, 5])):
            docs.append(changed(draw, base, vocab, int(len(base) * draw.choice([0, 0.02, 0.06]))))
    docs += [[draw.choice(vocab) for _ in range(30)] + passage for _ in range(8)]
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


def test_near_duplicates(spark):
    rows = near_rows(11)
    rows += [(900, rows[3][1]), (901, None), (902, ""), (903, "   "), (904, rows[3][1].upper()),
             (905, rows[3][1]), (905, rows[3][1]), (None, rows[5][1])]
    want = brute_classes(rows)
    got = neardup.classes(frame(spark, rows)).collect()
    text_of = {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    assert {(r["doc_id"], text_of[r["doc_id"]]): r["class_id"] for r in got} == want
    assert sum(r["first"] for r in got) == len(set(want.values()))


def test_bucket_rounds_find_links_that_the_center_misses(spark):
    """A chain: the ends are unlike each other but both like the middle."""
    draw = random.Random(12)
    vocab = vocabulary(draw, 3000)
    base = [draw.choice(vocab) for _ in range(100)]
    left, right = list(base), list(base)
    for k in range(0, 15):
        left[k] = draw.choice(vocab)
        right[99 - k] = draw.choice(vocab)
    rows = [(k, " ".join(w)) for k, w in enumerate([left, base, right])]
    got = neardup.classes(frame(spark, rows)).collect()
    assert {r["class_id"] for r in got} == {0}


def test_hot_group_is_one_class(spark):
    draw = random.Random(13)
    vocab = vocabulary(draw, 500)
    base = [draw.choice(vocab) for _ in range(80)]
    rows = [(k, " ".join(changed(draw, base, vocab, 2))) for k in range(300)]
    got = neardup.classes(frame(spark, rows)).collect()
    assert {r["class_id"] for r in got} == {0} and sum(r["first"] for r in got) == 1


def test_a_common_passage_hides_no_pair(spark):
    """150 texts share a footer; pairs of them at 0.84 that meet, meet in its buckets only."""
    draw = random.Random(15)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(7))
    footer = [word() for _ in range(30)]
    docs = [[word() for _ in range(58)] + footer for _ in range(150)]
    for k in range(11):
        other = list(docs[10 * k])
        for at in range(4, 58, 4):      # no five words in a row are left outside the footer
            other[at] = word()
        docs.append(other)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    keys = neardup.sketches(next(blocks(pa.array([t for _, t in rows]))))[1]
    meet = [k for k in range(11) if (keys[10 * k] == keys[150 + k]).any()]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, rows)).collect()}
    assert len(meet) > 4 and [got[150 + k] for k in meet] == [10 * k for k in meet]
    assert all(got[i] == i for i in range(150))


def test_word_parities_lose_no_pair():
    draw = random.Random(16)
    vocab = vocabulary(draw, 400)
    for _ in range(300):
        a = [draw.choice(vocab) for _ in range(draw.randint(1, 80))]
        b = changed(draw, a, vocab, draw.randint(0, 20))
        texts = pa.array([" ".join(a), " ".join(b)])
        n_words, _, parity = neardup.sketches(next(blocks(texts)))
        assert n_words.tolist() == [len(a), len(b)]
        differ = sum(int(x).bit_count() for x in parity[0] ^ parity[1])
        assert differ <= 2 * levenshtein(a, b) - abs(len(a) - len(b))


def pairs_at_the_threshold(draw, lengths):
    """Texts of unlike words, and each with as many random edits as leave it similar."""
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(8))
    fresh = [word() for _ in range(50_000)]
    rows = []
    for n in lengths:
        base = [word() for _ in range(n)]
        other = changed(draw, base, fresh, n // 5)
        edits = levenshtein(base, other)
        if edits and 5 * edits <= max(n, len(other)):
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    return rows


def test_short_texts_find_all_similar_ones(spark):
    rows = pairs_at_the_threshold(random.Random(17), [n for n in range(5, 45) for _ in range(8)])
    rows += [(9000, "one"), (9001, " ONE"), (9002, "q w e r t y u"), (9003, "q w e X t y u"),
             (9004, "h j k l"), (9005, "h j m k l")]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, rows)).collect()}
    short = [i for i, t in rows[1::2] if min(len(t.split()), len(rows[i - 1][1].split()
             if i < 9000 else "")) < 40]
    assert [i for i in short if got[i] != i - 1] == []


def test_recall_at_the_threshold(spark):
    draw = random.Random(18)
    rows = pairs_at_the_threshold(draw, [draw.randint(45, 150) for _ in range(300)])
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, rows)).collect()}
    found = sum(got[i] == i - 1 for i, _ in rows[1::2])
    assert len(rows) > 500 and found >= 0.99 * len(rows) / 2


def test_no_near_duplicates_in_an_empty_table(spark):
    assert neardup.classes(frame(spark, [])).count() == 0


# --- Repeated substrings ------------------------------------------------------------------------

def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            window = data[p:p + 100]
            if window in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows(seed):
    draw = random.Random(seed)
    vocab = vocabulary(draw, 300)
    rand = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    passages = [rand(draw.randint(10, 60)) for _ in range(6)]
    rows = []
    for i in range(110):
        parts = []
        for _ in range(draw.randint(0, 5)):
            kind = draw.random()
            if kind < 0.4:
                parts.append(draw.choice(passages))
            elif kind < 0.5:
                p = draw.choice(passages)
                a = draw.randint(0, len(p) - 1)
                parts.append(p[a:a + draw.randint(1, len(p))])
            elif kind < 0.6 and rows:
                parts.append(" ".join(changed(draw, draw.choice(rows)[1].split(" "), vocab, 2)))
            elif kind < 0.65:
                parts.append("ab" * draw.randint(1, 200))
            elif kind < 0.7:
                parts.append("x" * draw.randint(1, 300))
            else:
                parts.append(rand(draw.randint(1, 50)))
        rows.append((i, "".join(parts)))
    return rows + [(900, rows[5][1]), (901, None), (902, ""), (903, "é" * 99), (None, rows[7][1])]


@pytest.mark.parametrize("seed, bucket_rows", [(21, 20_000), (22, 3), (23, 20_000)])
def test_repeats(spark, seed, bucket_rows):
    rows = repeat_rows(seed)
    want = brute_repeats(rows)
    random.Random(seed).shuffle(rows)
    got = repeats.remove_repeats(frame(spark, rows).repartition(4), bucket_rows=bucket_rows).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_repeated_rows_are_one_document(spark):
    text = " ".join(vocabulary(random.Random(24), 40))
    rows = [(1, text), (1, text), (2, "y" + text)]
    got = repeats.remove_repeats(frame(spark, rows), columns=["th"]).collect()
    assert [r["n_removed"] for r in got if r["doc_id"] == 1] == [0, 0]
    assert [(r["kept"], r["extra"]["th"]) for r in got if r["doc_id"] == 2] == [("y", "x")]
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_maximal_repeats_have_all_occurrences(spark):
    draw = random.Random(25)
    vocab = vocabulary(draw, 400)
    rand = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    passage = rand(30)[:118]
    rows = [(k, f"{rand(20)}|{k}|{passage}|{rand(20)}") for k in range(5)]
    found = repeats.maximal_repeats(frame(spark, rows)).collect()
    groups = {}
    for r in found:
        groups.setdefault((r["repeat"], r["length"]), set()).add((r["doc_id"], r["start"]))
    places = {(i, len(t[:t.index(passage) - 1].encode())) for i, t in rows}
    size = len(passage.encode()) + 2
    assert any(length == size and starts == places for (_, length), starts in groups.items())


def test_maximal_repeats_of_exact_copies(spark):
    draw = random.Random(27)
    rand = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    text, passage = rand(130), rand(110)
    rows = [(k, text) for k in range(3)]                            # one class
    rows += [(k, "x" * 9 + passage + "yz") for k in (10, 11)]       # two classes that share a passage
    rows += [(k, "w" * 5 + passage + "vu") for k in (12, 13)]
    groups = {}
    for r in repeats.maximal_repeats(frame(spark, rows)).collect():
        groups.setdefault((r["repeat"], r["length"]), set()).add((r["doc_id"], r["start"]))
    found = {(length, frozenset(places)) for (_, length), places in groups.items()}
    assert any({i for i, _ in places} == {0, 1, 2} for _, places in found)
    assert (110, frozenset({(10, 9), (11, 9), (12, 5), (13, 5)})) in found
    text_of = dict(rows)
    for length, places in found:
        repeat = {text_of[i][start:start + length] for i, start in places}
        assert len(repeat) == 1
        shown = repeat.pop()
        assert {i for i, t in rows if shown in t} == {i for i, _ in places}


def test_common_prefix_intervals():
    draw = random.Random(26)
    for _ in range(300):
        words = sorted("".join(draw.choice("ab") for _ in range(draw.randint(0, 8)))
                       for _ in range(draw.randint(1, 12)))
        lcp = [0] + [repeats.common_prefix(x.encode(), y.encode()) for x, y in zip(words, words[1:])]
        got = set(repeats.intervals(lcp, 1))
        want = set()
        for a in range(len(words)):
            for b in range(a + 1, len(words)):
                length = min(lcp[a + 1:b + 1])
                if length and lcp[a] < length and (b + 1 == len(words) or lcp[b + 1] < length):
                    want.add((length, a, b))
        assert got == want


# --- URL rules ----------------------------------------------------------------------------------

PAGES = ["http://a.example.com/en/1?x=2", "https://www.example.com/en/2", "http://WWW.Example.COM/en/",
         "http://example.com", "http://example.com?x", "http://example.comx/en/", "x://b.net/es/1#q",
         "http://net/fr/", "http://net/de/", "http://fr.net/fr", "nothing", "", None, "://", "a://b://c",
         "http://com/", "http://.com/", "http://a..com/x", "http://example.com:80/en/", "http://org/es/"]


def test_url_rules_against_sql(spark):
    pages = [(k, u, "html") for k, u in enumerate(PAGES)] + [(None, PAGES[0], ""), (5, PAGES[1], "")]
    pages += [(100 + k, f"http://h{k % 7}.example.com/en/{k}", "") for k in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = urls.judge_pages(df, urls.rule_frame(spark, urls.RULES))
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(urls.SQL).fetchall(), key=repr)


def test_nested_rules_of_any_number(spark):
    draw = random.Random(31)
    label = lambda: draw.choice("abc")
    host = lambda: ".".join(label() for _ in range(draw.randint(1, 4)))
    rules = [(draw.choice(["allow", "block"]), host(), draw.choice(["", "/", "/a", "/a/b"]))
             for _ in range(60)] + [(None, "a", "/"), ("block", None, "/"), ("block", "", "/")]
    pages = [(k, f"http://{host()}{draw.choice(['', '/', '/a/b', '/b'])}") for k in range(500)]
    want = []
    for k, url in pages:
        own, _, path = url[7:].partition("/")
        path = "/" + path if "/" in url[7:] else ""
        fits = [(len(h) + len(p), h + p, v) for v, h, p in rules
                if v and h and (own == h or own.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want.append((k, own, path, best[1], best[2]))
    got = urls.judge_pages(spark.createDataFrame(pages, "page_id long, url string"),
                           spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert sorted(map(tuple, got.collect())) == want
    assert urls.judge_pages(spark.createDataFrame([], "page_id long, url string"),
                            urls.rule_frame(spark, urls.RULES)).count() == 0
