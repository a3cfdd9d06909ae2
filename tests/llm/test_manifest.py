"""The Merkle manifest against a plain tree built row by row."""

import hashlib
import zlib

import pyarrow as pa
import pytest

from canopyframe.llm import manifest

SCHEMA = ("doc_id long, source string, lang string, n_chars long, text string, g string, at string, "
          "row string, part string, leaf string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """All levels, the root's last."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def walk(levels, at):
    path = []
    for nodes in levels[:-1]:
        first = at - at % 2
        path.append((at % 2, nodes[first:first + 2]))
        at //= 2
    return path


def folded(leaf, path):
    for place, run in path:
        leaf = sha("".join(leaf if k == place else node for k, node in enumerate(run)))
    return leaf


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = climb([plain_leaf(r) for r in groups[lang]])
    top = climb([trees[lang][-1][0] for lang in order])
    out = []
    for g, lang in enumerate(order):
        for at, row in enumerate(groups[lang]):
            path = walk(trees[lang], at) + walk(top, g)
            proof = sha("".join(node for place, run in path for k, node in enumerate(run)
                                if k != place))
            used = list(row)
            if row[0] is not None and row[3] is not None \
                    and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                used[3] += 1
            back = folded(plain_leaf(used), path)
            out.append((row[0], plain_leaf(row), trees[lang][-1][0], top[-1][0], proof, back,
                        back == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, manifest.document_manifest(docs).collect()), key=repr)
    assert got == brute(rows)
    return got


def test_manifest_matches_a_plain_tree(spark):
    langs = ["en"] * 5 + ["fr", "é", "z", None, ""]
    rows = [(k * 3 % 1009, f"s{k % 3}", langs[k % 10], k, f"text {k} é" * (k % 4))
            for k in range(400)]
    got = check(spark, rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("count", [1, 2, 3, 1025])
def test_manifest_of_one_group(spark, count):
    check(spark, [(k, "s", "en", k, "t") for k in range(count)])


def test_manifest_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (7, "s", "en", None, ""), (7, "s", "en", 1, "a"),
            (7, "s", "en", 1, "a"), (7, "s", "en", 1, "a"), (None, "", "en", 2, "b"),
            (14, "s", "fr", 2 ** 63 - 1, "x" * 3_000_000)]
    rows += [(k, "s", "de", 1, "a") for k in range(30)]
    check(spark, rows)


def test_manifest_of_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert manifest.document_manifest(docs).collect() == []


def test_octopus_set_is_minimal_and_sufficient():
    n = 11
    levels = climb([sha(str(k)) for k in range(n)])
    for known in ({0}, {10}, {2, 3}, {0, 5, 9}, set(range(n)), {4, 5, 6, 7, 8}):
        wanted = list(manifest.missing(known, n))
        fetched = {(level, at): levels[level][at] for level, at in wanted}
        trees = manifest.derive({k: levels[0][k] for k in known}, n, fetched)
        assert trees[-1] == {0: levels[-1][0]}
        for k in known:
            assert manifest.fold(levels[0][k], manifest.siblings(trees, k)) == levels[-1][0]
        # Nothing fetched can be computed from the leaves or from other fetched nodes.
        for level, at in wanted:
            below = {k for k in range(n) if k >> level == at}
            assert not below & known
    assert list(manifest.missing(set(range(n)), n)) == []


def test_stored_manifest_exposes_a_changed_leaf(spark):
    rows = [(k, "s", "en", k, f"t{k}") for k in range(50)]
    docs = spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA)
    placed = manifest.place(manifest.document_leaves(docs))
    nodes, groups = manifest.build(placed)
    assert groups == 1
    root = climb([plain_leaf(r) for r in rows])[-1][0]
    for row in manifest.prove(placed, nodes, groups).collect():
        assert row["root"] == root and sha("".join(row["proof"])) == row["proof_sha256"]


def test_every_leaf_is_folded_through_its_own_siblings(monkeypatch):
    """Untampered leaves too: the folded root comes from the leaf and its path."""
    n = 6
    levels = climb([sha(str(k)) for k in range(n)])
    calls = []
    plain = manifest.fold
    monkeypatch.setattr(manifest, "fold", lambda leaf, path: calls.append(leaf) or plain(leaf, path))
    own = pa.table({"key": pa.array(range(n), pa.int64()), "g": [0] * n, "at": list(range(n)), "n": [n] * n,
                    "leaf": levels[0], "tampered": pa.array([None, sha("x"), *[None] * 4], pa.string())})
    fetched = pa.table({"g": pa.array([], pa.int64()), "level": pa.array([], pa.int32()),
                        "at": pa.array([], pa.int64()), "hash": pa.array([], pa.string())})
    out = manifest._expand(1, pa.int64())(own, fetched).to_pydict()
    assert calls == [levels[0][0], sha("x"), *levels[0][2:]]
    root = levels[-1][0]
    assert [f == root for f in out["folded_root"]] == [True, False, True, True, True, True]
