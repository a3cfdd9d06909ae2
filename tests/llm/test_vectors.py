"""Vector codes and the adaptive dimension scan against brute force."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from canopyframe.llm import dimscan, vectorcodes

SCHEMA = ("vec_id long, embedding array<{}>, label int, id string, vector string, n string, "
          "code string, c1 string")


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows],
                                 SCHEMA.format(kind))


def usable(vector):
    return vector is not None and all(v is not None and math.isfinite(v) for v in vector)


# --- vector codes ------------------------------------------------------------------------------

def brute_codes(rows, parts=8, entries=16, rounds=6):
    rows = [r for r in rows if usable(r[1])]
    if not rows:
        return []
    width = -(-max(len(r[1]) for r in rows) // parts) * parts
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    each = width // parts
    cut = []
    for _, vector, _ in rows:
        v = [math.floor(4096 * Fraction(x)) for x in vector] + [0] * (width - len(vector))
        cut.append([v[p * each:(p + 1) * each] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(members[k]) for col in zip(*members[k])]
                        if k in members else e for k, e in enumerate(books[p])]
    text = ",".join(str(v) for book in books for e in book for v in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    out, by_label = [], {}
    for (key, _, label), c in zip(rows, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(far for far, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((key, label, "".join(f"{k:02x}" for _, k in found), error))
    fits = lambda v: v if v < 2 ** 63 else None
    return sorted([(k, code, fits(e), fits(by_label[label]) if fits(e) is not None else 0, digest)
                   for k, label, code, e in out], key=repr)


def coded(spark, rows, kind="double"):
    return sorted(map(tuple, vectorcodes.compress(frame(spark, rows, kind)).collect()), key=repr)


def random_rows(n, width, seed, scale=1.0):
    draw = random.Random(seed)
    return [(draw.randrange(10 * n), [draw.gauss(0, scale) for _ in range(width)],
             draw.choice([1, 1, 1, 2, 3, None])) for _ in range(n)]


def test_codes_match_brute_force(spark):
    rows = random_rows(300, 24, 1)
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_of_bad_short_and_repeated_vectors(spark):
    rows = random_rows(60, 16, 2)
    rows += [(5, None, 1), (6, [None] * 16, 1), (7, [math.nan] * 16, 1), (8, [math.inf] * 16, 1),
             (9, [], 2), (10, [0.5] * 3, None), (None, [0.25] * 16, 4)]
    rows += [(11, [1.0] * 16, 1)] * 40 + [(12, [-0.0] * 16, 1)]
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_of_few_and_no_rows(spark):
    rows = random_rows(3, 8, 3)
    assert coded(spark, rows) == brute_codes(rows)
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1)]) == []
    assert coded(spark, [(1, [], 1)]) == brute_codes([(1, [], 1)])


def test_codes_of_huge_components_stay_exact(spark):
    rows = random_rows(40, 8, 4) + [(3, [1e300, -1e300] + [0.0] * 6, 9), (4, [3e8] * 8, 8),
                                    (1, [2.0 ** 45 + 1] * 8, 7)]
    got, want = coded(spark, rows), brute_codes(rows)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]


def test_coefficients_are_in_sequency_order_and_keep_distances():
    for given in (1, 2, 3, 8, 12, 64):
        width = vectorcodes.padded_width(given)
        basis = vectorcodes.transformed(np.eye(width, dtype=np.int64))
        changes = (np.diff(np.sign(basis.T), axis=1) != 0).sum(axis=1)
        assert changes.tolist() == list(range(width))
        rng = np.random.default_rng(given)
        a, b = rng.integers(-5000, 5000, (2, 50, given))
        far = ((vectorcodes.transformed(a) - vectorcodes.transformed(b)) ** 2).sum(axis=1)
        assert (far == width * ((a - b) ** 2).sum(axis=1)).all()


def test_entries_are_eliminated_early():
    rng = np.random.default_rng(0)
    # Smooth parts: the energy is in the first coefficients.
    smooth = np.cumsum(rng.integers(-50, 51, (2000, 32)), axis=1)
    entries = vectorcodes.transformed(smooth[:16])
    points = vectorcodes.transformed(smooth)
    found, far, looked = vectorcodes.nearest(points, entries)
    full = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()
    assert looked < 0.6 * full.size * 32


@pytest.mark.parametrize("kind", ["float", "double"])
def test_codes_of_one_hot_label(spark, kind):
    rows = [(k, [k % 7 / 8, k % 5 / 4, -0.5, 0.125] * 2, 1 if k % 3 else k) for k in range(600)]
    assert coded(spark, rows, kind) == brute_codes(rows)


# --- nearest neighbours ------------------------------------------------------------------------

def brute_neighbours(rows, wanted=20):
    rows = [(k, v) for k, v, _ in rows if usable(v) and any(x != 0 for x in v)]
    width = max((len(v) for _, v in rows), default=0)
    rows = sorted({(k, tuple(v) + (0.0,) * (width - len(v))) for k, v in rows},
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = {}
    for n, (q, x) in enumerate(rows):
        if q is None or q % 20:
            continue
        found = []
        for m, (k, y) in enumerate(rows):
            if m != n:
                total = 0.0
                for a, b in zip(x, y):
                    total += a * b
                found.append((-total, k is None, k or 0))
        found.sort()
        out.setdefault(q, []).append([(None if null else k, -t) for t, null, k in found[:wanted]])
    return out


def searched(spark, rows):
    out = {}
    for r in sorted(dimscan.neighbours(frame(spark, rows)).collect(),
                    key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_few_rows_are_searched_exactly(spark):
    rows = [(k, v, t) for k, (_, v, t) in enumerate(random_rows(60, 6, 5, scale=3.0))]
    rows += [(100, None, 1), (120, [0.0] * 6, 1), (140, [None] * 6, 1), (160, [math.nan] * 6, 1),
             (180, [math.inf] + [1.0] * 5, 1), (200, [1.0, 2.0], 1), (None, [2.0] * 6, 1),
             (220, [], 1)]
    # Copies under many ids, a whole row twice, and ties between different vectors.
    rows += [(k, [1.0, 0.0, 0.0, 0.0, 0.0, 2.0], 1) for k in range(1000, 1045)] + [rows[20]] * 3
    rows += [(2000, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (2001, [0.0, 1.0, 5.0, 0.0, 0.0, 0.0], 1)]
    got, want = searched(spark, rows), brute_neighbours(rows)
    assert set(got) == set(want)
    for q in want:
        assert got[q] == want[q][0], q


def test_search_of_no_rows_and_one_row(spark):
    assert searched(spark, []) == {}
    assert searched(spark, [(20, [0.0], 1), (40, None, 1)]) == {}
    assert searched(spark, [(20, [1.0], 1)]) == {}
    assert searched(spark, [(20, [1.0], 1), (21, [2.0], 1)]) == {20: [(21, 2.0)]}


def test_search_reaches_the_recall_and_exact_scores(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 24))
    points = centres[rng.integers(0, 30, 4000)] + 0.4 * rng.standard_normal((4000, 24))
    points *= rng.uniform(0.2, 3.0, (4000, 1))      # norms differ, so nearness is not the angle
    rows = [(k, p.tolist(), 1) for k, p in enumerate(points)]
    rows += [(10_000 + k, points[0].tolist(), 1) for k in range(2000)]   # a third are copies
    got = searched(spark, rows)
    x = np.array([r[1] for r in rows])
    ids = np.array([r[0] for r in rows])
    hits = 0
    for n in np.flatnonzero(ids % 20 == 0):
        score = dimscan.scores(np.broadcast_to(x[n], x.shape), x)
        others = np.flatnonzero(ids != ids[n])
        best = others[np.lexsort((ids[others], -score[others]))][:20]
        found = got[ids[n]]
        assert len(found) == 20
        value = dict(zip(ids.tolist(), score.tolist()))
        assert all(s == value[k] for k, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len({k for k, _ in found} & set(ids[best].tolist()))
    assert hits / (20 * len(got)) >= 0.94


def test_share_quantile_is_the_chance_of_a_random_rotation():
    rng = np.random.default_rng(1)
    square = rng.standard_normal((200_000, 33)) ** 2
    for seen in (1, 8, 16, 32):
        share = square[:, :seen].sum(axis=1) / square.sum(axis=1)
        bound = dimscan.share_quantile(seen, 33, 0.01)
        assert abs((share > bound).mean() - 0.01) < 0.002


@pytest.mark.parametrize("spread, most", [(0.2, 0.35), (9.0, 0.8)])
def test_scan_gives_pairs_up_early_and_keeps_the_near_ones(spread, most):
    """In clusters, and without any structure."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 64))[rng.integers(0, 40, 3000)]
    x = x + spread * rng.standard_normal(x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    space = dimscan.Space(64, 1.0, float((x * x).sum(axis=1).max()))
    stored, asked = space.stored(x), space.asked(x[:50])
    product = x[:50] @ x.T
    tau = np.sort(product, axis=1)[:, -21]
    q, c, looked = dimscan.scan(asked, stored, space.beat(x[:50], tau))
    want = set(zip(*np.nonzero(product >= tau[:, None])))
    assert len(want - set(zip(q, c))) <= 0.02 * len(want)
    assert looked < most * product.size * 65
    everything = dimscan.scan(asked, stored, np.full(50, np.inf))
    assert len(everything[0]) == product.size


def test_search_of_huge_components_does_not_fail(spark):
    rows = [(k, [1e300 * (1 + k % 3), -1e300, float(k)], 1) for k in range(60)]
    got = searched(spark, rows)
    assert set(got) == {0, 20, 40} and all(len(v) == 20 for v in got.values())
