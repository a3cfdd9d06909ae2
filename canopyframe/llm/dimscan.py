"""Nearest neighbours by inner product: lists of rotated vectors, scanned by columns adaptively.

Vectors get one more component, sqrt(M - |x|^2) for the largest squared norm M, so that the largest
inner product with a query (which gets 0) is the smallest distance; then everything is turned by one
random rotation. After it the share of a squared distance that d of D coordinates hold follows a
Beta(d / 2, (D - d) / 2) distribution, so a candidate whose first columns are already too far apart
is given up: with r the distance to beat, the hypothesis "distance <= r" is rejected when the partial
sum passes r^2 times the distribution's 1 - LEVEL quantile. Lists are cut by centroids; a task holds one block of a list as matrices of neighbouring columns and tests
all its queries against it block of columns by block of columns, going on with the pairs that are
left. Those left after the last column are scored with the original vectors in double precision.

Equal vectors form a class and are indexed and searched once; a class carries its 21 smallest ids,
which is all that any query can report. One class in 16, at most 8,192, chosen by hash, is *pinned*:
every query meets all of them first, which gives the distance to beat before any list is opened. The
number of lists to open is measured, not given: 128 queries are held against all rows, and as many
lists are opened as hold ``coverage`` of their true neighbours, and always enough for 21 candidates.

Blocks of a list hold 2,048 classes and 2,048 queries at most, so lists of any size, and queries that
crowd into one list, are dealt over tasks. What is sent to all tasks: the pinned vectors, at most
2,048 centroids and the rotation.

Cases: vectors that are null, zero or hold null, NaN or infinite components take no part; shorter
ones count as filled up with zeros; rows that repeat id and vector count once, rows that share an id
with other vectors are rows of their own; a null id is no query and is reported as null, after equal
scores; with fewer candidates than asked for all are given; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyframe.llm.common import record, written
from canopyframe.llm.vectors import finite, looked_up, matrix

NEAREST = 20
QUERY_EVERY = 20
LIST_ROWS = 400            # classes of a list, about
MAX_LISTS = 2048
FIT_ROWS = 32              # sampled classes per list that the centroids are fitted on
PIN_SHARE, MAX_PINNED = 16, 8192
TRIALS = 128               # queries that decide how many lists are opened
BLOCK = 2048               # classes, and queries, that meet in one task
LEVEL = 0.002              # chance that one test rejects a candidate as near as the distance to beat
COLUMNS = (8, 8, 16, 32, 64, 128)   # widths of the first blocks of columns; the last repeats
PAIRS = 1 << 20            # pairs that are worked on at once
SALTS = 32
LAST_ID = 2 ** 63 - 1      # stands for a null id, so that it comes last


# --- classes of equal vectors -------------------------------------------------------------------

def class_key(vector: str) -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64(vector).alias("c1"), F.xxhash64(F.lit(1), vector).alias("c2")]


def _rows(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    return vectors.filter(finite(vector) & F.exists(x, lambda v: v != 0)).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), x.alias("vector")
    ).select("id", "vector", *class_key("vector"))


def is_query(id_col: str = "id") -> Column:
    return (F.col(id_col) % QUERY_EVERY == 0) & (F.col(id_col) != LAST_ID)


def classes(rows: DataFrame, wanted: int) -> DataFrame:
    """(c1, c2, vector, ids, n, asks): each distinct vector with its ``wanted`` smallest ids.

    ``n`` counts its rows, ``asks`` those that are queries. Hot classes are cut down in salted groups
    first, and before that in every task.
    """
    slim = rows.select("id", "c1", "c2").distinct()
    sizes = slim.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"),
                                         F.count_if(is_query()).alias("asks"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    kept = slim.withColumn("salt", salt)
    for keys in (["c1", "c2", "salt"], ["c1", "c2"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        kept = kept.withColumn("place", place).filter(F.col("place") <= wanted)
    ids = kept.groupBy("c1", "c2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return rows.select("c1", "c2", "vector").dropDuplicates(["c1", "c2"]).join(
        ids, ["c1", "c2"]).join(sizes, ["c1", "c2"])


# --- the space that is searched -----------------------------------------------------------------

class Space:
    """Lifting by norm and one rotation; ``scale`` keeps squares of any doubles finite."""

    def __init__(self, width: int, scale: float, top: float, seed: int = 7):
        draw = np.random.default_rng(seed)
        turn, r = np.linalg.qr(draw.standard_normal((width + 1, width + 1)))
        self.turn = turn * np.sign(np.diag(r))
        self.width, self.scale, self.top = width, scale, top

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return x / self.scale

    def stored(self, x: np.ndarray) -> np.ndarray:
        """Rotated places of candidates, in single precision."""
        y = self.scaled(x)
        rest = np.sqrt(np.maximum(self.top - (y * y).sum(axis=1), 0.0))
        return (np.c_[y, rest] @ self.turn).astype(np.float32)

    def asked(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) @ self.turn[:-1]).astype(np.float32)

    def beat(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The squared distance of a candidate that has ``score`` with query ``x``."""
        y = self.scaled(x)
        with np.errstate(invalid="ignore", over="ignore"):
            far = (y * y).sum(axis=1) + self.top - 2 * (score / self.scale / self.scale)
        return np.where(np.isnan(far), np.inf, np.maximum(far, 0.0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            out = out + a[:, j] * b[:, j]
    return out


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((points * points).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)
            - 2 * points @ centres.T)


def fit_centres(points: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """k-means on a bounded sample; the first points start, empty lists keep their centre."""
    centres = points[:lists].astype(np.float64).copy()
    for _ in range(rounds):
        own = np.concatenate([distances(points[at:at + 4096], centres).argmin(axis=1)
                              for at in range(0, len(points), 4096)])
        order = np.argsort(own, kind="stable")
        found, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(points[order].astype(np.float64), first, axis=0)
        centres[found] = sums / np.diff(np.r_[first, len(own)])[:, None]
    return centres.astype(np.float32)


# --- the scan ----------------------------------------------------------------------------------

def column_blocks(width: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < width:
        to = min(width, at + COLUMNS[min(len(out), len(COLUMNS) - 1)])
        out.append((at, to))
        at = to
    return out


def share_quantile(seen: int, width: int, level: float) -> float:
    """The share of a squared distance that ``seen`` of ``width`` turned coordinates pass by chance
    ``level``, by summing the distribution's density."""
    # In terms of an angle the density has no poles at the ends, whatever the shape.
    angle = (np.arange(20_000) + 0.5) * (np.pi / 2 / 20_000)
    log = (seen - 1) * np.log(np.sin(angle)) + (width - seen - 1) * np.log(np.cos(angle))
    mass = np.cumsum(np.exp(log - log.max()))
    return float(np.sin(angle[np.searchsorted(mass, (1 - level) * mass[-1])]) ** 2)


def scan(asked: np.ndarray, stored: np.ndarray, beat: np.ndarray,
         level: float = LEVEL) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, candidate, columns looked at) of the pairs no test gives up, by query.

    ``beat`` is each query's squared distance to beat.
    """
    width = asked.shape[1]
    cuts = column_blocks(width)
    # The last test is against the distance itself, with room for single precision.
    slacks = [share_quantile(b, width, level) if b < width else 1 + 1e-4 for _, b in cuts]
    columns = [np.ascontiguousarray(stored[:, a:b]) for a, b in cuts]
    found, looked = ([], []), 0
    slab = max(1, PAIRS // max(len(stored), 1))
    for at in range(0, len(asked), slab):
        own = asked[at:at + slab]
        limit = beat[at:at + slab].astype(np.float64)
        row = col = partial = None
        for (a, b), slack, block in zip(cuts, slacks, columns):
            if row is None:
                square = distances(own[:, a:b], block)
                row, col = np.nonzero(square <= (limit * slack + 1e-6)[:, None])
                partial = square[row, col]
                looked += square.size * (b - a)
            else:
                step = own[row, a:b] - block[col]
                partial = partial + np.einsum("ij,ij->i", step, step)
                looked += len(row) * (b - a)
                left = partial <= limit[row] * slack + 1e-6
                row, col, partial = row[left], col[left], partial[left]
        found[0].append(row + at)
        found[1].append(col)
    if not found[0]:
        return np.zeros(0, int), np.zeros(0, int), 0
    return np.concatenate(found[0]), np.concatenate(found[1]), looked


def best_ids(query: np.ndarray, score: np.ndarray, ids: list[list[int]], same: np.ndarray,
             wanted: int):
    """(query, id, score, own) of each query's ``wanted`` best ids among scored classes.

    ``own`` marks ids of the query's class. Rows must be sorted by query.
    """
    counts = np.array([len(v) for v in ids], np.int64)
    flat = np.array([k for v in ids for k in v], np.int64)
    q, s, own = (np.repeat(v, counts) for v in (query, score, same))
    order = np.lexsort((flat, -s, q))
    q, s, own, flat = q[order], s[order], own[order], flat[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = place < wanted
    return q[keep], flat[keep], s[keep], own[keep]


def _array(column, kind, width: int) -> np.ndarray:
    """Fixed-width numbers kept as binary values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


FOUND = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("id", pa.int64()),
                   ("score", pa.float64()), ("own", pa.bool_())])
FOUND_SQL = "c1 long, c2 long, id long, score double, own boolean"


class Pinned:
    """The classes that every query meets."""

    def __init__(self, table: pa.Table, space: Space):
        width = space.width
        self.vectors = _array(table.column("vector"), np.float64, width)
        self.keys = np.c_[table.column("c1").to_numpy(), table.column("c2").to_numpy()]
        self.ids = table.column("ids").to_pylist()
        self.scaled = space.scaled(self.vectors)

    def meet(self, vectors: np.ndarray, keys: np.ndarray, space: Space, wanted: int):
        """(found ids, score to beat) of some queries."""
        n, m = len(vectors), len(self.keys)
        with np.errstate(over="ignore"):
            near = space.scaled(vectors) @ self.scaled.T if m else np.zeros((n, 0))
        take = min(wanted + 1, m)
        picked = np.argpartition(-near, take - 1, axis=1)[:, :take] if m else np.zeros((n, 0), int)
        # All that could be among the best by single rounding errors of the product are scored.
        if m:
            least = np.take_along_axis(near, picked, axis=1).min(axis=1)
            q, c = np.nonzero(near >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        else:
            q = c = np.zeros(0, int)
        score = scores(vectors[q], self.vectors[c])
        same = (keys[q] == self.keys[c]).all(axis=1)
        found = best_ids(q, score, [self.ids[k] for k in c], same, wanted)
        # ``wanted`` - 1 others at least reach the score to beat, whichever row asks.
        beat = np.full(n, -np.inf)
        others = ~same
        order = np.lexsort((-score[others], q[others]))
        q, score = q[others][order], score[others][order]
        first = np.searchsorted(q, np.arange(n + 1))
        enough = np.flatnonzero(np.diff(first) >= wanted - 1)
        beat[enough] = score[first[enough] + wanted - 2]
        return found, np.where(np.isnan(beat), -np.inf, beat)


# --- the whole search --------------------------------------------------------------------------

class Index:
    """Classes in lists, written to the shared folder, and what every task needs to know."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                 wanted: int = NEAREST, coverage: float = 0.96):
        self.wanted, self.coverage = wanted + 1, coverage   # one more: a row doesn't report itself
        self.rows = _rows(vectors, id_col, vector)
        found = written(classes(self.rows, self.wanted), "classes")
        size = found.agg(F.count(F.lit(1)), F.sum("n"), F.max(F.size("vector")),
                         F.max(F.array_max(F.transform("vector", F.abs)))).first()
        self.count, self.total = size[0], size[1] or 0
        if not self.count:
            return
        width, scale = size[2], size[3]
        norm = F.aggregate("vector", F.lit(0.0),
                           lambda a, v: a + (v / F.lit(scale)) * (v / F.lit(scale)))
        self.space = Space(width, scale, found.agg(F.max(norm)).first()[0])
        self.lists = max(1, min(MAX_LISTS, self.count // LIST_ROWS))
        self._pin(found)
        self._fit(found)
        self._deal(found)
        self._measure()

    def _sampled(self, found: DataFrame, rows: int, salt: int) -> Column:
        """About ``rows`` classes, chosen by hash."""
        share = min(1.0, rows / self.count)
        return F.pmod(F.xxhash64(F.lit(salt), "c1", "c2"), F.lit(1 << 30)) < int(share * (1 << 30))

    def _packed(self, found: DataFrame) -> DataFrame:
        width = self.space.width

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("c1"), batch.column("c2"), batch.column("ids"),
                     _binary(matrix(batch.column("vector"), width))], ["c1", "c2", "ids", "vector"])

        return found.select("c1", "c2", "ids", "vector").mapInArrow(
            pack, "c1 long, c2 long, ids array<long>, vector binary")

    def _pin(self, found: DataFrame) -> None:
        rows = min(MAX_PINNED, -(-self.count // PIN_SHARE))
        self.is_pinned = self._sampled(found, rows, 11)
        table = self._packed(found.filter(self.is_pinned)).toArrow().sort_by(
            [("c1", "ascending"), ("c2", "ascending")])
        self.pinned = Pinned(table, self.space)

    def _fit(self, found: DataFrame) -> None:
        """Centroids, fitted in one task on about ``FIT_ROWS`` classes per list."""
        space, lists = self.space, self.lists

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = [b for b in batches if b.num_rows]
            if not table:
                return
            table = pa.Table.from_batches(table).sort_by([("c2", "ascending"), ("c1", "ascending")])
            points = space.stored(matrix(table.column("vector"), space.width))
            centres = fit_centres(points, lists)
            yield pa.RecordBatch.from_arrays([_binary(centres)], ["centre"])

        sample = found.filter(self._sampled(found, FIT_ROWS * lists + 100, 13)).select(
            "c1", "c2", "vector").repartition(1)
        table = written(sample.mapInArrow(fit, "centre binary"), "centres").toArrow()
        self.centres = _array(table.column("centre"), np.float32, space.width + 1)
        if not len(self.centres):
            self.centres = np.zeros((1, space.width + 1), np.float32)

    def _deal(self, found: DataFrame) -> None:
        space, centres = self.space, self.centres

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("vector"), space.width)
                y = space.stored(x)
                own = distances(y, centres).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("c1", "c2", "ids", "asks", "pinned")),
                     pa.array(own.astype(np.int32)), _binary(x), _binary(y)],
                    ["c1", "c2", "ids", "asks", "pinned", "list", "vector", "place"])

        self.table = written(found.withColumn("pinned", self.is_pinned).select(
            "c1", "c2", "ids", "asks", "pinned", "vector").mapInArrow(
                deal, "c1 long, c2 long, ids array<long>, asks long, pinned boolean, list int, "
                      "vector binary, place binary"), "lists")
        sizes = self.table.filter("not pinned").groupBy("list").count().collect()
        self.sizes = np.zeros(len(centres), np.int64)
        for r in sizes:
            self.sizes[r["list"]] = r["count"]

    def ranks(self, asked: np.ndarray) -> np.ndarray:
        """Lists in the order in which each query opens them."""
        return np.argsort(distances(asked, self.centres), axis=1, kind="stable")

    def _measure(self) -> None:
        """How many lists hold ``coverage`` of the neighbours of some queries, found by brute force."""
        space, wanted = self.space, self.wanted
        asks = self.table.filter("asks > 0").filter(
            self._sampled(self.table, max(1, TRIALS * QUERY_EVERY), 17))
        trial = asks.select("c1", "c2", "vector").orderBy(
            F.xxhash64(F.lit(19), "c1", "c2")).limit(TRIALS).toArrow()
        self.probes = len(self.centres)
        if not trial.num_rows:
            return
        x = _array(trial.column("vector"), np.float64, space.width)
        keys = np.c_[trial.column("c1").to_numpy(), trial.column("c2").to_numpy()]
        rank = np.argsort(self.ranks(space.asked(x)), axis=1)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                other = _array(batch.column("vector"), np.float64, space.width)
                near = space.scaled(x) @ space.scaled(other).T
                own = (keys[:, None, 0] == batch.column("c1").to_numpy()) \
                    & (keys[:, None, 1] == batch.column("c2").to_numpy())
                near[own] = -np.inf
                take = min(wanted - 1, batch.num_rows)
                best = np.argpartition(-near, take - 1, axis=1)[:, :take] if take else None
                if not take:
                    continue
                lists = batch.column("list").to_numpy()[best]
                place = np.take_along_axis(rank, lists, axis=1)
                place[batch.column("pinned").to_numpy(zero_copy_only=False)[best]] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(x)), take)),
                     pa.array(np.take_along_axis(near, best, axis=1).ravel()),
                     pa.array(place.ravel().astype(np.int64))], ["q", "near", "place"])

        near = self.table.select("c1", "c2", "list", "pinned", "vector").mapInArrow(
            compare, "q long, near double, place long")
        order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "place"))
        places = [r["place"] for r in near.withColumn("k", order).filter(
            F.col("k") < wanted).select("place").collect()]
        if places:
            self.probes = 1 + int(np.quantile(places, self.coverage, method="higher"))

    def _routes(self) -> DataFrame:
        """What each query class finds among the pinned ones, and the lists it opens."""
        space, pinned, wanted, probes, sizes = (self.space, self.pinned, self.wanted, self.probes,
                                                self.sizes)
        kind = pa.struct([("id", pa.int64()), ("score", pa.float64()), ("own", pa.bool_())])
        schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("vector", pa.binary()),
                            ("place", pa.binary()), ("beat", pa.float64()),
                            ("lists", pa.list_(pa.int32())), ("found", pa.list_(kind))])
        centres = self.centres

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    own = batch.slice(at, 256)
                    x = _array(own.column("vector"), np.float64, space.width)
                    keys = np.c_[own.column("c1").to_numpy(), own.column("c2").to_numpy()]
                    (q, ids, score, same), beat = pinned.meet(x, keys, space, wanted)
                    asked = space.asked(x)
                    order = np.argsort(distances(asked, centres), axis=1, kind="stable")
                    # Where the pinned ones are too few, lists that hold enough are opened.
                    held = np.cumsum(sizes[order], axis=1)
                    need = np.where(np.isinf(beat), (held <= wanted).sum(axis=1) + 1, 0)
                    opened = [[int(k) for k in order[r, :max(probes, need[r])] if sizes[k]]
                              for r in range(len(x))]
                    cut = np.searchsorted(q, np.arange(len(x) + 1))
                    hits = [[{"id": int(i), "score": float(s), "own": bool(o)} for i, s, o in zip(
                        ids[a:b], score[a:b], same[a:b])] for a, b in zip(cut[:-1], cut[1:])]
                    yield record(schema, own.column("c1"), own.column("c2"), own.column("vector"),
                                 _binary(asked), space.beat(x, beat), pa.array(
                                     opened, schema.field("lists").type),
                                 pa.array(hits, schema.field("found").type))

        return written(self.table.filter("asks > 0").select("c1", "c2", "vector").mapInArrow(
            route, "c1 long, c2 long, vector binary, place binary, beat double, lists array<int>, "
                   "found array<struct<id: long, score: double, own: boolean>>"), "routes")

    def found(self) -> DataFrame:
        """(c1, c2, id, score, own): candidates of every query class, its best among them."""
        routes = self._routes()
        asks = np.zeros(len(self.centres), np.int64)
        for r in routes.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
            asks[r["list"]] = r["count"]
        row_blocks = F.array(*[F.lit(int(max(1, -(-k // BLOCK)))) for k in self.sizes])
        ask_blocks = F.array(*[F.lit(int(max(1, -(-k // BLOCK)))) for k in asks])
        mine = F.col("list") + 1
        # Both sides' keys must have one type, or they are dealt to different tasks.
        # Each class meets every block of queries of its list, and each query every block of classes.
        spread = lambda other: F.explode(F.sequence(F.lit(0), other - 1))
        rows = self.table.filter("not pinned").select(
            "list", F.pmod("c1", F.element_at(row_blocks, mine)).cast("int").alias("rows"),
            spread(F.element_at(ask_blocks, mine)).alias("asks"),
            "c1", "c2", "ids", "vector", "place")
        queries = routes.select(F.explode("lists").alias("list"), "c1", "c2", "vector", "place",
                                "beat").select(
            "list", spread(F.element_at(row_blocks, mine)).alias("rows"),
            F.pmod("c1", F.element_at(ask_blocks, mine)).cast("int").alias("asks"),
            "c1", "c2", "vector", "place", "beat")
        space, wanted = self.space, self.wanted

        def meet(own: pa.Table, asking: pa.Table) -> pa.Table:
            if not own.num_rows or not asking.num_rows:
                return FOUND.empty_table()
            width = space.width
            q, c, _ = scan(_array(asking.column("place"), np.float32, width + 1),
                           _array(own.column("place"), np.float32, width + 1),
                           asking.column("beat").to_numpy())
            x = _array(asking.column("vector"), np.float64, width)
            y = _array(own.column("vector"), np.float64, width)
            score = np.concatenate([scores(x[q[at:at + PAIRS]], y[c[at:at + PAIRS]])
                                    for at in range(0, len(q), PAIRS)] or [np.zeros(0)])
            keys = [np.c_[t.column("c1").to_numpy(), t.column("c2").to_numpy()]
                    for t in (asking, own)]
            ids = own.column("ids").to_pylist()
            same = (keys[0][q] == keys[1][c]).all(axis=1)
            q, best, score, same = best_ids(q, score, [ids[k] for k in c], same, wanted)
            return pa.table([keys[0][q, 0], keys[0][q, 1], best, score, same], schema=FOUND)

        scanned = rows.groupBy("list", "rows", "asks").cogroup(
            queries.groupBy("list", "rows", "asks")).applyInArrow(meet, FOUND_SQL)
        return scanned.unionByName(routes.select("c1", "c2", F.inline("found")))

    def nearest(self) -> DataFrame:
        """(query_id, rank, vec_id, score) of every query row."""
        order = Window.partitionBy("c1", "c2").orderBy(F.desc("score"), "id", "own")
        hit = F.struct("place", "id", "score", "own")
        best = written(
            self.found().withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= self.wanted).groupBy("c1", "c2").agg(
                F.sort_array(F.collect_list(hit)).alias("best"))
            .join(self.table.select("c1", "c2", "asks"), ["c1", "c2"]), "best")
        asking = self.rows.filter(is_query()).select("id", "c1", "c2").distinct()
        given = looked_up(asking, best, ["c1", "c2"], "asks", max(self.total // QUERY_EVERY, 1))
        others = F.filter("best", lambda h: ~(h["own"] & (h["id"] == F.col("id"))))
        return given.select(
            F.col("id").alias("query_id"),
            F.posexplode(F.slice(others, 1, self.wanted - 1)).alias("at", "hit")).select(
            "query_id", (F.col("at") + 1).alias("rank"),
            F.when(F.col("hit.id") != LAST_ID, F.col("hit.id")).alias("vec_id"), "hit.score")


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
               wanted: int = NEAREST) -> DataFrame:
    index = Index(vectors, id_col, vector, wanted)
    if not index.count:
        return vectors.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double")
    return index.nearest()
