"""Product codes of integer vectors by k-means, exact to the last digit.

Vectors become integers, are cut into parts, and each part is assigned to the nearest entry of its
position's codebook. Nearness is decided on Walsh-Hadamard coefficients: the transform of the
zero-padded part (width P, a power of two) multiplies every squared distance by P exactly, and in
sequency order (by number of sign changes) a part's energy comes first, so the running sum of
squared coefficient differences passes the distance to a good entry early. An entry is dropped the
moment its sum is larger; ties survive and go to the lower index. Nothing is rounded: batches whose
integers could overflow 64 bits are worked on with Python's.

Every round is one pass over the rows. A task adds its parts up per entry, so what is shuffled and
what reaches the driver are the codebooks' own numbers, entries x dimension, whatever the rows.

Cases: rows whose vector is null or holds null, NaN or infinite components are left out; shorter
vectors count as filled up with zeros to the longest, and that to a multiple of the parts; rows that
repeat are rows of their own; a null id comes after all others and equal ids are ordered by vector;
with fewer rows than entries a codebook has as many entries as there are rows; an empty table gives
an empty result; an error beyond 64 bits is null; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyframe.llm.common import written
from canopyframe.llm.vectors import finite, looked_up, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMB = 32          # sums travel in limbs of so many bits, so they may have any size
SLAB = 4096        # parts that are compared at once


# --- exact nearest entries ---------------------------------------------------------------------

def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 64-bit integers where they fit well, else as Python integers."""
    small = np.abs(x) < 2.0 ** 36
    if small.all():
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    out[small] = np.floor(x[small] * SCALE).astype(np.int64).astype(object)
    # Larger ones go through their exact fractions.
    out[~small] = [_whole(v) for v in x[~small].tolist()]
    return out


def _whole(value: float) -> int:
    top, bottom = value.as_integer_ratio()
    return top * SCALE // bottom


def padded_width(width: int) -> int:
    return 1 << max(width - 1, 0).bit_length()


def sequency_order(width: int) -> np.ndarray:
    """Rows of the Hadamard matrix of ``width`` by their number of sign changes."""
    k = np.arange(width)
    # Sign changes of row k: the Gray code inverse of its reversed bits.
    bits = max(width.bit_length() - 1, 0)
    turned = np.zeros(width, np.int64)
    for b in range(bits):
        turned |= ((k >> b) & 1) << (bits - 1 - b)
    changes = turned.copy()
    for b in range(1, bits):
        changes ^= turned >> b
    return np.argsort(changes)


def transformed(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of zero-padded integer rows, in sequency order."""
    n, given = rows.shape
    width = padded_width(given)
    out = np.zeros((n, width), rows.dtype)
    out[:, :given] = rows
    half = 1
    while half < width:
        pairs = out.reshape(n, -1, 2, half)
        a, b = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]
        out = np.stack([a, b], axis=2).reshape(n, width)
        half *= 2
    return out[:, sequency_order(width)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, comparisons) of every row of coefficients; ties to the lower entry.

    ``comparisons`` counts the coefficient differences that were looked at.
    """
    n, width = points.shape
    # The entry that is nearest in the first coefficients bounds the others.
    ahead = max(width // 4, 1)
    partial = np.zeros((n, len(entries)), points.dtype)
    for j in range(ahead):
        partial += (points[:, j, None] - entries[None, :, j]) ** 2
    guess = partial.argmin(axis=1)
    bound = ((points - entries[guess]) ** 2).sum(axis=1)
    looked = n * (len(entries) * ahead + width)
    row, entry = np.nonzero(partial <= bound[:, None])
    total = partial[row, entry]
    for j in range(ahead, width):
        looked += len(row)
        total = total + (points[row, j] - entries[entry, j]) ** 2
        left = np.asarray(total <= bound[row], bool)
        row, entry, total = row[left], entry[left], total[left]
    # Row by row and entries ascending: the first of the smallest sums is the answer.
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.zeros(0, int)
    best = np.minimum.reduceat(total, first) if n else total
    hits = np.flatnonzero(np.asarray(total == best[row], bool))
    hits = hits[np.r_[True, row[hits][1:] != row[hits][:-1]]] if n else hits
    return entry[hits], best, looked


class Books:
    """The codebooks of all part positions and their coefficients."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.coefficients = [transformed(e) for e in entries]
        self.width = entries[0].shape[1]
        self.scale = padded_width(self.width)
        # Sums of scale squares of differences of coefficients must stay below 2 ** 63.
        self.safe = int((2 ** 61 / self.scale ** 3) ** 0.5)
        self.largest = max((int(np.abs(e).max()) for e in entries if e.size), default=0)

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) of integer vectors, one column per part."""
        n = len(rows)
        codes, errors = np.zeros((n, len(self.entries)), np.int64), []
        top = int(np.abs(rows).max()) if rows.size else 0
        plain = max(top, self.largest) < self.safe
        kind = np.int64 if plain else object
        for p, book in enumerate(self.coefficients):
            part = transformed(rows[:, p * self.width:(p + 1) * self.width].astype(kind))
            found, far, _ = nearest(part, book.astype(kind))
            codes[:, p] = found
            errors.append(far // self.scale)
        return codes, np.stack(errors, axis=1)


# --- passes over the rows ----------------------------------------------------------------------

def _slabs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLAB):
            part = batch.slice(at, SLAB)
            yield part, integers(matrix(part.column("vector"), width))


def _sums(books: Books, width: int):
    """Per task the sums and counts of the parts of every entry, in limbs."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k = len(books.entries), len(books.entries[0])
        sums = np.zeros((parts, k, books.width), object)
        counts = np.zeros((parts, k), np.int64)
        for _, rows in _slabs(batches, width):
            codes, _ = books.assign(rows)
            for p in range(parts):
                own = rows[:, p * books.width:(p + 1) * books.width]
                order = np.argsort(codes[:, p], kind="stable")
                found, first = np.unique(codes[order, p], return_index=True)
                counts[p] += np.bincount(codes[:, p], minlength=k)
                if books.width:
                    # A slab's sums fit: 4,096 values below 2 ** 48, else Python integers.
                    sums[p, found] += np.add.reduceat(own[order], first, axis=0).astype(object)
        out = []
        for p, e in zip(*np.nonzero(counts)):
            out.append((p, e, -1, 0, int(counts[p, e])))
            for j, value in enumerate(sums[p, e]):
                value, limb = int(value), 0
                while not -2 ** 31 <= value < 2 ** 31:
                    out.append((p, e, j, limb, value & (2 ** LIMB - 1)))
                    value >>= LIMB
                    limb += 1
                out.append((p, e, j, limb, value))
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out[at:at + 10_000]], pa.int64()) for c in range(5)],
                ["part", "entry", "at", "limb", "value"])
    return add


def _improved(books: Books, rows: DataFrame, width: int) -> Books:
    """One round: entries become the floors of their parts' means; unused ones stay."""
    totals = (rows.select("vector")
              .mapInArrow(_sums(books, width), "part long, entry long, at long, limb long, value long")
              .groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect())
    counts = {(r.part, r.entry): r.value for r in totals if r["at"] < 0}
    means: dict[tuple[int, int, int], int] = {}
    for r in totals:
        if r["at"] >= 0:
            spot = (r.part, r.entry, r["at"])
            means[spot] = means.get(spot, 0) + (r.value << (LIMB * r.limb))
    entries = [e.astype(object) for e in books.entries]
    for (p, e, j), total in means.items():
        entries[p][e, j] = total // counts[p, e]
    return Books([_narrow(e) for e in entries])


def _narrow(entries: np.ndarray) -> np.ndarray:
    if entries.size and max(abs(int(v)) for v in entries.ravel()) >= 2 ** 40:
        return entries
    return entries.astype(np.int64)


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> Books:
    """Codebooks of (id, vector) rows, from the vectors of the smallest ids on."""
    first = [r["vector"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector")
             .limit(entries).select("vector").collect()]
    start = integers(matrix(pa.array(first, pa.list_(pa.float64())), width))
    each = width // parts
    books = Books([start[:, p * each:(p + 1) * each] for p in range(parts)])
    for _ in range(rounds):
        books = _improved(books, rows, width)
    return books


def digest(books: Books) -> str:
    numbers = (str(int(v)) for entries in books.entries for v in entries.ravel())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _coded(books: Books, width: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _slabs(batches, width):
            codes, errors = books.assign(rows)
            total = [int(v) for v in errors.sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"),
                 pa.array([bytes(c).hex() for c in codes.astype(np.uint8)], pa.string()),
                 pa.array([v if v < 2 ** 63 else None for v in total], pa.int64())],
                ["id", "label", "code", "error"])
    return code


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
             label: str = "label") -> DataFrame:
    """Per usable row: vec_id, code, error, label_error, codebooks_sha256."""
    rows = vectors.filter(finite(vector)).select(
        F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"),
        F.col(label).alias("label"))
    total, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    kind = dict(rows.dtypes)["label"]
    out = (F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
    if not total:
        return rows.withColumns({"code": F.lit(""), "error": F.lit(0).cast("long"),
                                 "label_error": F.lit(0).cast("long"),
                                 "codebooks_sha256": F.lit("")}).select(*out)
    width = -(-longest // PARTS) * PARTS
    books = train(rows, width)
    coded = written(rows.mapInArrow(
        _coded(books, width),
        f"id {dict(rows.dtypes)['id']}, label {kind}, code string, error long"), "codes")
    labels = coded.groupBy("label").agg(
        F.expr("try_cast(sum(cast(error as decimal(38,0))) as long)").alias("label_error"),
        F.count(F.lit(1)).alias("n"))
    return looked_up(coded, labels, ["label"], "n", total).withColumn(
        "codebooks_sha256", F.lit(digest(books))).select(*out)


# --- check SQL ---------------------------------------------------------------------------------

_DISTANCE = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _assigned(book: str) -> str:
    return f"""(SELECT vec_id, label, part, v, arg_min(entry, far * 16 + entry) AS entry,
  min(far) AS far FROM (SELECT p.*, c.entry, ({_DISTANCE})::BIGINT AS far
  FROM parts p JOIN {book} c USING (part)) GROUP BY ALL)"""


def _check_sql() -> str:
    rounds = []
    for k in range(ROUNDS):
        rounds.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(moved.v, old.v) AS v FROM book{k} old LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY at1) AS v FROM (
      SELECT part, entry, at1, floor_div(sum(x), count(*)) AS mean FROM (
        SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS at1
        FROM {_assigned(f'book{k}')}) GROUP BY ALL) GROUP BY part, entry) moved
  USING (part, entry))""".replace(
            "floor_div(sum(x), count(*))",
            "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding,
    lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v
  FROM kept CROSS JOIN (SELECT unnest(range({PARTS})) AS part)),
book0 AS MATERIALIZED (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{','.join(rounds)},
final AS MATERIALIZED {_assigned(f'book{ROUNDS}')},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
    sum(far)::BIGINT AS error FROM final GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry))
   FROM book{ROUNDS}) AS codebooks_sha256
FROM coded
"""


SQL = _check_sql()
