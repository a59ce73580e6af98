"""Vector codes (product quantisation) with codebooks trained by Hamerly's bounds.

A vector of integers is cut into equal parts; each part position has a codebook
of `entries` entries, improved by rounds of Lloyd. With each part goes its entry,
an upper bound of the distance to it, and a lower bound of the distance to every
other entry. When entries have moved, the upper bound grows by the own entry's
move and the lower one shrinks by the largest move. While the upper bound is
strictly below the lower one (or below half the distance from the own entry to
the next), the part keeps its entry unread; else the upper bound is made exact,
and if that doesn't settle it, the part is compared with all entries in integers,
ties to the lower index. Bounds are rounded outwards when they are stored.

Each round is one pass over a stored table of parts, entries and bounds, and a sum
by position and entry. Only codebooks and such sums reach the driver: positions x
entries rows, whatever the number of vectors.

Defined cases: rows with a null vector, or one that holds null or non-finite
components, go; so do vectors of another length than `dims`, which can't be cut
like the rest. Of repeated vec_ids each row counts, the smallest vector first; rows
without a vec_id get a code but start no entry. With fewer vectors than entries
there are so many entries; with none there are no rows. Rows without a label share one
label error. A component beyond 2^19 is an error. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import dropped, small, stored
from .common import table
from .vectors import DIMS, kept, matrix

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Parts that are compared with all entries at a time.
_SCANNED = 4096
#: What a rounded square root may be off by, and more.
_SLACK = 1e-12


def scanned(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, squared distance to the nearest other entry) of each part, exactly."""
    entry, first, second = (np.empty(len(parts), np.int64) for _ in range(3))
    for a in range(0, len(parts), _SCANNED):
        own = slice(a, a + _SCANNED)
        d = np.zeros((len(parts[own]), len(book)), np.int64)
        for x, c in zip(parts[own].T, book.T):
            d += (x[:, None] - c[None, :]) ** 2
        entry[own] = d.argmin(1)  # the first of equal ones
        at = np.arange(len(d))
        first[own] = d[at, entry[own]]
        d[at, entry[own]] = np.iinfo(np.int64).max
        second[own] = d.min(1)
    return entry, first, second


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + _SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.maximum(x * (1 - _SLACK), 0).astype(np.float32), np.float32(-np.inf))


class Position:
    """The codebook of one part position, and how far its entries have moved since the bounds were stored."""

    def __init__(self, book: np.ndarray, before: np.ndarray) -> None:
        self.book = book
        self.moved = np.sqrt(((book - before) ** 2).sum(1).astype(float)) * (1 + _SLACK)
        between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2).astype(float)
        np.fill_diagonal(between, np.inf)
        self.half = np.sqrt(between.min(1)) / 2 * (1 - _SLACK)

    def assigned(self, parts: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New entries and bounds, and how many parts were compared with all entries."""
        entry, upper, lower = entry.copy(), upper + self.moved[entry], lower - self.moved.max(initial=0)
        limit = np.maximum(lower, self.half[entry])
        open_ = np.flatnonzero(~(upper < limit))
        upper[open_] = np.sqrt(((parts[open_] - self.book[entry[open_]]) ** 2).sum(1).astype(float)) * (1 + _SLACK)
        open_ = open_[~(upper[open_] < limit[open_])]
        found, first, second = scanned(parts[open_], self.book)
        entry[open_], upper[open_], lower[open_] = found, np.sqrt(first.astype(float)), np.sqrt(second.astype(float))
        return entry, upper, lower, len(open_)


_STATE = "vec_id long, label int, v array<int>, code binary, upper array<float>, lower array<float>"


def _cut(v: pa.Array, dims: int, parts: int) -> np.ndarray:
    """(row, part, component) of a list array's vectors."""
    return matrix(v, dims).reshape(-1, parts, dims // parts)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), pa.float32()))


def _codes(code: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)


def begun(vectors: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """The first round's state of rows (vec_id, label, v): every part is compared with all entries."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = _cut(batch.column(2), dims, parts)
            code, upper, lower = np.empty(cut.shape[:2], np.uint8), np.empty(cut.shape[:2], np.float32), np.empty(cut.shape[:2], np.float32)
            for p in range(parts):
                code[:, p], first, second = scanned(cut[:, p], books[p])
                upper[:, p], lower[:, p] = _up(np.sqrt(first.astype(float))), _down(np.sqrt(second.astype(float)))
            yield _state(batch, code, upper, lower)

    return vectors.mapInArrow(run, _STATE)


def _state(batch: pa.RecordBatch, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    own = pa.array([row.tobytes() for row in code], pa.binary())
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), own, _lists(upper), _lists(lower)], ["vec_id", "label", "v", "code", "upper", "lower"])


def moved_on(state: DataFrame, books: np.ndarray, before: np.ndarray, dims: int) -> DataFrame:
    """The state after the codebooks have become `books`: bounds first, full comparisons where they fail."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions = [Position(b, o) for b, o in zip(books, before)]
        for batch in batches:
            cut, code = _cut(batch.column(2), dims, parts), _codes(batch.column(3), parts)
            upper, lower = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, parts) for i in (4, 5))
            for p, position in enumerate(positions):
                code[:, p], upper[:, p], lower[:, p], _ = position.assigned(cut[:, p], code[:, p], upper[:, p], lower[:, p])
            yield _state(batch, code.astype(np.uint8), _up(upper), _down(lower))

    return state.mapInArrow(run, _STATE)


def improved(state: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks with each entry the componentwise floor of the mean of its parts; unused ones stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            at = (_codes(batch.column(3), parts) + np.arange(parts) * entries).ravel()
            count += np.bincount(at, minlength=len(count))
            np.add.at(total, at, _cut(batch.column(2), dims, parts).reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used]), *(pa.array(c) for c in total[used].T)], ["at", "n", *(f"s{i}" for i in range(width))])

    kind = ", ".join(["at long, n long", *(f"s{i} long" for i in range(width))])
    sums = state.mapInArrow(run, kind).groupBy("at").agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(width)])
    out = books.copy()
    for at, n, *total in sums.collect():
        out[at // entries, at % entries] = [s // n for s in total]
    return out


def trained(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """(state, codebooks) of rows (vec_id, label, v): the codebooks after all rounds, and every vector's code in them."""
    if dims % parts or not 0 < entries <= 256:
        raise ValueError("parts must divide dims, and a code has one byte for each part")
    first = vectors.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in first], np.int64).reshape(-1, parts, dims // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    if not len(first):
        return vectors.sparkSession.createDataFrame([], _STATE), books
    state = stored(begun(vectors, books, dims), "vector-codes")
    for _ in range(rounds):
        before, books = books, improved(state, books, dims)
        after = stored(moved_on(state, books, before, dims), "vector-codes")
        dropped(state)
        state = after
    return state, books


def digest(books: np.ndarray) -> str:
    """The codebooks' components by part, entry and position, as decimal integers."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of rows (vec_id, label, v): code a byte for each part, error the squared distance to what it stands for."""
    state, books = trained(vectors, entries, parts, rounds, dims)
    own = np.arange(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error = ((_cut(batch.column(2), dims, parts) - books[own, _codes(batch.column(3), parts)]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(error)], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label int, code binary, error long").withColumn("codebooks_sha256", F.lit(digest(books)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, its error and that of its label."""
    vectors = kept(table(spark, sf_dir, "embeddings"), "vec_id", F.col("label").cast("int").alias("label"))
    rows = stored(coded(vectors), "vector-codes")
    labels = small(stored(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors"))
    joined = rows.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def _round_sql(r: int) -> str:
    """Assignment to the codebook c{r}, and the next codebook."""
    return f"""
d{r} AS (SELECT x.i, x.p, c.e, (x.a - c.a) * (x.a - c.a) + (x.b - c.b) * (x.b - c.b) + (x.c - c.c) * (x.c - c.c) + (x.d - c.d) * (x.d - c.d) AS d FROM x JOIN c{r} c ON x.p = c.p),
a{r} AS (SELECT i, p, min(d) AS d, min_by(e, (d, e)) AS e FROM d{r} GROUP BY i, p),
s{r} AS (SELECT p, e, count(*)::BIGINT AS n, sum(x.a)::BIGINT AS a, sum(x.b)::BIGINT AS b, sum(x.c)::BIGINT AS c, sum(x.d)::BIGINT AS d FROM x JOIN a{r} USING (i, p) GROUP BY p, e),
c{r + 1} AS (SELECT c.p, c.e, {", ".join(f"CASE WHEN n IS NULL THEN c.{k} ELSE (s.{k} - ((s.{k} % n) + n) % n) // n END AS {k}" for k in "abcd")} FROM c{r} c LEFT JOIN s{r} s ON c.p = s.p AND c.e = s.e),"""


OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, w) AS i, vec_id, label, w FROM (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64)),
x AS (SELECT i, p, w[4 * p + 1] AS a, w[4 * p + 2] AS b, w[4 * p + 3] AS c, w[4 * p + 4] AS d FROM v, range(16) t(p)),
c0 AS (SELECT p, i - 1 AS e, a, b, c, d FROM x JOIN v USING (i) WHERE i <= 64 AND vec_id IS NOT NULL),
{"".join(_round_sql(r) for r in range(ROUNDS + 1))}
codes AS (SELECT i, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY i),
books AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN v USING (i), books
"""
