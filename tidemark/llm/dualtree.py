"""Centroid clustering by Lloyd's rounds over two trees.

Vectors of integers are dealt into blocks, and each block gets a cover tree: a
node stands for the vectors within its radius of its point, its children lie
within the node's scale of it and further than half of that from each other, and one of
them has the node's own point. The trees are built and stored once, as the vectors
don't change. Each round makes a cover tree of the centroids, and each block goes down both
trees at once: a pair of nodes goes if even the nearest that its members can be
is further than a centroid that is known to be near all of the node's vectors;
of the rest the wider node is opened, and pairs of leaves are compared exactly, in
integers, ties to the smaller number. Bounds are kept a little too wide, so
rounding never drops a pair that matters.

A block is a task's unit of memory, so no tree grows with the table. Only a
round's counts and sums, one row for each centroid, reach the driver, and only
centroids are sent out.

Defined cases: rows with a null vector or one of another length than `dims`,
or that holds null or non-finite components, go; repeated rows each count, and of
equal ids the smaller vector starts first; rows without a vec_id are clustered
but start no centroid; with fewer vectors than centroids there are so many centroids,
with none there are no rows; centroids without vectors stay where they are. A component
beyond 2^19 is an error. Columns other than vec_id and embedding aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import dropped, stored
from .common import table
from .vectors import DIMS, kept, matrix

CLUSTERS = 40
ROUNDS = 5
SEED = 2
#: Vectors in one tree.
BLOCK = 1024
#: Vectors, and centroids, below which a node isn't divided.
LEAF, CENTROID_LEAF = 16, 2
#: Pairs whose distances are taken at a time.
_PAIRS = 1 << 15
_SLACK = 1e-9


class Tree(NamedTuple):
    """A cover tree: rows of `order` from begin to end are a node's; its children stand side by side."""

    order: np.ndarray
    point: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _far(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - point) ** 2).sum(1).astype(float))


def cover_tree(points: np.ndarray, leaf: int) -> Tree:
    """The tree over some points; a node of `leaf` points or fewer, or of equal ones, has no children."""
    order = np.arange(len(points))
    away = _far(points, points[0])
    nodes = [[0, away.max(initial=0), 0, len(points), 0, 0]]
    own_away = [away]  # of each node's rows, in order
    at = 0
    while at < len(nodes):
        point, radius, begin, end, _, _ = nodes[at]
        rows, away = order[begin:end], own_away[at]
        own_away[at] = None
        if end - begin > leaf and radius > 0:
            # the smallest power of two that covers the node; its children cover half of that
            scale = 2.0 ** np.floor(np.log2(radius))
            scale = scale if scale < radius else scale / 2
            left, parts, center = np.arange(len(rows)), [], point
            while len(left):
                near = away[left] <= scale
                parts.append((center, left[near], away[left][near]))
                left = left[~near]
                if len(left):
                    center = rows[left[0]]
                    away = away.copy()
                    away[left] = _far(points[rows[left]], points[center])
            nodes[at][4:] = [len(nodes), len(parts)]
            order[begin:end] = rows[np.concatenate([own for _, own, _ in parts])]
            for center, own, far in parts:
                nodes.append([center, far.max(initial=0), begin, begin + len(own), 0, 0])
                own_away.append(far)
                begin += len(own)
        at += 1
    point, radius, begin, end, child, children = zip(*nodes)
    return Tree(order, np.array(point), np.array(radius, float), *(np.array(x) for x in (begin, end, child, children)))


def _squared(points: np.ndarray, i: np.ndarray, others: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), _PAIRS):
        diff = points[i[a : a + _PAIRS]] - others[j[a : a + _PAIRS]]
        out[a : a + _PAIRS] = np.einsum("ij,ij->i", diff, diff)
    return out


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of all values of the ranges first, first + 1, ... of the given lengths."""
    which = np.repeat(np.arange(len(count)), count)
    return which, first[which] + np.arange(len(which)) - np.repeat(count.cumsum() - count, count)


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, among: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each point, and how many points were compared with a centroid at the leaves."""
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = np.full(len(tree.point), np.inf)  # a centroid is so near to all of a node's points
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    while len(v):
        between = np.sqrt(_squared(points, tree.point[v], centroids, among.point[c]).astype(float))
        np.minimum.at(bound, v, between + tree.radius[v])
        stay = between - tree.radius[v] - among.radius[c] <= bound[v] * (1 + _SLACK) + _SLACK
        v, c = v[stay], c[stay]
        deep, wide = tree.children[v] > 0, among.children[c] > 0
        open_v = deep & (~wide | (tree.radius[v] >= among.radius[c]))
        open_c = wide & ~open_v
        done = ~deep & ~wide
        ends.append((v[done], c[done]))
        pair, below = _spread(tree.child[v[open_v]], tree.children[v[open_v]])
        np.minimum.at(bound, below, bound[v[open_v]][pair])
        other, inner = _spread(among.child[c[open_c]], among.children[c[open_c]])
        v, c = np.concatenate([below, v[open_c][other]]), np.concatenate([c[open_v][pair], inner])
    v, c = (np.concatenate(x) for x in zip(*ends))
    stay = np.sqrt(_squared(points, tree.point[v], centroids, among.point[c]).astype(float)) - tree.radius[v] - among.radius[c] <= bound[v] * (1 + _SLACK) + _SLACK
    v, c = v[stay], c[stay]  # bounds may have become tighter since
    pair, row = _spread(tree.begin[v], tree.end[v] - tree.begin[v])
    c = c[pair]
    pair, number = _spread(among.begin[c], among.end[c] - among.begin[c])
    row, number = tree.order[row[pair]], among.order[number]
    far = _squared(points, row, centroids, number)
    order = np.lexsort((number, far, row))
    row, number, far = row[order], number[order], far[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return number[first], far[first], len(row)


_BLOCK = "ids array<long>, points binary, ordered binary, point binary, radius binary, begin binary, end binary, child binary, children binary"
_KINDS = (np.int32, np.int32, np.float64, np.int32, np.int32, np.int32, np.int32)


def blocks(vectors: DataFrame, dims: int, size: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Blocks of rows (vec_id, v), each with its cover tree."""

    def made(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        tree = cover_tree(points, leaf)
        own = pa.array([ids.to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([own, pa.array([points.astype(np.int32).tobytes()], pa.binary()), *(pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(tree, _KINDS))], [x.split()[0] for x in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= size:
                rows = pa.Table.from_batches(held).combine_chunks()
                yield made(rows.column(0).slice(0, size).combine_chunks(), matrix(rows.column(1).slice(0, size).combine_chunks(), dims))
                held, n = rows.slice(size).to_batches(), n - size
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield made(rows.column(0).combine_chunks(), matrix(rows.column(1).combine_chunks(), dims))

    return vectors.mapInArrow(run, _BLOCK)


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for row in batch.to_pylist():
        parts = [np.frombuffer(row[x.split()[0]], k) for x, k in zip(_BLOCK.split(", ")[2:], _KINDS)]
        yield pa.array(row["ids"], pa.int64()), np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(-1, dims), Tree(*(x if k is np.float64 else x.astype(np.int64) for x, k in zip(parts, _KINDS)))


def sums(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, s0, s1, ...): how many vectors are nearest to each centroid, and their sums; one row for each task and cluster."""
    dims = centroids.shape[1]
    among = cover_tree(centroids, CENTROID_LEAF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, points, tree in _read(batch, dims):
                number, _, _ = nearest(points, tree, centroids, among)
                order = np.argsort(number, kind="stable")
                used, first = np.unique(number[order], return_index=True)
                total[used] += np.add.reduceat(points[order], first, axis=0)
                count += np.bincount(number, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used]), *(pa.array(x) for x in total[used].T)], ["cluster", "n", *(f"s{i}" for i in range(dims))])

    return trees.mapInArrow(run, ", ".join(["cluster long, n long", *(f"s{i} long" for i in range(dims))]))


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of all vectors."""
    among = cover_tree(centroids, CENTROID_LEAF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, tree in _read(batch, centroids.shape[1]):
                number, far, _ = nearest(points, tree, centroids, among)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def started(vectors: DataFrame, clusters: int, seed: int, dims: int) -> np.ndarray:
    """The first centroids: the vectors with the smallest SHA-256 of `seed:vec_id`."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").select(by.alias("by"), "v").orderBy("by", "v").limit(clusters).collect()
    return np.array([r.v for r in first], np.int64).reshape(-1, dims)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), the final centroids) of rows (vec_id, v)."""
    centroids = started(vectors, clusters, seed, dims)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    trees = stored(blocks(vectors, dims), "cover-trees")
    for _ in range(rounds):
        new = centroids.copy()
        for cluster, n, *total in sums(trees, centroids).groupBy("cluster").agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(dims)]).collect():
            new[cluster] = [s // n for s in total]
        centroids = new
    rows = stored(assigned(trees, centroids), "clusters")
    dropped(trees)
    return rows, centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector, with the inertia of its cluster and of all."""
    rows, centroids = clustered(kept(table(spark, sf_dir, "embeddings"), "vec_id"))
    by = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(c, by[c], hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in by]
    # a row for each centroid
    about = spark.createDataFrame(known, "cluster int, cluster_inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(by.values())).cast("long").alias("inertia"), "centroid_sha256")


def _round_sql(r: int) -> str:
    """Assignment to the centroids c{r}, and the next centroids."""
    return f"""
a{r} AS (SELECT i, min(d) AS d, min_by(c, (d, c)) AS c FROM (SELECT v.i, c.c, list_sum(list_transform(list_zip(v.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} c) GROUP BY i),
s{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS w FROM (
  SELECT c, k, sum(w[k])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r} JOIN v USING (i), range(1, 65) t(k) GROUP BY c, k) GROUP BY c),
c{r + 1} AS (SELECT c.c, coalesce(s.w, c.w) AS w FROM c{r} c LEFT JOIN s{r} s ON c.c = s.c),"""


OP11_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, w) - 1 AS c, w FROM (SELECT sha256('{SEED}:' || vec_id) AS h, w FROM v WHERE vec_id IS NOT NULL ORDER BY h, w LIMIT {CLUSTERS})),
{"".join(_round_sql(r) for r in range(ROUNDS + 1))}
ends AS (SELECT c, sha256(array_to_string(w, ',')) AS h FROM c{ROUNDS})
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (i) JOIN ends ON a.c = ends.c
"""
