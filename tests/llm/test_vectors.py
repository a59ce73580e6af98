"""Clusters, codes and ball-hashed fingerprints against brute force, awkward rows included."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import ballhash, dualtree, vectorcodes, vectors

ROWS = "vec_id long, embedding array<float>, label int, v string, code string, cluster string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Two clouds, many equal vectors, ties, repeated ids, and vectors that aren't whole."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 0.02, 64) + (i % 3)).tolist(), i % 4) for i in range(600)]
    rows += [(1000 + i, [0.25] * 64, None) for i in range(300)]
    rows += [(2000 + i, [float(x) for x in rng.integers(-1, 2, 64)], 7) for i in range(200)]
    rows += [(5, [0.5] * 64, 1), (5, [0.5] * 64, 1), (None, [0.75] * 64, 2), (None, [-0.001] * 64, None)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [None, *[0.5] * 63], 1), (3003, [math.nan, *[0.5] * 63], 1), (3004, [math.inf, *[0.5] * 63], 1), (3005, [0.5] * 63, 1)]
    return spark.createDataFrame([(i, v, n, "v", "c", "k") for i, v, n in rows], ROWS).repartition(5)


def whole_rows(df):
    rows = [r for r in df.collect() if r.embedding and len(r.embedding) == 64 and all(x is not None and math.isfinite(x) for x in r.embedding)]
    return rows, np.array([[math.floor(256 * x) for x in r.embedding] for r in rows], np.int64).reshape(-1, 64)


def lloyd(points, first, rounds):
    """Plain Lloyd in integers; (nearest, squared distance, centroids)."""
    centers = np.array(first, np.int64)
    for last in range(rounds + 1):
        d = ((points[:, None, :] - centers[None, :, :]) ** 2).sum(2)
        near = d.argmin(1)
        if last == rounds:
            return near, d.min(1), centers
        for c in set(near.tolist()):
            own = points[near == c]
            centers[c] = [int(s) // len(own) for s in own.sum(0)]


@pytest.mark.parametrize("clusters", [1, 7, 40])
def test_clusters_are_those_of_plain_lloyd(awkward, clusters):
    rows, points = whole_rows(awkward)
    by = sorted((hashlib.sha256(f"2:{r.vec_id}".encode()).hexdigest(), p.tolist()) for r, p in zip(rows, points) if r.vec_id is not None)
    near, far, centers = lloyd(points, [p for _, p in by[:clusters]], 5)
    got, found = dualtree.clustered(vectors.kept(awkward, "vec_id"), clusters)
    assert (found == centers).all()
    assert sorted((repr(r.vec_id), int(c), int(d)) for r, c, d in zip(rows, near, far)) == sorted((repr(r.vec_id), r.cluster, r.distance) for r in got.collect())


def test_cover_trees_nest_cover_and_separate():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-400, 400, (300, 8)), rng.integers(-4, 4, (200, 8)), np.zeros((50, 8), np.int64)])
    tree = dualtree.cover_tree(points, 4)
    for i in range(len(tree.point)):
        own = tree.order[tree.begin[i] : tree.end[i]]
        assert tree.point[i] in own and np.linalg.norm(points[own] - points[tree.point[i]], axis=1).max() <= tree.radius[i] + 1e-9
        below = range(tree.child[i], tree.child[i] + tree.children[i])
        if below:
            assert sorted(x for c in below for x in tree.order[tree.begin[c] : tree.end[c]]) == sorted(own)
            assert tree.point[below[0]] == tree.point[i]
            scale = max(tree.radius[c] for c in below)
            apart = [np.linalg.norm(points[tree.point[a]] - points[tree.point[b]]) for a in below for b in below if a < b]
            assert min(apart, default=np.inf) > scale - 1e-9
    assert sorted(tree.order) == list(range(len(points)))


def test_trees_spare_most_pairs_of_clustered_vectors():
    rng = np.random.default_rng(2)
    centers = rng.integers(-2000, 2000, (40, 64))
    points = centers[rng.integers(0, 40, 1000)] + rng.integers(-5, 6, (1000, 64))
    number, far, compared = dualtree.nearest(points, dualtree.cover_tree(points, 16), centers, dualtree.cover_tree(centers, 2))
    d = ((points[:, None, :] - centers[None, :, :]) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (far == d.min(1)).all()
    assert compared < 0.1 * d.size


def test_ties_go_to_the_smaller_number():
    points = np.zeros((30, 64), np.int64)
    centers = np.array([[9] * 64, [1] * 64, [-1] * 64, [1] * 64], np.int64)
    number, far, _ = dualtree.nearest(points, dualtree.cover_tree(points, 16), centers, dualtree.cover_tree(centers, 2))
    assert set(number) == {1} and set(far) == {64}


@pytest.mark.parametrize("entries", [3, 64])
def test_codes_are_those_of_plain_lloyd(awkward, entries):
    rows, points = whole_rows(awkward)
    first = sorted((r.vec_id, p.tolist()) for r, p in zip(rows, points) if r.vec_id is not None)[:entries]
    start = np.array([p for _, p in first], np.int64)
    each = [lloyd(points[:, 4 * p : 4 * p + 4], start[:, 4 * p : 4 * p + 4], 2) for p in range(16)]
    codes = ["".join(f"{e[0][i]:02x}" for e in each) for i in range(len(rows))]
    errors = [sum(int(e[1][i]) for e in each) for i in range(len(rows))]
    digest = hashlib.sha256(",".join(str(x) for e in each for x in e[2].ravel()).encode()).hexdigest()
    got = vectorcodes.coded(vectors.kept(awkward, "vec_id", "label"), entries).collect()
    assert sorted((repr(r.vec_id), repr(r.label), c, e) for r, c, e in zip(rows, codes, errors)) == sorted((repr(r.vec_id), repr(r.label), r.code.hex(), r.error) for r in got)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_bounds_spare_full_comparisons_and_stay_right():
    rng = np.random.default_rng(4)
    book = rng.integers(-500, 500, (64, 4))
    parts = book[rng.integers(0, 64, 5000)] + rng.integers(-30, 31, (5000, 4))
    entry, first, second = vectorcodes.scanned(parts, book)
    moved = book + rng.integers(-3, 4, book.shape)
    found, upper, lower, compared = vectorcodes.Position(moved, book).assigned(parts, entry, np.sqrt(first), np.sqrt(second))
    right, near, other = vectorcodes.scanned(parts, moved)
    assert (found == right).all() and (upper >= np.sqrt(near) - 1e-9).all() and (lower <= np.sqrt(other) + 1e-9).all()
    assert compared < 2500


@pytest.mark.parametrize("make", [lambda df: dualtree.clustered(vectors.kept(df, "vec_id"))[0], lambda df: vectorcodes.coded(vectors.kept(df, "vec_id", "label"))])
def test_no_vectors_give_no_rows(awkward, make):
    assert make(awkward.where("false")).collect() == []
    assert make(awkward.where("vec_id >= 3000")).collect() == []


def test_a_component_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="too large"):
        dualtree.clustered(vectors.kept(df, "vec_id"))


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """component of each row of (doc_id, fingerprint), by all pairs."""
    found = np.array([f for _, f in rows], np.uint64)
    near = np.bitwise_count(found[:, None] ^ found[None, :]) <= 4
    root = np.arange(len(rows))
    while True:
        after = np.where(near, root[None, :], len(rows)).min(1)
        if (after == root).all():
            break
        root = after
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [least[r] for r in root]


def test_simhash_components_against_all_pairs(spark):
    rng = random.Random(8)
    word = [f"Wörd{i}" for i in range(300)]
    rows = [(None, None), (3, ""), (2, " \t\n"), (9, "one Two"), (8, "ONE two"), (8, "one two three"), (None, "lonely words that nobody else has")]
    for i in range(40):
        base = rng.choices(word, k=rng.choice([30, 300, 900]))
        for j in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(word)
            rows.append((100 + 10 * i + j, rng.choice([" ", "\n", "  "]).join(copy)))
    rows += [(5000, " ".join(rng.choices(word, k=80_000))), *rows[-3:]]
    df = spark.createDataFrame([(i, t, 1, "b", 0) for i, t in rows], "doc_id long, text string, fp int, bucket string, label int").repartition(4)
    fps = [(i, plain_simhash(t)) for i, t in rows]
    want = sorted(repr((i, f, c)) for (i, f), c in zip(fps, plain_components(fps)))
    got = ballhash.linked(df).collect()
    assert sorted(repr((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)) for r in got) == want
    assert ballhash.linked(df.where("false")).collect() == []


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_ball_hashing_finds_every_pair_within_the_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(150)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, radius + 3))) for x in base for _ in range(2)]
    values = sorted({*base, *near, 0, 1, (1 << 64) - 1})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long").repartition(3)
    edges = [(r.set & (1 << 64) - 1, r.other & (1 << 64) - 1) for r in ballhash.links(df, len(values), radius, most=2000, dealt=20_000).collect()]
    at = {x: k for k, x in enumerate(values)}
    root = ballhash.forest(np.array([at[a] for a, _ in edges], int), np.array([at[b] for _, b in edges], int), len(values))
    v = np.array(values, np.uint64)
    i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= radius)
    assert (root == ballhash.forest(i, j, len(values))).all()


def test_a_dense_ball_gives_no_more_edges_than_fingerprints_a_bucket(spark):
    ball = ballhash.Ball(2, 5)
    found = np.array([1 << a | 1 << b for a in range(40) for b in range(a)], np.uint64)
    a, b = ballhash.met(ball, [3, 4], found, 4)
    assert len(a) < len(found)
