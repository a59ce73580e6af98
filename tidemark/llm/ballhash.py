"""SimHash near-duplicates by meeting in the middle of two balls.

A text's fingerprint has a bit set where more than half of its shingle hashes
have it. Two fingerprints within `radius` bits of each other have a value
between them that is within half the radius of both, so each fingerprint emits
every variant within that half (2,081 for a radius of 4), and fingerprints that
emit the same variant meet.

1. Documents of equal fingerprints are one class, whatever their number.
2. Variants are dealt out over 2^b buckets by a linear hash: the hash of
   fingerprint XOR mask is hash(fingerprint) XOR hash(mask). So a bucket's number
   and a fingerprint tell which of its variants are meant, and eight bytes go
   through the shuffle for all of them together. A bucket holds about `DEALT`
   variants, of `HELD` fingerprints at most, however many fingerprints there are.
3. A bucket goes through its variants by further bits of the hash, some `VARIANTS`
   at a time, and sorts those; neighbours that are equal are pairs, each is
   verified by its differing bits, and the edges of a forest over them are passed on.
   Repeated pairs end there, and those of several buckets where edges are made distinct.
4. Classes that hang together get the smallest doc_id among them.

Defined cases: null, empty and white texts have the fingerprint zero and are
linked like any other; texts of fewer words than a shingle have one shingle of
all words; repeated rows stay, each with its component; a null doc_id gets a
component but names none, unless all ids in it are null: then it is null.
Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import dropped, setting, stored
from .common import BATCH_ROWS, table
from .setjoin import components
from .textkernels import mix

WORDS = 4
RADIUS = 4
SEED = 42
#: Variants that are sorted at a time, and those of a bucket, on average.
VARIANTS, DEALT = 2 << 20, 128 << 20
#: Fingerprints that a bucket has at most, on average.
HELD = 16 << 20
#: Fingerprints whose variants are dealt at a time.
_ROWS = 2048
#: Fingerprints whose variants are looked up at a time.
_LOOKED = 1 << 20
_HASHED = 1 << 16
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def simhash(text: bytes, k: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of k words."""
    line = b" ".join(text.lower().split())
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    n = max(len(starts) - k + 1, 1)
    votes = np.zeros(64, np.int64)
    for a in range(0, n, _HASHED):
        b = min(a + _HASHED, n)
        spans = zip(starts[a:b].tolist(), ends[len(ends) - n + a : len(ends) - n + b].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[i:j], seed) for i, j in spans), np.uint64, b - a)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of rows (doc_id, text); fp is a long with the fingerprint's 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(x.as_buffer().to_pybytes() if x.is_valid else b"", k, seed) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class Ball:
    """The masks of up to `half` bits, in order of their bucket under a linear hash of `bits` bits."""

    def __init__(self, half: int, bits: int) -> None:
        self.columns = mix(np.arange(1, 65, dtype=np.uint64)) & np.uint64((1 << bits) - 1)
        masks = np.array([sum(1 << i for i in own) for n in range(half + 1) for own in combinations(range(64), n)], np.uint64)
        place = self.bucket(masks)
        order = np.argsort(place, kind="stable")
        self.masks = masks[order]
        #: The buckets that masks have, where each one's masks begin, and how many it has.
        self.places, self.first, self.count = np.unique(place[order], return_index=True, return_counts=True)

    def bucket(self, values: np.ndarray) -> np.ndarray:
        """The linear hash: the XOR of the columns of the bits that are set."""
        out = np.zeros(len(values), np.uint64)
        for i, column in enumerate(self.columns):
            out ^= np.where(values >> np.uint64(i) & np.uint64(1), column, np.uint64(0))
        return out

    def dealt(self, found: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, the fingerprints that have a variant there)."""
        to = (self.bucket(found)[:, None] ^ self.places[None, :]).ravel()
        who = np.repeat(np.arange(len(found)), len(self.places))
        order = np.argsort(to, kind="stable")
        to, who = to[order], who[order]
        for own in np.split(np.arange(len(to)), np.flatnonzero(to[1:] != to[:-1]) + 1):
            if len(own):
                yield int(to[own[0]]), found[who[own]]

    def variants(self, bucket: int, found: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(variant, the place in `found` of its fingerprint) of all variants in one bucket; own: the fingerprints' buckets."""
        values, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for a in range(0, len(found), _LOOKED):
            wanted = own[a : a + _LOOKED] ^ np.uint64(bucket)
            at = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
            count = np.where(self.places[at] == wanted, self.count[at], 0)
            who = np.repeat(np.arange(len(at)), count)
            nth = np.arange(len(who)) - np.repeat(count.cumsum() - count, count)
            values.append(found[a + who] ^ self.masks[self.first[at][who] + nth])
            owners.append(a + who)
        return np.concatenate(values), np.concatenate(owners)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that edges (a, b) lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def met(ball: Ball, buckets: list[int], found: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) of a forest over the fingerprints that meet in some buckets."""
    found = np.unique(found)
    own, pairs = ball.bucket(found), np.empty(0, np.int64)
    for bucket in buckets:
        value, who = ball.variants(bucket, found, own)
        order = np.argsort(value)
        value, who = value[order], who[order]
        pair = np.flatnonzero(value[1:] == value[:-1])
        a, b = np.minimum(who[pair], who[pair + 1]), np.maximum(who[pair], who[pair + 1])
        pairs = np.union1d(pairs, a * len(found) + b)
    a, b = np.divmod(pairs, max(len(found), 1))
    near = np.bitwise_count(found[a] ^ found[b]) <= radius
    root = forest(a[near], b[near], len(found))
    linked = np.flatnonzero(root != np.arange(len(found)))
    return found[linked], found[root[linked]]


def links(classes: DataFrame, n: int, radius: int = RADIUS, most: int = VARIANTS, dealt: int = DEALT, held: int = HELD) -> DataFrame:
    """Edges (set, other) that join all fingerprints within `radius` bits, of n distinct ones in rows (fp)."""
    half = (radius + 1) // 2
    size = sum(1 for i in range(half + 1) for _ in combinations(range(64), i))
    bits = max(5, (n * size // dealt).bit_length(), (n * size // held).bit_length() if n > held else 0)
    fine = max(0, (n * size // most).bit_length() - bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(half, bits)
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(every), _ROWS):
                rows = list(ball.dealt(every[i : i + _ROWS]))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([f.tobytes() for _, f in rows], pa.binary())], ["bucket", "fps"])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("fps")])
        # the lower bits of the longer hash are the shorter one
        a, b = met(Ball(half, bits + fine), [key[0].as_py() | x << bits for x in range(1 << fine)], found, radius)
        return pa.table({"set": a.view(np.int64), "other": b.view(np.int64)})

    return classes.select("fp").mapInArrow(deal, "bucket long, fps binary").groupBy("bucket").applyInArrow(meet, "set long, other long")


def linked(docs: DataFrame, k: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) of all documents: the smallest doc_id that links lead to, its own included."""
    spark = docs.sparkSession
    with setting(spark, _ARROW_ROWS, str(BATCH_ROWS)):
        known = stored(fingerprints(docs, k, seed), "simhashes")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    edges = stored(links(classes, classes.count(), radius), "simhash-links")
    labels = components(classes, edges)
    named = classes.join(labels.withColumnRenamed("set", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = stored(named, "simhash-labels")
    dropped(edges, classes)
    ids = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return known.join(named.join(ids, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the component that it belongs to."""
    return linked(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
