"""N-gram Jaccard join by chosen paths.

Two documents are linked if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more.

1. Documents of equal sets are one class, whatever their number; from here on a
   class is one set.
2. A node of the search is a group of sets that have chosen the same tokens so
   far. In a run from the root, a set chooses each of its tokens with probability
   c / size, by a hash of the token and the run, so that two sets choose the same
   shared tokens. `runs` runs are so many that two sets of the least similarity
   are missed with a probability below 1 - `recall`.
3. Nodes of up to `leaf` sets are leaves. A set of a larger node goes on along
   `paths` paths of three more tokens each: the smallest ones under orders that
   a hash of the node picks from the 32 of the set's sketch. Two sets take such a
   path together with the third power of their similarity, so that the merely
   related part while similar ones meet again, missed with a probability below
   1 - `recall`. Neither the texts nor their tokens are read for that. A node whose
   sets mostly agree in the orders (a group of near copies) is a leaf as well.
4. A pair of sets is compared in the first of the leaves that both are in, and
   so once. The sketch rules out hopeless pairs; only the sets of the others are
   made again from their texts and intersected. Leaves of many sets are cut into
   blocks, and blocks are compared with blocks, so that no task holds a large leaf.
5. Leaves give the number of links of each set, and edges that join linked sets;
   classes that hang together get the smallest doc_id among them, by label
   propagation with pointer jumping over checkpointed tables.

Defined cases: null, empty and white texts have no shingles, no links and are
classes of their own; texts of one to four words have one shingle of all words;
repeated rows are copies; a null doc_id counts as the smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import dropped, small, steady, stored
from .common import packed, row_keys, table, text_batches
from .textkernels import mix, shingles, words

WORDS = 5
LEAST = 0.8
RECALL = 0.9999
#: Tokens that a set chooses at a node, on average.
CHOICES = 4.0
#: Sets that are compared without choosing again.
LEAF = 512
#: Tokens of a path below the first level.
STEPS = 3
#: Levels of choosing; what is large after the last is compared in blocks.
LEVELS = 4
#: Sets in a block of a large leaf.
BLOCK = 1024
#: Orders of the sketch by which a node is judged to be dense, and what share of its sets agrees then.
SAMPLED, DENSE = 4, 0.6
SKETCH = 32
#: Of 32 sketch bytes so many agree at least in pairs worth comparing: at a
#: similarity of 0.8 fewer do once in a million pairs.
AGREE = 13
_MOST = float(2**64)
_NULL_ID = -(1 << 63)


def runs_for(recall: float, least: float, choices: float) -> int:
    """How many runs keep the chance of missing a pair below 1 - recall.

    Of the larger set's tokens a share of `least` at the lowest is common, so a
    run makes the two meet with probability 1 - exp(-least * choices) or more.
    """
    return max(1, math.ceil(math.log(1 - recall) / (-least * choices)))


def paths_for(recall: float, least: float, steps: int = STEPS) -> int:
    """How many paths of `steps` tokens keep the chance of missing a pair below 1 - recall.

    The paths share the sketch: of its bytes two sets agree in a number that is spread as draws with the chance
    `least`, and given that number each path is one of the ways to pick `steps` bytes, all of which must agree.
    """
    agree = [math.comb(SKETCH, a) * least**a * (1 - least) ** (SKETCH - a) for a in range(SKETCH + 1)]
    apart = [1 - math.comb(a, steps) / math.comb(SKETCH, steps) for a in range(SKETCH + 1)]
    return next(n for n in range(1, 10_000) if sum(p * q**n for p, q in zip(agree, apart)) < 1 - recall)


def _token_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each text), by chunks."""
    for own in words(texts):
        found, row, _ = shingles(own, k)
        order = np.lexsort((found, row))
        found, row = found[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        found, row = found[new], row[new]
        yield own.first, np.split(found, np.bincount(row, minlength=own.rows).cumsum()[:-1])


def _chosen(tokens: np.ndarray, node: int, choices: float) -> np.ndarray:
    """The children of a node that a set goes to."""
    rank = mix(tokens ^ mix(np.array([node], np.int64).view(np.uint64)))
    size = max(len(tokens), 1)
    taken = rank if choices >= size else rank[rank < np.uint64(min(choices / size * _MOST, _MOST - 2048))]
    return mix(taken + np.uint64(1)).view(np.int64)


_SALTS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))


def _sketch(tokens: np.ndarray) -> bytes:
    """The lowest byte of the smallest token under each of 32 orders."""
    least = [(tokens * (s | np.uint64(1))).min() for s in _SALTS]
    return (mix(np.array(least)) & np.uint64(255)).astype(np.uint8).tobytes()


def _digest(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int((mix(tokens).sum() + np.uint64(len(tokens))).view(np.int64))


def profiles(docs: DataFrame, k: int, runs: int, choices: float) -> DataFrame:
    """(doc_id, key_a, key_b, set_a, set_b, size, sketch, nodes) of rows (doc_id, text, key_a, key_b).

    set_a and set_b are a digest of each set, nodes those of the first level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, sets in _token_sets(batch.column(1), k):
                a, b, sketches, nodes = [], [], [], []
                for s in sets:
                    a.append(_digest(s))
                    b.append(_digest(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                    sketches.append(_sketch(s) if len(s) else b"")
                    nodes.append(np.unique(np.concatenate([_chosen(s, r, choices) for r in range(runs)])) if len(s) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, len(sets)) for c in (ids, batch.column(2), batch.column(3))), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sketches, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                    ["doc_id", "key_a", "key_b", "set_a", "set_b", "size", "sketch", "nodes"],
                )

    return docs.mapInArrow(run, "doc_id long, key_a long, key_b long, set_a long, set_b long, size int, sketch binary, nodes array<long>")


def token_sets(docs: DataFrame, k: int) -> DataFrame:
    """(set, tokens) of rows (set, text): the set's hashes, eight bytes each; rows whose text has another set go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _token_sets(batch.column(1), k):
                # another text may have the same doc_id
                found = [(i, s.tobytes()) for i, s in zip(batch.column(0).slice(first, len(sets)).to_pylist(), sets) if _digest(s) == i]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["set", "tokens"])

    return docs.mapInArrow(run, "set long, tokens binary")


def _sized(members: DataFrame) -> DataFrame:
    """members with n, the number of rows of their node; nodes of one row go."""
    counts = members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(counts, "node")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of equal first three columns, which come one after another."""
    key, own = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != key:
                if own:
                    yield own
                key, own = row[:3], []
            own.append(row)
    if own:
        yield own


def _own_pairs(rows: list[tuple], leaf: int, least: float) -> np.ndarray:
    """Of a group's members, which pairs are compared here: a boolean matrix above the diagonal.

    rows: (leaf, i, j, set, block, size, sketch, leaves). Of a group of two
    blocks only pairs across count. Pairs met in an earlier leaf, of too unequal
    sizes, or of unlike sketches are left out.
    """
    m = len(rows)
    size = np.array([r[5] for r in rows], float)
    low = np.minimum(size[:, None], size[None, :]) >= least * np.maximum(size[:, None], size[None, :]) - 1e-9
    if rows[0][1] != rows[0][2]:
        block = np.array([r[4] for r in rows])
        low &= block[:, None] != block[None, :]
    low &= np.triu(np.ones((m, m), bool), 1)
    if low.any():
        sketch = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(m, SKETCH)
        agree = np.zeros((m, m), np.uint8)
        for column in sketch.T:
            agree += column[:, None] == column[None, :]
        low &= agree >= AGREE
    if low.any():
        counts = [sum(x < leaf for x in r[7]) for r in rows]
        flat, row = np.array([x for r in rows for x in r[7] if x < leaf], np.int64), np.repeat(np.arange(m), counts)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        for own in np.split(row, np.flatnonzero(flat[1:] != flat[:-1]) + 1):
            if len(own) > 1:  # its members have met there
                low[np.ix_(own, own)] = False
    return low


_MEMBER = "leaf long, i int, j int, set long, block int, size int, sketch binary, leaves array<long>"


def _worth(members: DataFrame, least: float) -> DataFrame:
    """The members of each group that have a pair to compare there."""
    names = [x.split()[0] for x in _MEMBER.split(", ")]
    kind = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _groups(batches):
            if len(rows) > 1:
                own = _own_pairs(rows, rows[0][0], least)
                out += [rows[i] for i in np.flatnonzero(own.any(0) | own.any(1))]
            if len(out) > 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kind)], schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kind)], schema=kind)

    return members.mapInArrow(run, _MEMBER)


def _shared(tokens: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections of some sets."""
    flat, which = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    order = np.argsort(flat, kind="stable")
    flat, which = flat[order], which[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = new.cumsum() - 1
    often = np.bincount(column)[column] > 1  # a token of one set adds to no intersection
    column, which = column[often], which[often]
    total = np.zeros((len(tokens), len(tokens)), np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        step = max(1, (8 << 20) // (4 * len(tokens)))  # 8 MB of a 0/1 matrix at a time
        for begin in range(0, int(column[-1]) + 1, step):
            a, b = np.searchsorted(column, [begin, begin + step])
            part = np.zeros((len(tokens), min(step, int(column[-1]) + 1 - begin)), np.float32)
            part[which[a:b], column[a:b] - begin] = 1
            total += part @ part.T
    return total


def _links(members: DataFrame, least: float) -> DataFrame:
    """(set, links, other): for each member the documents it is linked to here, and one linked set with a smaller id.

    Rows: those of _MEMBER, then copies and tokens. `other` are the edges of a
    forest over the group's links, so there are fewer of them than members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, links, others = [], [], []
        for rows in _groups(batches):
            if len(rows) < 2:
                continue
            own = _own_pairs(rows, rows[0][0], least)
            if not own.any():
                continue
            inter = _shared([np.frombuffer(r[9], np.uint64) for r in rows])
            size = np.array([r[5] for r in rows], float)
            union = size[:, None] + size[None, :] - inter
            near = own & (inter >= least * union - 1e-6)
            near |= near.T
            copies = np.array([r[8] for r in rows], np.int64)
            total = near @ copies
            ident = np.array([r[3] for r in rows], np.int64)
            root = np.arange(len(rows))
            order = np.argsort(ident, kind="stable")
            place = np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows))
            while True:  # the smallest member of each linked part
                below = np.where(near, place[root][None, :], len(rows)).min(1)
                better = np.minimum(below, place[root])
                if (better == place[root]).all():
                    break
                root = order[better]
            for i in np.flatnonzero(near.any(1)):
                sets.append(int(ident[i]))
                links.append(int(total[i]))
                others.append(int(ident[root[i]]))
            if len(sets) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(links, pa.int64()), pa.array(others, pa.int64())], ["set", "links", "other"])
                sets, links, others = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(links, pa.int64()), pa.array(others, pa.int64())], ["set", "links", "other"])

    return members.mapInArrow(run, "set long, links long, other long")


def _order(node: Column, i: int) -> Column:
    """Which byte of the sketch (from 1) a node's i-th order is."""
    return (F.pmod(F.xxhash64(node, F.lit(i)), F.lit(SKETCH)) + 1).cast("int")


def _orders(node: Column, path: int, steps: int) -> list[Column]:
    """The places in the sketch that a path from a node goes by: all of them different."""
    first = F.pmod(F.xxhash64(node, F.lit(path)), F.lit(SKETCH * SKETCH)).cast("int")
    # an odd step goes round all 32 places before it comes back
    return [F.pmod(first + i * (2 * F.floor(first / SKETCH) + 1), F.lit(SKETCH)).cast("int") + 1 for i in range(steps)]


def dense_nodes(large: DataFrame) -> DataFrame:
    """(node) of rows (node, set, n, sketch): nodes of which most sets agree in a few orders."""
    # a node's commonest byte under each order, of 256 at most; as text, which compares by value
    least = [F.hex(F.substring("sketch", _order(F.col("node"), i), F.lit(1))) for i in range(SAMPLED)]
    common = large.groupBy("node").agg(*[F.mode(x).alias(f"m{i}") for i, x in enumerate(least)])
    agree = sum(((x == F.col(f"m{i}")).cast("int") for i, x in enumerate(least)), F.lit(0))
    return large.join(common, "node").groupBy("node").agg((F.avg(agree) / SAMPLED).alias("share")).where(F.col("share") > DENSE).select("node")


def children(large: DataFrame, paths: int, steps: int = STEPS) -> DataFrame:
    """(node, set) of the next level, of rows (node, set, sketch); several rows may be the same."""
    node = F.col("node")
    ways = [F.xxhash64(node, F.lit(p), *[F.substring("sketch", at, F.lit(1)) for at in _orders(node, p, steps)]) for p in range(paths)]
    return large.select(F.explode(F.array(*ways)).alias("node"), "set")


def leaves(nodes: DataFrame, sketches: DataFrame, leaf: int, levels: int, paths: int) -> DataFrame:
    """(leaf, set, n): where the search ends, from the nodes (node, set, n) of the first level and sketches (set, sketch)."""
    ended = lambda df: df.select(F.col("node").alias("leaf"), "set", "n")
    done = ended(nodes.where(F.col("n") <= leaf))
    large = nodes.where(F.col("n") > leaf)
    for level in range(2, levels + 1):
        if large.isEmpty():
            return done
        known = stored(large.join(sketches, "set").select("node", "set", "n", "sketch"), "large-nodes")
        dense = stored(dense_nodes(known), "dense")
        done = done.unionByName(ended(known.join(dense, "node", "left_semi")))
        down = stored(children(known.join(dense, "node", "left_anti"), paths), "children")
        below = stored(_sized(down), "nodes")
        dropped(down)
        done = done.unionByName(ended(below.where(F.col("n") <= leaf)))
        large = below.where(F.col("n") > leaf)
    return done.unionByName(ended(large))


def components(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(set, label): the smallest set of each connected part, for sets that have edges (set, other)."""
    both = stored(edges.select("set", "other").where("set != other").unionByName(edges.select(F.col("other").alias("set"), F.col("set").alias("other")).where("set != other")).distinct(), "edges")
    labels = stored(both.groupBy("set").agg(F.min("other").alias("m")).select("set", F.least("set", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("set", "other"), "other").groupBy("set").agg(F.min("label").alias("m"))
        nearer = labels.join(seen, "set").select("set", "label", F.least("label", "m").alias("m"))
        # pointer jumping: the label of one's label
        jumped = nearer.join(labels.select(F.col("set").alias("m"), F.col("label").alias("over")), "m", "left").select("set", F.col("label").alias("before"), F.least("m", F.coalesce("over", "m")).alias("label"))
        after = stored(jumped, "labels")
        if after.where("before != label").isEmpty():
            return after.select("set", "label")
        labels = after.select("set", "label")


def joined(docs: DataFrame, k: int = WORDS, least: float = LEAST, recall: float = RECALL, choices: float = CHOICES, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """(doc_id, key_a, key_b, class_id, part, n_links) of all documents.

    class_id is the smallest doc_id among the documents that hang together by
    links, part a number of theirs (of documents without shingles, of each row);
    n_links counts the other documents of similarity `least` or more. key_a and
    key_b stand for the row's id and text.
    """
    spark = docs.sparkSession
    text_batches(spark)
    steady(spark)
    runs = runs_for(recall, least, choices)
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row_keys("doc_id", "text"))
    light = stored(profiles(rows, k, runs, choices), "profiles")
    full = light.where("size > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))
    classes = stored(classes.withColumnRenamed("set_a", "set"), "classes")
    nodes = stored(_sized(classes.select(F.explode("nodes").alias("node"), "set")), "nodes")
    ends = stored(leaves(nodes, classes.select("set", "sketch"), leaf, levels, paths_for(recall, least)).distinct(), "leaves")
    lists = ends.groupBy("set").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = ends.join(classes.select("set", "size", "sketch"), "set").join(lists, "set").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    spread = placed.select("leaf", "set", "block", "size", "sketch", "leaves", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = spread.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set", "block", "size", "sketch", "leaves")
    ordered = lambda df: df.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "set")
    worth = stored(_worth(ordered(members), least), "worth")
    # one text stands for the copies of a set: that of the smallest doc_id
    wanted = stored(classes.join(worth.select("set").distinct(), "set", "left_semi").select(F.col("first_id").alias("doc_id"), "set"), "wanted-sets")
    texts = rows.select("doc_id", "text").join(small(wanted), "doc_id").select("set", "text")
    sets = token_sets(texts, k).dropDuplicates(["set"])
    compared = ordered(worth.join(small(stored(classes.join(wanted, "set", "left_semi").select("set", "copies"), "copies")), "set").join(sets, "set").select(*worth.columns, "copies", "tokens"))
    found = stored(_links(compared, least), "links")
    labels = components(classes, found)
    firsts = classes.select(F.col("set").alias("label"), "first_id", "copies")
    parts = labels.join(firsts.select("label", "first_id"), labels["set"] == firsts["label"]).select(labels["set"], labels["label"].alias("part"), "first_id")
    ids = parts.groupBy("part").agg(F.min("first_id").alias("class_id"))
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    known = classes.select("set", "set_b", "first_id", "copies").join(labels, "set", "left").join(ids.withColumnRenamed("part", "label"), "label", "left").join(links, "set", "left")
    known = known.select(F.col("set").alias("set_a"), "set_b", F.coalesce("label", "set").alias("part"), F.coalesce("class_id", "first_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = light.select("doc_id", "key_a", "key_b", "set_a", "set_b", "size").join(known, ["set_a", "set_b"], "left")
    real = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    words = F.col("size") > 0
    return out.select(real("doc_id").alias("doc_id"), "key_a", "key_b", F.when(words, real("class_id")).otherwise(real("doc_id")).alias("class_id"), F.when(words, F.col("part")).otherwise(F.col("key_a")).alias("part"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of linked ones: one of the smallest doc_id.

    Rows that repeat it in full go too. Of several texts under one doc_id each is
    judged by itself; documents without a word link to none and stay.
    """
    firsts = joined(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id", "part").agg(F.min(F.struct("key_a", "key_b")).alias("one"))
    stay = stored(firsts.select("one.*"), "staying")
    keyed = packed(docs).select("row", *row_keys("row.doc_id", "row.text"))
    return keyed.join(small(stay), ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"]).select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document."""
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) c
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 10 * common >= 8 * (p.n + q.n - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links FROM d
"""
