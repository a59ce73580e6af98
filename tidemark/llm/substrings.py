"""Substring dedup over a log-structured fingerprint index.

A window is 35 consecutive words of a text. Its fingerprint is the smallest hash
of the eight-word windows in it (winnowing): equal windows have equal
fingerprints, and neighbouring windows mostly share theirs, so that the index
holds about one entry for 14 words.

The index is a list of runs. A run is an immutable bucketed table of
(fingerprint, n), sorted by fingerprint within its buckets: how often each
fingerprint's place was chosen in one batch of documents. A new batch is
merge-joined with each run, bucket by bucket, without moving the run; the
fingerprints met in a run, or twice in the batch, are its hits. Then the batch
becomes a run itself, and when there are more than `most_runs` runs the smallest
ones are merged into one. The index can be kept and opened again: add_batch()
gives the repeats that one more batch brings about, in it and in its history.

A hit only says that windows may be equal; then the words decide. A stretch is
a row of windows that share a fingerprint's place. Of the stretches with a hit,
and of no others, a 128-bit BLAKE2 digest of the very words is taken. Windows of
a stretch whose digest occurs twice are repeats. What is left are stretches with
the fingerprint, but not the words, of another one: of each such wording, once,
the windows get digests of their own. So copies are settled stretch by stretch,
by counts with partial sums and ordinary joins, and no group of copies meets in
one task.

Defined cases: null and empty texts have no words; texts of fewer than 35 words
have no window and keep all; repeated rows of one document repeat each other;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import setting, steady, stored, tidied
from .common import row_keys, table, text_batches
from .textkernels import Words, span_hashes, windows, words

WINDOW = 35
#: Words of the shorter windows whose smallest hash is a window's fingerprint.
PART = 8
BATCHES = 3
MOST_RUNS = 2


def fingerprints(own: Words, size: int = WINDOW, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, fingerprint, place) of each window of some texts.

    place: the word at which the smallest part begins; of equal ones the first.
    """
    parts = windows(span_hashes(own.data, own.starts, own.ends), part)
    n = len(own.row) - size + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    wide, width = size - part + 1, 1
    least, at = parts.copy(), np.arange(len(parts))
    while width < wide:  # the smallest of 1, 2, 4... parts, at last of all in a window
        shift = min(width, wide - width)
        m = len(least) - shift
        other = least[shift:] < least[:m]
        at = np.where(other, at[shift:], at[:m])
        least = np.where(other, least[shift:], least[:m])
        width += shift
    first = np.flatnonzero(own.row[:n] == own.row[size - 1 :])
    return first, least[first].view(np.int64), at[first]


def chosen(df: DataFrame) -> DataFrame:
    """(fingerprint) once for each place that windows of a text choose."""
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in words(batch.column(0)):
                _, prints, at = fingerprints(own)
                # one choice a place; windows of one place are neighbours
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(prints[new])], ["fingerprint"])

    return df.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "fingerprint long")


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, as bucketed tables of the warehouse."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, most_runs: int = MOST_RUNS):
        self.spark, self.name, self.most_runs = spark, name or f"fingerprints_{uuid.uuid4().hex[:12]}", most_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, int]] = []  # table and rows
        self.made = 0

    @classmethod
    def open(cls, spark: SparkSession, name: str, most_runs: int = MOST_RUNS) -> "FingerprintIndex":
        """The index of that name, from the runs that the catalog has of it."""
        runs = sorted(t.name for t in spark.catalog.listTables() if re.fullmatch(rf"{re.escape(name)}_\d+", t.name))
        if not runs:
            raise ValueError(f"the catalog has no run of {name}")
        buckets = next(int(r.data_type) for r in spark.sql(f"DESCRIBE TABLE EXTENDED {runs[0]}").collect() if r.col_name == "Num Buckets")
        own = cls(spark, name, buckets, most_runs)
        own.runs = [(x, spark.table(x).count()) for x in runs]
        own.made = int(runs[-1].rsplit("_", 1)[1])
        return own

    def _write(self, rows: DataFrame) -> None:
        self.made += 1
        name = f"{self.name}_{self.made:04d}"
        with tidied(self.spark):  # one file a bucket
            rows.repartition(self.buckets, "fingerprint").write.format("parquet").bucketBy(self.buckets, "fingerprint").sortBy("fingerprint").saveAsTable(name)
        self.runs.append((name, self.spark.table(name).count()))

    def add(self, docs: DataFrame) -> DataFrame:
        """Take in a batch of documents; (fingerprint) of its hits with earlier batches or itself."""
        before = list(self.runs)
        self._write(chosen(docs).groupBy("fingerprint").agg(F.count("*").alias("n")))
        batch = self.spark.table(self.runs[-1][0])
        hits = batch.where("n > 1").select("fingerprint")
        for name, _ in before:
            hits = hits.unionByName(batch.where("n = 1").select("fingerprint").join(self.spark.table(name), "fingerprint", "left_semi"))
        # with one file a bucket, a run is sorted as it is read
        with setting(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
            hits = stored(hits.distinct(), "hits")
        self.compact()
        return hits

    def compact(self) -> None:
        """Merge the smallest runs into one while there are more than most_runs."""
        while len(self.runs) > self.most_runs:
            self.runs.sort(key=lambda x: -x[1])
            (a, _), (b, _) = self.runs.pop(), self.runs.pop()
            self._write(self.spark.table(a).unionByName(self.spark.table(b)).groupBy("fingerprint").agg(F.sum("n").alias("n")))
            for name in (a, b):
                self.spark.sql(f"DROP TABLE {name}")

    def drop(self) -> None:
        for name, _ in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
        self.runs = []


def _windows_of(df: DataFrame) -> DataFrame:
    """(key_a, key_b, fingerprint, begin, end): stretches of windows that share a fingerprint, for documents (key_a, key_b, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [c.to_numpy() for c in batch.columns[:2]]
            for own in words(batch.column(2)):
                first, prints, at = fingerprints(own)
                cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, int)
                last = np.concatenate([cut[1:], [len(at)]]) - 1 if len(at) else cut
                base = np.concatenate([[0], own.counts().cumsum()])
                row = own.row[first[cut]]
                yield pa.RecordBatch.from_arrays([*(pa.array(k[own.first + row]) for k in keys), pa.array(prints[cut]), pa.array((first[cut] - base[row]).astype(np.int32)), pa.array((first[last] - base[row]).astype(np.int32))], ["key_a", "key_b", "fingerprint", "begin", "end"])

    return df.mapInArrow(run, "key_a long, key_b long, fingerprint long, begin int, end int")


def _joined(own: Words, a: int, b: int) -> tuple[bytes, np.ndarray]:
    """Words a to b of a chunk with one space between, and where each begins."""
    starts, lengths = own.starts[a:b], own.ends[a:b] - own.starts[a:b]
    place = np.concatenate([[0], (lengths + 1).cumsum()])
    data = np.full(place[-1], 32, np.uint8)
    inner = np.arange(lengths.sum()) - np.repeat(lengths.cumsum() - lengths, lengths)
    data[np.repeat(place[:-1], lengths) + inner] = own.data[np.repeat(starts, lengths) + inner]
    return data.tobytes(), place


def digests(df: DataFrame, each: bool, size: int = WINDOW) -> DataFrame:
    """(key_a, key_b, fingerprint, begin, end, digest_a, digest_b) of stretches, or of each of their windows.

    df: key_a, key_b, text, stretches array<struct<fingerprint:bigint,begin:int,end:int>>.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = [c.to_numpy() for c in batch.columns[:2]], batch.column(3).to_pylist()
            for own in words(batch.column(2)):
                base = np.concatenate([[0], own.counts().cumsum()])
                rows, out = [], []
                for r in range(own.rows):
                    if not lists[own.first + r]:
                        continue
                    text, place = _joined(own, base[r], base[r + 1])
                    n, key = len(place) - 1, [int(k[own.first + r]) for k in keys]
                    for x in lists[own.first + r]:
                        parts = ((i, i) for i in range(x["begin"], x["end"] + 1)) if each else ((x["begin"], x["end"]),)
                        for begin, end in parts:
                            if end + size <= n:
                                out.append(hashlib.blake2b(text[place[begin] : place[end + size] - 1], digest_size=16).digest())
                                rows.append((*key, x["fingerprint"], begin, end))
                found = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
                own_columns = [np.array(c) for c in zip(*rows)] or [np.empty(0, np.int64)] * 5
                arrays = [pa.array(c.astype(k)) for c, k in zip(own_columns, (np.int64, np.int64, np.int64, np.int32, np.int32))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["key_a", "key_b", "fingerprint", "begin", "end", "digest_a", "digest_b"])

    return df.mapInArrow(run, "key_a long, key_b long, fingerprint long, begin int, end int, digest_a long, digest_b long")


def removed(df: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without the words that repeats cover.

    df: doc_id, text, repeats array<struct<begin:int,end:int>>, the windows to take out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats = batch.column(2)
            for own in words(batch.column(1)):
                counts = own.counts()
                base = np.concatenate([[0], counts.cumsum()])
                mine = repeats.slice(own.first, own.rows)
                sizes = np.nan_to_num(mine.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                ranges, shift = mine.flatten(), np.repeat(base[:-1], sizes)
                turns = np.zeros(len(own.row) + 1, np.int64)
                np.add.at(turns, ranges.field("begin").to_numpy() + shift, 1)
                np.add.at(turns, np.minimum(ranges.field("end").to_numpy() + shift + size, len(own.row)), -1)
                keep = turns.cumsum()[:-1] == 0
                row, starts, ends = own.row[keep], own.starts[keep], own.ends[keep]
                lengths = ends - starts
                # a space goes behind each word but the last one of a text
                gap = np.ones(len(row), np.int64)
                if len(row):
                    gap[np.append(np.flatnonzero(row[1:] != row[:-1]), len(row) - 1)] = 0
                place = (lengths + gap).cumsum() - lengths - gap
                data = np.full(int((lengths + gap).sum()), 32, np.uint8)
                inner = np.arange(lengths.sum()) - np.repeat(lengths.cumsum() - lengths, lengths)
                data[np.repeat(place, lengths) + inner] = own.data[np.repeat(starts, lengths) + inner]
                kept = np.bincount(row, minlength=own.rows)
                bytes_of = np.bincount(row, lengths + gap, own.rows).astype(np.int64)
                offsets = np.concatenate([[0], bytes_of.cumsum()]).astype(np.int32)
                texts = pa.Array.from_buffers(pa.string(), own.rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(own.first, own.rows), pa.array(counts.astype(np.int64)), pa.array((counts - kept).astype(np.int64)), texts], ["doc_id", "n_words", "n_removed", "kept"])

    return df.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", *row_keys("doc_id", "text"))


def repeats(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """(key_a, key_b, begin, end): windows, from the first of a stretch to its last, that stand elsewhere too.

    keyed: doc_id, text, key_a, key_b; hits: the fingerprints that may be repeated.
    """
    keys = ["key_a", "key_b"]
    places = _windows_of(keyed.select(*keys, "text")).join(hits, "fingerprint", "left_semi")
    lists = lambda df: df.groupBy(*keys).agg(F.collect_set(F.struct("fingerprint", "begin", "end")).alias("stretches"))
    found = stored(digests(keyed.join(lists(places), keys).select(*keys, "text", "stretches"), False), "stretches")
    content = ["fingerprint", "digest_a", "digest_b"]
    wordings = stored(found.groupBy(*content).agg(F.count("*").alias("n"), F.min(F.struct(*keys, "begin", "end")).alias("one")), "wordings")
    several = wordings.groupBy("fingerprint").agg(F.count("*").alias("k")).where("k > 1").select("fingerprint")
    ones = wordings.join(several, "fingerprint", "left_semi").select("fingerprint", "one.*", "n")
    each = stored(digests(keyed.join(lists(ones), keys).select(*keys, "text", "stretches"), True), "windows")
    twice = each.groupBy("digest_a", "digest_b").agg(F.count("*").alias("k")).where("k > 1").select("digest_a", "digest_b")
    # windows of a wording that stands once; those of the others are repeats anyway
    alone = each.join(twice, ["digest_a", "digest_b"], "left_semi").select(*keys, "begin", "end")
    copied = found.join(wordings.where("n > 1").select(*content), content, "left_semi").select(*keys, "begin", "end")
    return copied.unionByName(alone)


def without(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of documents (doc_id, text, key_a, key_b) without their repeats."""
    lists = found.groupBy("key_a", "key_b").agg(F.collect_set(F.struct("begin", "end")).alias("repeats"))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    return removed(keyed.join(lists, ["key_a", "key_b"], "left").select("doc_id", "text", F.coalesce("repeats", none).alias("repeats")))


def add_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(key_a, key_b, begin, end): the repeats that a batch of documents brings about.

    history: the documents that the index has taken in before, whose windows
    may be repeats from now on too. Together with what earlier calls gave, the
    rows are the repeats of all documents.
    """
    text_batches(index.spark)
    steady(index.spark)
    rows = _keyed(batch)
    hits = index.add(rows.select("text"))
    return stored(repeats(rows if history is None else _keyed(history).unionByName(rows), hits), "batch-repeats")


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of all documents.

    They are taken into a fresh index in batches, by a hash of their rows; what
    the index has met is verified once, when all are in.
    """
    spark = docs.sparkSession
    text_batches(spark)
    steady(spark)
    keyed = _keyed(docs)
    index = FingerprintIndex(spark)
    hits = None
    for i in range(batches):
        found = index.add(keyed.where(F.pmod("key_a", F.lit(batches)) == i).select("text"))
        hits = found if hits is None else hits.unionByName(found)
    hits = stored(hits.distinct(), "all-hits")
    index.drop()
    return without(keyed, repeats(keyed, hits))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that 35-word windows repeat."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35),
keyed AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS k FROM win),
dup AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
gone AS (SELECT r, list_distinct(flatten(list(range(s, s + 35)))) AS pos FROM keyed JOIN dup USING (k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(pos), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: pos IS NULL OR NOT list_contains(pos, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
