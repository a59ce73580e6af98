"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words (runs of letters, A-Z folded) and the first four,
five and six bytes of each, so that inflected forms share terms; each is hashed
to one of 2^20 buckets and counts once a text. The machine scores

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so that a pair of terms (an insult with the mention of a group) can weigh more
than its two parts. Every bucket that `min_rows` training rows or more have is in
the model, however little it says by itself; an L1 penalty on weights and factors
takes those back to nought that help neither alone nor in pairs. The penalty of a
term's weight falls with the square of how far its share of toxic rows is from that of all, in
deviations, so that few labels don't spread over the many terms that chance has put
beside them; factors, which need no such sign, have one penalty. Both are spread over the rows, so they weigh less with more of them.

Training takes at most `max_labelled` labelled doc_ids, those of the smallest hash,
one text of each, and of these as many as have `max_terms` terms together. So much
comes to the driver and is fitted there by mini-batches that touch the batch's
terms only; both bounds are parameters. Scoring reads every whole text, in tasks.

Defined cases: null and empty texts have no terms and score sigmoid(w0); labels
that are null, and those of unknown documents, are left out; several labels of
one doc_id count as toxic if any is; of several texts under one doc_id that of the
smallest hash is learnt from; with no labelled row at all every score is 0. Only doc_id and text of the documents are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, text_batches
from .textkernels import mix, span_hashes, words

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: L1 penalties over all training rows, as a prior: of a weight whose term is SURE deviations from chance (at most
#: MOST squared times that for one by chance), and of a factor.
WEIGHT_PRIOR, SURE, MOST, PAIR_PRIOR = 1.0, 3.0, 3.0, 3.0

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Machine:
    """A trained model; its size is fixed by its parameters, not by the data."""

    terms: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    bias: float = -np.inf
    linear: np.ndarray = field(default_factory=lambda: np.empty(0))
    factors: np.ndarray = field(default_factory=lambda: np.empty((0, 1)))

    def scores(self, row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        """row, at: the text and the model's index of each of its terms."""
        total = np.full(rows, self.bias)
        if len(row):
            total += np.bincount(row, self.linear[at], rows)
            for v in self.factors.T:
                one, two = np.bincount(row, v[at], rows), np.bincount(row, v[at] ** 2, rows)
                total += 0.5 * (one * one - two)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60))) if np.isfinite(self.bias) else np.zeros(rows)


def batch_terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, bucket) of the distinct terms of each text, and the number of rows, by chunks."""
    for own in words(texts, _NO_LETTER):
        data, size, spans = _FOLD[own.data], own.ends - own.starts, [(own.starts, own.ends, own.row)]
        for k in PREFIXES:
            long = np.flatnonzero(size > k)
            spans.append((own.starts[long], own.starts[long] + k, own.row[long]))
        found = [mix(span_hashes(data, a, b) + np.uint64(n)) & np.uint64(BUCKETS - 1) for n, (a, b, _) in enumerate(spans)]
        keys = np.unique(np.concatenate([s[2] for s in spans]) * BUCKETS + np.concatenate(found).astype(np.int64))
        yield keys // BUCKETS, keys % BUCKETS, own.rows


def terms_of(df: DataFrame) -> DataFrame:
    """(doc_id, toxic, terms array<int>) of a frame with doc_id, toxic and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, buckets = [], []
            for row, bucket, rows in batch_terms(batch.column("text")):
                counts.append(np.bincount(row, minlength=rows))
                buckets.append(bucket)
            ends = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
            flat = np.concatenate(buckets).astype(np.int32) if buckets else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "toxic", "terms"])

    return df.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, terms array<int>")


def _trained(toxic: np.ndarray, sizes: np.ndarray, buckets: np.ndarray, min_rows: int, factors: int, visits: int, passes: int, seed: int) -> Machine:
    """Adagrad on the log loss with an L1 penalty, over mini-batches.

    toxic, sizes: of each row; buckets: the rows' distinct terms, one row after
    another. Rows are gone through until `visits` have been seen, or `passes` times.
    """
    rng = np.random.default_rng(seed)
    y = toxic.astype(float)
    # by parts and in 32 bits, as all this lies in the driver's memory
    often = sum(np.bincount(part, minlength=BUCKETS) for part in np.array_split(buckets, len(buckets) // 500_000 + 1))
    terms = np.flatnonzero(often >= min_rows)
    index = np.full(BUCKETS, -1, np.int32)
    index[terms] = np.arange(len(terms))
    at = index[buckets]
    known = at >= 0
    ends = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])[np.concatenate([[0], sizes.cumsum()])]
    at = at[known]
    share = (y.sum() + 0.5) / (len(y) + 1)
    b, w, v = float(np.log(share / (1 - share))), np.zeros(len(terms)), rng.normal(0, 0.02, (factors, len(terms)))
    gb, gw, gv = 1e-3, np.full(len(w), 1e-3), np.full(v.shape, 1e-3)
    rate, step = 0.15, 256
    # by how many deviations a term's toxic rows exceed or miss what chance would give it
    count = often[terms]
    found = np.zeros(len(terms), np.int64)
    for part in np.array_split(np.flatnonzero(y), len(y) // 500 + 1):
        own = [at[ends[i] : ends[i + 1]] for i in part]
        found += np.bincount(np.concatenate(own), minlength=len(terms)) if own else 0
    apart = np.abs(found - count * share) / np.sqrt(count * share * (1 - share))
    penalty, pair_penalty = WEIGHT_PRIOR / len(y) * np.clip(SURE / np.maximum(apart, 1e-9), 0.1, MOST) ** 2, PAIR_PRIOR / len(y)

    def moved(x: np.ndarray, squares: np.ndarray, slope: np.ndarray, speed: float, penalty: np.ndarray | float) -> np.ndarray:
        pace = speed / np.sqrt(squares)
        x = x - pace * slope
        return np.sign(x) * np.maximum(np.abs(x) - pace * penalty, 0)

    for _ in range(min(passes, -(-visits // len(y)))):
        order = rng.permutation(len(y))
        for part in np.split(order, range(step, len(order), step)):
            m, size = len(part), ends[part + 1] - ends[part]
            mine = np.repeat(np.arange(m), size)
            cols, own = np.unique(at[np.repeat(ends[part] - size.cumsum() + size, size) + np.arange(size.sum())], return_inverse=True)
            z, sums = b + np.bincount(mine, w[cols][own], m), []
            for f in range(factors):
                vf = v[f, cols][own]
                sums.append(np.bincount(mine, vf, m))
                z = z + 0.5 * (sums[f] ** 2 - np.bincount(mine, vf * vf, m))
            err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[part]) / m
            each = err[mine]
            dw, db = np.bincount(own, each, len(cols)), err.sum()
            gb += db * db
            b -= rate * db / np.sqrt(gb)
            gw[cols] += dw**2
            w[cols] = moved(w[cols], gw[cols], dw, rate, penalty[cols])
            for f in range(factors):
                dv = np.bincount(own, each * sums[f][mine], len(cols)) - v[f, cols] * dw
                gv[f, cols] += dv**2
                v[f, cols] = moved(v[f, cols], gv[f, cols], dv, 0.2 * rate, pair_penalty)
    used = (w != 0) | (v != 0).any(0)
    return Machine(terms[used], b, w[used], v[:, used].T.copy())


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, max_terms: int = 16_000_000, min_rows: int = 3, factors: int = 6, visits: int = 120_000, passes: int = 40, seed: int = 11) -> Machine:
    """Fit a machine to at most max_labelled texts, of max_terms terms in all, with labels (doc_id, toxic)."""
    text_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled)
    # max_labelled rows of two numbers: a proven bound for the broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    one = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("doc_id", "toxic", F.col("one.text").alias("text"))
    rows = terms_of(one).persist()
    try:
        order = rows.select("doc_id", F.size("terms").alias("n")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").collect()  # max_labelled rows at most
        fit = int((np.cumsum([r.n for r in order]) <= max_terms).sum())
        if not fit:
            return Machine()
        chosen = rows if fit == len(order) else rows.join(F.broadcast(rows.sparkSession.createDataFrame([(r.doc_id,) for r in order[:fit]], "doc_id long")), "doc_id")
        got = chosen.orderBy("doc_id").toArrow()  # max_terms numbers at most
    finally:
        rows.unpersist()
    lists = got.column("terms").combine_chunks()
    return _trained(got.column("toxic").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), min_rows, factors, visits, passes, seed)


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`, the probability that the text is toxic; other columns stay."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        index = np.full(BUCKETS, -1, np.int32)
        index[own.terms] = np.arange(len(own.terms))
        for texts in batches:
            found = [np.empty(0)]
            for row, bucket, rows in batch_terms(texts):
                at = index[bucket]
                found.append(own.scores(row[at >= 0], at[at >= 0], rows))
            yield pa.array(np.concatenate(found), pa.float64())

    return docs.withColumn(out, scores(F.col(text)))


def held_out() -> Column:
    """Rows that no model may learn from: crc32 of the doc_id's digits leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of held-out rows are not read."""
    machine = train(docs, labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the machine doesn't reject, with their columns."""
    machine = train(docs, labels.where(~held_out()))
    return score(packed(docs), machine, text="row.text").where(F.col("score") < threshold).select("row.*")
