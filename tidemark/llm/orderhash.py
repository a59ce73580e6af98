"""Order MinHash fingerprints, sensitive to edit distance.

A text's k-mers are its runs of five words, each numbered by how often it has
occurred before. For each of 64 orders the two smallest numbered k-mers are
taken, put in the order in which they stand in the text, and hashed together;
the share of equal hashes estimates how alike two texts are, order included.

The 64 orders are the rotations of one hash order: order b counts from the point
b/64 of the hash range on, and goes round. So one sort of a text's k-mers
serves all of them, and its k-mers never leave their row: everything is an
expression on arrays of longs, linear in the text but for that sort.

Defined cases: null and empty texts, and those of white space, have no k-mers
and the empty fingerprint, which is like (1.0) other empty ones and unlike (0.0)
all others; a text of fewer than five words has one k-mer of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..plans.scratch import stored
from .common import row_keys, sha256_hex, table

WORDS = 5
ORDERS = 64
#: A k-mer is a long: 38 bits of its hash above 25 bits of its place.
PLACE_BITS = 25
_PLACES = (1 << PLACE_BITS) - 1
_HASH_SHIFT = 64 - 38
_BIN_SHIFT = 63 - 6


def kmer_hashes(text: Column, k: int = WORDS) -> Column:
    """38-bit hashes of the k-mers of a text, in text order."""

    def cut(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, k)), _HASH_SHIFT))
        return F.when(F.size(w) > 0, many).otherwise(F.array().cast("array<bigint>"))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+"), 0), cut)


def _numbered(s: Column) -> Column:
    """Sorted k-mers with each repeat's hash replaced by one of (hash, number), sorted again."""

    def renamed(runs: Column) -> Column:
        def one(begin: Column, r: Column) -> Column:
            end = F.coalesce(F.get(runs, r + 1), F.size(s))

            def occurrence(j: Column) -> Column:
                x = F.element_at(s, j + 1)
                other = F.shiftrightunsigned(F.xxhash64(F.shiftright(x, PLACE_BITS), j - begin), _HASH_SHIFT)
                return F.when(j == begin, x).otherwise(F.shiftleft(other, PLACE_BITS).bitwiseOR(x.bitwiseAND(F.lit(_PLACES))))

            return F.transform(F.sequence(begin, end - 1), occurrence)

        return F.sort_array(F.flatten(F.transform(runs, one)))

    begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.shiftright(F.element_at(s, j + 1), PLACE_BITS) != F.shiftright(F.get(s, j - 1), PLACE_BITS)))
    return let(begins, renamed)


def _tuples(s: Column) -> Column:
    """The hash of the two smallest k-mers of each order, in text order."""
    n = F.size(s)

    def at_point(j: Column) -> Column:
        def pair(x: Column) -> Column:
            a, b = F.element_at(s, j + 1), F.element_at(s, (j + 1) % n + 1)
            before = a.bitwiseAND(F.lit(_PLACES)) <= b.bitwiseAND(F.lit(_PLACES))
            h, g = F.shiftright(a, PLACE_BITS), F.shiftright(b, PLACE_BITS)
            return F.when(before, F.xxhash64(h, g)).otherwise(F.xxhash64(g, h))

        return (pair(j).bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("smallint")

    def points(firsts: Column) -> Column:
        """The first k-mer from each of the points on: firsts are the first ones of their bins."""

        def bin_of(j: Column) -> Column:
            return F.shiftright(F.element_at(s, j + 1), _BIN_SHIFT).cast("int")

        runs = F.transform(firsts, lambda j, r: F.array_repeat(j, bin_of(j) - F.coalesce(bin_of(F.get(firsts, r - 1)), F.lit(-1))))
        rest = F.array_repeat(F.lit(0), ORDERS - 1 - bin_of(F.element_at(firsts, -1)))
        return F.transform(F.concat(F.flatten(runs), rest), at_point)

    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (F.shiftright(F.element_at(s, j + 1), _BIN_SHIFT) != F.shiftright(F.get(s, j - 1), _BIN_SHIFT)))
    return let(begins, points)


def fingerprint(text: Column, k: int = WORDS) -> Column:
    """The fingerprint of a text: 64 16-bit values as array<smallint>, or an empty array."""

    def of(h: Column) -> Column:
        # places of a text with more than 2^25 k-mers are coarsened; their order stays
        coarse = (F.size(h) / F.lit(1 << PLACE_BITS)).cast("int") + 1
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR((i / coarse).cast("bigint"))))
        repeats = F.size(F.array_distinct(h)) < F.size(h)
        numbered = let(packed, lambda s: F.when(repeats, _numbered(s)).otherwise(s))
        return F.when(F.size(h) > 0, let(numbered, _tuples)).otherwise(F.array().cast("array<smallint>"))

    return let(kmer_hashes(text, k), of)


def digits(prints: Column) -> Column:
    """A fingerprint as hexadecimal digits, four for each order."""
    return F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x.cast("int") + 0x8000), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of orders in which two fingerprints agree, from 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(ORDERS))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same)


def followers(docs: DataFrame) -> DataFrame:
    """(doc_id, key_a, key_b, next_a, next_b, need): for each document the one after it by descending doc_id.

    Ids and keys are dealt out by ranges of doc_id, so that no task sees all;
    the last row of a range is followed by the first of the next range, and the
    last of all by the first of all. Rows of equal doc_id and text are one
    document; those of equal doc_id follow each other by key; null ids come last.
    """
    light = docs.select("doc_id", *row_keys("doc_id", "text"), F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 3).cast("int").alias("need")).distinct()
    order = [F.desc_nulls_last("doc_id"), F.asc("key_a"), F.asc("key_b")]
    ranged = stored(light.repartitionByRange(*order).select("*", F.spark_partition_id().alias("range")), "ranges")
    by_range = Window.partitionBy("range").orderBy(*order)
    here = ranged.select("*", F.struct("key_a", "key_b").alias("own")).select("*", F.lead("own").over(by_range).alias("next"), F.row_number().over(by_range).alias("nth"))
    # one row for each range: as many as there are partitions
    firsts = here.where("nth = 1").select("range", "own")
    line = Window.orderBy("range")
    after = firsts.select("range", F.coalesce(F.lead("own").over(line), F.first("own").over(line)).alias("over"))
    return here.join(F.broadcast(after), "range").select("doc_id", "key_a", "key_b", "need", F.coalesce("next", "over").alias("next")).select("doc_id", "key_a", "key_b", "need", F.col("next.key_a").alias("next_a"), F.col("next.key_b").alias("next_b"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(text, key_a, key_b), dealt out by key: the one exchange of texts.

    All three steps that read it need all its columns and no more, so that none
    is pruned and the exchange is made once.
    """
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), *row_keys("doc_id", "text")).repartition("key_a", "key_b")


def edited(keyed: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, next_a, next_b, text, edited): texts whose last third is the next document's beginning.

    Only as much of the next text is sent as is needed.
    """
    sent = keyed.select(F.col("key_a").alias("next_a"), F.col("key_b").alias("next_b"), F.col("text").alias("other")).join(after, ["next_a", "next_b"])
    tails = sent.select("doc_id", "key_a", "key_b", "next_a", "next_b", "need", F.expr("substring(other, 1, need)").alias("tail")).dropDuplicates(["key_a", "key_b"])
    return keyed.join(tails, ["key_a", "key_b"]).select("doc_id", "next_a", "next_b", "text", F.concat(F.expr("substring(text, 1, char_length(text) - need)"), "tail").alias("edited"))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    A text's fingerprint is made twice, for itself and for the document before
    it: that takes less than to store it and move it once more.
    """
    keyed = keyed_texts(docs)
    made = edited(keyed, stored(followers(docs), "followers")).select(
        "doc_id", "next_a", "next_b", F.char_length("text").cast("long").alias("n_chars"), sha256_hex(F.col("edited")).alias("edited_sha256"), fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("changed")
    )
    others = keyed.select(F.col("key_a").alias("next_a"), F.col("key_b").alias("next_b"), fingerprint(F.col("text")).alias("following")).dropDuplicates(["next_a", "next_b"])
    return made.join(others, ["next_a", "next_b"]).select(
        "doc_id", "n_chars", "edited_sha256", digits(F.col("own")).alias("fingerprint"), digits(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op2_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every document and of its edited text."""
    return compared(table(spark, sf_dir, "documents"))
