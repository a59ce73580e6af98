"""Benchmark decontamination with a distributed positional inverted index.

1. Every benchmark item is cut into windows of 13 consecutive words; an item of
   fewer words, but not none, is one window.
2. One pass over the documents counts the windows' terms. A window with a term
   that no document has can't occur; of each other window the rarest terms
   become its anchors.
3. A second pass stores the postings (term, document, position) of the anchors
   in a Parquet index sorted by term.
4. The anchors' posting lists, each shifted by the anchor's offset, are
   intersected from the rarest on; what is left are places where a window may
   begin, and they are compared with the document's words.

Everything is DataFrame work. Windows, terms and anchors come from the test set;
they are broadcast only if they have no more rows than plans.scratch allows.

Terms are compared in full lower case to find places; the words themselves are
compared with A-Z lower-cased only, as words are defined here.

Defined cases: null and empty texts have no words, so no hits; items without
words have no windows; a null item_id counts as the id ''; repeated rows of
documents are judged each, repeated items count once; an empty benchmark hits
nothing. Only doc_id, text and item_id, text are read, and other columns of the
documents are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import changed_ascii_case, let
from ..plans.scratch import new_folder, small, steady, stored
from .common import others, packed, row_keys

WINDOW = 13
#: Posting lists that are intersected for each window.
ANCHORS = 3
#: One word, in a text of any case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, words, items): the distinct windows, and the items that have them."""
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(changed_ascii_case(F.col("text"))).alias("words")).where(F.size("words") > 0)
    placed = cut.select("item", let(F.col("words"), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.slice(w, i, size))).alias("found"))
    each = placed.select("item", F.explode("found").alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64("words").alias("window"), "words", "items")


def _placed_terms(df: DataFrame, ident: str) -> DataFrame:
    """(key_a, key_b, pos, term) of all words of a frame."""
    each = df.select(*row_keys(ident, "text"), F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return each.select("key_a", "key_b", "pos", F.lower("word").alias("term"))


def anchors(docs: DataFrame, found: DataFrame, most: int = ANCHORS) -> DataFrame:
    """(window, nth, offset, term, wanted): the rarest terms of the windows that can occur."""
    placed = found.select("window", F.posexplode("words").alias("offset", "word")).select("window", "offset", F.lower("word").alias("term"))
    terms = stored(placed.select("term").distinct(), "terms")
    counts = stored(_placed_terms(docs, "doc_id").select("term").join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n")), "counts")
    ranked = placed.join(counts, "term", "left")
    order = Window.partitionBy("window").orderBy("n", "term", "offset")
    whole = Window.partitionBy("window")
    return (
        ranked.select("*", F.row_number().over(order).alias("nth"), F.min(F.coalesce("n", F.lit(0))).over(whole).alias("least"), F.count("*").over(whole).alias("size"))
        .where((F.col("least") > 0) & (F.col("nth") <= most))
        .select("window", "nth", "offset", "term", F.least(F.col("size"), F.lit(most)).alias("wanted"))
    )


def index(docs: DataFrame, terms: DataFrame, path: str | None = None) -> DataFrame:
    """Store the postings (term, key_a, key_b, pos) of the given terms, sorted by term and document."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "postings")
    postings = _placed_terms(docs, "doc_id").join(small(terms), "term").select("term", "key_a", "key_b", "pos")
    # a frequent term's list is dealt out by document, so that no task holds it all
    postings.repartition("term", F.pmod("key_a", F.lit(64))).sortWithinPartitions("term", "key_a", "key_b", "pos").write.parquet(path)
    return spark.read.schema(postings.schema).parquet(path)


def phrase_places(postings: DataFrame, chosen: DataFrame, most: int = ANCHORS) -> DataFrame:
    """(window, key_a, key_b, start) where all anchors of a window stand at their offsets."""
    on = ["window", "key_a", "key_b", "start"]

    def shifted(nth: int) -> DataFrame:
        own = chosen.where(F.col("nth") == nth).select("window", "offset", "term", "wanted")
        return postings.join(small(own), "term").select("window", "key_a", "key_b", (F.col("pos") - F.col("offset")).alias("start"), "wanted").where("start >= 0")

    left = shifted(1).distinct()
    for nth in range(2, most + 1):
        # windows of fewer anchors than nth have nothing more to meet
        done = left.where(F.col("wanted") < nth)
        left = left.where(F.col("wanted") >= nth).join(shifted(nth).select(*on), on, "left_semi").unionByName(done)
    return left.select(*on)


def proximity_matches(postings: DataFrame, terms: list[str], span: int) -> DataFrame:
    """(key_a, key_b, pos): places of the first term with all others within `span` words before or after.

    The list of the first term should be the shortest. Positions are put into
    cells of `span` words, so that each join is an equality on neighbouring cells.
    """
    lead = postings.where(F.col("term") == terms[0].lower()).select("key_a", "key_b", "pos").distinct()
    for term in terms[1:]:
        other = postings.where(F.col("term") == term.lower()).select("key_a", "key_b", F.col("pos").alias("there"))
        near = other.select("*", F.explode(F.sequence(F.floor(F.col("there") / span) - 1, F.floor(F.col("there") / span) + 1)).alias("cell"))
        a = lead.withColumn("cell", F.floor(F.col("pos") / span))
        lead = a.join(near, ["key_a", "key_b", "cell"]).where(F.abs(F.col("pos") - F.col("there")) <= span).select("key_a", "key_b", "pos").distinct()
    return lead


def _judged(docs: DataFrame, items: DataFrame, size: int, share: int) -> DataFrame:
    """(row, found): the documents, and the struct that annotated() describes."""
    steady(docs.sparkSession)
    found = stored(windows(items, size), "windows")
    chosen = stored(anchors(docs, found), "anchors")
    postings = index(docs, stored(chosen.select("term").distinct(), "anchor-terms"))
    keys = ["key_a", "key_b"]
    places = phrase_places(postings, chosen).join(small(found), "window").groupBy(*keys).agg(F.collect_set(F.struct("start", "words", "items")).alias("places"))
    joined = packed(docs).select("row", *row_keys("row.doc_id", "row.text")).join(places, keys, "left")
    text = F.col("row.text")
    real = F.when(
        F.col("places").isNotNull(),
        let(words(changed_ascii_case(text)), lambda w: F.filter("places", lambda p: F.slice(w, p.start + 1, F.size(p.words)) == p.words)),
    )
    n_words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    no_items = F.array().cast("array<string>")

    def verdict(hits: Column) -> Column:
        covered = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(p.start, p.start + F.size(p.words) - 1)))))
        n_hit = F.when(hits.isNull(), 0).otherwise(covered).cast("long")
        ids = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda p: p["items"]))))
        return let(F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce(ids, no_items).alias("items")), lambda x: x.withField("contaminated", (x.n_hit > 0) & (x.n_hit * share >= x.n_words)))

    return joined.select("row", let(real, verdict).alias("found"))


def annotated(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20, out: str = "contamination") -> DataFrame:
    """docs with a struct `out` of n_words, n_hit, items (sorted) and contaminated.

    A word is hit if it lies in an occurrence of a window; a document is
    contaminated if `share` times its hit words reach its words.
    """
    return _judged(docs, items, size, share).select(*others(docs.columns, out), F.col("found").alias(out))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    return _judged(docs, items, WINDOW, 20).where("not found.contaminated").select("row.*")
