"""Line dedup: a segment-partition edit join of lines.

A line is removed if an earlier line, in this or another document, has a text
within `edits` edits of it (equal texts included). Lines come in order of
doc_id, then row key, then place; blank lines stay.

1. Equal lines are settled by their hashes: of each distinct text the first line
   is left, and the others go. The same pass gives a line's keys.
2. Each line is split into edits + 1 segments of even length. Two lines within
   `edits` edits of each other share a segment, and where it may stand in the
   longer line follows from the two lengths. So a line is indexed under (length,
   number, segment) and looked up under the few substrings that lengths of 0 to
   `edits` less allow.
3. Lines meet where an index entry and a substring do. Under a key of more than
   WARM lines, as near copies have it, each is first compared with the earliest
   line only, which settles groups of lines that are all alike. The others must
   be alike by step 4's parities, and under a key of more than HOT lines share one
   of the grams that are rarest in each as well. Both are true of all lines within
   `edits` edits, so that such a group isn't paired in full and none is missed.
4. The lines that meet are read again and verified, if the parities of how often
   they have each class of characters, pairs and triples allow it. The band of the edit distance matrix that counts, 2 * edits + 1
   diagonals, is kept in the bits of one long and moved a character at a time.

Only DataFrame functions are used. Hashes of lines are moved, texts once, at the
end; first lines, pairs and the pairs' texts are stored, as several steps read them.

Defined cases: null and empty texts have no lines and stay as they are; lines of
up to `edits` characters are all within `edits` edits of each other; rows that
repeat a document in full are one document and lose the same lines; a document
that loses all lines has an empty text. Other columns are kept. Two different
lines within `edits` edits whose 64-bit hashes are equal would not be compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import let
from ..plans.scratch import dropped, small, steady, stored
from .common import packed, quoted, row_keys, sha256_hex, table

EDITS = 2
#: Lines under one key from which on they must share a rare gram as well.
HOT = 32
#: Lines under one key from which on they are paired by their parities.
WARM = 8
#: Characters of a gram.
GRAM = 3
#: Words of 64 classes of runs by their characters, of which the parity is kept.
PARITY = {1: 1, 2: 4, 3: 4}


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have none."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def segment(length: Column, number: int, edits: int) -> tuple[Column, Column]:
    """(begin from 1, length) of a line's segment: the last ones are a character longer if need be."""
    n = edits + 1
    base = F.floor(length / n).cast("int")
    longer = (length % n).cast("int")
    before = F.greatest(F.lit(0), F.lit(number - n) + longer)
    return base * number + before + 1, base + F.when(F.lit(number) >= F.lit(n) - longer, 1).otherwise(0)


def _key(length: Column, number: int, part: Column) -> Column:
    return F.xxhash64(length.cast("int"), F.lit(number), part)


def index_keys(line: Column, n: Column, edits: int = EDITS) -> list[Column]:
    """The keys of the segments of a line of n characters."""
    return [_key(n, i, F.substring(line, *segment(n, i, edits))) for i in range(edits + 1)]


def probe_keys(line: Column, n: Column, edits: int = EDITS) -> list[Column]:
    """The keys under which a line of the same length, or up to `edits` less, can have indexed a common segment.

    Of a shorter line's segment i only those places count that leave room for at
    most i edits before it and edits - i behind it, seen from both ends.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            begin, size = segment(n - less, i, edits)
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [_key(n - less, i, F.substring(line, begin + move, size)) for move in range(low, high + 1)]
    return out


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two texts are at most `edits` edits apart (banded, bit-parallel).

    The distance matrix has a row for each character of the longer text and a
    column for each of the shorter one's. Of column j only the rows j - edits to
    j + edits are kept, as 2 * edits + 1 bits: `up` and `down` say from which row
    to the next the value rises or falls. The next column follows by a handful of
    word operations from these and from the bits of the rows whose character is
    the column's. The score is followed down the diagonal that ends in the
    matrix's corner: it stays where the diagonal's bit is set, else it rises.
    """
    width = 2 * edits + 1
    mask = F.lit((1 << width) - 1).cast("bigint")
    word = lambda n: F.lit(n).cast("bigint")

    def walk(x: Column, y: Column) -> Column:
        more = F.size(x) - F.size(y)

        def step(state: Column, j: Column) -> Column:
            def next_column(s: Column) -> Column:
                d = s.eq.bitwiseAND(state.up) + state.up
                d = d.bitwiseXOR(state.up).bitwiseOR(s.eq).bitwiseOR(state.down).bitwiseAND(mask)
                return let(d, moved)

            def moved(d: Column) -> Column:
                rises = state.down.bitwiseOR(F.bitwise_not(d.bitwiseOR(state.up))).bitwiseAND(mask)
                falls = d.bitwiseAND(state.up)
                lower = F.shiftrightunsigned(d, 1)
                stays = F.call_function("shiftright", d, more + edits).bitwiseAND(word(1)) == 1
                return F.struct(
                    falls.bitwiseOR(F.bitwise_not(lower.bitwiseOR(rises))).bitwiseAND(mask).alias("up"), lower.bitwiseAND(rises).alias("down"),
                    (state.score + F.when(stays, 0).otherwise(1)).alias("score"),
                )

            def equal(c: Column) -> Column:
                bits = [F.when(F.get(x, j + (k - edits)) == c, word(1 << k)).otherwise(word(0)) for k in range(width)]
                return F.struct(reduce(lambda p, q: p.bitwiseOR(q), bits).alias("eq"))

            return F.when(state.score > edits, state).otherwise(let(let(F.element_at(y, j + 1), equal), next_column))

        begin = F.struct(word((1 << width) - (1 << edits)).alias("up"), word(0).alias("down"), more.alias("score"))
        last = F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), begin, step)
        return F.when(F.size(y) == 0, more).otherwise(last.score) <= edits

    longer = F.char_length(a) >= F.char_length(b)
    both = F.struct(F.split(F.when(longer, a).otherwise(b), "").alias("x"), F.split(F.when(longer, b).otherwise(a), "").alias("y"))
    far = F.abs(F.char_length(a) - F.char_length(b)) > edits
    return F.when(far, False).when(F.char_length(a) * F.char_length(b) == 0, True).otherwise(let(both, lambda t: walk(t.x, t.y)))


def odd_counts(line: Column) -> Column:
    """struct(q1_0, q2_0, q2_1, ...): for each q of PARITY a bit for each class of runs of q characters, set if the line has an odd number of them.

    Runs that begin near the line's end are shorter.
    """
    nought = F.lit(0).cast("bigint")
    toggled = lambda acc, n: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), n % 64))

    def counted(x: Column) -> Column:
        def words(q: int, many: int) -> Column:
            classes = F.transform(x, lambda c, i: F.pmod(F.xxhash64(c, *[F.get(x, i + j) for j in range(1, q)]), F.lit(64 * many)).cast("int"))
            of = lambda n, k: F.aggregate(F.filter(n, lambda m: F.floor(m / 64) == k), nought, toggled)
            return let(classes, lambda n: F.array(*[of(n, k) for k in range(many)]))

        return let(F.struct(*[words(q, many).alias(f"q{q}") for q, many in PARITY.items()]), lambda w: F.struct(*[w[f"q{q}"][k].alias(f"q{q}_{k}") for q, many in PARITY.items() for k in range(many)]))

    return let(F.split(line, ""), counted)


def _close(a: str, b: str, edits: int) -> Column:
    """Whether two lines' odd counts allow so few edits: one takes q runs of q characters away and puts as many in, at most."""
    flips = lambda q, k: F.bit_count(F.col(f"{a}.q{q}_{k}").bitwiseXOR(F.col(f"{b}.q{q}_{k}")))
    return reduce(lambda x, y: x & y, [sum((flips(q, k) for k in range(1, many)), flips(q, 0)) <= 2 * q * edits for q, many in PARITY.items()])


def gram_hashes(line: Column, q: int = GRAM) -> Column:
    """Hashes of a line's runs of q characters, each with how often it has occurred before."""

    def numbered(grams: Column) -> Column:
        def runs(s: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j) != F.get(s, j - 1)))
            one = lambda b: lambda begin, r: F.transform(F.sequence(begin, F.coalesce(F.get(b, r + 1), F.size(s)) - 1), lambda j: F.xxhash64(F.get(s, j), j - begin))
            return let(begins, lambda b: F.flatten(F.transform(b, one(b))))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.transform(grams, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(let(F.array_sort(grams), runs))

    places = F.sequence(F.lit(1), F.greatest(F.char_length(line) - (q - 1), F.lit(1)))
    return let(F.transform(places, lambda i: F.xxhash64(F.substring(line, i, q))), numbered)


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, key_a, key_b, at, line) of all lines that aren't blank."""
    each = docs.select("doc_id", *row_keys("doc_id", "text"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    return each.where(~_blank(F.col("line")))


def first_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(ref, doc_id, key_a, key_b, at, keys): each distinct line's first place and its keys, those of its own segments first.

    ref is a 64-bit hash of the line. Lines are told apart by 128 bits. A text
    is not moved: its lines' hashes are.
    """
    each = _scanned(docs).select(
        F.xxhash64("line").alias("ref"), F.xxhash64(F.lit(1), "line").alias("other"), "doc_id", "key_a", "key_b", "at", F.char_length("line").alias("n"), "line"
    )
    keyed = each.select("ref", "other", F.struct("doc_id", "key_a", "key_b", "at", F.array(*index_keys(F.col("line"), F.col("n"), edits), *probe_keys(F.col("line"), F.col("n"), edits)).alias("keys")).alias("place"))
    return keyed.groupBy("ref", "other").agg(F.min("place").alias("place")).select("ref", "place.*")


def _wanted(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(ref, place, line, odd) of some first lines (key_a, key_b, at, ref), read from their documents again."""
    of = places.groupBy("key_a", "key_b").agg(F.collect_set(F.struct("at", "ref")).alias("wanted"))
    texts = docs.select("text", *row_keys("doc_id", "text"), "doc_id").join(small(stored(of, "wanted-lines")), ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"])
    cut = let(lines_of(F.col("text")), lambda w: F.transform("wanted", lambda x: F.struct(x.ref.alias("ref"), x.at.alias("at"), F.element_at(w, x.at + 1).alias("line"))))
    each = texts.select("doc_id", "key_a", "key_b", F.explode(cut).alias("x"))
    return each.select("x.ref", F.struct("doc_id", "key_a", "key_b", "x.at").alias("place"), "x.line", odd_counts(F.col("x.line")).alias("odd"))


def _hot_tokens(lines: DataFrame, edits: int) -> DataFrame:
    """(ref, token): the rarest grams of lines (ref, line), of which lines within `edits` edits share one.

    An edit changes GRAM grams at most, so that of the GRAM * edits + 1 first
    ones in any order one is left. Lines that may have no more grams than that
    meet under a token of their own.
    """
    most = GRAM * edits
    grams = stored(lines.select("ref", F.char_length("line").alias("n"), F.explode(gram_hashes(F.col("line"))).alias("gram")), "grams")
    counts = grams.groupBy("gram").agg(F.count("*").alias("often"))
    best = grams.join(counts, "gram").groupBy("ref").agg(F.slice(F.array_sort(F.collect_set(F.struct("often", "gram"))), 1, most + 1).alias("best"))
    rare = best.select("ref", F.explode("best.gram").alias("token"))
    few = lines.where(F.char_length("line") <= most + GRAM - 1 + edits).select("ref", F.lit(0).cast("bigint").alias("token"))
    return rare.unionByName(few).distinct()


def _compared(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """(ref): of pairs (ref_a, ref_b) of lines (ref, place, line, odd) within `edits` edits the later lines."""
    own = lambda s: lines.select(*[F.col(c).alias(f"{c}_{s}") for c in ("ref", "place", "line", "odd")])
    near = pairs.join(own("a"), "ref_a").join(own("b"), "ref_b").where(_close("odd_a", "odd_b", edits) & within(F.col("line_a"), F.col("line_b"), edits))
    return near.select(F.when(F.col("place_a") < F.col("place_b"), F.col("ref_b")).otherwise(F.col("ref_a")).alias("ref")).distinct()


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("ref_a != ref_b").select(F.least("ref_a", "ref_b").alias("ref_a"), F.greatest("ref_a", "ref_b").alias("ref_b")).distinct()


def crowded_lines(docs: DataFrame, firsts: DataFrame, own: DataFrame, probes: DataFrame, edits: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Of lines that meet under crowded keys: (ref) of those known to go, (ref_a, ref_b) of pairs to verify yet.

    own, probes: (k, ref), the index entries and the substrings of those keys.
    """
    refs = own.select("ref").unionByName(probes.select("ref")).distinct()
    lines = stored(_wanted(docs, firsts.join(refs, "ref", "left_semi").select("key_a", "key_b", "at", "ref")), "crowded-lines")
    places = lines.select("ref", "place")
    # first each line is compared with the earliest line of its keys: that settles groups of lines that are all alike
    leads = own.join(places, "ref").groupBy("k").agg(F.min(F.struct("place", "ref")).alias("lead"))
    led = probes.join(leads, "k").select(F.col("lead.ref").alias("ref_a"), F.col("ref").alias("ref_b"))
    gone = stored(_compared(_unordered(led), lines, edits), "led-lines")
    # then lines of close parities, unless the later one is settled; under the hot keys only those that share a rare gram
    known = stored(lines.join(gone.withColumn("gone", F.lit(True)), "ref", "left").select("ref", "place", "odd", F.coalesce("gone", F.lit(False)).alias("gone")), "known-lines")
    heavy = stored(own.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k"), "hot-keys")

    def met(a: DataFrame, b: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
        side = lambda df, s: df.join(known, "ref").select(*on, *[F.col(c).alias(f"{c}_{s}") for c in ("ref", "place", "odd", "gone")])
        x, y = side(a, "a"), side(b, "b")
        meet = reduce(lambda p, q: p & q, [x[c] == y[c] for c in on]) & _close("odd_a", "odd_b", edits)
        later = ((F.col("place_a") < F.col("place_b")) & ~F.col("gone_b")) | ((F.col("place_b") < F.col("place_a")) & ~F.col("gone_a"))
        return x.join(y, meet & later).select("ref_a", "ref_b")

    keys = small(heavy)
    pairs = met(own.join(keys, "k", "left_anti"), probes.join(keys, "k", "left_anti"), known, ["k"])
    if not heavy.isEmpty():
        own, probes = own.join(keys, "k"), probes.join(keys, "k")
        refs = own.select("ref").unionByName(probes.select("ref")).distinct()
        tokens = stored(_hot_tokens(lines.join(refs, "ref", "left_semi").select("ref", "line"), edits).join(known, "ref"), "rare-grams")
        pairs = pairs.unionByName(met(own, probes, tokens, ["k", "token"]))
    pairs = stored(_unordered(pairs), "crowded-pairs")
    dropped(lines, known, heavy)
    return gone, pairs


def near_lines(docs: DataFrame, firsts: DataFrame, edits: int = EDITS, hot: int = HOT, warm: int = WARM) -> DataFrame:
    """(key_a, key_b, at): places of the first lines that have an earlier line within `edits` edits.

    Lines meet under a key. Under a key of more than `warm` lines they are first
    compared with one line only, and then paired if their parities are close;
    under one of more than `hot` they must share one of their rarest grams as well.
    """
    n = edits + 1
    own = firsts.select(F.explode(F.slice("keys", 1, n)).alias("k"), "ref")
    probes = firsts.select(F.explode(F.array_distinct(F.slice("keys", n + 1, 1_000))).alias("k"), "ref")
    crowded = stored(own.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > min(hot, warm)).select("k"), "crowded-keys")
    paired = lambda a, b: a.withColumnRenamed("ref", "ref_a").join(b.withColumnRenamed("ref", "ref_b"), "k").select("ref_a", "ref_b")
    gone = None
    if crowded.isEmpty():
        pairs = stored(_unordered(paired(own, probes)), "line-pairs")
    else:
        keys = small(crowded)
        own_hot, probes_hot = stored(own.join(keys, "k"), "crowded-own"), stored(probes.join(keys, "k"), "crowded-probes")
        gone, more = crowded_lines(docs, firsts, own_hot, probes_hot, edits, hot)
        pairs = stored(_unordered(paired(own.join(keys, "k", "left_anti"), probes.join(keys, "k", "left_anti")).unionByName(more)), "line-pairs")
        dropped(own_hot, probes_hot, more, crowded)
    refs = pairs.select(F.explode(F.array("ref_a", "ref_b")).alias("ref")).distinct()
    lines = stored(_wanted(docs, firsts.join(refs, "ref", "left_semi").select("key_a", "key_b", "at", "ref")), "line-texts")
    near = _compared(pairs, lines, edits)
    near = stored(near if gone is None else near.unionByName(gone).distinct(), "near-lines")
    dropped(pairs, lines)
    return firsts.join(small(near), "ref", "left_semi").select("key_a", "key_b", "at")


def _deduped(docs: DataFrame, edits: int, hot: int) -> DataFrame:
    """(row, text, lines, kept): documents, their text of the kept lines, and the number of lines before and after."""
    steady(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    firsts = stored(first_lines(rows, edits), "first-lines")
    near = near_lines(rows, firsts, edits, hot)
    keys = ["key_a", "key_b"]
    places = firsts.select(*keys, "at").join(near, [*keys, "at"], "left_anti")
    stay = stored(places.groupBy(*keys).agg(F.collect_set("at").alias("stay")), "kept-lines")
    dropped(firsts)
    joined = packed(docs).select("row", *row_keys("row.doc_id", "row.text")).join(stay, keys, "left")

    def kept(w: Column) -> Column:
        return F.filter(w, lambda line, i: _blank(line) | F.coalesce(F.array_contains("stay", i), F.lit(False)))

    text = F.col("row.text")
    found = joined.select("row", let(lines_of(text), lambda w: F.struct(F.size(w).alias("n"), kept(w).alias("kept"))).alias("found"))
    left = F.when(F.coalesce(text, F.lit("")) != "", F.array_join("found.kept", "\n")).otherwise(text)
    return found.select("row", left.alias("text"), F.col("found.n").alias("lines"), F.size("found.kept").alias("kept"))


def _shortened(columns: list[str]) -> list[Column]:
    return [F.col("text") if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in columns]


def deduped(docs: DataFrame, edits: int = EDITS, hot: int = HOT) -> DataFrame:
    """docs with their text of the kept lines, and __lines and __kept, the number of lines before and after."""
    found = _deduped(docs, edits, hot)
    own = [c for c in docs.columns if c.lower() not in ("__lines", "__kept")]
    return found.select(*_shortened(own), F.col("lines").alias("__lines"), F.col("kept").alias("__kept"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents with their repeated lines taken out; those that have nothing left go."""
    found = _deduped(docs, EDITS, HOT).where("kept > 0 or lines = 0")
    return found.select(*_shortened(docs.columns))


def _digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), (F.col("__lines") - F.col("__kept")).cast("long").alias("n_removed"), sha256_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line nearly equals."""
    return _digests(deduped(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
first AS (SELECT line, min((doc_id, pos)) AS place, length(line) AS n FROM each WHERE trim(line, ' ') <> '' GROUP BY line),
-- levenshtein() counts bytes, of which an edit changes four at most
pairs AS (
  SELECT a.line AS a, b.line AS b, levenshtein(a.line, b.line) AS bytes FROM first a JOIN first b ON b.n BETWEEN a.n - 2 AND a.n + 2
  WHERE a.place < b.place AND abs(strlen(a.line) - strlen(b.line)) <= 8 AND levenshtein(a.line, b.line) <= 8),
wide AS (SELECT a, b, string_split(a, '') AS x, string_split(b, '') AS y FROM pairs WHERE strlen(a) <> length(a) OR strlen(b) <> length(b)),
-- a row of the distance matrix of characters after another; runs of more than two insertions don't count
matrix AS (
  SELECT a, b, x, y, 0 AS j, range(0, len(x) + 1) AS r FROM wide
  UNION ALL
  SELECT a, b, x, y, j, list_transform(range(0, len(t)), lambda i: least(t[i + 1], CASE WHEN i > 0 THEN t[i] + 1 ELSE 99 END, CASE WHEN i > 1 THEN t[i - 1] + 2 ELSE 99 END)) AS r
  FROM (SELECT a, b, x, y, j + 1 AS j, list_transform(range(0, len(r)), lambda i: CASE WHEN i = 0 THEN r[1] + 1 ELSE least(r[i + 1] + 1, r[i] + (x[i] <> y[j + 1])::INT) END) AS t FROM matrix WHERE j < len(y))),
gone AS (
  SELECT b AS line FROM pairs WHERE bytes <= 2 AND strlen(a) = length(a) AND strlen(b) = length(b)
  UNION SELECT b FROM matrix WHERE j = len(y) AND r[-1] <= 2),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.line, chr(10) ORDER BY e.pos) AS text
  FROM each e LEFT JOIN first f ON e.line = f.line
  WHERE trim(e.line, ' ') = '' OR ((e.doc_id, e.pos) = f.place AND e.line NOT IN (SELECT line FROM gone))
  GROUP BY e.doc_id)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
