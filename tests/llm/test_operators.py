"""Each operator on a small table of awkward rows, against brute force."""

import base64
import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat, decontamination, linededup, orderhash, setjoin, substrings, toxicity, urlfilter, warc
from tidemark.llm.common import table

DOCS = "doc_id long, text string, key string, words string, ref string"
WORD = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choices(WORD, k=n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty texts, copies, near copies, repeated rows, a long text, columns that clash."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    shared = sentence(rng, 45)
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "one two"), (None, sentence(rng, 50)), (9, shared + " " + sentence(rng, 30)), (10, sentence(rng, 20) + " " + shared), (10, sentence(rng, 20) + " " + shared)]
    rows += rows[-1:]
    rows += [(11, sentence(rng, 6000)), (12, "é" * 50 + " ñ"), (13, sentence(rng, 40) + "\n\n" + base[:80] + "x\n" + base[:80]), (14, base[:80] + "\nOther line of words\n" + base[:80])]
    return spark.createDataFrame([(i, t, "k", "w", "r") for i, t in rows], DOCS).repartition(3)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_line_distance_is_levenshtein(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choices("abé中", k=rng.randrange(0, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(0, len(b) + 1)
            if rng.random() < 0.5:
                b.insert(at, rng.choice("abx"))
            elif b:
                del b[min(at, len(b) - 1)]
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        bad = df.where(linededup.within(F.col("a"), F.col("b"), edits) != (F.levenshtein("a", "b") <= edits)).collect()
        assert not bad, (edits, bad[:3])


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    kinds = ["".join(rng.choices("abcdefgh ", k=rng.randrange(10, 60))) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(kinds))
            for _ in range(rng.randrange(0, 4)):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("".join(line))
        rows.append((i, "\n".join(lines), "k"))
    rows += [(100, None, "k"), (101, "", "k"), (102, "\n\n", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __of_key string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    seen, want = [], {}
    for i, text, _ in rows:
        kept = []
        for line in (text or "").split("\n") if text else []:
            blank = line.strip(" ") == ""
            near = any(line == s or (abs(len(line) - len(s)) <= 2 and lev(line, s) <= 2) for s in seen)
            if blank or not near:
                kept.append(line)
            if not blank:
                seen.append(line)
        want[i] = "\n".join(kept) if text else text
    got = {r.doc_id: r.text for r in linededup.deduped(df).collect()}
    assert got == want
    # keys of more than one line count as crowded, so that rare grams decide
    assert {r.doc_id: r.text for r in linededup.deduped(df, hot=1).collect()} == want
    assert linededup.deduped(df.limit(0)).count() == 0


def test_crowded_keys(spark):
    """Near copies share most segments; few of their pairs are met, and none is missed."""
    rng = random.Random(6)
    base = sentence(rng, 60).split()
    lines = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(60)] = "".join(rng.choices("abcdefghijklmnop", k=9))
        lines.append(" ".join(w))
    lines += [x[:40] + "#" + x[41:] for x in lines[:5]] + ["ab", "c", "dé", "xyz", "wxyz", "1234567", "1294567", "abababab", "babababa"]
    rows = [(i, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in linededup.deduped(df).where("__kept = 0").collect()}
    near = df.alias("a").crossJoin(df.alias("b")).where((F.col("a.doc_id") < F.col("b.doc_id")) & (F.levenshtein("a.text", "b.text") <= 2)).select("b.doc_id").distinct().collect()
    assert gone == {r.doc_id for r in near} and {300, 304, 306, 307} <= gone
    # all alike: compared with the earliest line, and not with each other
    alike = spark.createDataFrame([(i, base_line[:i] + "#" + base_line[i + 1 :]) for i, base_line in ((i, " ".join(base)) for i in range(300))], "doc_id long, text string")
    firsts = linededup.first_lines(alike)
    own, probes = (firsts.select(F.explode(F.slice("keys", *x)).alias("k"), "ref") for x in ((1, 3), (4, 100)))
    gone, pairs = linededup.crowded_lines(alike, firsts, own, probes, 2)
    assert gone.count() == firsts.count() - 1 > 200 and pairs.count() < 3_000 and linededup.deduped(alike).where("__kept = 1").count() == 1
    # segments in common, but far from each other
    firsts = linededup.first_lines(df)
    own, probes = (firsts.select(F.explode(F.slice("keys", *x)).alias("k"), "ref") for x in ((1, 3), (4, 100)))
    assert linededup.crowded_lines(df, firsts, own, probes, 2)[1].count() < 3_000 < own.withColumnRenamed("ref", "a").join(probes, "k").where("a != ref").count()


def test_parities(spark):
    """No pair within two edits is told apart by its odd counts; four letters put in at two places are."""
    rng = random.Random(8)

    def edited(x, n):
        for _ in range(n):
            at, c = rng.randrange(len(x) + 1), rng.choice("abé ")
            x = rng.choice([x[:at] + c + x[at:], x[:at] + x[at + 1 :], x[:at] + c + x[at + 1 :]])
        return x

    bases = ["".join(rng.choices("abcdé ", k=rng.randrange(0, 40))) for _ in range(600)]
    df = spark.createDataFrame([(x, edited(x, 2)) for x in bases], "a string, b string")
    odd = df.select("*", linededup.odd_counts(F.col("a")).alias("x"), linededup.odd_counts(F.col("b")).alias("y"))
    assert odd.count() == 600 and odd.where(~linededup._close("x", "y", 2)).count() == 0
    far = spark.createDataFrame([("the quickmpoc brown fox jumps over the dog", "the quick brown fox jumpsbalf over the dog")], "a string, b string")
    assert far.select(linededup.odd_counts(F.col("a")).alias("x"), linededup.odd_counts(F.col("b")).alias("y")).where(linededup._close("x", "y", 2)).count() == 0


def test_near_copies_by_template(spark, monkeypatch):
    """Lines of one template with four letters put in at one place: nearly all of their pairs are told apart before verification."""
    rng = random.Random(9)
    base = sentence(rng, 60)
    verified = []
    compared = linededup._compared
    monkeypatch.setattr(linededup, "_compared", lambda pairs, lines, edits: verified.append(pairs.count()) or compared(pairs, lines, edits))

    def lines(n):
        for _ in range(n):
            at = rng.choice([i for i, c in enumerate(base) if c == " "])
            yield base[:at] + "".join(rng.choices("abcdefghijklmn", k=4)) + base[at:]

    df = spark.createDataFrame(list(enumerate(lines(600))), "doc_id long, text string")
    gone = {r.doc_id for r in linededup.deduped(df).where("__kept = 0").collect()}
    near = df.alias("a").crossJoin(df.alias("b")).where((F.col("a.doc_id") < F.col("b.doc_id")) & (F.levenshtein("a.text", "b.text") <= 2)).select("b.doc_id").distinct().collect()
    assert gone == {r.doc_id for r in near} and 0 < len(gone) < 600
    assert sum(verified) < 15_000, verified


def test_lines_awkward(awkward):
    got = linededup.deduped(awkward)
    assert got.count() == awkward.count() and got.columns[:5] == awkward.columns
    kept = {r.doc_id: r for r in got.where("doc_id in (1, 2, 4, 5)").collect()}
    assert kept[2].text == "" and kept[1]["__kept"] == 1 and kept[4].text is None and kept[5].text == ""
    assert linededup.clean(awkward).where("doc_id = 2").count() == 0


def windows_removed(docs, size=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in docs]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(docs, split):
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_substrings_against_brute_force(spark, awkward):
    assert rows_of(substrings.dedup(awkward), "doc_id", "n_words", "n_removed", "kept") == windows_removed(texts(awkward))
    rng = random.Random(9)
    parts = [sentence(rng, 20) for _ in range(12)]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randrange(1, 7)))) for i in range(80)] + [(900, "a " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substrings.dedup(df, 2), "doc_id", "n_words", "n_removed", "kept") == windows_removed(rows)
    assert substrings.dedup(df.limit(0)).count() == 0


def test_substrings_by_batches(spark):
    rng = random.Random(10)
    parts = [sentence(rng, 20) for _ in range(12)]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randrange(1, 7)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, new, late = df.where("doc_id < 20"), df.where("doc_id between 20 and 39"), df.where("doc_id >= 40")
    index = substrings.FingerprintIndex(spark, "kept_fingerprints", most_runs=1)
    found = substrings.add_batch(index, old)
    alone = substrings.without(substrings._keyed(old), found)
    assert rows_of(alone, "doc_id", "n_words", "n_removed", "kept") == windows_removed(rows[:20])
    found = found.unionByName(substrings.add_batch(index, new, old))
    again = substrings.FingerprintIndex.open(spark, "kept_fingerprints", most_runs=1)
    assert again.runs == index.runs and len(again.runs) == 1 and again.buckets == index.buckets
    found = found.unionByName(substrings.add_batch(again, late, df.where("doc_id < 40")))
    assert rows_of(substrings.without(substrings._keyed(df), found), "doc_id", "n_words", "n_removed", "kept") == windows_removed(rows)
    again.drop()
    with pytest.raises(ValueError):
        substrings.FingerprintIndex.open(spark, "kept_fingerprints")


def shingle_set(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def linked(docs, least=0.8):
    sets = [(d, shingle_set(t)) for d, t in docs]
    near = lambda a, b: a and b and len(a & b) >= least * len(a | b)
    links = {i: [j for j in range(len(sets)) if j != i and near(sets[i][1], sets[j][1])] for i in range(len(sets))}
    label = list(range(len(sets)))
    while True:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in label and range(len(sets))]
        if new == label:
            break
        label = new
    part = {i: [j for j in range(len(sets)) if label[j] == label[i]] for i in range(len(sets))}
    low = lambda x: (-1 << 63) if x is None else x
    return sorted(((sets[i][0], min((sets[j][0] for j in part[i]), key=low) if sets[i][1] else sets[i][0], len(links[i])) for i in range(len(sets))), key=repr)


def test_jaccard_join_against_brute_force(spark, awkward):
    assert rows_of(setjoin.joined(awkward), "doc_id", "class_id", "n_links") == linked(texts(awkward))
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = sentence(rng, rng.randrange(30, 200)).split()
        for _ in range(rng.randrange(1, 30)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORD)
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # small leaves, so that nodes are split and large ones are cut into blocks
    assert rows_of(setjoin.joined(df, leaf=4), "doc_id", "class_id", "n_links") == linked(rows)
    kept = setjoin.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id in (2, 3, 8)").count() == 0 and kept.where("doc_id = 10").count() == 2
    assert setjoin.joined(df.limit(0)).count() == 0


def test_jaccard_join_recall(spark):
    """Pairs barely similar enough, among texts that share a passage, through small leaves."""
    rng = random.Random(14)
    passage, rows = sentence(rng, 45), []
    for _ in range(120):
        w = [f"{rng.choice(WORD)}{rng.randrange(9)}" for _ in range(100)]
        other = list(w)
        other[20], other[70] = "changed", "words"
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(other))]
    rows += [(len(rows) + i, " ".join(f"{rng.choice(WORD)}{rng.randrange(9)}" for _ in range(40)) + " " + passage) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sum(x[2] for x in linked(rows))
    got = setjoin.joined(df, leaf=8).agg(F.sum("n_links")).first()[0]
    assert want >= 240 and 0.995 * want <= got <= want


def test_decontamination_against_brute_force(spark, awkward):
    docs = texts(awkward)
    long = next(t for d, t in docs if d == 11).split()
    items = [("5", " ".join(long[100:125]).upper()), ("07", "One, TWO"), (None, " ".join(long[300:320])), ("9", ""), ("10", None), ("11", "never seen here")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, t in items:
        w = cut(t)
        for i in range(max(len(w) - 12, 1) if w else 0):
            wins.setdefault(tuple(w[i : i + 13]), set()).add(item or "")
    want = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for k, ids in wins.items():
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit |= set(range(i, i + len(k)))
                    found |= ids
        want.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontamination.annotated(awkward, bench).select("doc_id", "contamination.*")
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == sorted(want, key=repr)
    assert decontamination.clean(awkward, bench).where("doc_id in (7, 8)").count() == 0
    assert decontamination.annotated(awkward, bench.limit(0)).where("contamination.n_hit > 0").count() == 0
    assert decontamination.annotated(awkward.limit(0), bench).count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha x x beta x x x x x x alpha"), (2, "alpha x x x x x x beta")], "doc_id long, text string")
    terms = spark.createDataFrame([("alpha",), ("beta",)], "term string")
    got = decontamination.proximity_matches(decontamination.index(df, terms), ["alpha", "beta"], 3)
    assert [r.pos for r in got.collect()] == [0]


def order_minhash(text, k=5, orders=64):
    w = re.findall(r"[^ \t-\r]+", text)
    if not w:
        return ""
    seen, points = Counter(), []
    mask = (1 << 64) - 1

    def long_hash(x, seed):
        return xxhash.xxh64_intdigest((x & mask).to_bytes(8, "little"), seed)

    for i in range(max(len(w) - k + 1, 1)):
        h = 42
        for x in w[i : i + k]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        h >>= 26
        o = seen[h]
        seen[h] += 1
        if o:
            h = long_hash_pair(h, o) >> 26
        points.append((h, i))
    points.sort()
    out = []
    for b in range(orders):
        start = next((j for j, p in enumerate(points) if p[0] >> 32 >= b), 0)
        two = sorted((points[start], points[(start + 1) % len(points)]), key=lambda p: p[1])
        out.append(f"{long_hash(two[1][0], long_hash(two[0][0], 42)) & 0xFFFF:04X}")
    return "".join(out)


def long_hash_pair(h, o):
    first = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
    return int_hash(o, first)


def int_hash(o, seed):
    """Spark's 64-bit hash of an int."""
    m = (1 << 64) - 1
    p1, p2, p3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    h = (seed + 0x27D4EB2F165667C5 + 4) & m
    h ^= (o & 0xFFFFFFFF) * p1 & m
    h = ((h << 23 | h >> 41) & m) * p2 + p3 & m
    h ^= h >> 33
    h = h * p2 & m
    h ^= h >> 29
    h = h * p3 & m
    return h ^ h >> 32


def test_fingerprints_against_brute_force(awkward):
    rng = random.Random(4)
    got = awkward.withColumn("text", F.coalesce("text", F.lit(""))).select("text", orderhash.digits(orderhash.fingerprint(F.col("text"))).alias("f")).collect()
    for r in got:
        assert r.f == order_minhash(r.text), r.text[:40]
    loop = " ".join(["a b c"] * 40 + [sentence(rng, 9)])
    one = awkward.limit(1).select(orderhash.digits(orderhash.fingerprint(F.lit(loop))).alias("f")).first()
    assert one.f == order_minhash(loop)


def agreement(a, b):
    """The share of four-digit values that two fingerprints have in common."""
    if not a or not b:
        return float(a == b)
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / 64


def test_likeness_follows_edits_and_order(spark):
    rng = random.Random(12)
    rows = []
    for g in range(24):
        base = [f"v{rng.randrange(5000)}" for _ in range(400)]
        rows.append((g, -1, " ".join(base), " ".join(base)))
        for changes in (2, 8, 24, 60):
            w = list(base)
            for at in rng.sample(range(400), changes):
                w[at] = f"x{rng.randrange(5000)}"
            rows.append((g, changes, " ".join(base), " ".join(w)))
        blocks = [base[i : i + 20] for i in range(0, 400, 20)]
        rng.shuffle(blocks)
        rows.append((g, 1000, " ".join(base), " ".join(x for b in blocks for x in b)))
    df = spark.createDataFrame(rows, "g int, changes int, a string, b string").repartition(8)
    near = {r.changes: r.n for r in df.groupBy("changes").agg(F.avg(orderhash.likeness(orderhash.fingerprint(F.col("a")), orderhash.fingerprint(F.col("b")))).alias("n")).collect()}
    assert near[-1] == 1.0 > near[2] > near[8] > near[24] > near[60]
    # swapped blocks keep four of five k-mers, as 17 changed words do, but not their order
    kept = 4 / 5
    assert near[1000] < 0.8 * kept / (2 - kept) and near[1000] < near[8]


def test_texts_are_exchanged_once(spark, awkward):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = orderhash.compared(awkward)
        got.collect()
        final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert final.count("ReusedExchange") == 2 and final.count("REPARTITION_BY_COL") == 3


def test_edited_texts(spark, awkward):
    df = awkward.where("doc_id is not null and doc_id != 10")
    docs = sorted(texts(df), key=lambda x: -x[0])
    want = {}
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        want[d] = hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()
    got = orderhash.compared(df).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[2].near_next == 1.0 and 0 <= by[11].near_edited < 1
    assert by[5].fingerprint == "" and by[5].near_next == 1.0 and by[7].near_next == 0.0
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        near = [agreement(order_minhash(t), order_minhash(x)) for x in (t[: len(t) - len(t) // 3] + after[: len(t) // 3], after)]
        assert [by[d].near_edited, by[d].near_next] == pytest.approx(near), d
    assert orderhash.compared(awkward).count() == awkward.count()
    assert orderhash.compared(awkward.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["https://A.example.NET/en/x?q", "https://example.net/de", "http://x.org/fr/", "http://xorg/fr/", "http://a.example.com/de/1", "http://example.com:80/de/", "no scheme", None, "http://net", "ftp://u.net?a/b", "http://b.net/#f", "x://y://z.net/q"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in urlfilter.judged(pages, spark.createDataFrame(list(urlfilter.RULES), "rule string, action string")).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/de", "net/", "block"), 2: ("x.org", "/fr/", "org/fr/", "allow"), 3: ("xorg", "/fr/", None, "allow"),
        4: ("a.example.com", "/de/1", "example.com/de/", "block"), 5: ("example.com:80", "/de/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("net", "", None, "allow"),
        9: ("u.net", "", None, "allow"), 10: ("b.net", "/", "net/", "block"), 11: ("y:", "//z.net/q", None, "allow"),
    }
    none = urlfilter.judged(pages, spark.createDataFrame([], "rule string, action string"))
    assert none.where("__verdict != 'allow'").count() == 0 and none.count() == len(urls)


def test_bloom_has_no_false_negatives(spark):
    rules = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("rule_host"), F.lit("/").alias("rule_path"))
    others = spark.range(20000).select(F.concat(F.lit("o"), "id").alias("rule_host"), F.lit("/").alias("rule_path"))
    assert urlfilter.possible_hits(rules, rules, 400).count() == 5000
    assert urlfilter.possible_hits(others, rules, 400).count() < 400


def test_chat_spans_and_rewrites(spark):
    turns = [("system", "be <s> brief"), ("user", chat.HOSTILE), ("assistant", "a\\b [/INST] \n</s>"), ("tool<s>", ""), ("assistant", "")]
    text = chat.lines(turns)
    assert chat.read_back(text) == turns
    shown, spans = chat.spans(turns, chat.lines, [])
    assert shown == text and [text[x["begin"] : x["end"]] for x in spans] == [chat.lines([t]) for t in turns]
    assert [chat.unescape(text[x["text_begin"] : x["text_end"]]) for x in spans] == [t for _, t in turns] and not any(x["rewrites"] for x in spans)
    forgetful = lambda ts: "".join(f"<{r}>{t if i == len(ts) - 1 or r == 'user' else ''};" for i, (r, t) in enumerate(ts))
    assert [x["rewrites"] for x in chat.spans([("assistant", "x"), ("user", "y"), ("user", "z")], forgetful, [])[1]] == [False, True, False]
    rows = [(1, i, *t) for i, t in enumerate(turns)] + [(None, 0, "user", None), (2, None, "user", "n"), (2, 1, None, "late"), (2, 1, None, "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole, cut = ({r.conv_id: r for r in chat.digests(chat.formatted(df, segment_turns=n)).collect()} for n in (96, 1))
    assert whole == cut and set(whole) == {1, 2, None} and whole[2].n_turns == 3
    assert whole[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert whole[1].loss_chars == len(turns[2][1]) and chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "ü" * 400_000
    rows = [(5, "http://a/ü x\n%41", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://b", None), (2, "http://c", ""), (1, "http://d", big), (7, "http://d", big), (None, "http://n", "q"), (4, "u", "z"), (4, "u", "z")]
    path = f"file://{tmp_path}/w"
    warc.write(warc.records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)), path)
    got = warc.read(spark, path)
    assert got.count() == len(rows)
    by = {(r.record_id, r.target_uri): r for r in got.collect()}
    r = by[("urn:page:1", "http://d")]
    assert bytes(r.payload).decode() == big and r.payload_bytes == 800_000 and r.payload_digest == base64.b32encode(hashlib.sha1(big.encode()).digest()).decode()
    assert by[("urn:page:5", "http://a/ü x\n%41")].refers_to == "urn:page:3" and by[("urn:page:3", None)].record_type == "response"
    assert by[("urn:page:9", "http://b")].refers_to == "urn:page:2" and by[("urn:page:7", "http://d")].payload is None
    light = warc.read(spark, path, payload=False)
    assert light.where("record_type = 'revisit'").count() == 3 and light.where("payload is not null").count() == 0
    assert light.where("record_id = 'urn:page:1'").first().payload_digest == r.payload_digest
    assert got.where("payload_bytes = 1").count() == 3
    warc.write(warc.records(spark.createDataFrame([], "page_id long, url string, html string")), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_of_other_writers(tmp_path):
    import gzip
    import io

    one = warc.record("urn:x", "response", "u", warc.base32_sha1(b"hello"), 5, None, b"hello")
    two = warc.record("urn:y", "revisit", "u", warc.base32_sha1(b"hello"), 5, "urn:x", b"")
    data = io.BytesIO(gzip.compress(one) + gzip.compress(two) + warc.member(one))
    got = list(warc._records(data, [], True))
    assert [r[0] for r in got] == ["urn:x", "urn:y", "urn:x"] and got[0][-1] == b"hello" == got[2][-1]
    data.seek(0)
    assert [r[0] for r in warc._records(data, [("record_type", ["revisit"])], True)] == ["urn:y"]


def test_toxicity_learns_pairs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1200):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        w = rng.choices(WORD, k=30) + ["scoundrel"] * a + ["islanders"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], x) for x in w), int(a and b)))
    docs = spark.createDataFrame(rows + [(9000, None, None), (9001, "", None)], "doc_id long, text string, toxic int")
    machine = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic").where("doc_id % 4 != 0"))
    found = toxicity.score(docs, machine).where("doc_id % 4 = 0 and toxic is not null").select("toxic", (F.col("score") >= 0.3).cast("int").alias("p")).collect()
    assert np.mean([r.toxic == r.p for r in found]) > 0.97
    assert toxicity.score(docs.where("doc_id >= 9000"), machine).where("score < 0.3").count() == 2
    empty = toxicity.judged(docs.drop("toxic"), docs.select("doc_id", "toxic").limit(0))
    assert empty.where("score = 0 and predicted = 0").count() == docs.count()


def test_toxicity_of_pairs_that_say_nothing_alone(spark):
    """Toxic are texts with exactly one of two words, each of which is as common among the others."""
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(rng.choices(["oak", "elm", "ash", "fir"], k=3) + ["kip"] * a + ["vos"] * b), int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic").where("doc_id % 4 != 0"))
    found = toxicity.score(docs, machine).where("doc_id % 4 = 0").select("toxic", (F.col("score") >= 0.5).cast("int").alias("p")).collect()
    assert np.mean([r.toxic == r.p for r in found]) > 0.97


def test_machine_against_brute_force():
    rng = np.random.default_rng(3)
    own = toxicity.Machine(np.arange(9), -0.4, rng.normal(size=9), rng.normal(size=(9, 4)))
    rows = [sorted(rng.choice(9, n, replace=False)) for n in (0, 1, 2, 5, 9)]
    want = []
    for r in rows:
        z = own.bias + sum(own.linear[i] for i in r) + sum(own.factors[i] @ own.factors[j] for k, i in enumerate(r) for j in r[k + 1 :])
        want.append(1 / (1 + np.exp(-z)))
    at = np.array([i for r in rows for i in r], int)
    assert own.scores(np.repeat(np.arange(5), [len(r) for r in rows]), at, 5) == pytest.approx(want)


def test_toxicity_takes_bounded_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_trained", lambda toxic, sizes, buckets, *_: seen.append((list(sizes), len(buckets))) or toxicity.Machine())
    docs = spark.createDataFrame([(1, f"word{chr(97 + i)} other") for i in range(20)] * 3 + [(i, "a b c") for i in range(2, 30)] + [(40, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    toxicity.train(docs, labels, max_labelled=7)
    toxicity.train(docs, labels, max_terms=10)
    assert len(seen[0][0]) == 30 and len(seen[1][0]) <= 7 and seen[2][1] <= 10


@pytest.mark.parametrize("size, least", [("sf0.01", 0.6), ("sf0.1", 0.85)])
def test_toxicity_held_out(spark, size, least):
    d = f"/root/testdata/{size}"
    got = toxicity.judged(table(spark, d, "documents"), table(spark, d, "labels")).join(table(spark, d, "labels"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n.get((1, 1), 0) >= least * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[(0, 0)]


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries()) and json.dumps(sorted(entry.oracle_sql()))


def test_a_level_misses_no_more_than_it_states(spark):
    rng = np.random.default_rng(21)
    n, rows = 60_000, []
    one = rng.integers(0, 256, (n, setjoin.SKETCH), dtype=np.uint8)
    two = np.where(rng.random(one.shape) < setjoin.LEAST, one, rng.integers(0, 256, one.shape, dtype=np.uint8))
    for k, sketches in enumerate((one, two)):
        rows += [(i, 2 * i + k, bytearray(s.tobytes())) for i, s in enumerate(sketches)]
    df = spark.createDataFrame(rows, "node long, set long, sketch binary").repartition(8)
    down = setjoin.children(df, setjoin.paths_for(setjoin.RECALL, setjoin.LEAST)).distinct()
    met = down.withColumn("pair", F.expr("set div 2")).groupBy("pair", "node").count().where("count = 2").select("pair").distinct().count()
    # 6 are expected at most
    assert n - met <= 18
