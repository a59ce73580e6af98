"""The corpus pipeline and each of its stages against brute force."""

import base64
import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_operators import sentence, shingle_set
from tidemark.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, __key_a string, ref string"
BAD = ["vile", "scum", "filth"]


def words_only(rng, n):
    return re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], sentence(rng, n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (nulls, copies, near copies, repeated rows, extra columns), labels and benchmark."""
    rng = random.Random(21)
    base, item = words_only(rng, 80), words_only(rng, 30)
    near = base.split()
    near[40] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  "), (7, "one two"), (7, "one two"), (8, words_only(rng, 60) + " " + item), (9, words_only(rng, 900) + " " + " ".join(item.split()[:14]))]
    rows += [(10, words_only(rng, 40) + "\n" + base[:90]), (11, base[:89] + "!\n" + words_only(rng, 40)), (12, words_only(rng, 50) + " " + " ".join(BAD)), (13, " ".join(near)), (13, words_only(rng, 45)), (None, words_only(rng, 30)), (14, words_only(rng, 12_000))]
    labels = []
    for i in range(100, 700):
        toxic = i % 4 == 0
        rows.append((i, words_only(rng, 25) + (" " + " ".join(rng.sample(BAD, 2)) if toxic else "")))
        labels.append((i, 1, int(toxic)))
    for i in range(700, 740):  # long clean ones, as a corpus has them
        rows.append((i, words_only(rng, 9_000 if i % 10 == 0 else 900)))
        labels.append((i, 1, 0))
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "a", "r") for i, t in rows], DOCS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (101, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("x", item), (None, None), ("y", "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def near_lines(a, b, edits=2):
    """Whether a and b are within so many edits; equal beginnings are stepped over."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[n:], b[n:]
    if not a or not b or not edits:
        return len(a) + len(b) <= edits
    return any(near_lines(x, y, edits - 1) for x, y in ((a[1:], b), (a, b[1:]), (a[1:], b[1:])))


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    kept = stages["toxicity"](spark, docs, corpus)
    judged = toxicity.judged(docs, labels).join(docs.select("doc_id", "text"), "doc_id")
    bad = {r.doc_id for r in judged.where("predicted = 1").collect()}
    assert kept.columns == columns and 12 in bad and not bad & {*range(1, 12), 13, 14}
    assert rows_of(kept) == rows_of(docs.where(F.coalesce(~F.col("doc_id").isin(*bad), F.lit(True))))

    seen, want, low = [], [], lambda x: (x[0] is not None, x[0] or 0)
    before = rows_of(kept)
    once = sorted(set(before), key=lambda x: (low(x), repr(x[1])))
    split = lambda t: t.split("\n") if t else []
    got = stages["line_dedup"](spark, kept, corpus)
    after = rows_of(got)
    several = {i for i in [x[0] for x in once] if [x[0] for x in once].count(i) > 1}
    for i, text in once:
        left = []
        for line in split(text):
            blank = not line.strip(" ")
            near = any(abs(len(line) - len(s)) <= 2 and near_lines(line, s) for s in seen)
            if blank or not near:
                left.append(line)
            if not blank:
                seen.append(line)
        if left or not text:
            want += [(i, "\n".join(left) if text else text)] * before.count((i, text))
    assert got.columns == columns and several == {13} and after == sorted(want, key=repr)
    assert got.where("text is not null and n_chars != char_length(text)").count() == 0

    got = stages["jaccard_join"](spark, kept, corpus)
    sets = [(i, t, shingle_set(t or "")) for i, t in once]
    linked = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b)
    want = [(i, t) for k, (i, t, s) in enumerate(sets) if not any(linked(s, x) and (low((j,)) < low((i,)) or j == i and m < k) for m, (j, _, x) in enumerate(sets) if m != k)]
    assert got.columns == columns and rows_of(got) == sorted(want, key=repr) and (13, once[[x[0] for x in once].index(13)][1]) is not None

    got = stages["decontamination"](spark, kept, corpus)
    item = spark.read.parquet(f"{corpus}/benchmark.parquet").where("item_id = 'x'").first().text
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(cut(item)[i : i + 13]) for i in range(18)}
    hit = lambda w: len({j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)})
    assert got.columns == columns and rows_of(got) == [x for x in before if not (hit(cut(x[1])) and 20 * hit(cut(x[1])) >= len(cut(x[1])))]
    assert {8} == {x[0] for x in before} - {x[0] for x in rows_of(got)}


def test_whole_pipeline(spark, corpus):
    docs, kept = spark.read.parquet(f"{corpus}/documents.parquet"), None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs if kept is None else kept, corpus)
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    got = corpus_pipeline.run(spark, corpus).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in texts:
        ids = library.encode_ordinary(text or "")
        want.append((i, ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(((r.doc_id, r.ids, r.ids_sha256, r.decoded_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.doc_id for r in got} >= {1, 4, 5, 6, 7, 9, 10, 14, None} and not {r.doc_id for r in got} & {2, 3, 8, 12}


def test_no_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0, name
