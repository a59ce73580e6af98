"""Columns whose names hold dots or quotes, or are those of results and of steps inside."""

import sys
from pathlib import Path

import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from tidemark.llm import ballhash, bpe, decontamination, linededup, orderhash, setjoin, substrings, toxicity, urlfilter

ODD = ("a.b", "row", "TEXT2", "__host", "__Lines", "IDS", "raw", "Contamination", "found", "key_a", "c`d", "lines", "host", "score2", "fp", "label")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "some words of a text\nthat has two lines", "en", "s", 30), (2, None, "en", "s", 0), (3, "some words of a text\nthat has two lines", "en", "s", 30), (4, "another text of words", "de", "s", 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ODD:
        df = df.withColumn(name, df["lang"])
    return df


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that any document says at all, not even once, in any of its words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_odd_columns(spark, docs, folder, name):
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    if name != "bpe":
        assert got.columns == docs.columns
        assert all(r["a.b"] == r["c`d"] == r["lang"] for r in got.collect())
    assert got.count() > 0


def test_results_take_the_place_of_columns_of_their_name(spark, docs):
    names = lambda df: [c.lower() for c in df.columns]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    items = spark.createDataFrame([(1, "another text of words")], "item_id long, text string")
    pages = docs.withColumn("x.url", docs["text"])
    made = {
        "ids": bpe.coded(docs, path, pattern), "contamination": decontamination.annotated(docs, items), "__lines": linededup.deduped(docs),
        "__host": urlfilter.judged(pages, spark.createDataFrame(list(urlfilter.RULES), "rule string, action string"), "x.url"),
    }
    for name, df in made.items():
        assert names(df).count(name) == 1 and "a.b" in df.columns, name
        assert len(df.collect()) == 4
    assert {r["contamination"].contaminated for r in made["contamination"].where("doc_id = 4").collect()} == {True}


@pytest.mark.parametrize("run", [ballhash.linked, setjoin.joined, orderhash.fingerprints if hasattr(orderhash, "fingerprints") else ballhash.fingerprints])
def test_operators_that_read_their_own_columns_only(docs, run):
    assert run(docs).count() == 4
