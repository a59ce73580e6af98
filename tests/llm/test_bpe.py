import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import Row

from tidemark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(open(PATH, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(own, library):
    rng = random.Random(7)
    alphabet = "abcdefghijklmnopqrstuvwxyzÀéßжщ中文字ab the in  \n\t\u00a0\u2003\x1c\x85'sllve0123456789½²Ⅷ_-!?#😀\u0301"
    texts = ["", " ", "\n\n  x", "a" * 3000, "ab" * 1500, " " * 700 + "x", "<|endoftext|> it's", "I'll we've I'D"]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 200))) for _ in range(600)]
    texts += ["".join(chr(c) for c in rng.choices([*range(32, 0x3000), *range(0x1F300, 0x1F900)], k=60)) for _ in range(200)]
    texts += ["".join(rng.choices("thernaesio", k=20_000))]
    for text in texts:
        assert own.encode(text) == library.encode_ordinary(text), repr(text[:50])
        assert own.decode(own.encode(text)) == text.encode()
    many, counts = own.encode_all(texts)
    cut = iter(many.tolist())
    assert [[next(cut) for _ in range(n)] for n in counts] == [library.encode_ordinary(x) for x in texts]
    for text in ("aaaaaaaa" * 4, "thethethe" * 9, "abcabcabc" * 500):
        raw = text.encode()
        assert own.merged(raw) == tuple(own.merged_together([raw])[0].tolist()) == tuple(library.encode_ordinary(text))
    assert not any(own.low) and not any(own.middle)


def test_small_memory_and_equal_hashes(library, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "theatre", "zq" * 200, "né", "x1", "ratio nal"], k=30)) for _ in range(40)]
    want = [library.encode_ordinary(x) for x in texts]
    hashes = bpe.span_hashes
    # only three values of the first hash: most pre-tokens share it with others
    monkeypatch.setattr(bpe, "span_hashes", lambda data, a, b, seed=0: hashes(data, a, b, seed) if seed else hashes(data, a, b) % 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    own = bpe.Codec(open(PATH, "rb").read(), P.PATTERN)
    assert [own.encode(x) for x in texts] == want == [own.encode(x) for x in texts]
    many, counts = own.encode_all(texts)
    assert many.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


def test_coded_is_encode_and_decode(spark, library, monkeypatch):
    texts = [None, "", "The theatre", "né " * 500, None, "a" * 3000]
    df = spark.createDataFrame([(i, x, "r") for i, x in enumerate(texts)], "ids long, text string, other string")
    got = {r.ids: r for r in bpe.coded(df, PATH, P.PATTERN, ids="tokens").collect()}
    for i, x in enumerate(texts):
        assert (got[i].tokens, got[i].raw and bytes(got[i].raw)) == ((None, None) if x is None else (library.encode_ordinary(x), x.encode())), i
    own, arrow = bpe.Codec(open(PATH, "rb").read(), P.PATTERN), pytest.importorskip("pyarrow").array(texts)
    whole = bpe._encoded(own, arrow)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 10)
    monkeypatch.setattr(bpe, "CHUNK_IDS", 7)
    assert bpe._encoded(own, arrow).to_pylist() == whole.to_pylist()
    assert bpe._decoded(own, whole).to_pylist() == [x if x is None else x.encode() for x in texts]


def test_any_pattern():
    pattern = r"\p{N}|[^\s\p{N}]+|\s+"
    own = bpe.Codec(open(PATH, "rb").read(), pattern)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in ("", "a12 b", "Ünï 3½\u00a0x", "\n\n 77"):
        assert own.encode(text) == library.encode_ordinary(text)


def test_columns(spark, library):
    rows = [Row(ids=1, text="The theatre", raw="x"), Row(ids=2, text=None, raw="y"), Row(ids=3, text="", raw=None)]
    df = spark.createDataFrame(rows, "ids long, text string, raw string")
    got = bpe.decode(bpe.encode(df, PATH, P.PATTERN, ids="tokens"), PATH, P.PATTERN, ids="tokens", raw="back").orderBy("ids").collect()
    assert [x.tokens for x in got] == [library.encode_ordinary("The theatre"), None, []]
    assert [x.back and bytes(x.back) for x in got] == [b"The theatre", None, b""]
    assert [x.raw for x in got] == ["x", "y", None]
    assert bpe.encode(df.limit(0), PATH, P.PATTERN, ids="tokens").count() == 0
