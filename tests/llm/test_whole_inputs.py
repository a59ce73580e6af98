"""Long conversations and lines of every length."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import chat, linededup


def test_long_conversations_of_rewriting_templates(spark):
    turns = [("assistant" if i % 2 else "user", f"t{i}") for i in range(230)]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    forgetful = lambda ts: "".join(f"<{r}>{t if i == len(ts) - 1 or r == 'user' else ''};" for i, (r, t) in enumerate(ts))
    sliding = lambda ts: "".join(f"<{r}>{t};" for r, t in ts[-100:])
    for template in (forgetful, sliding):
        rows = chat.formatted(df, template).orderBy("segment").collect()
        assert "".join(r.formatted for r in rows) == template(turns)
        assert [x.rewrites for r in rows for x in r.spans] == [x["rewrites"] for x in chat.spans(turns, template, [])[1]]
    assert chat.formatted(df).count() == 3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_short_lines_are_compared_too(spark):
    rng = np.random.default_rng(17)
    docs = [(i, "\n".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(0, 28))) for _ in range(3))) for i in range(40)]
    docs += [(50, "a heading of 23 letters\nhome"), (51, "a heading of 23 lettres\nx\nhomes and more")]
    seen, want = [], {}
    for i, text in docs:
        kept = [x for k, x in enumerate(text.split("\n")) if not x or all(edits(x, y) > 2 for y in seen + [z for z in text.split("\n")[:k] if z])]
        seen += [x for x in text.split("\n") if x]
        want[i] = "\n".join(kept)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.deduped(df).collect()}
    assert got == want and "lettres" not in got[51]


def digests_of(spark, turns, **kw):
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(df, **kw)).first()


def test_private_characters_anywhere(spark):
    probes = ["\ue000", "\ue001 \ue000", "".join(map(chr, range(0xE000, 0xE020)))]
    for i in range(4):
        turns = [["user", "a"], ["assistant", "hello"], ["tool", "b"], ["assistant", "bye"]]
        turns[i][1] += probes[i % 3]
        turns[2][0] += probes[(i + 1) % 3]
        own = "".join(t for r, t in turns if r == "assistant")
        got = digests_of(spark, [tuple(t) for t in turns], segment_turns=1 + i % 2)
        assert (got.loss_chars, got.loss_sha256) == (len(own), hashlib.sha256(own.encode()).hexdigest()) and got.n_turns == 4
    marked = lambda ts: "".join(f"\ue000{r}:{t}\ue001" for r, t in ts)
    text, found = chat.spans([("user", "x"), ("assistant", "y\ue002")], marked, [])
    assert [text[x["text_begin"] : x["text_end"]] for x in found] == ["x", "y\ue002"]


def test_a_hidden_text_stops_the_digest(spark):
    counted = lambda ts: "".join(f"<s> {len(t)} </s>" for _, t in ts)
    with pytest.raises(Exception, match="as a piece"):
        digests_of(spark, [("assistant", "abc")], template=counted)


def test_a_long_first_turn(spark):
    turns = [("user", "u" * 300_000), ("assistant", "v" * 10), ("user", "w" * 300_000), ("assistant", "x")]

    def strict(ts):
        assert all(a[0] != b[0] for a, b in zip(ts, ts[1:])), "roles alternate"
        return chat.lines(ts)

    got = digests_of(spark, turns)
    assert got.n_turns == 4 and got.loss_chars == 11
    assert digests_of(spark, turns, template=strict).loss_sha256 == got.loss_sha256
    # behind the first turn alone, and behind the first and the last one
    assert chat.spans(turns[1:2], strict, turns[:1])[0] == chat.lines(turns[1:2])


def test_a_rewrite_late_in_a_long_conversation(spark):
    turns = [("assistant" if i % 2 else "user", f"t{i}") for i in range(240)]
    late = lambda ts: "".join(f"<{r}>{t if i != 2 or len(ts) < 200 else 'gone'};" for i, (r, t) in enumerate(ts))
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    found = [x for r in chat.formatted(df, late).orderBy("segment").collect() for x in r.spans]
    assert [i for i, x in enumerate(found) if x.rewrites] == [199]
