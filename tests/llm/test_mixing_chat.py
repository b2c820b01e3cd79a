"""Operators 6 and 8."""

import hashlib
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from claimledger.llm import chat, mixing
from claimledger.llm.common import WORD
from pyspark.sql import functions as F

from .conftest import words


def water(sizes, weights, cap=3.0):
    """Targets by repeated sharing, as the contract words it."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        share = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if share * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = share * weights[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def sized(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, size long, target2 string")


@pytest.mark.parametrize("sizes", [[100, 10, 10, 1000], [1, 1, 1, 1, 500], [7, 0, 30], [5]])
def test_targets(spark, sizes):
    rows = [(i * 100 + k, f"s{i}", 1) for i, n in enumerate(sizes) for k in range(n)] + \
           [(i * 100 + 99, f"s{i}", 0) for i in range(len(sizes))]
    got = {r.source: r for r in mixing.mix(sized(spark, rows)).groupBy("source").agg(
        F.first("target").alias("t"), F.first("source_size").alias("s"), F.max("copies").alias("most"),
        F.min("copies").alias("least"), F.sum("taken").alias("taken")).collect()}
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    for i, t in enumerate(want):
        g = got[f"s{i}"]
        assert g.s == sizes[i] and math.isclose(g.t, t, abs_tol=1e-9) and 0 <= g.least <= g.most <= 3
        assert abs(g.taken - t) < 1.0001


def test_mix_of_odd_documents(odd):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} <= {1, 2, 6, 7, 8, 9, 10, None}
    m = mixing.mix(odd.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    by = {r.doc_id: r for r in m.collect()}
    assert m.count() == odd.count() and by[3].size == 0 and by[4].size == 0 and by[5].size == 0
    assert by[10].size == 40001 and all(0 <= r.taken <= 3 * r.size for r in m.collect())
    # null comes last: a, b, c, null weigh 5, 2, 1, 5
    assert by[3].target == pytest.approx(3 * 1.0) and by[3].source_size == 1


def test_mix_reruns_agree_and_empty(odd, empty):
    m = lambda: sorted(mixing.mix(odd.select("doc_id", "source", F.length("text").alias("size"))
                                  .na.fill(0, ["size"])).select("doc_id", "taken").collect(), key=str)
    assert m() == m()
    assert mixing.mixed_documents(empty).count() == 0


def test_words_are_counted_as_the_contract_says(odd):
    for r in odd.select("text", mixing.word_count(F.col("text")).alias("n")).collect():
        assert r.n == len(words(r.text))
    assert WORD == r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- chat

@given(st.text(alphabet=st.one_of(st.sampled_from("<|>\\ab\n"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_escaping_is_reversible_and_safe(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and "<|" not in e and "|>" not in e


def test_spans_of_black_boxes():
    turns = [("user", "hi"), ("assistant", ""), ("user", "a longer text")]
    for template in (chat.chatml, lambda t: "BOS" + "".join(f"[{r}]{x}[/]" for r, x in t),
                     lambda t: "".join(f"{x}\t{r}\n" for r, x in t)):
        found = chat.spans(turns, template)
        assert "".join(s["piece"] for s in found) == template(turns)
        assert all(s["stable"] and s["piece"][s["text_start"]:s["text_start"] + s["text_length"]] == x
                   for s, (_, x) in zip(found, turns))


def test_rewritten_history_is_detected():
    def forgets(turns):  # drops the thoughts of earlier turns
        return "".join(f"<{r}>{x if i == len(turns) - 1 else x.split('#')[0]}" for i, (r, x) in enumerate(turns))
    assert [s["stable"] for s in chat.spans([("u", "a#b"), ("u", "c"), ("u", "d")], forgets)] == [True, False, True]
    assert [s["stable"] for s in chat.spans([("u", "abc")], lambda t: "".join(x.upper() for _, x in t))] == [False]


CONV = "conv_id long, turn long, role string, text string, seq string, piece int"


def digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(own), sha(turns), len(loss), sha(loss))
    return out


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "\\<|x|>"), (1, 1, "assistant", "\\<|x|>"), (1, None, None, None),
            (2, 5, "assistant", ""), (2, 5, "a\nb", "tie"), (None, 0, "user", "no id"), (3, 0, "assistant", "y" * 200000)]
    rows += [(4, k * (7 if k > 50 else 1), "assistant" if k % 2 else "user", f"turn {k}") for k in range(150)]
    c = spark.createDataFrame([(*r, "s", 1) for r in rows], CONV)
    formatted = chat.format_conversations(c)
    assert formatted.where("NOT stable").count() == 0
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == digests(rows)
    assert chat.read_back(chat.format_conversations(c.where("false"))).count() == 0


@pytest.mark.parametrize("look", ["window", "numbered", "folded"])
@pytest.mark.parametrize("most", [64, 3])
def test_long_conversations_are_rendered_whole(spark, monkeypatch, look, most):
    def template(turns):  # keeps the last 40 turns, numbers turns, or repeats the first turn in all others
        if look == "window":
            return "".join(f"<{r}>{x}" for r, x in turns[-40:])
        return "".join(f"[{k if look == 'numbered' else turns[0][1] if k else ''} {r}]{x}" for k, (r, x) in enumerate(turns))

    monkeypatch.setattr(chat, "SEGMENTS", most, raising=False)
    rows = {conv: [("assistant" if k % 2 else "user", f"{conv} turn {k}") for k in range(n)]
            for conv, n in ((1, 100), (2, 31), (3, 33), (4, 129))}
    c = spark.createDataFrame([(conv, k, *t) for conv, turns in rows.items() for k, t in enumerate(turns)],
                              "conv_id long, turn long, role string, text string")
    names = ["piece", "text_start", "text_length", "stable"]
    got = {(r.conv_id, r.seq): [r[n] for n in names] for r in chat.format_conversations(c, template).collect()}
    assert got == {(conv, k): [s[n] for n in names] for conv, turns in rows.items()
                   for k, s in enumerate(chat.spans(turns, template))}
    for conv, turns in rows.items():
        own = [got[conv, k] for k in range(len(turns))]
        if look == "window":
            assert [x[3] for x in own] == [k < 40 for k in range(len(turns))]
        else:
            assert all(x[3] for x in own) and "".join(x[0] for x in own) == template(turns)
