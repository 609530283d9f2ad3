"""Where a bound used to end the work: ranks, short items, filters, duals."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quantloom.llm import decontam, line_dedup, mixing


def within(own, words, edits, any_length):
    """Whether some passage of the words is within the edits of the item, by trying them all."""
    lengths = range(max(1, len(own) - edits), len(own) + edits + 1) if any_length else (len(own),)
    return any(decontam.word_edits(own, words[i : i + m]) <= edits for i in range(len(words)) for m in lengths)


@pytest.mark.parametrize("any_length", [False, True])
@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_short_items_lose_no_edit(any_length, similarity):
    r = random.Random(1)
    items = [(n, " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(4 + n % 4))) for n in range(40)]
    held = decontam.Items(items, similarity, 0.999, 8, any_length, 4)
    found = 0
    for _ in range(400):
        own = r.choice(items)[1].split()
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(own) + 1)
            own[at : at + r.randint(0, 1)] = [r.choice(["qq", "ax"])] * r.randint(0, 1)
        words = [r.choice("pqrs") for _ in range(r.randint(0, 5))] + own + [r.choice("pqrs") for _ in range(r.randint(0, 5))]
        want = {i for i, text in items if within(text.split(), words, decontam.edits_allowed(len(text.split()), similarity), any_length)}
        assert set(held.quoted(words)) == want, words
        found += len(want)
    assert found > 150


def test_word_edits():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("ab") for _ in range(r.randint(0, 6))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        table[:, 0], table[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = min(table[i, j + 1] + 1, table[i + 1, j] + 1, table[i, j] + (a[i] != b[j]))
        assert decontam.word_edits(a, b) == table[-1, -1]


def test_recall_out_of_reach_is_refused(monkeypatch):
    monkeypatch.setattr(decontam, "MOST_WALKS", 1)
    decontam.walks_needed.cache_clear()
    with pytest.raises(ValueError, match="recall"):
        decontam.walks_needed(30, 0.6, 0.999)
    decontam.walks_needed.cache_clear()


def test_only_suspects_are_shuffled(spark):
    rows = [(i, f"own line {i}\nshared {i % 5}\nanother of its own {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bits = line_dedup.bits_for(docs, "text")
    twice = spark.sparkContext.broadcast(line_dedup.twice_filter(docs, "text", bits))
    assert line_dedup.suspected_pairs(docs, "text", bits, twice).count() <= 400 + 4  # of 1200 lines those that repeat
    got = line_dedup.dedup_lines(docs, min_docs=10, broadcast_keys=0)
    assert {(r.doc_id, r.n_dropped, r.text) for r in got.collect()} == {(i, 1, f"own line {i}\nanother of its own {i}") for i, _ in rows}


def test_a_dual_that_does_not_settle_is_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NEWTON_STEPS", 1)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 3}") for i in range(200)], "doc_id long, text string, source string")
    with pytest.raises(RuntimeError, match="settled"):
        mixing.mix_sources(docs)
