"""Scores against a bigram model in plain Python."""

import math
import zlib
from collections import Counter

import pytest

from trenchwork.llm import ngramlm

from . import data


class Plain:
    """The model with the same quantised counts, over lists of tokens."""

    def __init__(self, train):
        self.word, self.pair = Counter(x for w in train for x in w), Counter(x for w in train for x in zip(w, w[1:]))
        self.n, self.v = sum(self.word.values()) - self.word[None], len([x for x in self.word if x is not None])

    def p(self, x, y):
        low = lambda c: 2 ** int(math.log2(c)) if c else 0
        high = lambda c: 2 ** (int(math.log2(c)) + 1) - 1 if c else 0
        alone = (low(self.word[y]) + 1) / (self.n + self.v + 1)
        return (low(self.pair[x, y]) + ngramlm.MU * min(1, alone)) / (high(self.word[x]) + ngramlm.MU)

    def score(self, w):
        return sum(math.log10(self.p(x, y)) for x, y in zip(w, w[1:]))


def tokens(docs):
    return [(r["doc_id"], [None, *data.words(r["text"], True), ""]) for r in docs.select("doc_id", "text").collect()]


def trained_on(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 != 2


@pytest.mark.parametrize("most_bits", [1 << 29, 1 << 13])
def test_score_agrees_with_a_bigram_model(docs, monkeypatch, most_bits):
    """In one slice, and in several."""
    monkeypatch.setattr(ngramlm, "MOST_BITS", most_bits)
    rows = tokens(docs)
    model = Plain([w for d, w in rows if trained_on(d)])
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in ngramlm.scored(docs).collect())
    want = sorted((d or -1, len(w) - 1, model.score(w)) for d, w in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-3)


def test_probabilities_sum_to_one_at_most(docs):
    model = Plain([w for d, w in tokens(docs) if trained_on(d)])
    for x in list(model.word)[:200]:
        assert sum(model.p(x, y) for y in model.word if y is not None) <= 1


def test_nothing_to_train_on(spark):
    held = [i for i in range(200) if not trained_on(i)]
    df = spark.createDataFrame([(i, "a few words") for i in held] + [(None, "x")], "doc_id long, text string")
    for r in ngramlm.scored(df).collect():
        assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0, 0)
    own = next(i for i in range(9) if trained_on(i))
    one = spark.createDataFrame([(own, "a b"), *((i, "a c") for i in held)], "doc_id long, text string").repartition(8)
    assert {(r["train_tokens"], r["n_known"]) for r in ngramlm.scored(one).where("held_out").collect()} == {(3, 2)}


def test_words_outside_the_table(spark, monkeypatch):
    """No word counts exactly 2, and the most frequent one alone fits the table."""
    monkeypatch.setattr(ngramlm, "MOST_WORDS", 1)
    ids = [i for i in range(9) if trained_on(i)][:3]
    got = ngramlm.scored(spark.createDataFrame([(i, "alpha beta beta") for i in ids], "doc_id long, text string")).collect()
    n, v = 12, 3
    want = sum(math.log10((c + 1) / (n + v + 1)) for c in (3, 6, 6, 3))
    assert all(r["base_score"] == pytest.approx(want) and r["n_known"] == 4 for r in got)
