"""The numpy kernels against plain Python."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trenchwork.llm import decontaminate, huffman, langid, ngramlm, passages, quality, suffixes, urls
from trenchwork.llm.text import ALNUM, NOT_SPACE, flat, words_of
from trenchwork.llm.tokenids import UnitTokenizer

from . import data

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n\té日.-!", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_agree_with_the_patterns(texts):
    column = pa.array(texts, pa.string())
    for table, lower, pattern in ((NOT_SPACE, False, data.SPACED), (ALNUM, True, data.ALNUM)):
        w = words_of(column, table, lower)
        got = [[w.text(j) for j in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
        assert got == [data.words(t, lower, pattern) for t in texts]
        by_hash = {}
        for j in range(len(w.start)):
            assert by_hash.setdefault(int(w.hash[j]), w.text(j)) == w.text(j)


def test_words_of_a_slice():
    column = pa.array(["x y", None, "z", "a b c"]).slice(1)
    assert words_of(column, NOT_SPACE).count.tolist() == [0, 1, 3]
    assert flat(pa.array([], pa.string()))[1].tolist() == [0]


def test_winnowing_keeps_every_shared_span():
    r = random.Random(5)
    for _ in range(30):
        shared = " ".join(f"w{r.randint(0, 30)}" for _ in range(10))
        texts = [f"{' '.join(f'v{r.randint(0, 9)}' for _ in range(r.randint(0, 12)))} {shared} {' '.join(f'u{r.randint(0, 9)}' for _ in range(r.randint(0, 12)))}" for _ in range(2)]
        kept = [set(decontaminate.winnow(words_of(pa.array([t]), ALNUM, True), 5, 10)[1].tolist()) for t in texts]
        assert kept[0] & kept[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.integers(6, 12))
def test_huffman_lengths_are_a_limited_code(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = np.array(counts) > 0
    assert ((lengths > 0) == used).all() and lengths.max(initial=0) <= limit
    assert (2.0 ** -lengths[used]).sum() <= 1
    if used.sum() > 1:
        assert (2.0 ** -lengths[used]).sum() == 1


def test_huffman_round_trip():
    r = np.random.default_rng(2)
    code = huffman.canonical(huffman.code_lengths(r.zipf(1.2, 5000)))
    runs = np.concatenate([r.integers(1, 1500, 60), [1, huffman.STEP, huffman.STEP + 1]])
    ids = r.integers(0, 5000, runs.sum())
    packed, sizes, marks, _ = huffman.encode(code, ids, runs)
    assert (huffman.decode(code, packed, sizes, runs, marks) == ids).all()
    one = huffman.canonical(huffman.code_lengths(np.array([0, 9, 0])))
    packed, sizes, marks, _ = huffman.encode(one, np.array([1, 1, 1]), np.array([2, 1]))
    assert huffman.decode(one, packed, sizes, np.array([2, 1]), marks).tolist() == [1, 1, 1]


def test_the_tokenizer_starts_no_threads(monkeypatch):
    """Tasks share the cores; each is one thread."""
    import os

    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    path = public_tokenizers.path("byte_bpe_50k.json")
    units, before = UnitTokenizer(path), len(os.listdir("/proc/self/task"))
    units.encode(pa.array([f"word{i} and {i * 7919} more" for i in range(4000)]))
    assert len(os.listdir("/proc/self/task")) == before
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_units_are_cut_where_the_tokenizer_cuts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, units = Tokenizer.from_file(path), UnitTokenizer(path, most=500)
    r = random.Random(1)
    parts = ["a.", ",", ";b", " ", "  ", "\n", "\t", "a", "b", "é", "1", ".", "'s", "'", " ", "　", "<|endoftext|>", "\x1c", "ß", "!", "日", "\r\n", "\x85", "<", "x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, counts = units.encode(pa.array(part))
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]


def thue_morse(a, b, n):
    return "".join(a if bin(i).count("1") % 2 else b for i in range(n))


def test_structured_texts_have_their_own_hashes():
    """Words that polynomial hashes modulo 2^64 confuse, and units of the same kind."""
    for n in (1024, 2048, 200):
        pair = [thue_morse("a", "b", n), thue_morse("b", "a", n)]
        w = words_of(pa.array(pair), NOT_SPACE)
        assert w.hash[0] != w.hash[1]
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, units = Tokenizer.from_file(path), UnitTokenizer(path)
    texts = [thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)]
    ids, counts = units.encode(pa.array(texts))
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [ids[: counts[0]].tolist(), ids[counts[0] :].tolist()] == want and want[0] != want[1]


def test_units_of_one_hash_are_told_apart(monkeypatch):
    from trenchwork.llm import tokenids

    real = tokenids.byte_hashes
    monkeypatch.setattr(tokenids, "byte_hashes", lambda data, start, end, seed=0: real(data, start, end, seed) % np.uint64(3 if not seed else 1 << 60))
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, units = Tokenizer.from_file(path), UnitTokenizer(path)
    texts = ["some words here", None, "and quite other words, there"]
    ids, counts = units.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in plain.encode(t or "", add_special_tokens=False).ids] and counts[1] == 0


def test_sampled_suffixes_are_a_cover():
    r = random.Random(9)
    shared = "".join(r.choice("abc") for _ in range(50))
    a, b = (("".join(r.choice("xy") for _ in range(n)) + shared + "zz").encode() for n in (7, 33))
    found = []
    for text in (a, b):
        place, _ = suffixes.sampled(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        start = text.index(shared.encode())
        found.append({p - start for p in place.tolist() if 0 <= p - start <= 26})
    assert found[0] & found[1]


def test_filter_counts_are_never_too_low():
    r = np.random.default_rng(4)
    keys = r.integers(0, 1 << 63, 300_000).astype(np.uint64) * np.uint64(2)
    counts = r.zipf(1.5, len(keys)).clip(1, 10**6)
    segment = keys >> np.uint64(56)
    one = ngramlm.LogFrequencyFilter([ngramlm.LogFrequencyFilter.part_of(keys[segment == s], counts[segment == s]) for s in range(ngramlm.SEGMENTS)])
    got, want = one.look_up(keys), ngramlm.levels(counts)
    assert (got >= want).all() and (got == want).mean() > 0.88
    other = r.integers(0, 1 << 63, 30_000).astype(np.uint64) * np.uint64(2)
    assert 0.05 < (one.look_up(other) > 0).mean() < 0.11


def test_chi_square():
    assert quality.chi2_cdf(quality.chi2_quantile(0.75, 5), 5) == pytest.approx(0.75)
    assert quality.chi2_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3)


def test_boosting_learns_a_rule():
    r = np.random.default_rng(0)
    x = r.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = urls.boost(x, y)
    assert (((trees.margins(x) > 0) == (y > 0)).mean()) > 0.97


def test_net_gradients():
    net = langid.ByteNet(["a", "b"], seed=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    r = np.random.default_rng(3)
    x, y = r.integers(1, 256, (3, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(3), y]).mean()
    g = net.gradients(x, y)
    for name, at in (("out", (1, 0)), ("conv", (2, 5)), ("embed", (int(x[0, 0]), 1)), ("bias", (4,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_agreement_of_passages():
    """Against sets: words changed, put in and left out around the shared token; runs of words that repeat."""
    r = random.Random(1)
    cases, wanted = [], []
    for case in range(300):
        base = [r.randrange(1 << 30) for _ in range(140)]
        if case % 5 == 4:
            base[75:95] = base[55:75]
        other, at = list(base), 70
        for _ in range(r.randint(0, 5)):
            i = r.choice([i for i in range(30, len(other) - 30) if not at - 5 < i < at + 6])
            kind, n = r.randrange(3), r.randint(1, 4)
            new = [r.randrange(1 << 30) for _ in range(n)]
            if kind == 0:
                other[i] = new[0]
            elif kind == 1:
                other[i:i] = new
                at += n if i <= at else 0
            elif i + n < at - 5 or i > at:
                del other[i : i + n]
                at -= n if i < at else 0
        token = lambda w: [hash(tuple(w[i : i + 5])) & 0xFFFFFFFF for i in range(len(w) - 4)]
        x, y = token(base)[70 - passages.SIDE : 71 + passages.SIDE], token(other)[at - passages.SIDE : at + 1 + passages.SIDE]
        if len(x) < passages.SPAN or len(y) < passages.SPAN or x[passages.SIDE] != y[passages.SIDE]:
            continue
        cases.append((x, y))
    x, y = (np.array(c, np.uint32) for c in zip(*cases))
    low, high = np.zeros(len(x), int), np.full(len(x), passages.SPAN - 1)
    ok, ends = passages.agreement(x, y, low, high, low, high)
    assert 30 < ok.sum() < len(x) - 10
    near = 0
    for i in range(len(x)):
        best = 0.0
        for a in range(0, passages.SIDE + 1, 3):
            for b in range(max(passages.SIDE, a + passages.T - 1), passages.SPAN, 3):
                one = set(x[i, a : b + 1].tolist())
                for c in range(max(0, a - 8), min(passages.SIDE, a + 8) + 1, 2):
                    for d in (b - 4, b - 2, b, b + 2, b + 4):
                        if passages.SIDE <= d < passages.SPAN:
                            two = set(y[i, c : d + 1].tolist())
                            best = max(best, len(one & two) / len(one | two))
        if best >= 0.8:
            near += 1
            # A repeated word run may be kept in one place only; such passages are compared in place.
            assert ok[i] or len(set(x[i].tolist())) < passages.SPAN
    assert near > 30
