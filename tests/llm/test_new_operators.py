"""Whitening, Merkle manifests and SentencePiece ids against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from trenchwork.llm import merkle, sentencepieces, whitening

from . import data

PIECES = public_tokenizers.path("piece_bpe_32k.model")
NOWHERE = float("nan")


def test_limbs_and_products_are_exact():
    r = random.Random(1)
    for bits in (5, 19, 20, 40, 62):
        x = np.array([[r.randrange(-(1 << bits), 1 << bits) for _ in range(7)] for _ in range(50)], np.int64)
        assert (sum(p.astype(object) << 20 * i for i, p in enumerate(map(lambda p: p.astype(np.int64), whitening.limbs(x)))) == x).all()
        assert (whitening.self_product(x) == x.astype(object).T @ x.astype(object)).all()
    edge = np.array([[-(1 << 63), (1 << 63) - 1, 0, -1]], np.int64)
    assert (whitening.self_product(edge) == edge.astype(object).T @ edge.astype(object)).all()


def test_small_variances_beside_large_ones():
    """Rows of a long first axis that no coordinate follows, and much shorter others."""
    r = np.random.default_rng(2)
    basis = np.linalg.qr(r.normal(size=(12, 12)))[0]
    x = np.rint(r.normal(size=(400, 12)) * 10.0 ** np.array([12, 8, 5, 3, *[1] * 8]) @ basis.T).astype(np.int64) + 10**15
    full = whitening.self_product(np.hstack([x, np.ones((400, 1), np.int64)]))
    fit = whitening.decomposed(full, 4)
    assert fit.error < 1e-6 and fit.n == 400
    y = x.astype(object) * 400 - np.array(fit.sums, object)
    w = (y.astype(np.float64) / 400) @ fit.axes / np.sqrt(fit.variance)
    assert np.abs(w.T @ w / 400 - np.eye(4)).max() < 1e-4


VECTORS = [
    (1, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (3, [0.1, 0.2, -0.3]), (4, None), (5, [0.1, None, 0.2]), (6, [0.1, NOWHERE, 0.2]), (7, [float("inf"), 0.0, 0.0]),
    (8, [-0.0, 0.001, 2.0]), (None, [0.7, 0.7, 0.7]), (9, []), (10, [0.3]), (11, [0.3]), (12, [0.9]), (13, [1.0, 5.0]), (14, [0.25, 0.125, -1e6]), (1, [0.5, -0.25, 1.0]),
]


def test_whitening_of_odd_rows(spark):
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in VECTORS], "vec_id long, embedding array<double>, n int, id double").repartition(3)
    got = whitening.whitened(df, components=4).collect()
    usable = [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in VECTORS if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, k + 1) for i, v in usable for k in range(min(4, len(v))))
    for size in (1, 2, 3):
        fit = sorted({v for _, v in usable if len(v) == size})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        cov = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3)) for j in range(size)] for i in range(size)])
        values = np.sort(np.linalg.eigvalsh(cov))[::-1]
        want = Counter((i, n, sum((n * c - s) ** 2 for c, s in zip(v, sums))) for i, v in usable if len(v) == size)
        first = [r for r in got if r["component"] == 1 and (r["vec_id"], r["n"], r["deviation"]) in want]
        assert Counter((r["vec_id"], r["n"], r["deviation"]) for r in first) == want
        own = [r for r in got if r["n"] == n and any(r["vec_id"] == i for i, v in usable if len(v) == size)]
        for r in own:
            assert str(r["deviation"]) == r["deviation_digits"]
            assert (r["whitened"] is None) == (r["component"] > min(size, n - 1))
            assert r["explained"] is None if n == 1 else abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
            assert r["identity_error"] is None if n == 1 else r["identity_error"] < 1e-6
    assert whitening.whitened(df.limit(0)).count() == 0


def test_deviations_beyond_64_bits(spark):
    rows = [(1, [3e18, 1.0]), (2, [-3e18, 2.0]), (3, [1e300, 0.0])]
    got = {r["vec_id"]: r for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()}
    x = {1: [(1 << 63) - 1, 256], 2: [-(1 << 63), 512], 3: [(1 << 63) - 1, 0]}
    sums = [sum(c) for c in zip(*x.values())]
    for i, v in x.items():
        assert got[i]["deviation"] is None and got[i]["deviation_digits"] == str(sum((3 * c - s) ** 2 for c, s in zip(v, sums)))


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def folded_up(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The last node, and for each leaf the siblings (left, right) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            first = i // 3 * 3
            path.append((nodes[first:i], nodes[i + 1 : first + 3]))
        nodes, at = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def test_manifest_equals_plain_python(spark, docs, none):
    rows = docs.collect()
    leaf = lambda r, text: sha(field(r["doc_id"]), field(r["source"]), field(r["lang"]), field(r["n_chars"]), field(text))
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for found in groups.values():
        found.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: folded_up([leaf(r, r["text"]) for r in groups[s]]) for s in names}
    root, above = folded_up([trees[s][0] for s in names])
    want = Counter()
    for s, upper in zip(names, above):
        for r, path in zip(groups[s], trees[s][1]):
            tampered = r["text"] and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            at = leaf(r, r["text"].replace("\n", "") if tampered else r["text"])
            for left, right in path + upper:
                at = sha(*left, at, *right)
            want[r["doc_id"], leaf(r, r["text"]), trees[s][0], root, sha(*[h for left, right in path + upper for h in left + right]), at, at == root] += 1
    got = merkle.audited(docs).collect()
    assert Counter(tuple(r) for r in got) == want
    assert {r["verified"] for r in got} == {True, False}
    assert merkle.audited(none).count() == 0
    one = merkle.audited(docs.where("doc_id = 1")).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("")


def test_manifest_of_many_equal_rows_and_groups(spark):
    rows = spark.range(700).selectExpr("cast(null as long) as doc_id", "'same' as text", "if(id < 300, 'hot', concat('s', id)) as source", "'en' as lang", "4L as n_chars")
    got = merkle.manifest(rows, ["text"], "source", "doc_id", arity=2).selectExpr("leaf", "subroot", "root", "size(path) as depth").collect()
    assert len(got) == 700 and len({r["root"] for r in got}) == 1
    assert sum(r["leaf"] == r["subroot"] for r in got) == 400 and {r["depth"] for r in got} == {9, 18}


def test_pieces_equal_the_library(spark, docs, none):
    odd = [" ", "  ", "\n", " \n ", "a", " a", "a  b   c ", "▁x ▁▁ y▁", "日本 　x", "a\x00b", "\x00", "<s> </s> <unk> <0x0A>", "x" * 3000, "ﬁ ①🙂 🙂🙂", "word " * 5000 + "end"]
    both = docs.select("doc_id", "text", "row", "id").unionByName(spark.createDataFrame([(1000 + i, t, None, None) for i, t in enumerate(odd)], "doc_id long, text string, row long, id string"))
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for r in both.collect():
        ids = model.encode(r["text"] or "")
        want[r["doc_id"], tuple(ids), model.decode(ids)] += 1
    got = sentencepieces.encoded(both, PIECES).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    hashed = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepieces.digests(both, PIECES).collect()}
    assert hashed == {(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, ids, t in want}
    assert sentencepieces.encoded(none, PIECES).count() == 0
    assert sentencepieces.words_apart(PIECES)


@pytest.mark.parametrize("block", [200, 5000])
def test_pieces_in_small_blocks_and_whole_texts(spark, docs, monkeypatch, block):
    """Many blocks, as in workers that see the module so; and texts that count as one word each."""
    monkeypatch.setattr(sentencepieces, "BLOCK_BYTES", block)
    model, batch = sentencepiece.SentencePieceProcessor(model_file=PIECES), data.rows()
    texts = [r[1] for r in batch]
    for apart in (True, False):
        words, before = sentencepieces._words(sentencepieces.pa.array(texts, sentencepieces.pa.string()), apart)
        distinct, ends, codes, _ = sentencepieces._ordered(words, 5)
        assert len(ends) == 5 and ends[-1] == len(distinct)
        pieces = distinct.to_pylist()
        for i, text in enumerate(texts):
            own = b"".join(pieces[c] for c in codes[before[i] : before[i + 1]])
            assert own.decode() == (" " + text if text else "")
            ids = [t for c in codes[before[i] : before[i + 1]] for t in model.encode(pieces[c][1:].decode()) or [model.piece_to_id("▁")]]
            assert ids == model.encode(text or "")
