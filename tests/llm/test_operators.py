"""Every operator on small tables with awkward rows, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trenchwork.llm import decontaminate, jaccard, langid, mixing, ngramlm, passages, quality, suffixes, tokenids, urls
from trenchwork.operators.network import components

from . import data

NO_ID = 1 << 70


def table(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(df, want, *columns):
    got = Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
    assert got == Counter(want)


def test_language(docs, none):
    got = langid.identify(docs, rows_per_language=50).collect()
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    text = dict(table(docs))
    sure = [r for r in got if r["doc_id"] is not None and len(data.words(text[r["doc_id"]])) >= 50]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in sure) >= 0.9 * len(sure)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] is not None and not any(c.isalpha() for c in text[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    assert langid.identify(none).count() == 0
    kept = langid.accepted(docs, 0.3, rows_per_language=50)
    assert kept.columns == docs.columns and kept.count() == sum(r["lang_pred"] != "und" and r["score"] >= 0.3 for r in got)


def test_language_without_labels(docs):
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def rule_by_hand(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(data.LOWER), rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for word, rule in urls.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (word, rule)
    return host, path, best


def test_urls(spark):
    r = random.Random(2)
    made = [f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'M.'])}{r.choice(['a', 'b'])}.{r.choice(['Example', 'other'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es'])}/{r.randint(1, 99)}{r.choice(['', '?a=1', '#x'])}" for _ in range(300)]
    odd = [None, "", "no scheme", "x://", "http://com/en/", "http://example.net/de/81", "http://badcom/en/1", "http://EXAMPLE.com/en/7?q=://z", "a://b?c/d"]
    pages = spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(made + odd)], "page_id long, url string, score double")
    got = {x["page_id"]: x for x in urls.judge(pages).collect()}
    assert len(got) == len(made) + len(odd)
    for i, u in enumerate(made + odd):
        host, path, best = rule_by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1])
        assert got[i]["verdict"] == best[0] if best else got[i]["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0
    assert {x["verdict"] for x in urls.judge(pages.where("url is null")).collect()} == {"allow"}


def test_mixing(docs, none):
    got = mixing.taken_words(docs, block_words=16).collect()
    sizes = Counter((d, len(data.words(t))) for d, t in table(docs))
    assert Counter((r["doc_id"], r["size"]) for r in got) == sizes
    by_source = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in by_source.items():
        assert sum(taken) == min(math.floor(target + 0.5), 2 * size)
    assert sum(t for _, t in by_source) == pytest.approx(1.5 * sum(n for _, n in sizes.elements()))
    again = mixing.taken_words(docs.repartition(5), block_words=16).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    coarse = mixing.taken_words(docs, block_words=4096).collect()
    assert Counter(map(tuple, coarse)) == Counter(map(tuple, got))
    assert mixing.taken_words(none).count() == 0


def test_mixing_schedule_is_even(docs):
    """Any stretch of the mix holds the sources in about their shares."""
    _, targets, pieces = mixing.mix_plan(docs, block_words=16)
    slots = mixing.schedule(targets, 16).orderBy("time").collect()
    total = Counter(s["source_no"] for s in slots)
    for n in (len(slots) // 4, len(slots) // 2):
        seen = Counter(s["source_no"] for s in slots[:n])
        for source, count in total.items():
            assert abs(seen[source] - count * n / len(slots)) <= 2 + math.log2(len(slots))
    for source in total:
        assert sorted(s["rank"] for s in slots if s["source_no"] == source) == list(range(total[source]))


def test_mixed_documents(docs):
    mixed = mixing.mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    whole = {t for _, t in table(docs)}
    assert sum(r["text"] not in whole for r in mixed.collect()) <= docs.select("source").distinct().count()


BENCH = [("b1", None), ("b2", ""), ("b3", "Changed"), ("b4", "Line ONE"), ("b5", "!!!")]


def test_decontamination(spark, docs, none):
    passage = data.words(dict(table(docs))[29], True, data.ALNUM)[15:50]
    items = [*BENCH, ("b6", " ".join(passage)), ("b7", "x y " + "-".join(passage[3:14]) + " z"), (None, " ".join(passage[5:16]))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, n_words int")
    windows = {}
    for i, t in items:
        w = data.words(t, True, data.ALNUM)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    want = []
    for d, t in table(docs):
        w, hit, found = data.words(t, True, data.ALNUM), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= of
        ids = sorted(x for x in found if x is not None)
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    got = decontaminate.contamination(docs, bench)
    same(got, want, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sum(w[5] for w in want) >= 4
    assert decontaminate.contamination(none, bench).count() == 0
    assert not decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count()


def shingles(text, k):
    w = data.words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, none, k, percent):
    rows = table(docs)
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), NO_ID), NO_ID if d is None else d)
    want = [(d, len(sets[i]), least[root(i)] if least[root(i)] < NO_ID else None) for i, (d, _) in enumerate(rows)]
    same(jaccard.similar_components(docs, k, percent), want, "doc_id", "n_shingles", "component_id")
    assert len({w[2] for w in want}) < len(want) - 3
    assert jaccard.similar_components(none, k, percent).count() == 0


def test_jaccard_of_a_large_group(spark):
    """Members that are not all alike take several rounds of leaders."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(i % 4):
            w[(7 * i + 13 * j) % 60] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:30] + [f"y{r.randint(0, 10**9)}" for _ in range(40)])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: shingles(t, 4) for d, t in rows}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and label[b] < label[a]:
                    label[a], changed = label[b], True
    same(jaccard.similar_components(df), [(d, label[d]) for d in sets], "doc_id", "component_id")


def test_suffixes(docs, none):
    rows = table(docs)
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, NO_ID), NO_ID if d is None else d)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (NO_ID if d is None else d):
                gone[i : i + 50] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    same(suffixes.deduplicated(docs), want, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sum(w[2] > 0 for w in want) >= 5
    assert suffixes.deduplicated(none).count() == 0


def test_passages(docs, none):
    got = {}
    for r in passages.near_duplicate_passages(docs).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["word_from"], r["word_to"]))
    rows = [(d, data.words(t, True)) for d, t in table(docs)]
    where = {}
    for i, (_, w) in enumerate(rows):
        for p in range(len(w) - 49):
            where.setdefault(tuple(w[p : p + 50]), set()).add(i)
    exact = {d for d, w in rows for p in range(len(w) - 49) if len(where[tuple(w[p : p + 50])]) > 1}
    assert exact <= set(got)
    near = {2, 3, 34, 35}
    assert set(got) <= exact | near
    assert passages.near_duplicate_passages(none).count() == 0


def test_token_file(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(d, [*plain.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in table(docs)]
    got = tokenids.token_digests(docs, path).collect()
    digest = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(i), digest(i)) for d, i in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)
    assert tokenids.token_digests(none, path).count() == 0


def by_hand(text):
    w = data.words(text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(three), set()
    for i, x in enumerate(three):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if data.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, none):
    got = quality.judged(docs, prior_rows=8).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == Counter((d, *by_hand(t)) for d, t in table(docs))
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judged(none).count() == 0


def test_quality_rejects_outliers(spark):
    r = random.Random(4)
    rows = [(i, data.prose(r, "en", 80 + i % 40), "en", "s") for i in range(120)]
    rows += [(500 + i, " ".join(w + "$#%" for w in data.prose(r, "en", 90).split()), "en", "s") for i in range(4)]
    kept = {x["doc_id"] for x in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == set(range(120))


def test_quality_finds_the_least_determinant(spark):
    """Against concentration from many random starts in numpy, with a third of the rows far out along a line."""
    r = np.random.default_rng(7)
    x = r.normal(0, 1, (90, 5)) @ np.diag([0.3, 0.4, 0.5, 0.6, 0.7])
    x[:20] += np.array([4, -3, 5, 2, -4]) + r.normal(0, 0.05, (20, 5))
    floor, keep = np.diag(np.square(quality.FLOOR)), 68
    scale = 0.75 / quality.chi2_cdf(quality.chi2_quantile(0.75, 5), 7)
    best = np.inf
    for _ in range(300):
        inside = r.choice(90, 10, False)
        for _ in range(20):
            mean, cov = x[inside].mean(axis=0), np.cov(x[inside].T, bias=True) * scale + floor
            distance = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            inside = np.argsort(distance)[:keep]
        best = min(best, np.linalg.slogdet(cov)[1])
    df = spark.createDataFrame([("k", *map(float, row)) for row in x], "key string, x_0 double, x_1 double, x_2 double, x_3 double, x_4 double")
    got = quality._whitened(quality.robust_estimates(df)).first()
    assert got["log_det"] == pytest.approx(best, abs=0.15)
    assert abs(got["m_2"]) < 0.3


@pytest.mark.parametrize("most_words", [2_000_000, 3])
def test_language_model(docs, none, monkeypatch, most_words):
    monkeypatch.setattr(ngramlm, "MOST_WORDS", most_words)
    rows = [(d, [*data.words(t, True), None]) for d, t in table(docs)]
    part = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 7
    count = Counter(w for d, t in rows if d is not None and part(d) != 2 for w in t)
    n, v = sum(count.values()), len(count)
    want = Counter((d, part(d) == 2, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 5)) for d, t in rows)
    got = ngramlm.scored(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert ngramlm.scored(none).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 55)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 55: 50, 60: 50}
    assert components(links.limit(0)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing in common with anything at all here today really")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and set(got[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_output"]
