"""Stages where ids are null or repeated."""

import random
from collections import Counter

import corpus_pipeline


def prose(seed, n=120):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def test_null_and_repeated_ids(spark, tmp_path):
    a, b, c, d, e = (" ".join(prose(i)) for i in range(5))
    item = " ".join(prose(9, 15))
    rows = [(None, a), (None, a + " more"), (None, b), (7, c), (7, d), (5, c + " more"), (3, d + " more"), (7, e), (7, e), (None, f"{e} {item}"), (8, f"{b} {item} {a}"), (8, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and len(x & y) >= 0.8 * len(x | y):
                label = [label[j] if v == label[i] else v for v in label]
    groups = {}
    for v, row in zip(label, rows):
        groups.setdefault(v, []).append(row)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert sum(got.values()) == len(groups)
    for group in groups.values():
        least = min(group, key=lambda x: (x[0] is None, x[0] or 0))[0]
        assert sum(got[x] for x in set(group)) == 1 and sum(got[x] for x in set(group) if x[0] == least) == 1
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect())
    assert clean == Counter(x for x in rows if item not in x[1])


def test_equal_rows_are_joined_once(spark):
    """Two thousand equal rows with null ids: one row of the join, and one that stays."""
    text = " ".join(prose(1))
    docs = spark.range(2000).selectExpr("cast(null as long) as doc_id", f"'{text}' as text").unionByName(spark.createDataFrame([(1, " ".join(prose(2))), (None, None), (None, None)], "doc_id long, text string"))
    keyed = docs.withColumn("_key", corpus_pipeline.row_key())
    groups = keyed.selectExpr("_key as doc_id", "_key as component_id")
    assert corpus_pipeline.one_row_each(keyed, groups).count() == 3
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == Counter([(None, text), (1, " ".join(prose(2))), (None, None)])
