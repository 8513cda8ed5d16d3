"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, merkle, mixing, ngramlm, passages, quality, sentencepieces, suffixes, tokenids, urls, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), rules=urls.RULES)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(_read(spark, sf_dir, "documents"))


def op6_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenids.token_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_read(spark, sf_dir, "documents"), least_words=50, most_repeated=50)


def op9_ngramlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.scored(_read(spark, sf_dir, "documents"), folds=7, fold=2)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_read(spark, sf_dir, "embeddings"), scale=256.0, components=4)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(_read(spark, sf_dir, "documents"), arity=3)


def op13_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepieces.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def embedding_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of op11_whitening, which SQL can give too: n and deviation of every row."""
    return whitening.whitened(_read(spark, sf_dir, "embeddings"), scale=256.0, components=1).select("vec_id", "n", "deviation")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8_quality, which SQL can give too."""
    return quality.text_statistics(_read(spark, sf_dir, "documents")).drop("lang", "source")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say in op2_urls: host, path, rule, and a verdict where one fits."""
    judged = urls.judge(_read(spark, sf_dir, "pages"), rules=urls.RULES)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_urls": op2_urls,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_passages": op5_passages,
    "op6_tokenids": op6_tokenids,
    "op7_suffixes": op7_suffixes,
    "op8_quality": op8_quality,
    "op9_ngramlm": op9_ngramlm,
    "op10_jaccard": op10_jaccard,
    "op11_whitening": op11_whitening,
    "op12_merkle": op12_merkle,
    "op13_sentencepieces": op13_sentencepieces,
    "embedding_deviation": embedding_deviation,
    "quality_counts": quality_counts,
    "url_rules": url_rules,
}

ORACLE_SQL: dict[str, str] = {
    "embedding_deviation": r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
f AS (SELECT DISTINCT x FROM e),
m AS (SELECT len(x) AS d, count(*) AS n FROM f GROUP BY 1),
s AS (SELECT d, k, sum(v)::HUGEINT AS s FROM (SELECT len(x) AS d, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS k FROM f) GROUP BY 1, 2),
u AS (SELECT r, vec_id, len(x) AS d, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS k FROM e)
SELECT vec_id, n::BIGINT AS n, sum((n * v - s) * (n * v - s))::BIGINT AS deviation FROM u JOIN m USING (d) JOIN s USING (d, k) GROUP BY r, vec_id, n""",
    "op12_merkle": r"""
WITH RECURSIVE d AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n,
    list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda p: ascii(substr(doc_id::VARCHAR, p, 1))::BIGINT),
      lambda c, b: list_reduce(range(8), lambda a, j: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295::BIGINT) & 1 AS low
  FROM documents),
f AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, replace(text, chr(10), '') AS cut FROM d),
leaf AS (
  SELECT g, i, n, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN low = 1 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS seen FROM f),
low(lvl, g, i, n, h) AS (
  SELECT 0, g, i, n, leaf FROM leaf
  UNION ALL SELECT lvl + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lvl, g, i // 3, n),
top AS (SELECT g, h FROM low WHERE n = 1),
high(lvl, i, n, h) AS (
  SELECT 100, g, (SELECT count(*) FROM top), h FROM top
  UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 3, n),
node AS (SELECT lvl, g, i, h FROM low WHERE n > 1 UNION ALL SELECT lvl, -1, i, h FROM high WHERE n > 1),
family AS (
  SELECT a.lvl, a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM node a JOIN node b ON a.lvl = b.lvl AND a.g = b.g AND a.i // 3 = b.i // 3 GROUP BY ALL),
step AS (
  SELECT x.g, x.i, y.lvl, y.l, y.r FROM leaf x JOIN family y ON y.g = x.g AND y.i = x.i // (3 ** y.lvl)::BIGINT
  UNION ALL SELECT x.g, x.i, y.lvl, y.l, y.r FROM leaf x JOIN family y ON y.g = -1 AND y.i = x.g // (3 ** (y.lvl - 100))::BIGINT),
proof AS (SELECT g, i, string_agg(l || r, '' ORDER BY lvl) AS p, list(l || '|' || r ORDER BY lvl) AS steps FROM step GROUP BY g, i),
folded AS (
  SELECT leaf.*, top.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(coalesce(p, '')) AS proof_sha256,
    list_reduce(coalesce(steps, []), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2)), seen) AS folded_root
  FROM leaf JOIN top USING (g) LEFT JOIN proof USING (g, i))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
    "quality_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "url_rules": r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
f AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule) AS rn FROM u JOIN r
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, length(split_part(rule, '/', 1)) + 1)))
SELECT page_id, host, path, rule, verdict FROM u LEFT JOIN (SELECT * FROM f WHERE rn = 1) USING (page_id)""",
    "op3_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_no
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(source_no % 3 + 1)::INTEGER] AS weight, 2.0::DOUBLE * source_size AS most FROM src),
levels AS (
  SELECT *, most / weight AS fill,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM weighed)::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
chosen AS (SELECT level AS first_level FROM levels WHERE level < fill ORDER BY fill, source_no LIMIT 1),
targets AS (
  SELECT source, source_size, coalesce(least(most, weight * (SELECT first_level FROM chosen)), most) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, least(floor(t.target + 0.5), 2.0 * t.source_size)::BIGINT AS to_take,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE (to_take // source_size) * size
     + greatest(0, least(size, to_take % source_size - start)) END)::BIGINT AS taken
FROM placed""",
    "op4_decontamination": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM item WHERE len(w) > 0)),
doc_window AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, n, item_id FROM doc_window JOIN item_window USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_jaccard": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM doc WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node)
SELECT doc.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, (SELECT min(root) FROM reach WHERE node = doc.doc_id)::BIGINT AS component_id
FROM doc LEFT JOIN sizes USING (doc_id)""",
    "op7_suffixes": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (
  SELECT doc_id, i, substr(hx, 2 * i - 1, 100) AS s
  FROM (SELECT doc_id, hx, unnest(range(1, length(hx) // 2 - 48)) AS i FROM d WHERE length(hx) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS brk FROM r),
q AS (SELECT doc_id, i, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS b FROM q GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS p FROM runs),
kept AS (
  SELECT doc_id, string_agg(substr(hx, 2 * p + 1, 2 * (a - p - 1)), '' ORDER BY run) AS head, max(b) AS last, count(*) AS n_spans, sum(b - a + 1) AS n_removed
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substr(hx, 2 * last + 1), hx))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
