"""URL filtering: path rules, and gradient-boosted trees on lexical features for the rest.

URLs that a rule fits are the labelled ones. Trees are trained in numpy on the driver from at
most ``most_rows`` of them, chosen by hash; suffix statistics (how common a host's last labels
are and how often labelled URLs under them are blocked) are counted over all URLs, in a fixed
number of hashed buckets.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and is
judged by the trees on its (empty or whole) text; without labelled URLs of both verdicts, the
method's verdict is the only one known, or ``allow``. Repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import flat, pieces

#: (verdict, host and path) of each rule.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BUCKETS = 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


FEATURES = ("length", "host_length", "path_length", "depth", "digits", "entropy", "parameters", "dots", "hyphens", "suffix_share", "suffix_blocked", "domain_share", "domain_blocked")


def features(batch: pa.RecordBatch, suffixes: np.ndarray) -> np.ndarray:
    """Rows of FEATURES for the columns url, host_length, path_length, suffix and domain."""
    data, offsets = flat(batch.column("url"))
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    counts = np.bincount(row * 256 + data, minlength=256 * len(size)).reshape(-1, 256).astype(np.float64)
    share = counts / np.maximum(size, 1)[:, None]
    logs = np.log2(share, out=np.zeros_like(share), where=share > 0)
    at = {c: counts[:, ord(c)] for c in "/?&=.-"}
    whole = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    return np.column_stack(
        [
            size, whole("host_length"), whole("path_length"), at["/"], counts[:, 48:58].sum(1) / np.maximum(size, 1), -(share * logs).sum(1),
            at["?"] + at["&"] + at["="], at["."], at["-"], suffixes[whole("suffix")], suffixes[whole("domain")],
        ]
    ).astype(np.float32)


@dataclass
class Trees:
    """Boosted trees of one depth, in arrays: node ``i`` has children ``2i+1`` and ``2i+2``."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
            out += leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Logistic boosting with second-order gains over quantile bins."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(d)])
    rate_y = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_y / (1 - rate_y)))
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, limit, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            cut = np.full(width, bins + 1)
            for f in range(d):
                key = (node - first) * (bins + 1) + binned[:, f]
                gs = np.cumsum(np.bincount(key, g, width * (bins + 1)).reshape(width, -1), axis=1)
                hs = np.cumsum(np.bincount(key, h, width * (bins + 1)).reshape(width, -1), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge))[:, : len(edges[f])]
                if gain.shape[1]:
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better], cut[better] = top[better], at[better]
                    feature[t, first : first + width][better] = f
                    limit[t, first : first + width][better] = edges[f][at[better]]
            split = cut[node - first]
            node = 2 * node + 1 + (binned[np.arange(n), feature[t][node]] > split)
        place = node - inner
        leaf[t] = -rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + ridge)
        margin += leaf[t][place]
    return Trees(base, feature, limit, leaf)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, most_rows: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block) for every page."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    labels = F.split("host", r"\.")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    rows = split.select(
        "page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"),
        F.length("host").alias("host_length"), F.length("path").alias("path_length"),
        bucket(F.element_at(labels, -1)).alias("suffix"), bucket(F.substring_index("host", ".", -2)).alias("domain"),
    )
    label = F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)
    both = rows.select(F.explode(F.array("suffix", "domain")).alias("bucket"), label.alias("y"))
    # One row for each bucket, BUCKETS at most.
    stats = both.groupBy("bucket").agg(F.count("*").alias("n"), F.count("y").alias("known"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("blocked")).collect()
    total = max(1, sum(r["n"] for r in stats))
    known, blocked = sum(r["known"] for r in stats), sum(r["blocked"] for r in stats)
    prior = blocked / known if known else 0.5
    suffixes = np.tile(np.array([0.0, prior], np.float32), (BUCKETS, 1))
    for r in stats:
        suffixes[r["bucket"]] = r["n"] / total, (r["blocked"] + 10 * prior) / (r["known"] + 10)
    used = ["url", "host_length", "path_length", "suffix", "domain"]
    trees, constant = None, 1.0 if known and blocked == known else 0.0
    if 0 < blocked < known:
        keep = F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * most_rows / (known / 2)))
        sample = rows.where(keep & label.isNotNull()).select(*used, label.alias("y")).orderBy(F.xxhash64("url"), "url").limit(most_rows).toArrow().combine_chunks()
        if sample.num_rows:
            trees = boost(np.concatenate([features(b, suffixes) for b in sample.to_batches()]), np.concatenate([b.column("y").to_numpy(zero_copy_only=False) for b in sample.to_batches()]))
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "url", 1 << 19):
            x = features(batch, suffixes)
            score = 1 / (1 + np.exp(-trees.margins(x))) if trees is not None else np.full(len(x), constant)
            own = np.where(score > 0.5, "block", "allow").astype(object)
            ruled = np.array(batch.column("ruled").to_pylist(), object)
            verdict = np.where(ruled == None, own, ruled)  # noqa: E711
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(score.astype(np.float64))], ["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.select("page_id", "host", "path", "rule", "ruled", *used).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
