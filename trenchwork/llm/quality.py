"""Quality rules: text statistics and robust multivariate outliers (DataFrame functions only).

Statistics of each whole text are transformed to a vector; for every language and source a
minimum-covariance-determinant estimate is fitted. It starts from three deterministic estimates
(medians with median absolute deviations, the correlation of squashed coordinates, and that of
spatial signs); each is concentrated twice: keep the three quarters of the rows with the least
Mahalanobis distance, take their mean and covariance. The start with the least determinant is then
concentrated until its determinant falls no more. A document is kept if it passes the fixed rules
and its distance is not beyond the cutoff.

The covariance gets a small variance added in each coordinate, so that a statistic that hardly
varies in a group does not make tiny deviations outliers. Every group's estimate is drawn towards that over all
rows, with the weight of ``prior_rows`` rows, so that small groups have one too.

Defined results: a null or wordless text has zero counts and fails the base rule; null languages
and sources form groups of their own; repeated rows are judged each; an empty table gives an
empty result. Only ``doc_id``, ``text``, ``lang`` and ``source`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import join_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Standard deviations that are added to each coordinate's spread, in the order of ``vector``.
FLOOR = (0.05, 0.10, 0.07, 0.15, 0.30)
D = len(FLOOR)


def _without(column: str, characters: str) -> Column:
    return F.length(F.translate(column, characters, ""))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Three-word windows are compared by hash, sorted within the row's own array: no row is split
    or shuffled for it.
    """
    base = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    words = base.select(
        "doc_id", "lang", "source",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        _without("text", SPACES).cast("long").alias("word_chars"),
        (F.length("text") - _without("text", SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    w = F.col("words")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    hashed = words.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) > 3, F.sort_array(windows)).alias("windows"),
    )
    s = F.col("windows")
    pairs = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    covered = F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    return hashed.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(s.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def vector() -> list[Column]:
    """The transformed statistics of a row with words."""
    n = F.col("n_words")
    return [
        F.log(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
        F.log(n.cast("double")),
    ]


def chi2_cdf(x: float, d: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    a, t = d / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= t / k
        total += term
    return total * math.exp(a * math.log(t) - t - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, d) < p else (lo, mid)
    return hi


MEANS = [f"m_{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
COVARIANCES = [f"c_{i}_{j}" for i, j in PAIRS]


def _whitened(stats: DataFrame) -> DataFrame:
    """With w_i_j, the inverse of the Cholesky factor of c_i_j, and the logarithm of the determinant."""
    out = stats
    for i, j in PAIRS:
        c = F.col(f"c_{i}_{j}")
        for k in range(j):
            c = c - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l_{j}_{j}"))
    for i, j in PAIRS:
        if i == j:
            w = F.lit(1.0) / F.col(f"l_{i}_{i}")
        else:
            w = F.lit(0.0)
            for k in range(j, i):
                w = w - F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}")
            w = w / F.col(f"l_{i}_{i}")
        out = out.withColumn(f"w_{i}_{j}", w)
    determinant = sum((2 * F.log(f"l_{i}_{i}") for i in range(D)), F.lit(0.0))
    return out.select(*stats.columns, determinant.alias("log_det"), *[f"w_{i}_{j}" for i, j in PAIRS])


def _with_distance(rows: DataFrame, stats: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    squares = None
    for i in range(D):
        z = sum((F.col(f"w_{i}_{j}") * (F.col(f"x_{j}") - F.col(f"m_{j}")) for j in range(i + 1)), F.lit(0.0))
        squares = z * z if squares is None else squares + z * z
    return join_small(rows, stats, "key").withColumn("distance", squares).select(*rows.columns, *also, "distance")


def _few(groups: DataFrame, name: str) -> DataFrame:
    """A written table with a row for each group or start, in a few files."""
    return materialize(groups.coalesce(4), name)


def _starts(rows: DataFrame) -> DataFrame:
    """(key, start, means, covariances): three estimates that outliers do not carry away."""
    medians = _few(rows.groupBy("key").agg(*[F.percentile_approx(f"x_{i}", 0.5, 1000).alias(f"m_{i}") for i in range(D)]), "mcd-medians")
    off = join_small(rows, medians, "key").groupBy("key").agg(*[F.first(m).alias(m) for m in MEANS], *[F.percentile_approx(F.abs(F.col(f"x_{i}") - F.col(f"m_{i}")), 0.5, 1000).alias(f"d_{i}") for i in range(D)])
    scale = [F.sqrt(F.pow(F.col(f"d_{i}") * 1.4826, 2) + FLOOR[i] ** 2).alias(f"s_{i}") for i in range(D)]
    scales = _few(off.select("key", *MEANS, *scale), "mcd-scales")
    z = [((F.col(f"x_{i}") - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"z_{i}") for i in range(D)]
    near = join_small(rows, scales, "key").select("key", *z)
    norm = F.sqrt(F.greatest(sum((F.pow(f"z_{i}", 2) for i in range(D)), F.lit(0.0)), F.lit(1e-12)))
    squashed, sign = [F.tanh(f"z_{i}") for i in range(D)], [F.col(f"z_{i}") / norm for i in range(D)]
    sums = [F.avg(of[i] * of[j]).alias(f"{name}_{i}_{j}") for name, of in (("t", squashed), ("g", sign)) for i, j in PAIRS]
    both = near.groupBy("key").agg(*sums).join(scales, "key")
    out = None
    for start, name in enumerate(("", "t", "g")):
        # Correlations of the squashed values or signs, with the robust spreads.
        r = lambda i, j: F.lit(float(i == j)) if not name else F.when(F.lit(i == j), 1.0).otherwise(F.col(f"{name}_{i}_{j}") / F.sqrt((F.col(f"{name}_{i}_{i}") + 0.01) * (F.col(f"{name}_{j}_{j}") + 0.01)))  # noqa: B023, E731
        one = both.select("key", F.lit(start).alias("start"), *MEANS, *[(r(i, j) * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}") for i, j in PAIRS])
        out = one if out is None else out.unionByName(one)
    return out


def robust_estimates(rows: DataFrame, half: float = 0.75) -> DataFrame:
    """Mean and covariance of each key of ``rows`` (key, x_0.. x_4), one row for each key.

    Each start is concentrated twice, then that of the least determinant until no group's falls any more. A step that
    does not make a group's determinant fall is not taken, so determinants only fall, and there is an end (they have a floor).
    """
    scale = half / chi2_cdf(chi2_quantile(half, D), D + 2)
    stats, step = _few(_whitened(_starts(rows)), "mcd-start"), 0
    while True:
        near = _with_distance(rows, stats, ("start",))
        limits = _few(near.groupBy("key", "start").agg(F.percentile_approx("distance", half, 1000).alias("limit")), f"mcd-limits-{step}")
        inner = join_small(near, limits, ["key", "start"]).where("distance <= limit")
        moments = inner.groupBy("key", "start").agg(
            *[F.avg(f"x_{i}").alias(f"m_{i}") for i in range(D)],
            *[(F.covar_pop(f"x_{i}", f"x_{j}") * scale + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS],
        )
        before, stats = stats, _few(_whitened(moments), f"mcd-step-{step}")
        if step == 1:
            best = stats.groupBy("key").agg(F.min(F.struct("log_det", "start")).alias("best")).select("key", "best.start")
            stats = _few(stats.join(best, ["key", "start"]), "mcd-best")
        elif step > 1:
            both = stats.select("key", F.struct(*stats.columns).alias("new")).join(before.select("key", F.struct(*stats.columns).alias("old")), "key")
            fallen = F.col("old.log_det") - F.col("new.log_det") > 1e-3
            stats = _few(both.select(F.when(fallen, F.col("new")).otherwise(F.col("old")).alias("row"), fallen.alias("fallen")).select("row.*", "fallen"), f"mcd-kept-{step}")
            if not stats.where("fallen").limit(1).count():
                break
            stats = stats.drop("fallen")
        elif not stats.limit(1).count():
            break
        step += 1
    return stats.select("key", *MEANS, *COVARIANCES)


def judged(docs: DataFrame, least_words: int = 50, most_repeated: int = 50, prior_rows: int = 50, confidence: float = 0.999999) -> DataFrame:
    """doc_id, the five counts, base_failed, distance (null where not judged) and kept."""
    n = F.col("n_words")
    base = (n < least_words) | (100 * F.col("n_repeat_words") > most_repeated * n)
    rows = materialize(text_statistics(docs).withColumn("base_failed", base), "text-statistics")
    passed = rows.where("not base_failed").withColumn("key", F.to_json(F.struct("lang", "source"))).select(*rows.columns, "key", *[x.alias(f"x_{i}") for i, x in enumerate(vector())])
    of_all = F.lit("all")
    narrow = passed.select("key", *[f"x_{i}" for i in range(D)])
    # Each row counts in its own group and among all; the JSON of a struct is never "all".
    estimates = _few(robust_estimates(narrow.withColumn("key", F.explode(F.array("key", of_all)))), "mcd-estimates")
    every = estimates.where(F.col("key") == of_all).select(*[F.col(c).alias(f"all_{c}") for c in (*MEANS, *COVARIANCES)])
    sizes = passed.groupBy("key").agg(F.count("*").alias("rows"))
    # One row is joined to all.
    own = estimates.join(sizes, "key").crossJoin(F.broadcast(every.limit(1)))
    drawn = [((F.col("rows") * F.col(c) + prior_rows * F.col(f"all_{c}")) / (F.col("rows") + prior_rows)).alias(c) for c in (*MEANS, *COVARIANCES)]
    fitted = _few(_whitened(own.select("key", *drawn)), "mcd-fitted")
    cutoff = chi2_quantile(confidence, D)
    out = [*rows.columns, "distance"]
    judged_rows = _with_distance(passed, fitted).select(out).unionByName(rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")).select(out))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return judged_rows.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
