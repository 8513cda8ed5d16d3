"""Language identification with a byte convolutional network.

A text is lower-cased and cut into windows of ``WINDOW`` bytes; each window goes through a byte
embedding, filters of several widths, a rectifier, max pooling and softmax. A text's prediction
is the mean over all its windows, weighted by their bytes. The network is trained in numpy on the
driver from a bounded sample: at most ``rows_per_language`` texts of each language, at most
``SAMPLE_CHARS`` characters of each, chosen by hash, of at most ``MOST_LANGUAGES`` languages.
Of equally probable languages the first in the sample's order, by name, is taken.

Defined results: a null text and a text without letters get ``und`` and score 0; a null label is
no training row; a null doc_id is never held out and never trained on; with no labelled text at
all, every text gets ``und``. Repeated rows are predicted each; columns other than doc_id, text
and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import bounded_batches, flat, pieces

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4, 5), 8, 6
SAMPLE_CHARS, MOST_LANGUAGES = 600, 256
WIDEST = max(WIDTHS)


class ByteNet:
    """Embedding, filters of several widths, max pooling and a softmax layer."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.labels = labels
        self.mask = np.zeros((WIDEST * DIM, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p = {
            "embed": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "conv": (r.normal(0, 0.4, self.mask.shape) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": r.normal(0, 0.1, (n, len(labels))).astype(np.float32),
            "out_bias": np.zeros(len(labels), np.float32),
        }
        self.p["embed"][0] = 0

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        e = p["embed"][x]
        columns = sliding_window_view(e, WIDEST, axis=1).transpose(0, 1, 3, 2).reshape(-1, WIDEST * DIM)
        return columns, (columns @ p["conv"]).reshape(len(x), -1, p["conv"].shape[1])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x: windows of bytes, (n, WINDOW) uint8."""
        _, h = self._pooled(x)
        z = np.maximum(h.max(axis=1) + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        columns, h = self._pooled(x)
        at = h.argmax(axis=1)
        top = np.take_along_axis(h, at[:, None, :], axis=1)[:, 0] + p["bias"]
        pooled = np.maximum(top, 0)
        z = pooled @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        back = (d @ p["out"].T) * (top > 0)
        seen = columns.reshape(n, -1, WIDEST * DIM)[np.arange(n)[:, None], at]
        g_conv = np.einsum("bf,bfc->cf", back, seen) * self.mask
        g_embed = np.zeros_like(p["embed"])
        to_input = (back[:, :, None] * p["conv"].T[None]).reshape(n, -1, WIDEST, DIM)
        places = at[:, :, None] + np.arange(WIDEST)
        np.add.at(g_embed, x[np.arange(n)[:, None, None], places], to_input)
        g_embed[0] = 0
        return {"embed": g_embed, "conv": g_conv, "bias": back.sum(0), "out": pooled.T @ d, "out_bias": d.sum(0)}


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, bytes of each); the last window of a row is filled up with zeros."""
    counts = -(-np.diff(offsets) // WINDOW)
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[row] + within * WINDOW
    length = np.minimum(WINDOW, offsets[row + 1] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    x = sliding_window_view(padded, WINDOW)[start].copy()
    x[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
    return x, row, length


def train(texts: list[str], labels: list[str], epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Fit by Adam on windows of the texts, a third of them cut short."""
    names = sorted(set(labels))
    net = ByteNet(names, seed)
    x, row, length = windows_of(*flat(pc.utf8_lower(pa.array(texts, pa.large_string()))))
    number = {name: i for i, name in enumerate(names)}
    y = np.array([number[v] for v in labels], np.int64)[row]
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(x))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            part = x[pick].copy()
            short = r.random(len(pick)) < 0.33
            part[short[:, None] & (np.arange(WINDOW)[None] >= r.integers(12, WINDOW, len(pick))[:, None])] = 0
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, g in net.gradients(part, y[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def training_sample(docs: DataFrame, rows_per_language: int) -> tuple[list[str], list[str]]:
    """Texts and labels of the training folds; equally likely within a language, at most so many of each
    of the MOST_LANGUAGES most frequent ones. Held-out documents are not even counted."""
    learnt = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", 4, 2))
    labelled = learnt.where(F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("doc_id").alias("h"), "text")
    counts = {r["lang"]: r["n"] for r in learnt.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[v for k, n in counts.items() for v in (F.lit(k), F.lit(min(1.0, 3.0 * rows_per_language / n)))])
    near = labelled.where(F.col("lang").isin(list(counts))).where(F.pmod("h", F.lit(1 << 20)) / float(1 << 20) < F.element_at(share, F.col("lang")))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    near = near.select("lang", "h", F.col("text").substr(place, F.lit(SAMPLE_CHARS)).alias("text"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    rows = ranked.where(F.col("rank") <= rows_per_language).orderBy("lang", "rank").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def predict(net: ByteNet | None, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text."""
    known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    pred, score = np.full(len(known), "und", object), np.zeros(len(known))
    if net is not None and known.any():
        x, row, length = windows_of(*flat(pc.utf8_lower(text)))
        total = np.zeros((len(known), len(net.labels)))
        for at in range(0, len(x), 256):
            of = slice(at, at + 256)
            np.add.at(total, row[of], net.probabilities(x[of]) * length[of, None])
        mean = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
        best = mean.argmax(axis=1)
        pred[known] = np.array(net.labels, object)[best[known]]
        score[known] = np.minimum(1.0, mean[np.arange(len(best)), best][known])
    return pred, score


def _trained(docs: DataFrame, rows_per_language: int) -> ByteNet | None:
    bounded_batches(docs.sparkSession)
    texts, labels = training_sample(docs, rows_per_language)
    return train(texts, labels) if texts else None


def identify(docs: DataFrame, rows_per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    net, kind = _trained(docs, rows_per_language), dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            pred, score = predict(net, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least_score: float, rows_per_language: int = 400) -> DataFrame:
    """The documents whose language is known with at least this score, all their columns as they are."""
    net = _trained(docs, rows_per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            pred, score = predict(net, batch.column("text"))
            yield batch.filter(pa.array((pred != "und") & (score >= least_score)))

    return docs.mapInArrow(run, docs.schema)
