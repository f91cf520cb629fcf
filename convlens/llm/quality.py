"""Quality by regularised quadratic discriminant analysis of document statistics.

Each document gives a vector of statistics of its whole text, each transformed towards symmetry. Per class, mean and
covariance come from sums over all labelled rows (added up in the cluster; only the sums reach the driver). The
covariances are shrunk towards the pooled one and towards a diagonal, their Cholesky factors are computed once. The
difference of the two log densities plus the log prior odds is divided by a temperature before the logistic: words of one text are
not independent, so the densities alone are far too sure. The temperature is the one of a fixed grid with the least log loss on labelled rows,
each scored by a model of the other half (halves by a hash of the statistics), towards targets smoothed by the numbers of rows.

Null text counts as empty; very long texts are read whole; empty texts have defined statistics and a score. Labelled rows with a null label or
without a document are not learnt from. With no rows of one class every score is the smoothed share of label 1.
A document labelled twice is learnt from twice. Repeated rows are scored alike; an empty table gives an empty result.
Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import Scratch, bytes_of, claim, pieces_of, split_words

NAMES = (
    "words", "word_length", "symbols", "digits", "capitals", "blank_share", "stops", "no_letter_words", "same_as_last",
    "distinct_words", "top_word", "short_words", "long_words", "line_words",
)


#: Parts of one in which statistics are added up.
STEPS = 4096
#: Short texts are drawn to usual values as if they had so many more usual bytes and words.
PRIOR_BYTES, PRIOR_WORDS = 200.0, 30.0


def byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars.encode())] = 1
    return table


SYMBOL, DIGIT = byte_class("#$%&*+/<=>@[\\]^_`{|}~"), byte_class("0123456789")
CAPITAL, STOP, LINE = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_class(".!?"), byte_class("\n")
BLANK = byte_class(" \t\r\n\f\v")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    raw = bytes_of(texts)

    def share(table: np.ndarray, usual: float) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[raw], dtype=np.int64)))
        return (sums[ends] - sums[ends - sizes] + PRIOR_BYTES * usual) / (sizes + PRIOR_BYTES)

    codes, offsets, words = split_words(texts)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(n), counts)
    length = np.array([len(w) for w in words] or [0])
    letterless = np.array([not any(map(str.isalpha, w)) for w in words] or [False])

    def mean(x: np.ndarray, usual: float) -> np.ndarray:
        return (np.bincount(owner, weights=x, minlength=n) + PRIOR_WORDS * usual) / (counts + PRIOR_WORDS)

    lengths = length[codes] if len(codes) else np.zeros(0)
    same = np.zeros(len(codes))
    if len(codes) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = np.zeros(n), np.zeros(n)
    if len(codes):
        pairs = np.sort(owner * np.int64(len(words)) + codes)
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        runs, of = np.diff(np.append(first, len(pairs))), pairs[first] // len(words)
        distinct = np.bincount(of, minlength=n).astype(float)
        np.maximum.at(top, of, runs.astype(float))
    small = lambda x, e: np.log(x + e)
    return np.column_stack([
        np.log1p(counts),
        np.log1p(mean(lengths, 5.0)),
        small(share(SYMBOL, 0.001), 0.004),
        small(share(DIGIT, 0.005), 0.01),
        small(share(CAPITAL, 0.02), 0.01),
        share(BLANK, 0.16),
        small(share(STOP, 0.015), 0.01),
        small(mean(letterless[codes].astype(float) if len(codes) else np.zeros(0), 0.002), 0.01),
        small(mean(same, 0.005), 0.02),
        # Distinct words against what their number alone leads to expect.
        np.log((distinct + PRIOR_WORDS) / (counts + PRIOR_WORDS)) + 0.15 * np.log1p(counts),
        small((top + 2) / (counts + PRIOR_WORDS), 0.02),
        small(mean((lengths <= 3).astype(float), 0.3), 0.05),
        small(mean((lengths >= 9).astype(float), 0.2), 0.05),
        np.log1p((counts + 15.0) / (share(LINE, 0.01) * sizes + 1)),
    ])


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                x = statistics(batch.column("text"))
                flat = pa.array(x.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(compute, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors by class, and the temperature; ``share`` alone where a class has no rows."""

    share: float
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    constant: float = 0.0
    temperature: float = 1.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Logarithms, before the temperature."""
        q = [((x - m) @ w.T) for m, w in zip(self.means, self.whiten)]
        return self.constant + 0.5 * ((q[0] ** 2).sum(1) - (q[1] ** 2).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        odds = self.odds(x) / self.temperature
        small = np.exp(-np.abs(odds))
        return np.where(odds >= 0, 1.0, small) / (1 + small)


def sums_of(labelled: DataFrame) -> dict[int, np.ndarray]:
    """Of rows (x, label, half): by half, the sums of 1, x and x x' of each class, added up in the cluster.

    Sums are of whole numbers of 1 / STEPS, so they are the same in any order.
    """
    k = len(NAMES)
    width = 1 + k + k * k

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, width), np.int64)
        for batch in batches:
            y, half = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "half"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            for h in (0, 1):
                for c in (0, 1):
                    own = np.rint(x[(half == h) & (y == c)] * STEPS).astype(np.int64)
                    total[h, c] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    got = {r["at"]: r["v"] for r in labelled.mapInArrow(sums, "at long, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    total = np.array([float(got.get(i, 0)) for i in range(4 * width)]).reshape(2, 2, width)
    total[:, :, 1 : k + 1] /= STEPS
    total[:, :, k + 1 :] /= STEPS**2
    return {0: total[0], 1: total[1]}


def discriminant(total: np.ndarray, to_pooled: float, to_diagonal: float, least_variance: float) -> Discriminant:
    k = len(NAMES)
    n = total[:, 0]
    share = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Discriminant(share)
    means = total[:, 1 : k + 1] / n[:, None]
    cov = total[:, k + 1 :].reshape(2, k, k) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    whiten, logdet = [], []
    for c in (0, 1):
        s = (1 - to_pooled) * cov[c] + to_pooled * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + least_variance * np.eye(k)
        low = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(low))
        logdet.append(np.log(np.diag(low)).sum())
    return Discriminant(share, means, np.array(whiten), float(np.log(n[1] / n[0]) + logdet[0] - logdet[1]))


#: Temperatures that are tried, from 1 to 1000.
TEMPERATURES = 10 ** np.linspace(0, 3, 61)


def temperature(labelled: DataFrame, halves: dict[int, Discriminant], n: np.ndarray) -> float:
    """Of TEMPERATURES that with the least log loss; the targets are those of n + 2 rows, one of each other class."""
    targets = np.array([1 / (n[0] + 2), (n[1] + 1) / (n[1] + 2)])
    k = len(NAMES)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES), np.int64)
        for batch in batches:
            y, half = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "half"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            for h in (0, 1):
                own = half == h
                odds = halves[1 - h].odds(x[own])[:, None] / TEMPERATURES
                loss = np.logaddexp(0, odds) - targets[y[own]][:, None] * odds
                total += np.rint(loss * STEPS).astype(np.int64).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], ["at", "v"])

    got = labelled.mapInArrow(losses, "at long, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return float(TEMPERATURES[min(got, key=lambda r: (r["v"], r["at"]))["at"]])


def fit(labelled: DataFrame, *, to_pooled: float = 0.1, to_diagonal: float = 0.05, least_variance: float = 1e-3) -> Discriminant:
    """From rows (x, label)."""
    rows = labelled.select("x", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("x"), F.lit(2)).cast("int").alias("half"))
    by_half = sums_of(rows)
    shrunk = (to_pooled, to_diagonal, least_variance)
    total = by_half[0] + by_half[1]
    model, halves = discriminant(total, *shrunk), {h: discriminant(by_half[h], *shrunk) for h in (0, 1)}
    if model.means is None or any(m.means is None for m in halves.values()):
        return model
    return replace(model, temperature=temperature(rows, halves, total[:, 0]))


def score(vectors: DataFrame, model: Discriminant) -> DataFrame:
    k = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return vectors.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, score). ``learn_from`` is a condition on the labels' rows that may be learnt from."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    vectors = scratch.put(features(docs, id_col=id_col, text_col=text_col), "features")
    learn = labels.where(learn_from) if learn_from is not None else labels
    learn = learn.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
    return score(vectors, fit(vectors.join(learn, "doc_id")))
