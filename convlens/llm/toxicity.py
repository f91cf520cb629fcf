"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-case runs of letters; every term of a bounded sample of labelled rows counts, none is left out. Document
frequencies are counted over all documents. A weight is (1 + log count) times the inverse document frequency, times
how surely the sample shows that the term tells the label (from its likelihood ratio; a term that tells nothing keeps
``floor``). The examples' unit vectors lie in an inverted index whose postings are cut into blocks of examples, each
with its largest weight, so blocks whose upper bound is below the k-th best cosine are never opened; the result is
that of comparing with every example. Votes are weighted by closeness, and an isotonic fit to the examples' own votes,
each without itself, turns a vote into a calibrated score. The ids of the nearest examples are the evidence.

Null text counts as empty; very long texts are read whole. A text that shares no term with an example has no
neighbours; its score is the smoothed share of label 1 in the sample. Without a label-1 or a label-0 example all scores
are that share. Ties between equally near examples go to the smaller id. A document labelled both ways is learnt as
label 1; of rows that repeat a labelled id the least text is learnt. Repeated rows are scored alike; an empty table
gives an empty result. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import Scratch, claim, coded_words, collect_garbage, pieces_of, ranges, shared, trim

LETTERS = r"[^\p{L}]+"


def terms_of(texts: pa.Array, known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(ends by text, terms, counts, names): the terms of each text in ascending number, among ``known`` if given."""
    codes, offsets, words = coded_words(texts)
    lists = pc.split_pattern_regex(pc.utf8_lower(words), LETTERS)
    runs, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    if known is None:
        coded = runs.dictionary_encode()
        names, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.where(pc.equal(runs, "").to_numpy(zero_copy_only=False), -1, number)
    else:
        names, number = known, pc.fill_null(pc.index_in(runs, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, number = owner[number >= 0], number[number >= 0]
    size = np.bincount(owner, minlength=len(words)).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    starts, own = np.cumsum(size) - size, size[codes]
    text = np.repeat(np.searchsorted(offsets, np.arange(len(codes)), side="right") - 1, own)
    base = np.int64(max(1, len(names)))
    keys, counts = np.unique(text * base + number[ranges(starts[codes], own)], return_counts=True)
    return np.searchsorted(keys // base, np.arange(len(texts) + 1)), keys % base, counts, names


def example_terms(examples: DataFrame) -> DataFrame:
    """(label, term) of each example."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for whole in batches:
            for batch in pieces_of(whole, "text", 2_000_000):
                ends, terms, _, names = terms_of(batch.column("text"))
                row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
                yield pa.RecordBatch.from_arrays([batch.column("label").take(row), names.take(pa.array(terms)).cast(pa.string())], ["label", "term"])

    return examples.select("label", "text").mapInArrow(run, "label int, term string")


def term_counts(docs: DataFrame, vocabulary: pa.Array, *, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """(doc_id, row, terms, counts) of the vocabulary's terms over whole texts."""
    # The sample's terms, bounded by its rows.
    sent = shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for whole in batches:
            for batch in pieces_of(whole, "text", 2_000_000):
                ends, terms, counts, _ = terms_of(batch.column("text"), sent.value)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.astype(np.int32)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), lists(terms), lists(counts)], ["doc_id", "row", "terms", "counts"])
        trim()

    row = (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row, F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, terms array<int>, counts array<int>")


def telling(with_1: np.ndarray, with_any: np.ndarray, n_1: int, n: int, floor: float, least: float = 7.0, half: float = 40.0) -> np.ndarray:
    """From ``floor`` to 1 + ``floor``: how surely a term tells the label, by the likelihood ratio beyond ``least``."""
    gain = np.zeros(len(with_any))
    for seen, rows, share in ((with_1, with_any, n_1), (with_any - with_1, with_any, n - n_1)):
        for x, total in ((seen, rows), (share - seen, n - rows)):
            expected = total * share / n
            ok = x > 0
            gain[ok] += 2 * x[ok] * np.log(x[ok] / expected[ok])
    sure = np.maximum(0.0, gain - least)
    return sure / (sure + half) + floor


class Index:
    """Inverted index with block maxima over unit vectors (offsets, terms, weights); ``search`` is exact.

    ``rank`` settles ties: of equally near examples that of lower rank comes first.
    """

    def __init__(self, n_terms: int, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, rank: np.ndarray | None = None, block: int = 64):
        self.n, self.block = len(ends) - 1, block
        self.rank = np.arange(self.n) if rank is None else rank
        self.n_blocks = self.n // block + 1
        docs = np.repeat(np.arange(self.n), np.diff(ends))
        order = np.lexsort((docs, terms))
        self.docs, self.weights, terms = docs[order], weights[order], terms[order]
        key = terms.astype(np.int64) * self.n_blocks + self.docs // block
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.first, self.size = first, np.diff(np.append(first, len(key)))
        self.largest = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.of_block = key[first] % self.n_blocks
        edges = np.searchsorted(key[first] // self.n_blocks, np.arange(n_terms + 1))
        self.begin, self.blocks_of = edges[:-1], np.diff(edges)
        self.edges = np.searchsorted(terms, np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine, ties to the smaller number."""
        held = self.blocks_of[terms]
        part = ranges(self.begin[terms], held)
        weight, block = np.repeat(weights, held), self.of_block[part]
        bound = np.bincount(block, weight * self.largest[part], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ids, best, at = np.zeros(0, np.int64), np.zeros(0), 0
        while at < len(order):
            # First the two blocks of the highest bounds, then all that may still hold one of the k nearest.
            some = order[at : at + 2] if at == 0 else order[at:]
            if len(best) >= k:
                some = some[bound[some] + 1e-9 >= best[k - 1]]
            if not len(some):
                break
            opened = np.zeros(self.n_blocks, bool)
            opened[some] = True
            if 4 * len(some) > len(order):
                # Most blocks: whole lists, one after the other, and what was opened before left out.
                spans = [slice(a, b) for a, b in zip(self.edges[terms].tolist(), self.edges[terms + 1].tolist())]
                docs, weight_of = np.concatenate([self.docs[x] for x in spans]), np.concatenate([self.weights[x] for x in spans])
                sums = np.bincount(docs, np.repeat(weights, [x.stop - x.start for x in spans]) * weight_of, minlength=self.n)
                sums[~np.repeat(opened, self.block)[: self.n]] = 0
            else:
                take = opened[block]
                sizes = self.size[part[take]]
                posting = ranges(self.first[part[take]], sizes)
                sums = np.bincount(self.docs[posting], np.repeat(weight[take], sizes) * self.weights[posting], minlength=self.n)
            if without >= 0:
                sums[without] = 0
            if len(best) >= k:
                found = np.flatnonzero((sums > 0) & (sums + 1e-9 >= best[k - 1]))
            else:
                found = np.flatnonzero(sums > 0)
            ids, best = np.concatenate((ids, found)), np.concatenate((best, np.round(sums[found], 12)))
            if len(best) > k:
                near = np.flatnonzero(best >= np.partition(best, len(best) - k)[len(best) - k])
                ids, best = ids[near], best[near]
            near = np.lexsort((self.rank[ids], -best))[:k]
            ids, best = ids[near], best[near]
            at += 2 if at == 0 else len(order)
        return ids, best


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step fit of y on x: the least x of each step and the step's smoothed mean."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for v, t in zip(x[order], y[order]):
        steps.append([v, t, 1.0])
        while len(steps) > 1 and (steps[-2][0] == steps[-1][0] or steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]):
            last = steps.pop()
            steps[-1] = [steps[-1][0], steps[-1][1] + last[1], steps[-1][2] + last[2]]
    return np.array([e[0] for e in steps]), np.array([(e[1] + 0.1) / (e[2] + 0.2) for e in steps])


def calibrated(vote: float, steps: tuple[np.ndarray, np.ndarray]) -> float:
    """Between the middles of the steps' left ends a score rises in a straight line, so that votes differ in score."""
    return float(np.interp(vote, *steps))


@dataclass
class Neighbours:
    weight: np.ndarray
    share: float
    index: Index | None = None
    labels: np.ndarray | None = None
    ids: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None
    k: int = 15

    def vectors(self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of unit vectors that lie one after the other."""
        w = (1 + np.log(counts)) * self.weight[terms]
        norm = np.sqrt(np.bincount(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), w * w, minlength=len(ends) - 1))
        return w / np.repeat(np.maximum(norm, 1e-300), np.diff(ends))

    def vote(self, near: np.ndarray, cos: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(cos, 1.0))
        return float((w * self.labels[near]).sum() / w.sum()) if len(near) else 0.0

    def scores(self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[list[float], list[list[int]]]:
        if self.index is None:
            return [self.share] * (len(ends) - 1), [[]] * (len(ends) - 1)
        weights, out, evidence = self.vectors(ends, terms, counts), [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            near, cos = self.index.search(terms[a:b], weights[a:b], self.k)
            out.append(calibrated(self.vote(near, cos), self.steps) if len(near) else self.share)
            evidence.append(self.ids[near[:3]].tolist())
        return out, evidence


def fit(docs: DataFrame, labelled: DataFrame, scratch: Scratch, *, examples: int, floor: float, k: int, id_col: str, text_col: str, row_col: str | None) -> tuple[Neighbours, DataFrame]:
    """The model and the term counts of all documents. ``labelled`` has (doc_id, label)."""
    chosen = labelled.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    # At most ``examples`` rows of two numbers.
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(scratch.put(chosen, "chosen")), "doc_id")
    sample = scratch.put(sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")
    stats = example_terms(sample).groupBy("term").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("rows")).orderBy("term").toArrow().combine_chunks()
    vocabulary = pa.concat_arrays(stats["term"].chunks) if len(stats) else pa.array([], pa.string())
    vectors = scratch.put(term_counts(docs, vocabulary, id_col=id_col, text_col=text_col, row_col=row_col), "vectors")
    n = vectors.count()
    df = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow()
    frequency = np.zeros(len(vocabulary))
    frequency[df["t"].to_numpy()] = df["n"].to_numpy()
    # The driver's JVM lets go of what it no longer needs before the driver's own arrays are made.
    collect_garbage(docs.sparkSession)
    own = term_counts(sample, vocabulary, id_col="doc_id", text_col="text").join(sample.select("doc_id", "label"), "doc_id").orderBy("doc_id").toArrow()
    ids, y = own["doc_id"].to_numpy(), own["label"].to_numpy().astype(float)
    share = float((y.sum() + 0.1) / (len(y) + 0.2)) if len(y) else 0.5
    model = Neighbours(np.zeros(len(vocabulary)), share, k=k)
    if not len(vocabulary) or not 0 < y.sum() < len(y):
        return model, vectors
    sure = telling(stats["ones"].to_numpy().astype(float), stats["rows"].to_numpy().astype(float), int(y.sum()), len(y), floor)
    model.weight = (np.log((n + 1) / (frequency + 1)) + 1) * sure
    term, counts = (pc.list_flatten(own[c]).to_numpy() for c in ("terms", "counts"))  # 32 bits each
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(own["terms"]).to_numpy()))).astype(np.int64)
    del own, stats, df
    # Examples that share their most telling term, or their most frequent one, share blocks, so bounds are close.
    owner = np.repeat(np.arange(len(ids)), np.diff(ends))
    strongest, usual = np.full(len(ids), -1), np.full(len(ids), -1)
    by_weight, by_use = np.argsort(sure[term], kind="stable"), np.argsort(frequency[term], kind="stable")
    strongest[owner[by_weight]] = np.where(sure[term[by_weight]] > 0.3, term[by_weight], -1)
    usual[owner[by_use]] = term[by_use]
    order = np.lexsort((ids, usual, strongest))
    sizes = np.diff(ends)[order]
    take = ranges(ends[:-1][order], sizes)
    term, counts, ends, ids, y = term[take].astype(np.int64), counts[take].astype(np.int64), np.concatenate(([0], np.cumsum(sizes))), ids[order], y[order]
    del take, owner, by_weight, by_use
    weights = model.vectors(ends, term, counts)
    model.labels, model.ids = y, ids
    model.index = Index(len(vocabulary), ends, term, weights, np.argsort(np.argsort(ids, kind="stable")))
    del counts
    collect_garbage(docs.sparkSession)
    votes = [model.vote(*model.index.search(term[a:b], weights[a:b], k, without=i)) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
    model.steps = isotonic(np.array(votes), y)
    return model, vectors


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    learn_from: Column | None = None,
    examples: int = 4096,
    floor: float = 0.02,
    k: int = 15,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    row_col: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, row, score, evidence); ``row`` is the number in ``row_col``. At most ``examples`` labelled rows, chosen by a hash of the id, are learnt from."""
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    learn = labels.where(learn_from) if learn_from is not None else labels
    learn = learn.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null")
    model, vectors = fit(docs, learn, scratch, examples=examples, floor=floor, k=k, id_col=id_col, text_col=text_col, row_col=row_col)
    # Bounded by the terms of ``examples`` rows.
    sent = shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in (whole.slice(start, 2000) for whole in batches for start in range(0, whole.num_rows, 2000)):
            lists = batch.column("terms")
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
            terms, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "counts"))
            scores, evidence = sent.value.scores(ends, terms, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "row", "score", "evidence"]
            )

    return vectors.mapInArrow(run, "doc_id long, row long, score double, evidence array<long>")
