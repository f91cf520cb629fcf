"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs with at most k edits shares at least m - q + 1 - k q character q-grams with the
place, on diagonals that differ by at most k. Every text's q-grams are looked up among the items' (a bit table first,
then exact hashes); hits are counted per item in overlapping bands of diagonals 2 (k + 1) wide, one starting every
k + 1; bands that reach the bound are aligned with the item by a banded edit distance. A bound the lemma proves loses
no occurrence within the budget. q-grams that many items share (a template of prompts) are left out of the count of an
item that has enough others: its bound falls by as many as it has of them, which the lemma proves just as well.

Both texts are compared in lower case with runs of white space as one blank; ``start`` and ``end`` are positions in that
form of the text. Items of fewer than ``least_chars`` characters, null items included, are not searched for: they say
nothing about a leak. Null and empty texts have no hits; very long texts are read whole. Of equally good places of an
item in a text the first is given. Repeated rows and copies are each reported; repeated items by each of their ids.
Empty tables give an empty result. Only the named columns are read, so other columns may have any name. The items go
out in slices of at most ``slice_chars`` characters, and each Python worker indexes a slice once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import KEPT, claim, pieces_of, ranges, shared, trim

SPREAD = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, item_id long, start long, end long, edits int"


def plain(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\s\s+|[^\S ]", " "), " ")


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each position."""
    h = np.zeros(max(0, len(codes) - q + 1), np.uint64)
    for k in range(q):
        h *= np.uint64(0x100000001B3)
        h += codes[k : k + len(h)]
    return h * SPREAD


@dataclass
class Items:
    """The items of one slice with an inverted index of their q-grams."""

    ids: np.ndarray
    texts: list[str]
    q: int
    rate: float
    common: int = 64

    def __post_init__(self):
        sizes = np.array([len(t) for t in self.texts])
        # As many edits as the rate allows and the lemma still bounds by one shared q-gram.
        self.budget = np.minimum(np.floor(sizes * self.rate), (sizes - self.q) // self.q).astype(int)
        self.bound = sizes - self.q + 1 - self.budget * self.q
        hashes = [gram_hashes(code_points(t), self.q) for t in self.texts]
        item = np.repeat(np.arange(len(self.texts)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        flat = np.concatenate(hashes)
        # q-grams of more than ``common`` places are not counted for items that keep a quarter of their bound without them.
        _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
        both = times[which] > self.common
        n_shared = np.bincount(item[both], minlength=len(self.texts))
        without = self.bound - n_shared >= np.maximum(1, self.bound // 4)
        self.bound = np.where(without, self.bound - n_shared, self.bound)
        counted = ~(both & without[item])
        item, place, flat = item[counted], place[counted], flat[counted]
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first, self.count = first, np.diff(np.append(first, len(flat)))
        self.item, self.place = item[order], place[order]
        wide = int(np.clip(np.ceil(np.log2(len(self.grams) + 1)) + 5, 16, 26))
        self.shift, self.bits = np.uint64(64 - wide), np.zeros(1 << wide, bool)
        self.bits[self.grams >> self.shift] = True


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def alignment(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of ``item`` in ``text`` along diagonals low to high, if at most ``most`` edits."""
    width, never = high - low + 1, most + 1
    lanes = np.arange(low, high + 1)
    inside = (lanes >= 0) & (lanes <= len(text))
    cost = np.where(inside, 0, never)
    origin = lanes.copy()
    for i, c in enumerate(item):
        at = lanes + i
        match = np.full(width, 1)
        ok = (at >= 0) & (at < len(text))
        match[ok] = text[at[ok]] != c
        new = np.where(ok, np.minimum(cost + match, never), never)
        source = origin.copy()
        down = np.append(cost[1:] + 1, never)  # the item's character is missing in the text
        better = down < new
        new, source = np.where(better, down, new), np.where(better, np.append(origin[1:], 0), source)
        # Characters that only the text has: a running minimum along the band.
        lift = new - np.arange(width)
        best = np.minimum.accumulate(lift)
        at_best = np.maximum.accumulate(np.where(lift == best, np.arange(width), 0))
        cost, origin = np.minimum(best + np.arange(width), never), source[at_best]
        if cost.min() > most:
            return None
    ends = lanes + len(item)
    cost = np.where((ends >= 0) & (ends <= len(text)), cost, never)
    k = int(np.lexsort((np.abs(ends - origin - len(item)), cost))[0])
    return (int(cost[k]), int(origin[k]), int(ends[k])) if cost[k] <= most else None


def passing(items: Items, row: np.ndarray, place: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row * items + item, band) of the bands of diagonals that reach their item's bound."""
    times = items.count[gram]
    where = ranges(items.first[gram], times)
    item = items.item[where]
    # Pairs are numbered anew, so that a pair and a band fit one key whatever the numbers of rows and items.
    pairs, pair = np.unique(np.repeat(row, times).astype(np.int64) * len(items.texts) + item, return_inverse=True)
    diagonal = np.repeat(place, times) - items.place[where]
    step = items.budget[item] + 1
    keys = []
    for shift in (0, 1):
        band = (diagonal // step + shift) // 2 * 2 - shift  # bands two steps wide from even or odd steps
        key, first, counts = np.unique(pair << np.int64(32) | (band + 1), return_index=True, return_counts=True)
        keys.append(key[counts >= items.bound[item[first]]])
    key = np.unique(np.concatenate(keys))
    return pairs[key >> np.int64(32)], (key & np.int64(0xFFFFFFFF)) - 1


_HELD: dict[str, Items] = {}
KEPT.append(_HELD)


def held(name: str, sent, q: int, rate: float) -> Items:
    """The index of a slice of items, built once in each Python worker; one slice is held at a time."""
    if name not in _HELD:
        _HELD.clear()
        _, own = sent.value
        _HELD[name] = Items(np.arange(len(own)), own, q, rate)
    return _HELD[name]


def search(items: Items, texts: pa.Array, most_hits: int = 4_000_000) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits): the best place of each item in each text."""
    texts = plain(texts)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    strings = texts.to_pylist()
    codes = code_points("\0".join(strings))
    hashes = gram_hashes(codes, items.q)
    maybe = np.flatnonzero(items.bits[hashes >> items.shift])
    found = np.searchsorted(items.grams, hashes[maybe])
    found = np.minimum(found, len(items.grams) - 1)
    hit = items.grams[found] == hashes[maybe]
    at, gram = maybe[hit], found[hit]
    if not len(at):
        return
    row = np.searchsorted(starts, at, side="right") - 1
    longest = max(map(len, items.texts))
    passed = []
    # Rows whose hits are expanded at once; all hits of a row stay together.
    work = np.cumsum(items.count[gram])
    last_of_row = np.flatnonzero(np.append(row[1:] != row[:-1], True))
    begin = 0
    while begin < len(at):
        goal = (work[begin - 1] if begin else 0) + most_hits
        end = int(last_of_row[max(np.searchsorted(work[last_of_row], goal, "right") - 1, np.searchsorted(last_of_row, begin))]) + 1
        passed.append(passing(items, row[begin:end], at[begin:end] - starts[row[begin:end]] + longest, gram[begin:end]))
        begin = end
    best: dict[int, tuple[int, int, int]] = {}
    for p, band in zip(*(np.concatenate(x).tolist() for x in zip(*passed))):
        r, i = divmod(p, len(items.texts))
        k = int(items.budget[i])
        if best.get(p, (k + 1,))[0] == 0:
            continue
        low = band * (k + 1) - longest
        exact = strings[r].find(items.texts[i])
        if exact >= 0:
            best[p] = (0, exact, exact + len(items.texts[i]))
            continue
        text = codes[starts[r] : starts[r] + lengths[r]]
        got = alignment(code_points(items.texts[i]), text, low - k, low + 2 * (k + 1) - 1 + k, k)
        if got and got < best.get(p, (k + 1, 0, 0)):
            best[p] = got
    for p, (edits, start, end) in best.items():
        r, i = divmod(p, len(items.texts))
        yield r, i, start, end, edits


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    q: int = 10,
    edit_rate: float = 0.08,
    least_chars: int = 30,
    slice_chars: int = 20_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of every item in every document, at its best place in the plain text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where(F.length("text") >= least_chars)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = total // slice_chars + 1
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for s in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).collect()
        texts = plain(pa.array([r["text"] for r in rows], pa.string())).to_pylist()
        kept = [(r["item_id"], t) for r, t in zip(rows, texts) if len(t) >= max(least_chars, q)]
        if not kept:
            continue
        sent = shared(spark, ([i for i, _ in kept], [t for _, t in kept]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            claim("decontamination")
            ids, _ = sent.value
            index = held(name, sent, q, edit_rate)
            for whole in batches:
                for start in range(0, whole.num_rows, 16384):
                    for batch in pieces_of(whole.slice(start, 16384), "text"):
                        hits = list(search(index, batch.column("text")))
                        rows, item, begin, end, edits = zip(*hits) if hits else ((),) * 5
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([ids[i] for i in item], pa.int64()),
                                pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32()),
                            ],
                            ["doc_id", "item_id", "start", "end", "edits"],
                        )
            trim()

        part = inputs.mapInArrow(run, RESULT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], RESULT)
