"""Token counts by byte-pair merges, in one pass over the texts: no piece of a text is shuffled.

A text is cut into pieces by the pattern of byte-level vocabularies; merges never cross pieces, so a text's count is the sum of its
pieces'. A worker merges each distinct piece once as long as it is among the CACHED that it keeps. Null and empty
texts have no tokens; very long texts are cut as a whole. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Fixed value: contractions, then letters, digits and other signs with a blank before them, then white space.
PIECE = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose numbers of tokens a Python worker keeps, beside those of a slice.
CACHED = 300_000


def letters() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in set(prints))
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(2)
def ranks(path: str) -> dict[tuple[str, str], int]:
    """Rank of each merge in a vocabulary file of this kind."""
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    return {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}


def merged(piece: str, rank: dict[tuple[str, str], int], letter: dict[int, str]) -> list[str]:
    """Neighbours of least rank become one, the first of them first, until none has a rank."""
    parts = [letter[b] for b in piece.encode()]
    if len(parts) > 200:
        return merged_by_kind(parts, rank)
    none = len(rank)
    cost = [rank.get(p, none) for p in zip(parts, parts[1:])]
    while cost and (least := min(cost)) < none:
        i = cost.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del cost[i]
        if i:
            cost[i - 1] = rank.get((parts[i - 1], parts[i]), none)
        if i < len(cost):
            cost[i] = rank.get((parts[i], parts[i + 1]), none)
    return parts


def merged_by_kind(parts: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """The same for long pieces: all equal neighbours in one pass."""
    while len(parts) > 1:
        least, best = min((rank.get(p, 1 << 60), p) for p in zip(parts, parts[1:]))
        if least == 1 << 60:
            break
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@lru_cache(1)
def kept(path: str) -> dict[str, int]:
    """Numbers of tokens that the tasks of a Python worker have found."""
    return {}


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def counts(rows: DataFrame, key: str, path: str, text: str = "text") -> DataFrame:
    """(key, tokens) of each row, by the vocabulary file at ``path`` (a path that every executor has); one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, letter, known = ranks(path), letters(), kept(path)
        for whole in batches:
            for batch in stretches(whole):
                lists = batch.column("pieces")
                coded = lists.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                if len(known) > CACHED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = len(merged(w, rank, letter))
                ends = np.concatenate(([0], np.cumsum(np.array([known[w] for w in words], np.int64)[coded.indices.to_numpy(zero_copy_only=False)])))
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                edges = ends[np.concatenate(([0], np.cumsum(sizes)))]
                yield pa.record_batch({key: batch.column(key), "tokens": pa.array(np.diff(edges), pa.int64())})

    held = rows.select(key, F.coalesce(pieces(F.col(text)), F.array().cast("array<string>")).alias("pieces"))
    return held.mapInArrow(run, StructType([rows.schema[key], StructField("tokens", LongType())]))


def stretches(batch: pa.RecordBatch, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` pieces at most."""
    ends, start = np.cumsum(pc.list_value_length(batch.column("pieces")).to_numpy(zero_copy_only=False)), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def tokens(messages: DataFrame, path: str) -> DataFrame:
    """(conv_id, tokens), as budgets and statistics of conversations take them; messages have (conv_id, turn, text)."""
    numbered = messages.select("conv_id", F.struct("conv_id", "turn").alias("_m"), "text")
    return counts(numbered, "_m", path).groupBy(F.col("_m.conv_id").alias("conv_id")).agg(F.sum("tokens").alias("tokens"))
