"""Collocations by hierarchical pair naming.

Words of a language that occur often enough get names (numbers). A phrase of k words is a pair of adjacent phrases of k - 1 words
that overlap in all but their ends, so level k counts pairs of neighbouring names, keeps those with at least ``least`` occurrences and
gives them names of their own. A pair is its phrase's two parents. Each name carries what its parents hand down: the counts of all its
first and last parts (for the cuts) and its words; and as a phrase inside a longer one with the same count is inside one that is
a word longer and has that count too, the parents of a level are all that has to be looked at for subsumption.

Texts are held in blocks of some megabytes, one language each, cut where pieces end: words are numbers within a block, level k has
the places and names of what is still frequent. Only names that may make up a longer phrase stay. Frequent names go out to all tasks if they
are few (checked: ``MOST``); else blocks get them by a join on what each holds at least once, which shuffles. Counts are summed in
the tasks before they are dealt, and a few blocks (``TOGETHER``) are the most that any task holds at once, since files hold no more. Scores are exact decimal numbers.

A null language is ``und``; null and empty texts have no words. Very long texts are cut between pieces; a piece without an end is
kept whole. Of cuts with one score the shortest first part counts; phrases with equal score and count go by their bytes. Repeated
rows count each time. An empty table gives an empty result. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens.llm.common import Scratch, bytes_of, claim, collect_garbage, pieces_of, ranges, shared, trim
from convlens.session import broadcast_if_few as few

#: What ends a piece, and what parts words in it.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLOCK = 6_000_000
#: Blocks in a file: a task has so many at once when it reads or writes, whatever its share of the input.
TOGETHER = 4
_BLOCK = "block long, lang string, n long, words array<string>, counts array<long>, codes binary"


def stretches(batch: pa.RecordBatch, most: int = BLOCK) -> Iterator[tuple[str, np.ndarray]]:
    """(language, bytes) of about ``most`` bytes, documents parted by a line feed; longer texts are cut where pieces end."""
    langs = np.array(batch.column("lang").to_pylist(), object)
    texts = batch.column("text")
    for lang in sorted(set(langs.tolist())):
        own = texts.filter(pa.array(langs == lang))
        sizes = np.diff(np.frombuffer(own.buffers()[1], np.int32 if pa.types.is_string(own.type) else np.int64)[own.offset : own.offset + len(own) + 1]).astype(np.int64)
        data = np.full(int(sizes.sum()) + len(sizes), ord("\n"), np.uint8)
        data[ranges(np.cumsum(sizes + 1) - sizes - 1, sizes)] = bytes_of(own)
        while len(data) > most:
            cuts = np.flatnonzero(_KIND[data[:most]] == 2)
            later = cuts[-1:] if len(cuts) else most + np.flatnonzero(_KIND[data[most:]] == 2)[:1]
            yield lang, data[: later[0] + 1]
            data = data[later[0] + 1 :]
        if len(data):
            yield lang, data


def worded(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, code of each word in order with -1 where a piece ends) of lower-cased text."""
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    letters = _LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.large_utf8(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    pieces = np.cumsum(kind == 2)[begin] if len(begin) else np.zeros(0, np.int64)
    codes = np.full(len(begin) + (int(np.count_nonzero(np.diff(pieces))) if len(begin) else 0), -1, np.int32)
    codes[np.arange(len(begin)) + np.concatenate(([0], np.cumsum(np.diff(pieces) != 0))).astype(np.int64)[: len(begin)]] = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, codes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("phrases")
    made = TaskContext.get().partitionId() << 33
    for whole in batches:
        for batch in pieces_of(whole, "text", BLOCK):
            for lang, data in stretches(batch):
                words, codes = worded(data)
                if not len(words):
                    continue
                counts = np.bincount(codes[codes >= 0], minlength=len(words))
                yield pa.record_batch({
                    "block": pa.array([made], pa.int64()), "lang": [lang], "n": pa.array([counts.sum()], pa.int64()),
                    "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                    "counts": pa.array([counts], pa.list_(pa.int64())), "codes": pa.array([codes.tobytes()], pa.binary()),
                })
                made += 1
    trim()


_BODY = "block long, lang string, gaps binary, own binary, codes binary"


def _body(block: int, lang: str, places: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Only names with a neighbour can make up a longer phrase."""
    next_to = np.diff(places) == 1
    stays = np.append(next_to, False) | np.insert(next_to, 0, False) if len(places) else np.zeros(0, bool)
    own, code = np.unique(names[stays], return_inverse=True)
    packed = (np.diff(places[stays], prepend=0).astype(np.int32), own.astype(np.int64), code.astype(np.int32))
    return pa.record_batch({"block": pa.array([block], pa.int64()), "lang": [lang]} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("gaps", "own", "codes"), packed)})


def _words_named(block: int, lang: str, codes: bytes, at: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """The block by the names of its words, given as word number and name side by side."""
    code = np.frombuffer(codes, np.int32)
    table = np.full(max(int(code.max(initial=0)), int(at.max(initial=0))) + 1, -1, np.int64)
    table[at] = name
    found = np.where(code >= 0, table[np.maximum(code, 0)], -1)
    places = np.flatnonzero(found >= 0)
    return _body(block, lang, places, found[places])


def pairs_of(gaps: bytes, own: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: (left, right, count) of its distinct pairs, and (place, pair number) of each."""
    at, own, code = np.cumsum(np.frombuffer(gaps, np.int32), dtype=np.int64), np.frombuffer(own, np.int64), np.frombuffer(codes, np.int32).astype(np.int64)
    i = np.flatnonzero(np.diff(at) == 1)
    pair, number, count = np.unique(code[i] * len(own) + code[i + 1], return_inverse=True, return_counts=True)
    return own[pair // max(1, len(own))], own[pair % max(1, len(own))], count, at[i], number


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("phrases")
    for batch in batches:
        for block, gaps, own, codes in zip(*(batch.column(c) for c in ("block", "gaps", "own", "codes"))):
            left, right, count, _, _ = pairs_of(gaps.as_py(), own.as_py(), codes.as_py())
            for k in range(0, len(left), 100_000):
                part = slice(k, k + 100_000)
                m = len(left[part])
                yield pa.record_batch({"block": pa.array(np.full(m, block.as_py())), "left": pa.array(left[part]), "right": pa.array(right[part]), "pair": pa.array(np.arange(k, k + m, dtype=np.int32)), "count": pa.array(count[part].astype(np.int64))})
    trim()


def _pairs_named(block: int, lang: str, place: np.ndarray, number: np.ndarray, pairs: int, at: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    table = np.full(pairs, -1, np.int64)
    table[at] = name
    found = table[number]
    keep = found >= 0
    return _body(block, lang, place[keep], found[keep])


class WordNames:
    """Names by language and word."""

    def __init__(self, names: pa.Table):
        self.by = {lang: names.filter(pc.equal(names.column("lang"), lang)) for lang in names.column("lang").unique().to_pylist()}
        self.by = {lang: (t.column("phrase").combine_chunks(), t.column("name").to_numpy()) for lang, t in self.by.items()}

    def of(self, lang: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, name) of those that have a name."""
        if lang not in self.by:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known, name = self.by[lang]
        found = pc.index_in(words, known).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(found == found)
        return at, name[found[at].astype(np.int64)]


class PairNames:
    """Names by pair; a name belongs to one language, so pairs do too."""

    def __init__(self, names: pa.Table):
        left, right, name = (names.column(c).to_numpy() for c in ("left", "right", "name"))
        self.left, self.right = np.unique(left), np.unique(right)
        key = np.searchsorted(self.left, left) * len(self.right) + np.searchsorted(self.right, right)
        order = np.argsort(key)
        self.key, self.name = key[order], name[order]

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.minimum(np.searchsorted(own, x), len(own) - 1) for own, x in ((self.left, left), (self.right, right)))
        key = a * len(self.right) + b
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        at = np.flatnonzero((self.key[i] == key) & (self.left[a] == left) & (self.right[b] == right))
        return at, self.name[i[at]]


#: Names go out to all tasks up to so many; beyond, blocks get theirs by joins.
MOST = 1_000_000


def _sent(names: DataFrame, columns: list[str], kind: type) -> Broadcast | None:
    if names.limit(MOST + 1).count() > MOST:
        return None
    return shared(names.sparkSession, kind(names.select(*columns).toArrow()))


def _with_names(rows: DataFrame, name_of: Callable[..., pa.RecordBatch]) -> DataFrame:
    """Blocks, one row each, by what ``name_of`` makes of a row's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("phrases")
        for batch in batches:
            for row in range(batch.num_rows):
                yield name_of(**{c: batch.column(c)[row] for c in batch.schema.names})
        trim()

    return rows.mapInArrow(run, _BODY)


def name_words(blocks: DataFrame, names: DataFrame, words: DataFrame) -> DataFrame:
    sent = _sent(names, ["lang", "phrase", "name"], WordNames)
    if sent is not None:
        return _with_names(blocks.select("block", "lang", "words", "codes"), lambda block, lang, words, codes: _words_named(block.as_py(), lang.as_py(), codes.as_py(), *sent.value.of(lang.as_py(), words.values)))
    held = words.join(names.select("lang", "phrase", "name"), ["lang", "phrase"])
    own = held.groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("name").alias("name"))
    return _with_names(blocks.select("block", "lang", "codes").join(own, "block"), lambda block, lang, codes, at, name: _words_named(block.as_py(), lang.as_py(), codes.as_py(), np.asarray(at.values), np.asarray(name.values)))


def name_pairs(bodies: DataFrame, names: DataFrame, pairs: DataFrame) -> DataFrame:
    sent = _sent(names, ["left", "right", "name"], PairNames)

    def looked_up(block, lang, gaps, own, codes):
        left, right, _, place, number = pairs_of(gaps.as_py(), own.as_py(), codes.as_py())
        return _pairs_named(block.as_py(), lang.as_py(), place, number, len(left), *sent.value.of(left, right))

    def joined(block, lang, gaps, own, codes, at, name):
        left, _, _, place, number = pairs_of(gaps.as_py(), own.as_py(), codes.as_py())
        return _pairs_named(block.as_py(), lang.as_py(), place, number, len(left), np.asarray(at.values), np.asarray(name.values))

    if sent is not None:
        return _with_names(bodies, looked_up)
    held = pairs.join(names.select("left", "right", "name"), ["left", "right"])
    at = held.groupBy("block").agg(F.collect_list("pair").alias("at"), F.collect_list("name").alias("name"))
    return _with_names(bodies.join(at, "block"), joined)


def _frequent(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    found = counts.groupBy(*keys).agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    return found.select(F.monotonically_increasing_id().alias("name"), *keys, "f")


def _dense(names: DataFrame) -> DataFrame:
    """The written names as small numbers: place in a part by part, instead of part by place."""
    parts = (names.agg(F.max(F.shiftright("name", 33))).first()[0] or 0) + 1
    return names.withColumn("name", F.shiftright("name", 33) + parts * F.col("name").bitwiseAND(F.lit((1 << 33) - 1)))


def levels(docs: DataFrame, scratch: Scratch, longest: int, least: int, text_col: str, lang_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n), names by level: name, lang, left, right, f, phrase, last, firsts, lasts).

    ``firsts`` and ``lasts``: counts of the parts of 1, 2, ... words at the phrase's start and end.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = scratch.put(rows.mapInArrow(_blocks, _BLOCK), "blocks", rows_per_file=TOGETHER)
    totals = scratch.put(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("block", "lang", "at", F.col("w.words").alias("phrase"), F.col("w.counts").alias("count"))
    names = _dense(scratch.put(_frequent(words, ["lang", "phrase"], least), "names-1"))
    none = F.array().cast("array<long>")
    out = [names.select("*", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), F.col("phrase").alias("last"), none.alias("firsts"), none.alias("lasts"))]
    bodies = scratch.put(name_words(blocks, names, words), "bodies-1", rows_per_file=TOGETHER)
    scratch.drop("blocks")
    collect_garbage(docs.sparkSession)
    for k in range(2, longest + 1):
        pairs = bodies.mapInArrow(_counted, "block long, left long, right long, pair int, count long")
        found = _dense(scratch.put(_frequent(pairs, ["left", "right"], least), f"pairs-{k}"))  # a name belongs to one language, so its pairs do
        collect_garbage(docs.sparkSession)
        parent = out[-1]
        a = parent.select("lang", F.col("name").alias("left"), F.col("phrase").alias("head"), F.col("f").alias("fa"), F.col("firsts").alias("fs"))
        b = parent.select(F.col("name").alias("right"), F.col("last"), F.col("f").alias("fb"), F.col("lasts").alias("ls"))
        full = found.join(few(a), "left").join(few(b), "right")
        out.append(scratch.put(full.select("name", "lang", "f", "left", "right", F.concat_ws(" ", "head", "last").alias("phrase"), "last", F.concat("fs", F.array("fa")).alias("firsts"), F.concat("ls", F.array("fb")).alias("lasts")), f"names-{k}"))
        if k == longest or found.isEmpty():
            break
        bodies = scratch.put(name_pairs(bodies, found, pairs), f"bodies-{k}", rows_per_file=TOGETHER)
        scratch.drop(f"bodies-{k - 1}")
    return totals, out


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(18,0)")
    product = (wide(F.lit(1000)) * wide(a)).cast("decimal(20,0)") * wide(n)
    return F.call_function("div", product.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, scratch: Scratch | None = None, longest: int = 5, least: int = 100, best: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``best`` phrases by score, count and bytes."""
    totals, names = levels(docs, scratch or Scratch(docs.sparkSession, "phrases"), longest, least, text_col, lang_col)
    every = None
    for k in range(2, len(names) + 1):
        own = names[k - 1].select("lang", "name", "phrase", F.col("f").alias("a"), "firsts", "lasts")
        if k < len(names):
            longer = names[k]
            inside = longer.select(F.col("left").alias("name"), F.col("f").alias("a")).union(longer.select("right", "f")).distinct()
            own = own.join(inside, ["name", "a"], "left_anti")
        every = own if every is None else every.unionByName(own)
    scored = every.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang")
    scored = scored.select("lang", "phrase", "a", "n", F.posexplode("firsts").alias("k", "l"), F.reverse("lasts").alias("lasts")).withColumn("r", F.col("lasts")[F.col("k")])
    scored = scored.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "k", "l", "r"))
    ranked = scored.groupBy("lang", "phrase", "a", "n").agg(lowest.alias("m")).select("lang", "phrase", "a", "n", "m.l", "m.r", "m.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First the best of 64 parts of a language, then the best of those.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part")
    top = ranked.select("*", part).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("_at") <= best)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return top.withColumn("rank", rank).where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
