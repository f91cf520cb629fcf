"""Token ids in a content-addressed store.

Texts are encoded and each document's ids, with an end id appended, are cut where a rolling hash of the last ids
matches a mask, so equal passages give equal chunks (of 96 ids in the mean, some 40 words of the test tables). A
chunk is stored once, in the row of the first document as staged that has it; every document keeps a recipe (chunk
digests in order, which of them it stores, how often each is used) and a Merkle root over it. Packs are Parquet files
in ascending order of document id; each ends with a manifest row: its numbers of ids and chunks and a Merkle root over
the roots of its documents. Reading checks the packs against their manifests, rebuilds every document from recipes and
chunks, and fails where a digest, root or length does not match.

Null text counts as empty (only the end id). Very long texts are encoded whole; a batch holds few of them. Rows that
repeat an id are kept apart, in an order fixed by the staged row number. An empty table gives an empty store. Only the
id and text columns are read, so other columns may have any name. Null ids sort first.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convlens.llm.common import KEPT, Scratch, claim, collect_garbage, frequent, join_counted, pieces_of, ranges, trim

#: White space other than one blank or one line feed between other characters, a special token, or the mark that the
#: encoder itself puts at the start of a text: encoded as a whole.
ODD = (
    r"[ \n\t\r\f\v][ \n\t\r\f\v]|[\x02\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|^[ \n]|[ \n]$|<\|"
)
#: ASCII marks but the apostrophe: after letters a run of them is one piece.
STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
STAGED = "doc_id long, n_tokens long, hi array<long>, lo array<long>, sizes array<int>, blob binary"
PACKED = (
    "doc_id long, uid long, manifest boolean, pack int, offset long, n_tokens long, n_chunks long, hi array<long>, lo array<long>, sizes array<int>, "
    "mine array<boolean>, uses array<int>, blob binary, root binary"
)
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int, n_stored int"


def digest_of(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(digests: bytes, fan: int = 32) -> bytes:
    """Root of a Merkle tree over digests of 16 bytes each, in a row; ``fan`` of them make a node."""
    level = digests or digest_of(b"")
    while len(level) > 16:
        level = b"".join([digest_of(level[i : i + 16 * fan]) for i in range(0, len(level), 16 * fan)])
    return level


def as_bytes(hi: pa.Array, lo: pa.Array) -> bytes:
    """Digests kept as two numbers each, in a row."""
    return np.stack([pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in (hi, lo)], 1).astype("<i8").tobytes()


def gathered(ids: np.ndarray, lengths: np.ndarray, places: pa.Array, total: int) -> np.ndarray:
    """Of stretches of these lengths that lie in a row, those at ``places``, ``total`` ids, one after the other."""
    if not total:
        return np.zeros(0, ids.dtype)
    ends = np.concatenate(([0], np.cumsum(lengths))) * ids.dtype.itemsize
    rows = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])
    return np.frombuffer(rows.take(places).buffers()[2], ids.dtype, total)


class Encoder:
    """Texts to ids. Byte-level BPE is run word by word, over the distinct words of a batch, with a bounded cache."""

    _HELD: dict[str, Encoder] = {}

    @classmethod
    def held(cls, path: str) -> Encoder:
        """One encoder for each Python worker, so that tasks share what earlier tasks have encoded."""
        if path not in cls._HELD:
            cls._HELD[path] = cls(path)
        return cls._HELD[path]

    def __init__(self, path: str, cached: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        model = self.tokenizer.model
        self.by_word = bool(byte_level and type(model).__name__ == "BPE" and not self.tokenizer.normalizer and not model.dropout)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.spelling = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.blank = self.spelling[32]
        self.line = self.whole("\n")
        # Words encoded before, in Arrow's memory: their ids lie one after the other.
        self.words, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def letters_of(self, piece: str) -> bytes:
        """Ids of one piece of letters, with a blank before them or not, that the pre-tokenizer would not split."""
        spelt = piece.replace(" ", self.blank) if piece.isascii() else piece.encode().decode("latin-1").translate(self.spelling)
        return array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def stretch(self, stretch: str) -> bytes:
        """Ids of a stretch between blanks; \\x02 stands for no blank before it, a line feed for itself."""
        if stretch[:1] not in ("\x02", "\n"):
            return self.letters_of(" " + stretch) if stretch.isalpha() else self.whole(" " + stretch)
        lead, body = self.line if stretch[0] == "\n" else b"", stretch[1:]
        return lead + (self.letters_of(body) if body.isalpha() else self.whole(body) if body else b"")

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of stretches in a row, offsets); most are letters after a blank, so these make no arrays of their own."""
        ids, ends, blank, tokenize = [], [0], self.blank, self.tokenizer.model.tokenize
        for t in texts:
            if t.isascii() and t.isalpha():
                ids += [x.id for x in tokenize(blank + t)]
            else:
                ids += array(self.dtype.char, self.stretch(t))
            ends.append(len(ids))
        return np.array(ids, self.dtype), np.array(ends, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets by text)."""
        if not self.by_word:
            return self.joined([self.whole(t) for t in texts.to_pylist()])
        odd = pc.match_substring_regex(texts, ODD)
        if pc.any(odd).as_py():
            flags = odd.to_numpy(zero_copy_only=False)
            ids, offsets = self.plain(texts.filter(pc.invert(odd)))
            plain = iter([ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])])
            rest = iter([self.whole(t) for t in texts.filter(odd).to_pylist()])
            return self.joined([next(rest if x else plain) for x in flags])
        return self.plain(texts)

    def joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate(([0], np.cumsum([len(p) // self.dtype.itemsize for p in parts]))).astype(np.int64)
        return np.frombuffer(b"".join(parts), self.dtype), offsets

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.binary_join_element_wise("\x02", pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(lists).dictionary_encode()
        ids, lengths = self.distinct(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        own = lengths[codes]
        ends = np.concatenate(([0], np.cumsum(own)))
        offsets = ends[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        return gathered(ids, lengths, coded.indices, int(ends[-1])), offsets

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of these distinct words stands among the held ones; new ones are encoded and held."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        ids, ends = self.stretches(new.to_pylist())
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.words) + np.arange(len(new))
        all_ids, all_ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, self.ends[-1] + ends[1:]))
        if len(self.words) + len(new) <= self.cached:
            self.words, self.ids, self.ends = pa.concat_arrays([self.words, new]), all_ids, all_ends
            return place
        # Too many: those of this batch stay.
        sizes = np.diff(all_ends)[place]
        self.words, self.ids, self.ends = words, all_ids[ranges(all_ends[:-1][place], sizes)], np.concatenate(([0], np.cumsum(sizes)))
        return np.arange(len(words))

    def distinct(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids) of distinct stretches: letters from the cache, then stops that follow them."""
        letters = pc.utf8_rtrim(stretches, STOPS)
        split = pc.utf8_is_alpha(pc.utf8_ltrim(letters, "\x02\n"))
        letters = pc.if_else(split, letters, stretches)
        sizes = (pc.utf8_length(stretches).to_numpy(), pc.utf8_length(letters).to_numpy())
        bases = letters.dictionary_encode()
        place = self.places(bases.dictionary.cast(pa.string()))
        base_ids, base_ends = self.ids, self.ends
        base = place[bases.indices.to_numpy(zero_copy_only=False)]
        n_base = np.diff(base_ends)[base]
        # The stops after letters make one piece, and there are few different ones.
        some = np.flatnonzero(sizes[0] > sizes[1])
        tail = pc.replace_substring_regex(stretches.take(pa.array(some)), "(?s)^.*?([" + re.escape(STOPS) + "]*)$", r"\1").dictionary_encode()
        tail_ids, tail_ends = self.joined([self.whole(t) for t in tail.dictionary.to_pylist()])
        of = tail.indices.to_numpy(zero_copy_only=False)
        n_tail = np.zeros(len(stretches), np.int64)
        n_tail[some] = np.diff(tail_ends)[of]
        lengths = n_base + n_tail
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), self.dtype)
        out[ranges(starts, n_base)] = base_ids[ranges(base_ends[:-1][base], n_base)]
        out[ranges((starts + n_base)[some], n_tail[some])] = tail_ids[ranges(tail_ends[:-1][of], n_tail[some])]
        return out, lengths


KEPT.append(Encoder._HELD)


def chunk_ends(ids: np.ndarray, offsets: np.ndarray, gear: np.ndarray, mean: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks, number of chunks of each document) for documents that lie one after the other.

    A chunk ends where a rolling hash over the last 16 ids is low enough, once in ``mean`` ids. Chunks have a quarter (16
    at least, so no hash reaches into the document before) to four times that length; only the last may be shorter.
    """
    least, most = max(16, mean // 4), mean * 4
    h = gear[ids]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] * np.uint32(3**k)
    marks = np.flatnonzero(h < np.uint32((1 << 32) // mean)) + 1
    first, last = np.searchsorted(marks, offsets[:-1], "right").tolist(), np.searchsorted(marks, offsets[1:], "left").tolist()
    places, ends, counts = marks.tolist(), [], []
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first, last):
        before, at = len(ends), a
        for p in places[i:j]:
            while p - at > most:
                at += most
                ends.append(at)
            if p - at >= least:
                ends.append(p)
                at = p
        while b - at > most:
            at += most
            ends.append(at)
        if at < b:
            ends.append(b)
        counts.append(len(ends) - before)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def lists_of(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def stage(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, end_id: int, mean: int) -> DataFrame:
    """One row per document: digests and sizes of its chunks and its compressed ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        encoder = Encoder.held(tokenizer)
        width = encoder.dtype.itemsize
        gear = np.random.default_rng(7).integers(0, 1 << 32, 1 << (16 if width == 2 else 20), dtype=np.uint32)
        packer = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
        for whole in batches:
            for batch in pieces_of(whole, "text", 8_000_000):
                ids, offsets = encoder.encode(pc.fill_null(batch.column("text"), ""))
                ids = np.insert(ids, offsets[1:], np.array(end_id, encoder.dtype))
                offsets = offsets + np.arange(len(offsets))
                ends, counts = chunk_ends(ids, offsets, gear, mean)
                sizes = np.diff(ends, prepend=0)
                raw = memoryview(ids.tobytes())
                digests = b"".join([digest_of(raw[a:b]) for a, b in zip(((ends - sizes) * width).tolist(), (ends * width).tolist())])
                at = (offsets * width).tolist()
                blobs = [packer.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
                hi, lo = np.frombuffer(digests, "<i8").reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), lists_of(counts, pa.array(hi)), lists_of(counts, pa.array(lo)),
                        lists_of(counts, pa.array(sizes, pa.int32())), pa.array(blobs, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "hi", "lo", "sizes", "blob"],
                )
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, STAGED)


def write_store(
    docs: DataFrame,
    tokenizer: str,
    scratch: Scratch,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    mean: int = 96,
    pack_tokens: int = 1 << 25,
) -> DataFrame:
    """Writes the store into ``scratch`` and returns its rows as read back. A pack has about ``pack_tokens`` ids at most."""
    spark = docs.sparkSession
    staged = scratch.put(stage(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id, mean=mean).withColumn("uid", F.monotonically_increasing_id()), "staged")
    tokens, total = staged.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    several = staged.select("uid", F.explode(F.arrays_zip("hi", "lo")).alias("d")).groupBy("d.hi", "d.lo").agg(F.min("uid").alias("owner"), F.count(F.lit(1)).alias("n"))
    several = scratch.put(several.where("n > 1"), "several")
    refs = staged.select("doc_id", "uid", F.posexplode(F.arrays_zip("hi", "lo")).alias("seq", "d")).select("doc_id", "uid", "seq", "d.hi", "d.lo")
    marks = join_counted(refs, several.withColumn("_n", F.col("n")), ["hi", "lo"], total)
    marks = marks.select("doc_id", "uid", "seq", (F.col("owner") == F.col("uid")).alias("own"), F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n"))
    both = staged.select("doc_id", "uid", F.lit(-1).alias("seq"), "n_tokens", "hi", "lo", "sizes", "blob").unionByName(marks, allowMissingColumns=True)
    # A document's row comes after the marks of its chunks, so one pass puts them together.
    packs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // pack_tokens + 1)
    ordered = both.repartitionByRange(packs, "doc_id", "uid").sortWithinPartitions("doc_id", "uid", F.desc("seq"))
    width = Encoder.held(tokenizer).dtype.itemsize
    store = scratch.put(ordered.mapInArrow(lambda b: pack(b, width), PACKED), "store")
    scratch.drop("staged")
    scratch.drop("several")
    del staged, several, refs, marks, both, ordered
    collect_garbage(spark)
    return store


def pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    claim("packs")
    packer, unpacker = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True), zstandard.ZstdDecompressor()
    number, offset, total, roots = TaskContext.get().partitionId(), 0, 0, RunningMerkle()
    fields = ["doc_id", "uid", "manifest", "pack", "offset", "n_tokens", "n_chunks", "hi", "lo", "sizes", "mine", "uses", "blob", "root"]
    kinds = [
        pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
        pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(),
    ]
    # The marks of the chunks of a document whose own row has not come yet.
    waiting: tuple[list, ...] = ([], [], [])

    def placed(digests: bytes, sizes: list[int], blob: bytes, marks: tuple[list, ...]) -> tuple[list, list, bytes]:
        """Which chunks the document stores, how often each is used, and what it stores, compressed."""
        marked = {seq: (own, uses) for seq, own, uses in zip(*marks)}
        times = [marked[i][1] if i in marked else 1 for i in range(len(sizes))]
        mine, met = [], set()
        for i in range(len(sizes)):
            d = digests[16 * i : 16 * i + 16]
            mine.append(i not in marked or marked[i][0] and d not in met)
            met.add(d)
        if not all(mine):
            raw, kept, at = unpacker.decompress(blob), [], 0
            for size, stays in zip(sizes, mine):
                if stays:
                    kept.append(raw[at : at + size * width])
                at += size * width
            blob = packer.compress(b"".join(kept)) if kept else b""
        return mine, times, blob

    for batch in batches:
        seq = batch.column("seq").to_numpy(zero_copy_only=False)
        marks = [seq, pc.fill_null(batch.column("own"), False).to_numpy(zero_copy_only=False), pc.fill_null(batch.column("n"), 0).to_numpy(zero_copy_only=False)]
        at = np.flatnonzero(seq < 0)
        begins = np.concatenate(([0], at + 1)).tolist()
        docs = batch.filter(pa.array(seq < 0))
        hi, lo, held = (docs.column(c) for c in ("hi", "lo", "sizes"))
        digests, edges = as_bytes(hi, lo), np.concatenate(([0], np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False)))).astype(int).tolist()
        own_roots, changed = [], {}
        for j, (a, b, x, y) in enumerate(zip(begins, at.tolist(), edges[:-1], edges[1:])):
            own = digests[16 * x : 16 * y]
            own_roots.append(merkle(own))
            roots.add(own_roots[-1])
            if b > a or waiting[0]:
                got = tuple(w + m[a:b].tolist() for w, m in zip(waiting, marks))
                waiting = ([], [], [])
                changed[j] = placed(own, held[j].as_py(), docs.column("blob")[j].as_py(), got)
        waiting = tuple(w + m[begins[-1] :].tolist() for w, m in zip(waiting, marks))
        if not docs.num_rows:
            continue
        counts, n = docs.column("n_tokens").to_numpy(), docs.num_rows
        blobs = docs.column("blob")
        if changed:
            blobs = pa.array([changed[j][2] if j in changed else b for j, b in enumerate(blobs.to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                docs.column("doc_id"), docs.column("uid"), pa.array([False] * n), pa.array([number] * n, pa.int32()),
                pa.array(offset + np.cumsum(counts) - counts), docs.column("n_tokens"), pa.array(np.diff(edges), pa.int64()), hi, lo, held,
                *(pa.array([changed[j][i] if j in changed else None for j in range(n)], k) for i, k in enumerate(kinds[10:12])), blobs, pa.array(own_roots, pa.binary()),
            ],
            fields,
        )
        offset, total = offset + int(counts.sum()), total + edges[-1]
    if offset:
        last = (None, None, True, number, 0, offset, total, None, None, None, None, None, None, roots.root())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(last, kinds)], fields)
    trim()


class RunningMerkle:
    """A Merkle root over leaves that come one by one, in memory that grows with the logarithm of their number."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, held in enumerate(self.levels):
            if held is None:
                self.levels[i] = leaf
                return
            leaf, self.levels[i] = digest_of(held + leaf), None
        self.levels.append(leaf)

    def root(self) -> bytes:
        out = b""
        for held in self.levels:
            if held is not None:
                out = digest_of(held + out) if out else held
        return out


def starts_of_packs(store: DataFrame) -> DataFrame:
    before = Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    return store.where("manifest").select("pack", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("pack_start"))


def lending(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(hi, lo, n, chunk) of the chunks that a document stores for others too."""
    claim("packs")
    unpacker = zstandard.ZstdDecompressor()
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            data, out = whole.slice(start, 500).to_pydict(), []
            for hi, lo, sizes, mine, uses, blob in zip(*(data[c] for c in ("hi", "lo", "sizes", "mine", "uses", "blob"))):
                raw, at = unpacker.decompress(blob) if blob else b"", 0
                for h, w, size, own, n in zip(hi, lo, sizes, mine, uses):
                    if own:
                        if n > 1:
                            out.append((h, w, n, raw[at : at + size * width]))
                        at += size * width
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["hi", "lo", "n", "chunk"])


def read_store(store: DataFrame, tokenizer_bytes: int = 2) -> DataFrame:
    """Rebuilds every document from the files and checks it: (doc_id, start, n_tokens, ids_crc32, n_chunks, n_stored).

    The packs are checked against their manifests first, so a row or a manifest that is missing is an error.
    """
    damaged = damaged_packs(store).head(1)
    if damaged:
        raise ValueError(f"pack {damaged[0]['pack']} does not match its manifest")
    docs = store.where("not manifest")
    total = store.where("manifest").agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0]
    # Two numbers for each pack.
    rows = docs.join(F.broadcast(starts_of_packs(store)), "pack")
    rows = rows.select("doc_id", "uid", (F.col("pack_start") + F.col("offset")).alias("start"), "n_tokens", "hi", "lo", "sizes", "mine", "blob", "root")
    lacks = F.coalesce(F.exists("mine", lambda m: ~m), F.lit(False))
    lends = F.exists(F.arrays_zip("mine", "uses"), lambda c: c["mine"] & (c["uses"] > 1))
    offered = docs.where(lends).select("hi", "lo", "sizes", "mine", "uses", "blob").mapInArrow(lambda b: lending(b, tokenizer_bytes), "hi long, lo long, n int, chunk binary")
    wanted = docs.where(lacks).select("uid", F.posexplode(F.arrays_zip("hi", "lo", "mine", "uses")).alias("seq", "c")).where("not c.mine")
    wanted = wanted.select("uid", "seq", "c.hi", "c.lo", F.col("c.uses").alias("n"))
    # Common chunks, at most 65536 of them (see ``frequent``), go out; each of the rest has too few uses to be a hot key.
    common, rare = (F.col("n") > frequent(total), F.col("n") <= frequent(total))
    lent = wanted.where(common).drop("n").join(F.broadcast(offered.where(common).drop("n")), ["hi", "lo"])
    lent = lent.unionByName(wanted.where(rare).drop("n").join(offered.where(rare).drop("n"), ["hi", "lo"]))
    lent = lent.groupBy("uid").agg(F.collect_list(F.struct("seq", "chunk")).alias("lent"))
    alone = rows.where(~lacks).withColumn("lent", F.lit(None).cast("array<struct<seq:int,chunk:binary>>"))
    return alone.unionByName(rows.where(lacks).join(lent, "uid", "left")).mapInArrow(lambda b: rebuild(b, tokenizer_bytes), RESULT)


def rebuild(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    claim("packs")
    unpacker = zstandard.ZstdDecompressor()
    kind = np.dtype(f"<u{width}")
    for whole in batches:
        for begin in range(0, whole.num_rows, 2000):
            part = whole.slice(begin, 2000)
            digests = as_bytes(part.column("hi"), part.column("lo"))
            data = part.select(["doc_id", "n_tokens", "sizes", "mine", "blob", "root", "lent"]).to_pydict()
            crcs, chunks_n, stored_n, first = [], [], [], 0
            for doc, n, sizes, mine, blob, root, lent in zip(*data.values()):
                raw = unpacker.decompress(blob) if blob else b""
                if mine is not None and not all(mine):
                    other, parts, at = {x["seq"]: x["chunk"] for x in lent or ()}, [], 0
                    for i, (size, own) in enumerate(zip(sizes, mine)):
                        parts.append(raw[at : at + size * width] if own else other.get(i, b""))
                        at += size * width * own
                    raw = b"".join(parts)
                view, at, found = memoryview(raw), 0, []
                for size in sizes:
                    found.append(digest_of(view[at : at + size * width]))
                    at += size * width
                recipe = digests[16 * first : 16 * (first + len(sizes))]
                if b"".join(found) != recipe or merkle(recipe) != root or len(raw) != n * width:
                    raise ValueError(f"document {doc} does not match its recipe")
                first += len(sizes)
                crcs.append(zlib.crc32(np.frombuffer(raw, kind).astype("<u4")))
                chunks_n.append(len(sizes))
                stored_n.append(len(sizes) if mine is None else sum(mine))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array(chunks_n, pa.int32()), pa.array(stored_n, pa.int32())],
                ["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "n_stored"],
            )


def damaged_packs(store: DataFrame) -> DataFrame:
    """Packs without a manifest or whose manifest does not match the Merkle roots of their rows; empty for a sound store.

    A pack is streamed in order, one task for each range of packs, so none is gathered in memory.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack_now, roots, bad, open_pack = None, RunningMerkle(), [], False
        for whole in batches:
            for number, last, root in zip(*(whole.column(c).to_pylist() for c in ("pack", "manifest", "root"))):
                if number != pack_now:
                    bad += [pack_now] if open_pack else []
                    pack_now, roots = number, RunningMerkle()
                open_pack = not last
                if not last:
                    roots.add(root)
                elif roots.root() != root:
                    bad.append(number)
        bad += [pack_now] if open_pack else []
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int32())], ["pack"])

    n = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = store.select("pack", "manifest", "offset", "uid", "root")
    return rows.repartitionByRange(n, "pack").sortWithinPartitions("pack", "manifest", "offset", "uid").mapInArrow(check, "pack int")
