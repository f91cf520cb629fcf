"""Fill-in-the-middle transformation, with cuts found by a parallel automaton scan.

One automaton reads bytes: its states say how many bytes of a code point are still to come and how much of a mark
(``<P>``, ``<S>``, ``<M>``) has been seen. A stretch of bytes is summed up without knowing how it is entered, as the state
in which each of the six start states leaves it and the code points and marks each of them has then counted. Such
functions compose associatively, so stretches of 256 bytes are run in lockstep, composed by doubling within a document,
and from the function of all before a stretch follow its entry state and the code points before it. A cut after c code
points is looked for only in the stretch that holds it.

Documents of more than ``chunk`` bytes are dealt out: each chunk's function is made by whatever task has the chunk, the
functions of a document (48 numbers a chunk, 2^15 chunks at most) are composed, and only chunks that hold a cut are read
again. Texts stay in the JVM, where the pieces are put together by byte positions.

Null texts are empty; empty texts, and those that hold a mark, are ``plain`` and handed on as they are. Very long texts are read
whole. Ties (two cuts at one place) make an empty middle. Repeated rows get equal answers, a null id counts as the empty text
in the draw. An empty table gives an empty result. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from convlens.llm.common import Scratch, bytes_of, pieces_of, ranges, whole_text

MARKS = "PSM"
WIDTH = 256
#: Between code points; after "<"; after "<" and a letter of a mark; 1, 2 or 3 bytes of a code point still to come.
STATES = 6
PAD = 255


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, code points ended + 2^16 x marks ended), both by state x 256 + byte. PAD changes nothing."""
    to, ends = np.zeros((STATES, 256), np.uint8), np.zeros((STATES, 256), np.int64)
    for state in range(STATES):
        for byte in range(256):
            inside = 0x80 <= byte < 0xC0
            if byte == PAD:
                to[state, byte] = state
            elif inside and state > 3:
                to[state, byte] = state - 1
            elif byte >= 0xC0:
                to[state, byte] = 3 if byte < 0xE0 else 4 if byte < 0xF0 else 5
            else:
                ends[state, byte] = 1
                if byte == ord("<"):
                    to[state, byte] = 1
                elif state == 1 and chr(byte) in MARKS:
                    to[state, byte] = 2
                elif state == 2 and byte == ord(">"):
                    ends[state, byte] += 1 << 16
    return to.ravel(), ends.ravel()


_TO, _ENDS = _automaton()


class Functions:
    """For each stretch and start state: the state at its end, and the code points and marks ended in it."""

    def __init__(self, end: np.ndarray, units: np.ndarray, marks: np.ndarray):
        self.end, self.units, self.marks = end, units, marks

    @staticmethod
    def of(stretches: np.ndarray) -> Functions:
        """``stretches``: one row of bytes each, filled up with PAD."""
        state = np.repeat(np.arange(STATES, dtype=np.int64)[None], len(stretches), 0)
        counted = np.zeros_like(state)
        for column in np.ascontiguousarray(stretches.T):
            at = state * 256 + column[:, None]
            counted += _ENDS[at]
            state = _TO[at].astype(np.int64)
        return Functions(state, counted & 0xFFFF, counted >> 16)

    def then(self, other: Functions) -> Functions:
        """Row by row: first this, then the other."""
        reach = lambda values: np.take_along_axis(values, self.end, 1)
        return Functions(reach(other.end), self.units + reach(other.units), self.marks + reach(other.marks))

    def take(self, rows: np.ndarray) -> Functions:
        return Functions(self.end[rows], self.units[rows], self.marks[rows])

    def put(self, rows: np.ndarray, other: Functions) -> None:
        self.end[rows], self.units[rows], self.marks[rows] = other.end, other.units, other.marks

    def scanned(self, first: np.ndarray) -> Functions:
        """Each row composed with all before it from its row ``first`` on, in rounds of doubled reach."""
        out, row, reach = self.take(np.arange(len(first))), np.arange(len(first)), 1
        while len(rows := np.flatnonzero(row - reach >= first)):
            out.put(rows, out.take(rows - reach).then(out.take(rows)))
            reach *= 2
        return out


def stretches_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of WIDTH bytes, owner of each, number of each owner's first row); an empty text has one row."""
    each = np.maximum(1, -(-lengths // WIDTH))
    owner = np.repeat(np.arange(len(lengths)), each)
    first = np.repeat(np.cumsum(each) - each, each)
    nth = np.arange(len(owner)) - first
    size = np.minimum(WIDTH, lengths[owner] - nth * WIDTH)
    rows = np.full((len(owner), WIDTH), PAD, np.uint8)
    begin = starts[owner] + nth * WIDTH
    rows[np.repeat(np.arange(len(owner)), size), ranges(np.zeros_like(size), size)] = data[ranges(begin, size)]
    return rows, owner, first


def place(rows: np.ndarray, entry: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Number of bytes of each row, entered in the given state, after which so many code points have ended."""
    state, left, at = entry.astype(np.int64), units.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
    for column in np.ascontiguousarray(rows.T):
        on = left > 0
        key = state * 256 + column
        at += on
        left -= np.where(on, _ENDS[key] & 0xFFFF, 0)
        state = _TO[key].astype(np.int64)
    return at


def cuts_of(texts: pa.Array, draws: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(code points, marks, smaller and larger cut in code points, the same in bytes) of each text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    rows, owner, first = stretches_of(bytes_of(texts), starts, lengths)
    until = Functions.of(rows).scanned(first)
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    units, marks = until.units[last, 0], until.marks[last, 0]
    drawn = np.sort(np.stack([d % (units + 1) for d in draws]), 0)
    # Rows are in order, and so are the pairs (owner, code points up to the row's end): the row of a cut by binary search.
    wide = int(units.max(initial=0)) + 2
    seen = owner * wide + until.units[:, 0]
    at = []
    for cut in drawn:
        row = np.searchsorted(seen, np.arange(len(units)) * wide + cut)
        inner = row > first[row]
        entry = np.where(inner, until.end[row - 1, 0], 0)
        before = np.where(inner, until.units[row - 1, 0], 0)
        at.append((row - first[row]) * WIDTH + place(rows[row], entry, cut - before))
    return units, marks, drawn[0], drawn[1], at[0], at[1]


COLUMNS = ("n", "marks", "a", "b", "at_a", "at_b")
FOUND = StructType([StructField(c, LongType()) for c in COLUMNS])


@F.arrow_udf(FOUND)
def _cuts(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Null where the text is null."""
    parts = []
    for batch in pieces_of(pa.record_batch({"text": texts, "one": one, "two": two}), "text"):
        here = batch.column("text")
        found = cuts_of(here.fill_null(""), [batch.column(c).to_numpy(zero_copy_only=False) for c in ("one", "two")])
        parts.append(pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], list(COLUMNS), mask=here.is_null()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(c, pa.int64()) for c in COLUMNS]))


def _chunk_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces_of(whole, "bytes"):
            data, starts, lengths = _packed(batch.column("bytes"))
            rows, owner, first = stretches_of(data, starts, lengths)
            last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
            total = Functions.of(rows).scanned(first).take(last)
            table = np.concatenate((total.end, total.units, total.marks), 1)
            yield pa.record_batch({"row": batch.column("row"), "chunk": batch.column("chunk"), "function": pa.array(list(table), pa.list_(pa.int64()))})


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = column.to_pylist()
    lengths = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(lengths) - lengths, lengths


def _composed(table: pa.Table) -> pa.Table:
    """Of one document: how each chunk is entered, and the totals."""
    table = table.sort_by("chunk")
    f = np.array(table.column("function").to_pylist(), np.int64).reshape(-1, 3, STATES)
    until = Functions(f[:, 0], f[:, 1], f[:, 2]).scanned(np.zeros(len(f), np.int64))
    shift = lambda x: np.concatenate(([0], x[:-1, 0]))
    out = {"row": table.column("row"), "chunk": table.column("chunk"), "entry": shift(until.end), "before": shift(until.units), "until": until.units[:, 0]}
    return pa.table(out | {"n": np.full(len(f), until.units[-1, 0]), "marks": np.full(len(f), until.marks[-1, 0])})


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte position in its document of each cut asked for in a chunk."""
    for whole in batches:
        for batch in pieces_of(whole, "bytes"):
            data, starts, lengths = _packed(batch.column("bytes"))
            entry, cut = (batch.column(c).to_numpy() for c in ("entry", "cut"))
            rows, owner, first = stretches_of(data, starts, lengths)
            every = Functions.of(rows).scanned(first)
            # Code points up to each row's end as the chunk is entered here.
            until, end = every.units[np.arange(len(rows)), entry[owner]], every.end[np.arange(len(rows)), entry[owner]]
            wide = WIDTH * len(rows) + 2
            row = np.searchsorted(owner * wide + until, np.arange(len(lengths)) * wide + cut)
            inner = row > first[row]
            at = (row - first[row]) * WIDTH + place(rows[row], np.where(inner, end[row - 1], entry), cut - np.where(inner, until[row - 1], 0))
            yield pa.record_batch({"row": batch.column("row"), "which": batch.column("which"), "at": pa.array(at + batch.column("from").to_numpy())})


def _giants(long: DataFrame, scratch: Scratch, chunk: int) -> DataFrame:
    """The documents of several chunks, with FOUND as the udf gives it for the others."""
    long = scratch.put(long.withColumn("row", F.monotonically_increasing_id()), "long")
    cut_up = long.select("row", F.col("text").cast("binary").alias("bytes")).select("row", "bytes", F.posexplode(F.sequence(F.lit(0), (F.octet_length("bytes") - 1).cast("int"), F.lit(chunk))).alias("chunk", "from"))
    chunks = cut_up.select("row", "chunk", "from", F.expr(f"substring(bytes, `from` + 1, {chunk})").alias("bytes")).repartition("row", "chunk")
    functions = chunks.mapInArrow(_chunk_functions, "row long, chunk int, function array<long>")
    composed = scratch.put(functions.groupBy("row").applyInArrow(_composed, "row long, chunk int, entry long, before long, until long, n long, marks long"), "composed")
    totals = composed.where("chunk = 0").select("row", "n", "marks").join(long.select("row", "h1", "h2"), "row")
    cuts = totals.select("row", "n", "marks", F.array_sort(F.array(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1))).alias("cuts"))
    asked = composed.join(cuts.select("row", F.posexplode("cuts").alias("which", "cut")), "row")
    asked = asked.where("cut > before and cut <= until or chunk = 0 and cut = 0")
    wanted = asked.select("row", "chunk", "which", "entry", (F.col("cut") - F.col("before")).alias("cut"))
    held = cut_up.join(wanted, ["row", "chunk"]).select("row", "from", "which", "entry", "cut", F.expr(f"substring(bytes, `from` + 1, {chunk})").alias("bytes"))
    at = held.mapInArrow(_places, "row long, which int, at long").groupBy("row").agg(F.min(F.when(F.col("which") == 0, F.col("at"))).alias("at_a"), F.min(F.when(F.col("which") == 1, F.col("at"))).alias("at_b"))
    found = cuts.join(at, "row").select("row", F.struct("n", "marks", F.col("cuts")[0].alias("a"), F.col("cuts")[1].alias("b"), "at_a", "at_b").alias("found"))
    return long.join(found, "row").drop("row")


def transform(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, chunk: int = 65536) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document.

    Draws are the first 8-digit groups of the sha256 of ``seed:id``: two for the cuts, one for whether a document stays plain,
    one for its form, ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), *map(draw, (1, 2, 3, 4)))
    short = F.octet_length("text") <= chunk
    near = rows.where(short).withColumn("found", _cuts("text", "h1", "h2"))
    both = near.unionByName(_giants(rows.where(~short), scratch or Scratch(docs.sparkSession, "fim"), chunk))
    plain = (F.col("found.n") == 0) | (F.col("found.marks") > 0) | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    part = lambda a, b: F.expr(f"cast(substring(cast(text as binary), cast({a} + 1 as int), cast({b} - {a} as int)) as string)")
    prefix, middle, suffix = part("0", "found.at_a"), part("found.at_a", "found.at_b"), part("found.at_b", "octet_length(text)")
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
        .otherwise(F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle))
    )
    cut = lambda value: F.when(F.col("form") != "plain", value)
    return both.withColumn("form", form).select("doc_id", F.col("found.n").alias("n"), "form", cut(F.col("found.a")).alias("prefix_chars"), cut(F.expr("found.b - found.a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
