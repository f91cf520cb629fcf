"""Secret scan: fixed patterns, and how many guesses the values in credential contexts would take.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a credential word, then : or =, then a value of six or
more characters), ``access`` (AKIA..., 20 or more) and ``hex`` (24 or more of 0-9a-f). Every value in a credential
context, base ones included, is given its cost: log10 of the guesses that the cheapest segmentation takes. Beyond the base spans, ``guess`` marks the
value after these and more credential words, or after an authorization scheme, if it costs at least ``least_cost`` and
overlaps no base span. The cost is the minimum over all segmentations into dictionary words (also
capitalised or with digits for letters), dates, repeats, runs of the alphabet or digits, keyboard walks and
brute-force stretches: a dynamic programme over positions, with ``SWITCH`` for each segment after the first. The
dictionary is the words of passwords below and, if a vocabulary file is given, the words in it by rank.
A brute-force character costs log10 of the alphabet that the value draws on (10 to 95; see ``PROSE`` for words
after "is"). A block again and again, of any width, costs what the block costs and log10 of how often; of a stretch that repeats, as many
whole blocks as it has are taken from its start or up to its end. Memory is in proportion to the length n of a value, of any
length, and time to n log n.

Spans are in code points of the whole text, end exclusive, ordered by start, then kind as listed. Null and empty texts
have none; very long texts are read whole. Repeated rows, and rows that repeat an id or have none, are scanned alike; an
empty table gives an empty result. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.llm.common import claim, pieces_of

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Short words start a name or follow "_" or "-" in it (DB_PWD); the base words may also stand inside one (dbPassword).
CONTEXT = re.compile(
    r"""(?:(?ai:(?:(?<![A-Z0-9])(?:pwd|pass|passphrase|passcode|credentials?|authorization|bearer|private[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|session[_-]?key|login|pin)|password|passwd|secret|token|api[_-]?key))["']?\x20*(?:[:=]|(?P<is>\bis\b))\x20*["']?(?ai:(?:bearer|basic|token|digest)\x20+)?["']?|(?P<bearer>(?ai:(?<![A-Z0-9])bearer)\x20+))(?P<value>[^\s"'<>,;]{8,})"""
)
#: Words as prose has them; after a bare "bearer" they are no value, after "is" their letters cost less than random ones.
PROSE = re.compile(r"[A-Z]?[a-z]+(?:[-'./][A-Za-z]?[a-z]+)*[.!?:)]*")
#: What a text must hold to be looked at more closely; a superset of all kinds.
MAYBE = (
    r"AKIA|[0-9a-f]{24}|(?i:(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=])|(?i:bearer\x20)"
    r"|(?i:(?:passw(?:or)?d|secret|token|pwd|pass|passphrase|passcode|credentials?|authorization|bearer|key|login|pin)[\"']?\x20*(?:[:=]|is\b))"
)

#: Frequent words of passwords, most frequent first.
COMMON = (
    "password qwerty admin welcome login secret letmein monkey dragon master sunshine princess football shadow michael "
    "jordan superman batman trustno hello freedom whatever ninja mustang access flower passw summer winter spring autumn "
    "love baseball soccer hockey killer pepper ginger cookie cheese banana orange apple purple yellow silver golden "
    "diamond computer internet server database system root user guest test demo example sample default changeme temp "
    "public private token key pass auth company office london paris berlin madrid monday friday january december"
).split()


class Ranks(dict):
    """Ranks by word, and the length of the longest word."""

    def __init__(self, words: dict[str, int]):
        super().__init__(words)
        self.longest = max(map(len, words), default=0)


RANK = Ranks({w: i + 1 for i, w in enumerate(COMMON)})
LEET = str.maketrans("430157@$!", "aeoistasi")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
PLACE = {c: (r, k + 0.5 * r) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
#: log10 of how many more guesses each further segment takes.
SWITCH = 1.0


@lru_cache(4)
def ranks(path: str | None) -> Ranks:
    """Words by rank: the common ones, then the whole words of three letters or more of a byte-level vocabulary file."""
    known = dict(RANK)
    if path:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        for token, number in sorted(vocabulary.items(), key=lambda x: x[1]):
            word = token[1:].lower()
            if token[0] == "\u0120" and len(word) > 2 and word.isascii() and word.isalpha():
                known.setdefault(word, len(COMMON) + number)
    return Ranks(known)


def runs(value: str) -> list[tuple[int, int, int]]:
    """(start, end, width) of every stretch that repeats with that width, at least twice, and cannot be longer; width is its least.

    For each width only places that are its multiples are compared with the next one: a stretch of two widths holds one.
    """
    n, found = len(value), []
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside: dict[int, list[tuple[int, int]]] = {}  # by width, stretches that repeat with a part of it
    for width in range(1, n // 2 + 1):
        anchors = np.arange(0, n - width, width)
        known, done = inside.pop(width, ()), 0
        for a in anchors[points[anchors] == points[anchors + width]].tolist():
            if a < done:
                continue
            if over := [e for s, e in known if s <= a and a + width < e]:
                done = over[0] - width
                continue
            start, done = a, a
            while start and value[start - 1] == value[start - 1 + width]:
                start -= 1
            while done + width < n and value[done] == value[done + width]:
                done += 1
            if done - start >= width:
                end = done + width
                for more in range(2 * width, (end - start) // 2 + 1, width):
                    inside.setdefault(more, []).append((start, end))
                found.append((start, end, width))
    return found


def segments(value: str, known: Ranks = RANK) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of every stretch that is cheaper to guess than by brute force; repeated blocks are in ``repeats``."""
    out, n, lower = [], len(value), value.lower()
    plain = lower.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + known.longest) + 1):
            rank = known.get(lower[i:j])
            changed = 0.0 if rank else 0.3 * sum(a != b for a, b in zip(lower[i:j], plain[i:j]))
            rank = rank or known.get(plain[i:j])
            if rank:
                capitals = sum(c.isupper() for c in value[i:j])
                cased = 0.0 if not capitals else 0.3 if value[i].isupper() and capitals == 1 or capitals == j - i else 0.3 + math.log10(math.comb(j - i, min(capitals, j - i - capitals)) + 1)
                out.append((i, j, math.log10(rank + 1) + changed + cased))
        found = DATE.match(value, i)
        if found:
            year = int(re.search(r"(?:19|20)\d\d", found[0])[0])
            days = 1 if len(found[0]) == 4 else 365
            out.append((i, found.end(), math.log10(max(abs(year - 2000), 20) * days) + (0.6 if found[1] or found[2] else 0)))
    for step in (1, -1):  # abc, 321
        i = 0
        while i < n:
            j = i + 1
            while j < n and value[j].isalnum() and value[j - 1].isalnum() and ord(value[j]) - ord(value[j - 1]) == step:
                j += 1
            if j - i >= 3:
                out.append((i, j, math.log10((4 if value[i] in "aAzZ019" else 26) * (j - i)) + (0.3 if step < 0 else 0)))
            i = max(j - 1, i + 1) if j - i > 1 else j
    keys = [PLACE.get(c) for c in lower.translate(SHIFTED)]
    i = 0
    while i < n:
        j, turns, last = i + 1, 1, None
        while j < n and keys[j] and keys[j - 1]:
            move = (keys[j][0] - keys[j - 1][0], round(keys[j][1] - keys[j - 1][1], 1))
            if abs(move[0]) > 1 or abs(move[1]) > 1 or move == (0, 0.0):
                break
            turns, last, j = turns + (last is not None and move != last), move, j + 1
        if j - i >= 4:
            out.append((i, j, math.log10(47 * (j - i)) + turns * math.log10(4.6)))
        i = max(j - 1, i + 1) if j - i > 1 else j
    return out


def brute_rate(value: str) -> float:
    """log10 of the alphabet a guesser must try for each character: the classes that the value has, 95 at most."""
    small, capital, digit = (any(lo <= c <= hi for c in value) for lo, hi in ("az", "AZ", "09"))
    other = any(not (c.isascii() and c.isalnum()) for c in value)
    return math.log10(max(10, 26 * small + 26 * capital + 10 * digit + 33 * other))


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, width): of each run as many whole blocks as it has, from its start and up to its end."""
    out = set()
    for start, end, width in runs(value):
        whole = (end - start) // width * width
        out |= {(start, start + whole, width), (end - whole, end, width)}
    return sorted(out)


def guess_cost(value: str, rate: float = 1.0, known: Ranks = RANK, costs: dict[str, float] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation; a brute-force character costs ``rate``.

    A block again and again costs what the block costs, and log10 of how often; ``costs`` has the blocks already seen.
    """
    if not value:
        return 0.0
    costs = {} if costs is None else costs
    if value in costs:
        return costs[value]
    found = segments(value, known)
    for i, j, width in repeats(value):
        found.append((i, j, guess_cost(value[i : i + width], rate, known, costs) + math.log10((j - i) // width)))
    found = sorted((j, i, cost) for i, j, cost in found)
    # best: a segment ends here; brute: a brute-force stretch, one segment, reaches here.
    best, brute, at = array("d", [0.0]), math.inf, 0
    for j in range(1, len(value) + 1):
        brute = min(brute, best[j - 1] + (SWITCH if j > 1 else 0.0)) + rate
        least = brute
        while at < len(found) and found[at][0] == j:
            _, i, cost = found[at]
            least, at = min(least, best[i] + (SWITCH if i else 0.0) + cost), at + 1
        best.append(least)
    costs[value] = best[-1]
    return best[-1]


def find_spans(text: str, least_cost: float, known: Ranks = RANK) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, cost of the value) in order."""
    cost = lambda value: guess_cost(value, brute_rate(value), known)
    spans = [("assign", m.start(), m.end(), cost(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end(), cost(m[0])) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end(), cost(m[0])) for m in HEX.finditer(text) if len(m[0]) >= 24]
    covered: list[list[int]] = []  # the base spans as disjoint stretches, in order
    for _, a, b, _ in sorted(spans, key=lambda s: s[1:3]):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    starts, ends = [a for a, _ in covered], [b for _, b in covered]
    for m in CONTEXT.finditer(text):
        a, b = m.span("value")
        before = bisect_left(starts, b)
        if before and ends[before - 1] > a or m["bearer"] and PROSE.fullmatch(m["value"]):
            continue
        rate = 1.0 if m["is"] and PROSE.fullmatch(m["value"]) else brute_rate(m["value"])
        guesses = guess_cost(m["value"], rate, known)
        if guesses >= least_cost:
            spans.append(("guess", a, b, guesses))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, *, least_cost: float = 11.0, dictionary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): the spans of each document as an array of (kind, start, end, cost).

    ``dictionary`` is the path of a vocabulary file whose words a guesser tries by rank.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        known = ranks(dictionary)
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                texts = pc.fill_null(batch.column("text"), "")
                maybe = pc.match_substring_regex(texts, MAYBE)
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                rows = pc.indices_nonzero(maybe)
                for i, text in zip(rows.to_pylist(), texts.take(rows).to_pylist()):
                    found[i] = [{"kind": k, "start": a, "end": b, "cost": round(c, 6)} for k, a, b, c in find_spans(text, least_cost, known)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, found array<struct<kind:string,start:long,end:long,cost:double>>"
    )


def costs(spans: Column) -> Column:
    """start:cost of every span, joined by commas; the cost in tenths of log10 guesses."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), F.round(s["cost"] * 10).cast("long").cast("string"))), ",")


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
