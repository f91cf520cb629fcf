"""Ward's criterion, exact: searches for near clusters are dealt to all tasks, one task merges along the lists they find."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions import vectors as V
from convlens.session import checkpointed

#: Near clusters that each cluster lists, clusters in a pack, rows and columns of a product, and pairs whose vectors are compared at once.
LISTED, PACK, ROWS, COLUMNS, AT_ONCE = 16, 1024, 256, 16_384, 16_384
#: Clusters in a block that a task searches for at most, tasks of a search, and pairs to compare that are not dealt out: some seconds.
OWN, TASKS, ALONE = 65_536, 48, 1 << 29

SCHEMA = "kind string, number long, live int, wanted int, row binary, size binary, centre binary, known binary, near binary, cost binary, beyond binary, after binary"
FIELDS = ("row", "size", "centre", "known", "near", "cost", "beyond", "after")
TYPES = {"row": np.int64, "size": np.float64, "centre": np.float64, "known": np.bool_, "near": np.int64, "cost": np.float64, "beyond": np.float64, "after": np.int64}


def steps(size: np.ndarray, centre: np.ndarray, sizes: np.ndarray, centres: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squares of the heights at which clusters i and j would merge; by differences, so alike from both sides."""
    out = np.empty(len(i))
    for start in range(0, len(i), AT_ONCE):
        p, q = i[start : start + AT_ONCE], j[start : start + AT_ONCE]
        out[start : start + AT_ONCE] = 2 * size[p] * sizes[q] / (size[p] + sizes[q]) * ((centre[p] - centres[q]) ** 2).sum(1)
    return out


class Search:
    """The nearest of all clusters seen, and the first of those left out, for each of some clusters; the nearer first, ties to the smaller row."""

    def __init__(self, row: np.ndarray, size: np.ndarray, centre: np.ndarray):
        self.row, self.size, self.centre = row, size, centre
        self.shift = centre.mean(0)
        self.far = ((centre - self.shift) ** 2).sum(1)
        self.room = np.empty(0, np.float32)
        self.near, self.cost = np.full((len(row), LISTED + 1), -1), np.full((len(row), LISTED + 1), np.inf)

    def see(self, row: np.ndarray, size: np.ndarray, centre: np.ndarray) -> None:
        # Groups of 32 hold clusters of like sizes: the least size of a group and its least distance tell that none in it is near enough.
        order = np.argsort(size, kind="stable")
        row, size, centre = row[order], size[order], centre[order]
        far, parts = ((centre - self.shift) ** 2).sum(1).max(), -(-len(row) // 32)
        unit = float(np.sqrt(max(far, self.far.max()))) or 1.0
        at = np.arange(32 * parts).reshape(parts, 32).T.ravel()
        pad, at = at >= len(row), np.minimum(at, len(row) - 1)
        least, most, sizes, packed = size[::32], size[np.minimum(np.arange(31, 32 * parts, 32), len(size) - 1)], size[at], {}

        def thin(c: np.ndarray, kind: type) -> np.ndarray:
            # Products only sort out the rest: squares less twice what they may be wrong by are never above the true ones.
            y, less = (c - self.shift) / unit, 1 - (c.shape[1] + 8) * np.finfo(kind).eps
            return np.column_stack((y, np.ones(len(y)), less * (y * y).sum(1))).astype(kind)

        for start in range(0, len(self.row), ROWS):
            own = slice(start, start + ROWS)
            s, top = self.size[own], self.cost[own, LISTED]
            rest = np.arange(len(s))
            for kind in (np.float32, np.float64):
                # Near copies are not told apart in single precision: rows that too many groups may be near to are looked at again in double.
                if kind not in packed:
                    packed[kind] = thin(centre, kind)[at]
                    packed[kind][pad, -1] = 1e30
                mine, width = thin(self.centre[own][rest], kind), 32 * parts
                if self.room.dtype != kind or len(self.room) < len(mine) * width:
                    self.room = np.empty(len(mine) * width, kind)
                low = self.room[: len(mine) * width].reshape(len(mine), width)
                np.matmul(np.column_stack((-2 * mine[:, :-2], mine[:, -1], np.ones(len(mine), kind))), packed[kind].T, out=low)
                share = lambda of, other: 2 * unit**2 * of * other / (of + other)
                nearest = np.maximum(low.reshape(len(rest), 32, parts).min(1), 0)
                lows = nearest * share(s[rest, None], least)

                def within(edge: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    edge = np.minimum(edge * (1 + 1e-9), 1e28 * unit**2)
                    k, part = np.nonzero(lows[some] <= edge[some, None])
                    k, there = some[k], part[:, None] + parts * np.arange(32)
                    p, q = np.nonzero(np.maximum(low[k[:, None], there], 0) * share(s[rest[k], None], sizes[there]) <= edge[k, None])
                    i, j = rest[k[p]], at[there[p, q]]
                    other = self.row[own][i] != row[j]
                    i, j = i[other], j[other]
                    return i, j, steps(s, self.centre[own], size, centre, i, j)

                edge = top[rest]
                blank = np.flatnonzero(np.isinf(edge))
                if len(blank) and parts > LISTED + 2:
                    # So many groups have one that is as near as this at most.
                    wrong = 4 * (centre.shape[1] + 8) * np.finfo(kind).eps
                    edge[blank] = np.partition((nearest[blank] + wrong) * share(s[rest[blank], None], most), LISTED + 1, axis=1)[:, LISTED + 1]
                many = (lows <= edge[:, None] * (1 + 1e-9)).sum(1) > 4 * LISTED if kind == np.float32 else np.zeros(len(rest), bool)
                self._list(start, *within(edge, np.flatnonzero(~many)), row)
                rest = rest[many]
                if not len(rest):
                    break

    def _list(self, start: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, row: np.ndarray) -> None:
        kept = d <= self.cost[start + i, LISTED]
        i, j, d = start + i[kept], row[j[kept]], d[kept]
        new = np.unique(i)
        p, q = np.nonzero(np.isfinite(self.cost[new]))
        i, j, d = np.concatenate((new[p], i)), np.concatenate((self.near[new[p], q], j)), np.concatenate((self.cost[new[p], q], d))
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        kept = rank <= LISTED
        self.near[i[kept], rank[kept]], self.cost[i[kept], rank[kept]] = j[kept], d[kept]


class Clusters:
    """Clusters by ascending row, their lists of near ones, and the merges found: (height, row, row), each after those below it.

    Two clusters that are each other's nearest are merged whatever the rest does, so all such pairs are merged at once. A merged
    cluster is no nearer to others than the nearer of its two was: a cluster's list of near ones holds, with the merged in place of
    their parts, as long as one of them is nearer than all that were left out. Those without a list are wanted: to be searched for.
    """

    def __init__(self, row: np.ndarray, size: np.ndarray, centre: np.ndarray):
        n = len(row)
        self.row, self.size, self.centre, self.wanted = row, size, centre, np.ones(n, bool)
        self.near, self.cost = np.zeros((n, LISTED), np.int32), np.full((n, LISTED), np.inf)
        self.beyond, self.after = np.full(n, np.inf), np.full(n, -1)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take(self, row: np.ndarray, near: np.ndarray, cost: np.ndarray, beyond: np.ndarray, after: np.ndarray) -> None:
        i, listed = np.searchsorted(self.row, row), np.isfinite(cost)
        self.near[i], self.cost[i], self.beyond[i], self.after[i], self.wanted[i] = np.where(listed, np.searchsorted(self.row, near), 0), cost, beyond, after, False

    def packs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for start in range(0, len(self.row), COLUMNS):
            yield tuple(v[start : start + COLUMNS] for v in (self.row, self.size, self.centre))

    def look(self) -> None:
        search = Search(*(v[self.wanted] for v in (self.row, self.size, self.centre)))
        for pack in self.packs():
            search.see(*pack)
        self.take(search.row, search.near[:, :LISTED], search.cost[:, :LISTED], search.cost[:, LISTED], search.near[:, LISTED])

    def merge(self) -> None:
        """Merges until one is left or some are wanted."""
        row, size, centre, wanted, near, cost, beyond, after = self.row, self.size, self.centre, self.wanted, self.near, self.cost, self.beyond, self.after
        live = slots = len(row)
        alive = np.ones(slots, bool)
        least = cost.min(1)
        best = near[np.arange(slots), np.where(cost == least[:, None], row[near], np.iinfo(np.int64).max).argmin(1)].astype(np.int64)
        while live > 1:
            known, place = alive & ~wanted, np.arange(slots)
            a = np.flatnonzero(known & known[best] & (best[best] == place) & (place < best))
            if not len(a):
                if (alive & wanted).any():
                    break
                # Rounding has put one before the other: the least pair of all is one that merges.
                some = np.flatnonzero(alive)
                a = some[[np.lexsort((row[some], least[some]))[0]]]
            b = best[a]
            self.found.append((np.sqrt(least[a]), row[a], row[b]))
            into = size[a] + size[b]
            centre[a] = (size[a, None] * centre[a] + size[b, None] * centre[b]) / into[:, None]
            size[a], row[a] = into, np.minimum(row[a], row[b])
            alive[b], wanted[a], wanted[b], live = False, True, False, live - len(a)
            touched = np.zeros(slots, bool)
            touched[a] = touched[b] = True
            place[b] = a
            held = np.flatnonzero(alive & ~wanted)
            i, p = np.nonzero(touched[near[held]] & np.isfinite(cost[held]))
            i = held[i]
            near[i, p] = place[near[i, p]]
            cost[i, p] = steps(size, centre, size, centre, i, near[i, p])
            lost = held[touched[best[held]]]
            low = cost[lost].min(1)
            tied = np.where(cost[lost] == low[:, None], row[near[lost]], np.iinfo(np.int64).max)
            best[lost], least[lost] = near[lost, tied.argmin(1)], low
            wanted[lost] = ~((low < beyond[lost]) | (low == beyond[lost]) & (tied.min(1) < after[lost]))
            if live < 0.8 * slots:
                row, size, centre, wanted, near, cost, beyond, after, best, least = self._kept(alive, row, size, centre, wanted, near, cost, beyond, after, best, least)
                alive, slots = np.ones(live, bool), live
        self.row, self.size, self.centre, self.wanted, self.near, self.cost, self.beyond, self.after, _, _ = self._kept(alive, row, size, centre, wanted, near, cost, beyond, after, best, least)

    @staticmethod
    def _kept(alive: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        place = np.where(alive, np.cumsum(alive) - 1, 0)
        row, size, centre, wanted, near, cost, beyond, after, best, least = (v[alive] for v in columns)
        return [row, size, centre, wanted, place[near].astype(np.int32), cost, beyond, after, place[best], least]


def root(top: list[int], i: int) -> int:
    while top[i] != i:
        top[i] = top[top[i]]
        i = top[i]
    return i


def tree(n: int, height: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges of rows 0..n-1 in the order of their heights, those of one height as they were found; numbered from n."""
    top, name, out = list(range(n)), list(range(n)), []
    order = np.argsort(height, kind="stable")
    for step, (high, i, j) in enumerate(zip(height[order].tolist(), left[order].tolist(), right[order].tolist())):
        i, j = sorted((root(top, i), root(top, j)))
        out.append((name[i], name[j], high))
        top[j], name[i] = i, n + step
    return out


def checked(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all():
        raise ValueError("a vector has a component that is not finite")
    return x


def merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Ward's merges, least first; rows are clusters 0..n-1, merges are numbered from n. Ties go to the smaller row.

    Memory is in proportion to the rows, time to their square.
    """
    n = len(x)
    if n < 2:
        return []
    x = checked(np.array(x, float) + 0.0)
    _, first, group, count = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    group = group.ravel()
    copies = np.flatnonzero(first[group] != np.arange(n))
    order = np.argsort(first)
    clusters = Clusters(first[order], count[order].astype(float), x[first[order]])
    while len(clusters.row) > 1:
        clusters.look()
        clusters.merge()
    return tree(n, *(np.concatenate(f) for f in zip((np.zeros(len(copies)), first[group[copies]], copies), *clusters.found)))


def _batch(kind: str, number: int = 0, live: int = 0, wanted: int = 0, **fields: np.ndarray) -> pa.RecordBatch:
    binary = [pa.array([np.ascontiguousarray(fields[f], TYPES[f]).tobytes() if f in fields else None], pa.binary()) for f in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([number], pa.int64()), pa.array([live], pa.int32()), pa.array([wanted], pa.int32()), *binary], ["kind", "number", "live", "wanted", *FIELDS])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, dict[str, np.ndarray]]]:
    """Rows of packs: their plain columns, and their arrays."""
    for batch in batches:
        plain = [c for c in batch.schema.names if c not in FIELDS]
        for i in range(batch.num_rows):
            cells = {f: batch.column(f)[i] for f in FIELDS if f in batch.schema.names}
            yield {c: batch.column(c)[i].as_py() for c in plain}, {f: np.frombuffer(v.as_buffer(), TYPES[f]) for f, v in cells.items() if v.is_valid}


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        if v.null_count:
            raise ValueError("a vector is missing")
        x = checked(np.asarray(v.flatten().to_numpy(zero_copy_only=False), float) + 0.0)
        width = len(x) // batch.num_rows if batch.num_rows else 0
        if not (np.diff(v.offsets.to_numpy()) == width).all():
            raise ValueError("vectors differ in length")
        row, size, x = batch.column("row").to_numpy(), batch.column("size").to_numpy().astype(float), x.reshape(batch.num_rows, width)
        for start in range(0, len(row), PACK):
            p = slice(start, start + PACK)
            yield _batch("cluster", 0, len(row[p]), len(row[p]), row=row[p], size=size[p], centre=x[p])


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each task ``t`` its own clusters, then those to compare them with; their lists are the answer."""
    now, own, others, search = None, [], [], None

    def see(least: int) -> None:
        if sum(len(p["row"]) for p in others) >= least:
            search.see(*(np.concatenate([p[f] for p in others]) for f in ("row", "size", "centre")))
            others.clear()

    def lists() -> Iterator[pa.RecordBatch]:
        if others:
            see(1)
        for start in range(0, len(search.row) if search else 0, PACK):
            p = slice(start, start + PACK)
            cells = {"row": search.row[p], "near": search.near[p], "cost": search.cost[p]}
            yield pa.RecordBatch.from_arrays([pa.array([now // TASKS], pa.int32()), pa.array([start], pa.int32()), *[pa.array([v.astype(TYPES[f]).tobytes()], pa.binary()) for f, v in cells.items()]], ["i", "start", *cells])

    for plain, pack in _rows(batches):
        if plain["t"] != now:
            yield from lists()
            now, own, search = plain["t"], [], None
        pack["centre"] = pack["centre"].reshape(len(pack["row"]), -1)
        if not plain["other"]:
            own.append(pack)
            continue
        if search is None and own:
            row, size, centre = (np.concatenate([p[f] for p in own]) for f in ("row", "size", "centre"))
            order, own = np.argsort(row), []
            search = Search(row[order], size[order], centre[order])
        if search is not None:
            others.append(pack)
            see(COLUMNS)
    yield from lists()


def _joined(table: pa.Table) -> pa.Table:
    """One list of what several tasks have found for the same clusters."""
    found = [pack for _, pack in _rows(table.to_batches())]
    near, cost = (np.concatenate([p[f].reshape(-1, LISTED + 1) for p in found], axis=1) for f in ("near", "cost"))
    order = np.lexsort((near, cost), axis=-1)[:, : LISTED + 1]
    near, cost = np.take_along_axis(near, order, 1), np.take_along_axis(cost, order, 1)
    return pa.Table.from_batches([_batch("list", row=found[0]["row"], near=near[:, :LISTED], cost=cost[:, :LISTED], beyond=cost[:, LISTED], after=near[:, LISTED])])


def _merge(live: int, alone: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, size, centre, done, lists = np.empty(live, np.int64), np.empty(live), None, 0, []
        for plain, pack in _rows(batches):
            if plain["kind"] == "cluster":
                p = slice(done, done := done + len(pack["row"]))
                centre = np.empty((live, len(pack["centre"]) // len(pack["row"]))) if centre is None else centre
                row[p], size[p], centre[p] = pack["row"], pack["size"], pack["centre"].reshape(len(pack["row"]), -1)
            if "near" in pack:
                known = pack.get("known", np.ones(len(pack["row"]), bool))
                lists.append([v.reshape(len(known), -1)[known] for v in (pack["row"], pack["near"], pack["cost"], pack["beyond"], pack["after"])])
        if centre is None:
            return
        order = np.argsort(row)
        clusters = Clusters(row[order], size[order], centre[order])
        del row, size, centre
        while lists:
            of, near, cost, beyond, after = lists.pop()
            clusters.take(of.ravel(), near, cost, beyond.ravel(), after.ravel())
        clusters.merge()
        while len(clusters.row) > 1 and len(clusters.row) * int(clusters.wanted.sum()) <= alone:
            clusters.look()
            clusters.merge()
        for number, (height, left, right) in enumerate(clusters.found):
            yield _batch("merge", number, row=left, near=right, cost=height)
        for start in range(0, len(clusters.row), PACK):
            p = slice(start, start + PACK)
            known, lists = ~clusters.wanted[p], {f: getattr(clusters, f)[p] for f in ("row", "size", "centre", "cost", "beyond", "after")}
            yield _batch("cluster", start, len(known), int((~known).sum()), known=known, near=clusters.row[clusters.near[p]], **lists)

    return run


def _searched(packs: DataFrame) -> DataFrame:
    """Lists of the wanted clusters' nearest: blocks of them by parts of all clusters, each pair in a task that streams the part."""
    told = packs.select("number", "live", "wanted").orderBy("number").collect()
    live, wanted = np.cumsum([[r["live"], r["wanted"]] for r in told], axis=0).T
    # All clusters are sent to each block, so few wanted ones make few blocks and many parts.
    few = round(2 * np.sqrt(TASKS * wanted[-1] / live[-1]))
    blocks = int(max(-(-wanted[-1] // OWN), min(8, -(-wanted[-1] // PACK), few), 1))
    parts = int(min(-(-TASKS // blocks), -(-live[-1] // PACK), 24))
    # The i-th block and j-th part a pack is in, so that all have about as many clusters.
    deal = [(r["number"], int((w - 1) * blocks // wanted[-1]) if r["wanted"] else 0, int((n - 1) * parts // live[-1])) for r, n, w in zip(told, live, wanted)]
    known = packs.join(F.broadcast(packs.sparkSession.createDataFrame(deal, "number long, i int, j int")), "number").select(*(F.col(c) for c in ("i", "j", "wanted", "known", "row", "size", "centre")))

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for plain, pack in _rows(batches):
            some = ~pack["known"] if "known" in pack else np.ones(len(pack["row"]), bool)
            yield _batch("own", plain["i"], row=pack["row"][some], size=pack["size"][some], centre=pack["centre"].reshape(len(some), -1)[some])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = ("row", "size", "centre")
    mine = known.where("wanted > 0").mapInArrow(own, SCHEMA).select(*cells, F.col("number").cast("int").alias("i"), every(parts).alias("j"), F.lit(False).alias("other"))
    rest = known.select(*cells, every(blocks).alias("i"), "j", F.lit(True).alias("other"))
    dealt = mine.unionByName(rest).select(*cells, (F.col("i") * TASKS + F.col("j")).alias("t"), "other", (F.col("i") * parts + F.col("j")).alias("at"))
    lists = dealt.repartitionById(blocks * parts, "at").sortWithinPartitions("t", "other").mapInArrow(_search, "i int, start int, row binary, near binary, cost binary")
    return lists.groupBy("i", "start").applyInArrow(_joined, SCHEMA)


def _labels(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, row, first), first where the row is a copy of another, and merges (round, number, left, right, height) as labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found = [], []
        for batch in batches:
            plain = np.asarray(batch.column("round").fill_null(-1)) < 0
            rows.append(np.column_stack([np.asarray(batch.column(c).fill_null(-1))[plain] for c in ("row", "id", "first")]))
            for i in np.flatnonzero(~plain):
                cells = [np.frombuffer(batch.column(c)[i].as_buffer(), TYPES[t]) for c, t in (("height", "cost"), ("left", "row"), ("right", "near"))]
                found.append(((batch.column("round")[i].as_py(), batch.column("number")[i].as_py()), cells))
        row, id_, first = (rows := np.concatenate(rows) if rows else np.empty((0, 3), np.int64))[rows[:, 0].argsort()].T
        if not len(row):
            return
        found = [cells for _, cells in sorted(found, key=lambda f: f[0])]
        copies = first >= 0
        height, left, right = (np.concatenate(f) for f in zip((np.zeros(copies.sum()), first[copies], row[copies]), *found))
        order = np.argsort(height, kind="stable")[: max(len(row) - k, 0)]
        top = list(range(len(row)))
        for i, j in zip(np.searchsorted(row, left[order]).tolist(), np.searchsorted(row, right[order]).tolist()):
            i, j = sorted((root(top, i), root(top, j)))
            top[j] = i
        _, label = np.unique([root(top, i) for i in range(len(row))], return_inverse=True)
        for start in range(0, len(row), 10_000):
            p = slice(start, start + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(id_[p]), pa.array(label[p], pa.int32())], ["id", "label"])

    return run


def ward(df: DataFrame, k: int, checkpoint: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(id, label) by Ward's criterion, labels by the least id. Exact at every size.

    Time goes by the square of the rows, in searches that are dealt to all tasks, a block of clusters and a stream of others each. What lies
    between the searches is in proportion to the rows, in time and in memory, and runs in one task, as do searches of at most ALONE pairs.
    """
    vector = F.transform(V.doubles(F.col("v")), lambda x: x + F.lit(0.0))
    rows = checkpoint(df.select("id", vector.alias("v")).repartitionByRange("id").sortWithinPartitions("id").withColumn("row", F.monotonically_increasing_id()))
    alike = checkpoint(rows.groupBy("v").agg(F.min("row").alias("first"), F.count("*").alias("size")))
    several = alike.where("size > 1").select(F.col("v").alias("w"), "first")
    named = checkpoint(rows.join(several, F.col("v") == F.col("w"), "left").select(F.col("id").cast("long").alias("id"), "row", F.when(F.col("row") != F.col("first"), F.col("first")).alias("first")))
    packs = checkpoint(alike.select(F.col("first").alias("row"), "size", "v").mapInArrow(_pack, SCHEMA).withColumn("number", F.monotonically_increasing_id()))
    merged = None
    for round_ in itertools.count():
        live, wanted = packs.agg(F.coalesce(F.sum("live"), F.lit(0)), F.coalesce(F.sum("wanted"), F.lit(0))).first()
        if live < 2:
            break
        given = packs.unionByName(checkpoint(_searched(packs))) if live * wanted > ALONE else packs
        told = checkpoint(given.coalesce(1).mapInArrow(_merge(live, ALONE), SCHEMA))
        new = told.where("kind = 'merge'").select(F.lit(round_).alias("round"), "number", F.col("row").alias("left"), F.col("near").alias("right"), F.col("cost").alias("height"))
        merged = new if merged is None else merged.unionByName(new)
        packs = told.where("kind = 'cluster'")
    found = named if merged is None else named.unionByName(merged, allowMissingColumns=True)
    missing = [F.lit(None).cast(t).alias(c) for c, t in (("round", "int"), ("number", "long"), ("left", "binary"), ("right", "binary"), ("height", "binary")) if c not in found.columns]
    return found.select("*", *missing).coalesce(1).mapInArrow(_labels(k), "id long, label int")
