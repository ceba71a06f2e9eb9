"""N-gram Jaccard join in the metric space of shingle sets: Voronoi regions of pivots, joined recursively and exactly.

A document is its set of distinct 5-word shingles, as 64-bit hashes. Two documents link when their sets' Jaccard
similarity is 0.75 or more, that is when their Jaccard distance, a metric, is 0.25 or less. The result is each
document's component: the smallest id that it reaches by links.

1. Equal sets are one point; from here on a point stands for all its copies.
2. First regions: every shingle is a pivot, and a point is near to those pivots that are its own shingles, and at distance
   1 of all others. Under any total order of shingles two linked sets share one of the first |x| - ceil(0.75 |x|) + 1
   shingles of each, so a point is replicated to the pivots of that prefix and no link is lost. Points that meet often
   enough there (see ``coarse_links``) hang together; a connected group of them is a region, and no link leaves it. The
   order goes by a sketch of counts over all documents, emptiest counters first (see ``ranks``); the sketch only decides
   how large regions get, never which links are found. (Documents as pivots for all documents can't start: nearly all
   pairs are at distance 1, and every window would hold everything. The README has figures.)
3. Every region is joined by pivots from among its points, recursively (``PivotJoin``). Each point belongs to its nearest
   pivot. Points within 0.25 of a pivot are linked to it. A point visits the cell of an earlier pivot if its distance to
   that pivot is at most the cell's radius plus 0.25: by the triangle inequality no link is lost. Points far from all
   pivots are a cell of their own. A cell with its visitors that hangs together already is done, others are regions again.
   Of the pairs in the smallest cells only those are compared whose distances to all pivots differ by 0.25 at most.
4. Regions too large for one task are split the same way over many tasks (``split_regions``), until their cells fit.
   A region that pivots don't thin out is joined in blocks: every pair of blocks meets in one task.

Defined results: texts without words have no shingles and link with nothing; texts of fewer than five words have one
shingle, the whole sequence; rows that share an id are joined by their texts, each row with its own component; null ids
are one id, smaller than all others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, near, slices, utf8
from .components import components

WORDS = 5
#: Points, and shingles in all, that are joined in one task.
LIMIT, LIMIT_SHINGLES = 512, 2_000_000
PIVOTS = 16
#: Farther than this from all pivots, a point is in the cell of the far ones (number PIVOTS).
FAR = 0.75
#: Points that are compared pair by pair; and the part of a region's pairs that its cells may have to count as thinned out.
LEAF, THINNED = 8, 0.5
#: Sets that share a 64-bit name and get another one, at most (chance has some hundred among 1e11).
RENAMED = 1_000_000
#: Points at one shingle that are paired, or this times the noise of a counter if that is more; still more are tied to one.
CROWD, NOISES = 64, 4
#: Width of the bands of sizes, as a logarithm: sizes of linked sets are in the same band or in neighbours.
BAND = float(np.log(4 / 3)) * 1.001
#: Counters of the sketch, and counters that travel as one row.
SKETCH, BLOCK = 1 << 22, 1 << 13
NO_ID = -(2**63)
EPS = 1e-9

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < WORDS:
        return mix((hashed * _ODD[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - WORDS + 1
    total = hashed[:n] * _ODD[0]
    for k in range(1, WORDS):
        total += hashed[k : k + n] * _ODD[k]
    return np.unique(mix(total))


def linked(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Jaccard similarity of 0.75 or more, in integers."""
    return 100 * inter >= 75 * (a + b - inter)


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def set_key(points: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set; the first names the point, the second tells if two sets share a name."""
    data = points.tobytes()
    return _signed(xxhash.xxh3_64_intdigest(data)), _signed(xxhash.xxh64_intdigest(data, 1))


#: New names of the sets whose name another set has, by both hashes.
Renamed = dict[tuple[int, int], int]


def name_of(points: np.ndarray, renamed: Renamed) -> int:
    key = set_key(points)
    return renamed.get(key, key[0]) if renamed else key[0]


def rename(points: DataFrame, named: DataFrame) -> Renamed:
    """Names for all but one of the sets that share one. ``named``: fp, least and greatest check."""
    shared = named.where("c <> d").select("fp")
    found = points.join(shared, "fp").select("fp", "check").distinct().limit(RENAMED + 1).collect()
    if len(found) > RENAMED:
        raise RuntimeError("too many sets share a name")
    checks: dict[int, list[int]] = {}
    for r in found:
        checks.setdefault(r["fp"], []).append(r["check"])
    todo, made, turn = [(fp, c) for fp, cs in checks.items() for c in sorted(cs)[1:]], {}, 0
    while todo:
        turn += 1
        new = {key: _signed(xxhash.xxh64_intdigest(b"%d %d" % key, turn)) for key in todo}
        spark = points.sparkSession
        used = {r["fp"] for r in named.join(F.broadcast(spark.createDataFrame([(x,) for x in new.values()], "fp long")), "fp").select("fp").collect()} | set(made.values())
        taken: set[int] = set()
        for key, x in new.items():
            if x not in used and x not in taken:
                made[key] = x
                taken.add(x)
        todo = [key for key in todo if key not in made]
    return made


def with_ids(docs: DataFrame) -> DataFrame:
    """id, text and a hash of the text, which tells rows with one id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")


def read_points(docs: DataFrame, own: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(rows (id, th, n, fp, check) of all documents, the counters of the sketch). One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(SKETCH, np.int64), ["kind", "id", "th", "n", "fp", "check", "counts"]
        held: list[np.ndarray] = []
        size = 0
        for part in slices(batches):
            sets = [shingles(x) for x in utf8(part.column("text"))]
            keys = [set_key(x) for x in sets]
            rows = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * rows, pa.int32()), part.column("id"), part.column("th"), pa.array([len(x) for x in sets], pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.nulls(rows, pa.binary())], names)
            held += sets
            size += sum(map(len, sets))
            if size > 1_000_000:
                counts += np.bincount((np.concatenate(held) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                held, size = [], 0
        if held:
            counts += np.bincount((np.concatenate(held) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        blocks = counts.reshape(-1, BLOCK)
        for some in np.array_split(np.flatnonzero(blocks.any(axis=1)), 8):
            if len(some):
                no = pa.nulls(len(some), pa.int64())
                data = [zlib.compress(np.minimum(blocks[i], 2**31 - 1).astype(np.uint8 if blocks[i].max() < 256 else np.uint32).tobytes(), 1) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(some), pa.int32()), pa.array(some, pa.int64()), no, no, no, no, pa.array(data, pa.binary())], names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for part in slices(batches):
            for block, data in zip(part.column("id").to_pylist(), part.column("counts").to_pylist(), strict=True):
                raw = zlib.decompress(data)
                x = np.frombuffer(raw, np.uint8 if len(raw) == BLOCK else np.uint32).astype(np.uint32)
                found[block] = found[block] + x if block in found else x
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in found.values()], pa.binary())], ["id", "counts"])

    table = own.table(with_ids(docs).mapInArrow(run, "kind int, id long, th long, n long, fp long, check long, counts binary"), "jaccard-points")
    summed = table.where("kind = 1").select("id", "counts").repartition("id").mapInArrow(total, "id long, counts binary").toArrow()
    counts = np.zeros((SKETCH // BLOCK, BLOCK), np.int64)
    for block, data in zip(summed.column("id").to_pylist(), summed.column("counts").to_pylist(), strict=True):
        counts[block] += np.frombuffer(zlib.decompress(data), np.uint32)
    return table.where("kind = 0").select("id", "th", "n", "fp", "check"), counts.reshape(-1)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Counters from empty to full: up to 3 times the noise above the mean by eighths of the noise, then by doublings.

    The steps below the mean count: a shingle shares its counter with hundreds of others on large inputs, so a frequent
    one can be hidden in the noise. A prefix takes a quarter of a point's shingles, the emptiest counters first, and there
    a shingle of some noises is not found; were all of them equal, a quarter of the hidden ones would be in prefixes, and
    the crowds at them would tie all points into one region.
    """
    mean = counts.mean()
    above = (counts - mean) / np.sqrt(mean + 1)
    return np.where(above < 3, np.clip(above, -5, 3) * 8 + 40, 65 + np.log2(np.maximum(3, above) / 3)).astype(np.uint8)


def coarse_links(docs: DataFrame, counts: np.ndarray, renamed: Renamed, own: Scratch) -> DataFrame:
    """(a, b): pairs of points that hold all links together, and more.

    Every point is sent to the shingles of its prefix. Points that meet at a shingle with up to ``crowd`` of them are
    paired, and a pair is kept if it meets often enough: of its common shingles all up to the end of the shorter prefix
    are meetings, so a pair that could reach the similarity by what lies beyond it is kept, and no other. Where more
    points meet they are tied to the smallest one, in bands of sizes, as linked sets differ in size by a quarter at most;
    of a shingle that is crowded in one batch already, only the smallest point of each band is sent on, marked.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks(counts))
    crowd = max(CROWD, int(NOISES * np.sqrt(counts.mean())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, known = shared.value, set()
        for part in slices(batches, 1024):
            hs, fps, ns = [], [], []
            for text in utf8(part.column("text")):
                points = shingles(text)
                fp = name_of(points, renamed)
                if not len(points) or fp in known:
                    continue
                known.add(fp)
                first = np.lexsort((points, order[(points % np.uint64(SKETCH)).astype(np.int64)]))[: prefix_length(len(points))]
                hs.append(points[first])
                fps.append(np.full(len(first), fp, np.int64))
                ns.append(np.full(len(first), len(points), np.int64))
            if len(known) > 1_000_000:
                known.clear()
            if not hs:
                continue
            h, fp, n = np.concatenate(hs), np.concatenate(fps), np.concatenate(ns)
            by = np.lexsort((fp, h))
            h, fp, n = h[by], fp[by], n[by]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(start, len(h)))
            crowded = np.repeat(size > crowd, size)
            # each point is in its own band and the next; ties are cells of two points of their own, one for each pair
            h2, fp2, n2 = np.tile(h[crowded], 2), np.tile(fp[crowded], 2), np.tile(n[crowded], 2)
            band = np.floor(np.log(n[crowded].astype(np.float64)) / BAND).astype(np.int64)
            band = np.concatenate([band, band + 1])
            by = np.lexsort((fp2, band, h2))
            h2, fp2, n2, band = h2[by], fp2[by], n2[by], band[by]
            start = np.flatnonzero(np.append(True, (h2[1:] != h2[:-1]) | (band[1:] != band[:-1]))[: len(h2)])
            lead = np.repeat(start, np.diff(np.append(start, len(h2))))
            other = lead != np.arange(len(h2))
            sent = np.unique(np.stack([h2[start].view(np.int64), fp2[start], n2[start]], axis=1), axis=0)
            tied = np.unique(np.stack([fp2[lead][other], n2[lead][other], fp2[other], n2[other]], axis=1), axis=0)
            made = mix(tied[:, 0].astype(np.uint64) * _ODD[0] + mix(tied[:, 2].astype(np.uint64))).view(np.int64)
            h, fp, n = h[~crowded].view(np.int64), fp[~crowded], n[~crowded]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h, sent[:, 0], made, made])), pa.array(np.concatenate([fp, sent[:, 1], tied[:, 0], tied[:, 2]])), pa.array(np.concatenate([n * 2, sent[:, 2] * 2 + 1, tied[:, 1] * 2 + 1, tied[:, 3] * 2 + 1]))],
                ["h", "fp", "m"],
            )

    cells = docs.select("text").mapInArrow(run, "h long, fp long, m long")
    by_h = Window.partitionBy("h")
    met = cells.withColumn("rows", F.count("*").over(by_h)).where("rows > 1").withColumn("crowd", (F.col("rows") > crowd) | (F.max(F.col("m") % 2).over(by_h) == 1))
    met = own.table(met.select("h", "fp", F.shiftright("m", 1).alias("n"), "crowd"), "jaccard-cells")

    few = met.where("not crowd").groupBy("h").agg(F.array_sort(F.collect_set(F.struct("fp", "n"))).alias("x")).where(F.size("x") > 1)
    pairs = few.select("x", F.posexplode("x").alias("i", "p")).select("p", F.explode(F.slice("x", F.col("i") + 2, F.lit(crowd))).alias("q"))
    pairs = pairs.select(F.col("p.fp").alias("a"), F.col("p.n").alias("na"), F.col("q.fp").alias("b"), F.col("q.n").alias("nb"))
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    needed = F.ceil((F.col("na") + F.col("nb")) * 3 / 7 - F.lit(1e-6)) - (F.floor((3 * most + 3) / 4) - 1)
    kept = pairs.where(4 * least >= 3 * most).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("times")).where(F.col("times") >= needed).select("a", "b")

    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(BAND)).cast("int")
    many = met.where("crowd").select("h", "fp", F.explode(F.array(band, band + 1)).alias("band"))
    tied = many.withColumn("b", F.min("fp").over(Window.partitionBy("h", "band"))).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return kept.unionByName(tied)


def regions_with_sets(docs: DataFrame, names: DataFrame, regions: DataFrame, renamed: Renamed, own: Scratch) -> DataFrame:
    """(region, fp, points): the sets of the points of first regions, read again from one document each.

    These points are a part of all; if they are few, the texts are filtered where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows may repeat
        for part in slices(batches):
            sets = [shingles(x) for x in utf8(part.column("text"))]
            right = []
            for x, fp in zip(sets, part.column("fp").to_pylist(), strict=True):
                right.append(fp not in seen and name_of(x, renamed) == fp)
                if right[-1]:
                    seen.add(fp)
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([part.column("region"), part.column("fp"), pa.array([x.tobytes() for x in sets], pa.binary())], ["region", "fp", "points"]).filter(pa.array(right, pa.bool_()))

    wanted = own.table(names.join(regions.withColumnRenamed("node", "fp").withColumnRenamed("component", "region"), "fp").select("id", "th", "fp", "region"), "jaccard-wanted")
    return with_ids(docs).join(near(wanted), ["id", "th"]).select("region", "fp", "text").mapInArrow(run, "region long, fp long, points binary")


class PivotJoin:
    """The recursive join of one region in memory. ``links`` connect the same points as all links between them do;
    ``pivots``, ``visits`` and ``compared`` count what was done."""

    def __init__(self, fps: list[int], sets: list[np.ndarray]) -> None:
        self.fps, self.size = fps, np.array([len(x) for x in sets], np.int64)
        _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        again = times[number] > 1  # shingles of one point alone are in no intersection
        row = np.repeat(np.arange(len(sets)), self.size)[again]
        self.held = np.bincount(row, minlength=len(sets))
        self.at = np.zeros(len(sets) + 1, np.int64)
        np.cumsum(self.held, out=self.at[1:])
        self.shingle = number[again]
        self.mark = np.zeros(len(times), bool)
        self.root = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []
        self.pivots = self.visits = self.compared = 0

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def link(self, i: int, others: np.ndarray) -> None:
        for j in others:
            a, b = self.find(i), self.find(int(j))
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((self.fps[i], self.fps[int(j)]))

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.root[rows]
        while (found != (up := self.root[found])).any():
            found = up
        self.root[rows] = found
        return found

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingles of the points end to end, where each begins and the last ends)."""
        n = self.held[rows]
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(n, out=at[1:])
        return self.shingle[np.arange(at[-1]) + np.repeat(self.at[rows] - at[:-1], n)], at

    def intersections(self, i: int, gathered: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Sizes of the intersections of point ``i`` with the gathered points."""
        own = self.shingle[self.at[i] : self.at[i + 1]]
        self.mark[own] = True
        hits = np.append(0, np.cumsum(self.mark[gathered[0]]))
        self.mark[own] = False
        self.compared += len(gathered[1]) - 1
        return hits[gathered[1][1:]] - hits[gathered[1][:-1]]

    def run(self) -> PivotJoin:
        todo = [np.arange(len(self.fps))]
        while todo:
            todo += self.split(todo.pop())
        return self

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Joins the points with pivots and returns the cells that are left to join."""
        if len(rows) < 2 or (self.roots(rows) == self.roots(rows[:1])).all():
            return []
        gathered, size = self.gather(rows), self.size[rows]
        apart, nearest, pivot = [], np.full(len(rows), 2.0), 0
        while len(apart) < PIVOTS:  # the next pivot is the point farthest from those before
            i = int(rows[pivot])
            inter = self.intersections(i, gathered)
            self.pivots += 1
            self.link(i, rows[linked(inter, size, self.size[i])])
            apart.append(1 - inter / (size + self.size[i] - inter))
            nearest = np.minimum(nearest, apart[-1])
            pivot = int(nearest.argmax())
            if nearest[pivot] <= 0.25:
                break
        d = np.stack(apart)
        home = np.where(nearest > FAR, len(d), d.argmin(axis=0))
        cells = []
        for p in range(len(d) + 1):
            inside = home == p
            if not inside.any():
                continue
            visits = (home > p) & (d[p] <= nearest[inside].max() + 0.25 + EPS) if p < len(d) else np.zeros(len(rows), bool)
            cell = np.flatnonzero(inside | visits)
            self.visits += int(visits.sum())
            if (self.roots(rows[cell]) != self.roots(rows[cell[:1]])).any():
                cells.append(cell)
        if sum(len(c) ** 2 for c in cells) > THINNED * len(rows) ** 2:  # joining the cells would be no less work
            self.pairs(rows, d)
            return []
        for c in cells:
            if len(c) <= LEAF:
                self.pairs(rows[c], d[:, c])
        return [rows[c] for c in cells if len(c) > LEAF]

    def pairs(self, rows: np.ndarray, d: np.ndarray) -> None:
        """Compares the pairs that the distances to the pivots and the sizes leave."""
        size = self.size[rows]
        for k in range(len(rows) - 1):
            others = np.arange(k + 1, len(rows))
            near = (np.abs(d[:, others] - d[:, k : k + 1]) <= 0.25 + EPS).all(axis=0) & (4 * np.minimum(size[others], size[k]) >= 3 * np.maximum(size[others], size[k]))
            others = others[near]
            others = others[self.roots(rows[others]) != self.find(int(rows[k]))]
            if len(others):
                inter = self.intersections(int(rows[k]), self.gather(rows[others]))
                self.link(int(rows[k]), rows[others[linked(inter, size[others], size[k])]])


def join_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (group, fp, points), each group small enough for a task: the spanning links (a, b) of the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, {}
        out: list[tuple[int, int]] = []
        for part in slices(batches):
            for group, fp, data in zip(part.column("group").to_pylist(), part.column("fp").to_pylist(), part.column("points").to_pylist(), strict=True):
                if group != own:
                    if len(held) > 1:
                        out += PivotJoin(list(held), list(held.values())).run().links
                    own, held = group, {}
                held[fp] = np.frombuffer(data, np.uint64)
            if out:
                yield _links(out)
                out = []
        if len(held) > 1:
            out += PivotJoin(list(held), list(held.values())).run().links
        yield _links(out)

    return rows.select("group", "fp", "points").repartition("group").sortWithinPartitions("group", "fp").mapInArrow(run, "a long, b long")


def _links(pairs: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(list(pairs), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def region_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("region").agg(F.count("*").alias("members"), F.sum(F.octet_length("points") / 8).cast("long").alias("total"))


def _parts(times: int) -> Column:
    """Parts of a region of which ``times`` fit into a task."""
    return F.greatest(F.ceil(F.col("members") * times / LIMIT), F.ceil(F.col("total") * times / LIMIT_SHINGLES), F.lit(1)).cast("int")


def blocks_joined(rows: DataFrame, sizes: DataFrame, own: Scratch) -> DataFrame:
    """All points of each region in blocks, every pair of blocks in a task."""
    cut = rows.join(near(own.table(sizes.select("region", _parts(2).alias("blocks")), "jaccard-blocks")), "region").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return join_groups(met.select(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "fp", "points"))


_MEASURED = "region long, fp long, home int, near double, apart array<double>, balls int, hubs array<long>"


def _measure(points: pa.Table, pivots: pa.Table) -> pa.Table:
    """Distances of a part of a region to the region's pivots: cell, distances, pivots linked to (as a mask, and by name)."""
    sets = [(p, fp, np.frombuffer(x, np.uint64)) for p, fp, x in zip(*(pivots.column(c).to_pylist() for c in ("p", "fp", "points")), strict=True)]
    home, nearest, apart, balls, hubs = [], [], [], [], []
    for data in points.column("points").to_pylist():
        x = np.frombuffer(data, np.uint64)
        d, ball, hub = [2.0] * PIVOTS, 0, []
        for p, fp, y in sets:
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            inter = int((y[at] == x).sum())
            d[p] = 1 - inter / (len(x) + len(y) - inter)
            if linked(inter, len(x), len(y)):
                ball |= 1 << p
                hub.append(fp)
        best = int(np.argmin(d))
        home.append(best if d[best] <= FAR else PIVOTS), nearest.append(min(d)), apart.append(d), balls.append(ball), hubs.append(hub)
    kinds = (("home", home, pa.int32()), ("near", nearest, pa.float64()), ("apart", apart, pa.list_(pa.float64())), ("balls", balls, pa.int32()), ("hubs", hubs, pa.list_(pa.int64())))
    return pa.table({**{c: points.column(c) for c in ("region", "fp")}, **{n: pa.array(v, k) for n, v, k in kinds}})


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each region the label of every pivot: pivots hang together through a point that is linked to both."""
    for part in slices(batches):
        made = []
        for masks in part.column("masks").to_pylist():
            label = list(range(PIVOTS))
            for mask in masks:
                own = [p for p in range(PIVOTS) if mask >> p & 1]
                least = min(label[p] for p in own)
                joined = {label[p] for p in own}
                label = [least if x in joined else x for x in label]
            made.append(label)
        yield pa.RecordBatch.from_arrays([part.column("region"), pa.array(made, pa.list_(pa.int32()))], ["region", "labels"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each point goes to its own cell, and to those of earlier pivots that it can have links into."""
    for part in slices(batches):
        at, cell, visits = [], [], []
        for i, (home, apart, label, cells) in enumerate(zip(*(part.column(c).to_pylist() for c in ("home", "apart", "label", "cells")), strict=True)):
            for c in cells:
                p = c["home"]
                if p == home or p < home and apart[p] <= c["radius"] + 0.25 + EPS and not (label is not None and label == c["whole"]):
                    at.append(i), cell.append(p), visits.append(p != home)
        took = part.select(["region", "fp"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell, pa.int32()), pa.array(visits, pa.bool_())], ["region", "fp", "cell", "visits"])


def split_regions(rows: DataFrame, sizes: DataFrame, depth: int, own: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits each region of ``rows`` (region, fp, points) by pivots: (links found, rows of the new regions, the regions
    that pivots don't thin out and whose cells are not among the new ones).

    A region's points are measured in parts of ``LIMIT``, each beside a copy of the region's pivots, so no task gets a
    whole region and no pivot reaches the driver; what is kept of a region as a whole is a row of its cells.
    """
    table = own.table(sizes.select("region", "members", _parts(1).alias("parts")), "jaccard-parts")
    drawn = rows.groupBy("region", F.pmod(F.xxhash64("fp", F.lit(depth)), F.lit(PIVOTS)).cast("int").alias("p")).agg(F.min("fp").alias("fp"))
    pivots = own.table(rows.join(own.table(drawn, "jaccard-drawn"), ["region", "fp"]).dropDuplicates(["region", "p"]).select("region", "p", "fp", "points"), "jaccard-pivots")
    dealt_points = rows.join(near(table), "region").select("region", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int").alias("part"), "fp", "points")
    dealt_pivots = pivots.join(near(table), "region").select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "p", "fp", "points")
    measured = own.table(dealt_points.groupBy("region", "part").cogroup(dealt_pivots.groupBy("region", "part")).applyInArrow(_measure, _MEASURED), "jaccard-measured")
    links = own.table(measured.where("balls <> 0").select(F.col("fp").alias("a"), F.explode("hubs").alias("b")).where("a <> b").distinct(), "jaccard-links")

    labels = own.table(measured.where("balls <> 0").groupBy("region").agg(F.collect_set("balls").alias("masks")).mapInArrow(_labels, "region long, labels array<int>"), "jaccard-labels")
    lowest = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda p: F.col("balls").bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(PIVOTS)]), p + 1)) != 0))
    points = measured.join(near(labels, 50_000), "region", "left").withColumn("label", F.when(F.col("balls") != 0, F.element_at("labels", lowest + 1))).select("region", "fp", "home", "near", "apart", "label")
    # of each cell: radius, and the label that all its points have, if they have one
    one = F.when((F.count("*") == F.count("label")) & (F.min("label") == F.max("label")), F.min("label"))
    cells = points.groupBy("region", "home").agg(F.max("near").alias("radius"), one.alias("whole"))
    cells = own.table(cells.groupBy("region").agg(F.collect_list(F.struct("home", "radius", "whole")).alias("cells")), "jaccard-of-regions")
    dealt = own.table(points.join(near(cells, 50_000), "region").mapInArrow(_deal, "region long, fp long, cell int, visits boolean"), "jaccard-dealt")
    # a cell that hangs together needs a task only if it has visitors
    whole = cells.select("region", F.explode("cells").alias("c")).select("region", F.col("c.home").alias("cell"), F.col("c.whole").isNotNull().alias("whole"))
    visited = dealt.groupBy("region", "cell").agg(F.max("visits").alias("visited"), F.count("*").alias("n"))
    open_cells = own.table(visited.join(whole, ["region", "cell"]).where("(visited or not whole) and n > 1").select("region", "cell", "n"), "jaccard-open")
    work = open_cells.groupBy("region").agg(F.sum(F.col("n").cast("double") ** 2).alias("work")).join(table, "region")
    stuck = own.table(work.where(F.col("work") > THINNED * F.col("members").cast("double") ** 2).select("region"), "jaccard-stuck")
    thinned = own.table(open_cells.join(near(stuck), "region", "left_anti").select("region", "cell"), "jaccard-thinned")
    moves = own.table(dealt.join(near(thinned), ["region", "cell"]).select("region", "fp", "cell"), "jaccard-moves")
    new = rows.join(near(moves), ["region", "fp"]).select(F.xxhash64("region", "cell", F.lit(depth)).alias("region"), "fp", "points")
    return links, own.table(new, "jaccard-regions"), stuck


def region_links(rows: DataFrame, own: Scratch) -> DataFrame:
    """Links (a, b) that connect the points of each region of ``rows`` (region, fp, points) as all links do.

    Regions that fit are joined in a task each; others are split until they do. A region whose cells have together more
    than ``THINNED`` of its pairs is joined in blocks, so the rounds end: each has half the pairs of the one before.
    """
    found, depth = [], 0
    while True:
        sizes = own.table(region_sizes(rows), "jaccard-sizes")
        fits = (F.col("members") <= LIMIT) & (F.col("total") <= LIMIT_SHINGLES)
        pick = lambda regions, rows=rows: rows.join(near(own.table(regions.select("region"), "jaccard-picked")), "region")
        found.append(own.table(join_groups(pick(sizes.where(fits & (F.col("members") > 1))).withColumnRenamed("region", "group")), "jaccard-links"))
        large = sizes.where(~fits)
        if large.isEmpty():
            break
        links, new, stuck = split_regions(own.table(pick(large), "jaccard-large"), large, depth, own)
        found.append(links)
        if not stuck.isEmpty():
            found.append(own.table(blocks_joined(rows, sizes.join(near(stuck), "region"), own), "jaccard-links"))
        rows, depth = new, depth + 1
    links = found[0]
    for x in found[1:]:
        links = links.union(x)
    return links


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_shingles, component_id), a row for each row."""
    with Scratch(docs.sparkSession) as own:
        points, counts = read_points(docs, own)
        group = lambda p: own.table(p.groupBy("fp").agg(F.min("id").alias("id"), F.min_by("th", "id").alias("th"), F.min("check").alias("c"), F.max("check").alias("d"), F.max("n").alias("n")), "jaccard-names")
        named, renamed = group(points), {}
        if not named.where("c <> d").isEmpty():
            renamed = rename(points, named)
            table = docs.sparkSession.createDataFrame([(*key, x) for key, x in renamed.items()], "fp long, check long, other long")
            points = points.join(F.broadcast(table), ["fp", "check"], "left").withColumn("fp", F.coalesce("other", "fp")).drop("other")
            named = group(points)
        names = named.where("n > 0").select("fp", "id", "th")
        coarse = components(coarse_links(docs, counts, renamed, own), own)
        rows = own.table(regions_with_sets(docs, names, coarse, renamed, own), "jaccard-regions")
        links = components(region_links(rows, own), own).withColumnRenamed("node", "fp")
        ids = own.table(names.join(links, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component")), "jaccard-ids")
        least = own.table(ids.groupBy("component").agg(F.min("id").alias("component_id")), "jaccard-least")
        final = own.table(ids.join(least, "component").select("fp", "component_id"), "jaccard-final")
        back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        return own.keep(points.select("id", "n", "fp").join(final.hint("merge"), "fp", "left").select(
            back("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, back("component_id")).otherwise(back("id")).alias("component_id"),
        ), "jaccard-components")
