"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint's bits form segments; a segment's bit count is a coordinate. The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints. Fingerprints that agree on some coordinates share a cell of a grid;
in a cell the Manhattan bound and then the exact Hamming distance decide.

`near_groups` joins fingerprints so: 64 bits, segments of two, a small radius, and no pair lost. The coordinates are dealt to G groups:
at distance r or less at most r groups differ, so two fingerprints within the radius share the cell of at least one choice of
G - r groups. G grows with the number of fingerprints so that a cell of unlike ones stays small; that changes the work, never the result.

`similar_groups` joins texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, and loses none either. There about
15 % of all bits differ, which no small number of groups covers, so the sets themselves are joined by prefixes: in one order of all
shingles, two such sets of n and m share one of the first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1. A cell is such a shingle. Shingles
that a sample finds frequent come last, so that cells stay small. Sizes, places in the order and parity bits rule out pairs by
bounds that hold for every similar pair, and the sets of the others are compared. A cell above SMALL gives first the pairs that are likely to join
it; only what those leave apart is then compared with all of the cell, block by block.

Copies meet before the join: it runs on distinct fingerprints or sets. Of fingerprints, only a spanning forest of a cell's links leaves its
task. Links are sought by pivots: a pivot is held against its whole cell, what it links is joined to it, and only
fingerprints of different components are compared further; a cell of m near copies of one text costs m comparisons, not m * m.
Cells above CELL fingerprints are taken out, linked to one pivot each by a join, and only what that leaves is held against
the cell, block by block.

Defined results: null or blank text has the fingerprint zero and links like any
other; a null doc_id takes part but is never the smallest unless its whole component
has none; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GONE, free, map_arrow, slices, table, without, written
from .components import components

SEED = 42
#: Fingerprints in a cell that one task compares with each other; larger cells are cut into blocks of this size.
CELL = 8192
#: Sets in a cell of a shingle whose pairs all become candidates at once; in a larger cell those that NEAREST and a forest do not join follow.
SMALL, NEAREST = 128, 3
#: Texts whose shingles are counted (less than twice as many), shingles of one text that are, and shingles kept as frequent: they set the order of the shingles alone, never what is found.
SAMPLE, SAMPLE_SHINGLES, FREQUENT = 4000, 10_000, 100_000
#: Words of 64 bits in which a text notes the parity of its shingles for large cells, and bits in which a row is looked up before its text or parity is read.
WORDS, LOOKUP = 4, 1 << 23
#: Shingles of the texts whose candidates one task compares together; components of more are compared pair by pair.
TOGETHER = 2_000_000
#: Against rounding: a bound is never too strict by it.
SLACK = 1e-6
SIMILARITY = 0.8
#: Fingerprints that a task remembers as joined, to leave out links that join nothing new.
SEEN = 1_000_000


def shingle_hashes(text: bytes, words_in_shingle: int) -> np.ndarray:
    """Of UTF-8 text: ASCII letters lower-cased, words split at ASCII white space, XXH64 of each shingle; none without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words_in_shingle, len(words))
    h = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    return np.fromiter((h(whole[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words_in_shingle: int) -> int:
    return majority(shingle_hashes(text, words_in_shingle))


def fingerprints(docs: DataFrame, words_in_shingle: int = 4, *more: str) -> DataFrame:
    """(doc_id, *more, fp): bits as a signed long; `more` are further columns of longs."""
    names = ["doc_id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(x.as_py() or b"", words_in_shingle) for x in batch.column(len(names))], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([*batch.columns[:-1], pa.array(bits)], names=[*names, "fp"])

    texts = docs.select(*[F.col(c).cast("long").alias(c) for c in names], F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    return map_arrow(texts, run, ", ".join(f"`{c}` long" for c in [*names, "fp"]))


def grid_groups(n: int, radius: int) -> int:
    """The fewest groups that leave about 256 unlike fingerprints in a cell (a two-bit segment has 1.5 bits of entropy)."""
    for g in range(radius + 1, radius + 6):
        if n / 2 ** (48 * (g - radius) / g) <= 256:
            return g
    return radius + 5


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(fps: DataFrame, radius: int, groups: int) -> DataFrame:
    """(cell, fp): a row for each choice of groups - radius groups. Cells are hashes of choice and coordinates."""
    lows = [round(32 * g / groups) for g in range(groups + 1)]
    masks = []
    for chosen in combinations(range(groups), groups - radius):
        masks.append(_signed(sum(3 << 2 * i for g in chosen for i in range(lows[g], lows[g + 1]))))
    odd, beside = F.lit(0x5555555555555555), F.shiftrightunsigned("fp", 1)
    two = F.shiftleft(F.col("fp").bitwiseAND(beside).bitwiseAND(odd), 1)
    counts = two.bitwiseOR(F.col("fp").bitwiseXOR(beside).bitwiseAND(odd))
    return fps.withColumn("_c", counts).select(
        F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("choice", "_mask"), "_c", "fp"
    ).select(F.xxhash64("choice", F.col("_c").bitwiseAND(F.col("_mask"))).alias("cell"), "fp")


def _segment_counts(fp: np.ndarray) -> np.ndarray:
    """Two-bit counts of segments of two."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of vectors of 32 two-bit counts: |x - y| for fields in 0..2 is the number of bits that differ in unary form."""
    unary = lambda c: (c & np.uint64(0x5555555555555555)) | ((c >> np.uint64(1)) & np.uint64(0x5555555555555555)) | (c & np.uint64(0xAAAAAAAAAAAAAAAA))
    return np.bitwise_count(unary(a) ^ unary(b))


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which fingerprints (rows of words) are within the radius. A single word is held against the Manhattan bound first."""
    if a.shape[-1] == 1:
        low = _manhattan(_segment_counts(a[..., 0]), _segment_counts(b[..., 0])) <= radius
        return low & (np.bitwise_count(a[..., 0] ^ b[..., 0]) <= radius)
    return _hamming(a, b) <= radius


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    distance = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], dtype=np.uint16)
    for i in range(a.shape[-1]):
        distance += np.bitwise_count(a[..., i] ^ b[..., i])
    return distance


class Forest:
    """Components of longs, as links come in."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
        return ra != rb


def _links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Tree edges, as places, of the links among the fingerprints of one cell."""
    n, out, forest = len(fp), [], Forest()
    covered = np.zeros(n, dtype=bool)

    def joined(a: int, others: np.ndarray) -> None:
        out.extend((a, b) for b in others.tolist() if b != a and forest.join(a, b))

    for pivot in range(n):
        if not covered[pivot]:
            near = np.flatnonzero(_near(fp[pivot], fp, radius))
            covered[near] = True
            joined(pivot, near)
    label = np.fromiter((forest.root(x) for x in range(n)), dtype=np.int64, count=n)
    largest = np.bincount(label).argmax() if n else 0
    for a in np.flatnonzero(label != largest).tolist():  # pivots have met all others; what is left are other members
        if label[a] != a:
            joined(a, np.flatnonzero((label != label[a]) & _near(fp[a], fp, radius)))
    return out


def _forest_of_runs(radius: int):
    """For batches (cell, node, words ...) sorted by cell: the tree edges of each cell as (a, b), and (cell, null) for cells above CELL."""
    short = 64
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(cell: np.ndarray, node: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        """Whole cells only. Short ones are compared by shifts of the whole array, long ones one by one."""
        n = len(cell)
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        length = np.diff(np.append(start, n))
        out = []
        for s, m in zip(start[length > short].tolist(), length[length > short].tolist()):
            if m > CELL:
                out.append((int(cell[s]), None))
                continue
            here = fp[s : s + m]
            out += [(int(node[s + a]), int(node[s + b])) for a, b in _links(here, radius)]
        run = np.repeat(np.where(length > short, -1, np.arange(len(start))), length)
        for shift in range(1, int(length[length <= short].max(initial=0))):
            at = np.flatnonzero((run[shift:] == run[:-shift]) & (run[shift:] >= 0))
            if not len(at):
                break
            at = at[_near(fp[at], fp[at + shift], radius)]
            out += zip(node[at].tolist(), node[at + shift].tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        forest, skipped = Forest(), None

        def tree(links: list[tuple[int, int | None]]) -> pa.RecordBatch:
            out = [x for x in links if x[1] is None or forest.join(*x)]
            if len(forest.parent) > SEEN:
                forest.parent.clear()
            return pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)

        def whole(columns: list[np.ndarray]) -> pa.RecordBatch:
            return tree(compare(columns[0], columns[1], np.stack(columns[2:], axis=1).view(np.uint64)))

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if skipped is not None:
                rest = now[0] != skipped
                now = [c[rest] for c in now]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            kept = [c[cut:] for c in now]
            if cut:
                yield whole([c[:cut] for c in now])
            if len(kept[0]) > CELL:
                skipped, kept = int(kept[0][0]), None
                yield tree([(skipped, None)])
        if kept is not None:
            yield whole(kept)

    return run


def _across(radius: int):
    """For batches (cell, i, j, side, node, words ...) sorted by the first four: links between the sides 0 and 1 of each task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        side, node = columns[3], columns[4]
        fp = np.stack(columns[5:], axis=1).view(np.uint64)
        out, forest = [], Forest()
        other, names = fp[side == 1], node[side == 1]
        for x, name in zip(fp[side == 0], node[side == 0].tolist()):
            out += [(name, b) for b in names[_near(x, other, radius)].tolist() if b != name and forest.join(name, b)]
        yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=schema)

    return _by_task(compare)


def _by_task(compare):
    """For batches sorted by their first three columns: what `compare` gives for the rows of each value of the three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            if not len(now[0]):
                continue
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in now[:3]])) + 1
            for a, b in zip([0, *new[:-1].tolist()], new.tolist()):
                yield from compare([c[a:b] for c in now])
            kept = [c[new[-1] if len(new) else 0 :] for c in now]
        if kept is not None and len(kept[0]):
            yield from compare(kept)

    return run


def _distance(words: list[str], other: Column) -> Column:
    return sum((F.bit_count(F.col(w).bitwiseXOR(other[w])) for w in words), F.lit(0))


def _large_cells(rows: DataFrame, large: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(a, b): links of cells above CELL. Each cell's least node is its pivot; what it does not link is held against all rows, block by block."""
    mine = written(rows.join(large, "cell"), "large_cells")
    pivots = mine.groupBy("cell").agg(F.min(F.struct("node", *words)).alias("p"), F.count(F.lit(1)).alias("n"))
    held = written(mine.join(pivots, "cell").withColumn("near", _distance(words, F.col("p")) <= radius), "pivots")
    stars = held.filter("near AND node <> p.node").select(F.col("p.node").alias("a"), F.col("node").alias("b"))
    size = CELL // 2
    left = held.filter("NOT near").groupBy("cell").agg(F.count(F.lit(1)).alias("r"))
    dealt = held.join(left, "cell").withColumn("bi", F.ceil(F.col("r") / size)).withColumn("bj", F.ceil(F.col("n") / size))
    place = F.xxhash64("node")
    some = dealt.filter("NOT near").select("cell", F.pmod(place, "bi").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bj") - 1)).alias("j"), F.lit(0).alias("side"), "node", *words)
    every = dealt.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bi") - 1)).alias("i"), F.pmod(place, "bj").alias("j"), F.lit(1).alias("side"), "node", *words)
    by = ["cell", "i", "j"]
    tasks = some.unionByName(every).repartition(*by).sortWithinPartitions(*by, "side")
    return stars.unionByName(map_arrow(tasks, _across(radius), "a long, b long"))


def forest(rows: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(a, b): a spanning forest, cell by cell, of all links among rows (cell, node, words ...)."""
    dealt = rows.select("cell", "node", *words).repartition("cell").sortWithinPartitions("cell")
    found = written(map_arrow(dealt, _forest_of_runs(radius), "a long, b long"), "links")
    large = found.filter("b IS NULL").select(F.col("a").alias("cell"))
    few = found.filter("b IS NOT NULL")
    return few.unionByName(_large_cells(rows, large, words, radius)) if large.take(1) else few


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that join all that are within the radius, directly or by others."""
    rows = cells(fps, radius, grid_groups(fps.count(), radius))
    return forest(rows.withColumn("node", F.col("fp")), ["fp"], radius)


def near_groups(docs: DataFrame, radius: int = 4, words_in_shingle: int = 4, *more: str) -> DataFrame:
    """(doc_id, *more, fp, component_id) for every row of docs: fingerprints within the radius are linked, none is lost."""
    rows = written(fingerprints(docs, words_in_shingle, *more), "fingerprints")
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.col("fp")), "firsts")
    return rows.join(_named(firsts, links(firsts.select("fp"), radius), ["fp"]), "fp").select("doc_id", *more, "fp", "component_id")


def similar_groups(docs: DataFrame, row: str, words_in_shingle: int = 5, least: float = SIMILARITY) -> DataFrame:
    """(row, doc_id, component_id) for every row of docs, named by the column `row`: texts whose shingle sets have a Jaccard similarity of `least` are linked, none is lost."""
    rows = written(described(docs, row, words_in_shingle), "descriptions")
    one = [F.min(F.struct("node", *_PARITY)).alias("one"), F.min("doc_id").alias("first_id")]
    firsts = written(rows.withColumnRenamed(row, "node").groupBy(*_DIGEST).agg(*one).select(*_DIGEST, "first_id", "one.*"), "firsts")
    again = rows.select(row).join(firsts.select(F.col("node").alias(row)), row, "left_anti")
    texts = without(docs.select(row, "text"), again, row)
    dealt = prefixes(texts, row, words_in_shingle, least, _frequent(rows)).repartition("cell").sortWithinPartitions("cell")
    found = written(map_arrow(dealt, _pairs_of_runs(least), "cell long, a long, b long, place long"), "prefix_pairs")
    odd = rows.select(F.col(row).alias("node"), "n", "odd")

    def check(pairs: DataFrame) -> DataFrame:
        near = written(_within_parity(written(pairs.distinct(), "candidates"), odd, least), "candidates")
        return verified(docs, row, near, words_in_shingle, least)

    linked = written(check(found.filter("b IS NOT NULL").select("a", "b")), "similar")
    members = found.filter("b IS NULL").select("cell", F.col("a").alias("node"), "place")
    if members.take(1):
        linked = _similar_in_large_cells(members.join(firsts.select("node", *_PARITY), "node"), linked, check, least)
    return rows.join(_named(firsts, linked, _DIGEST), _DIGEST).select(row, "doc_id", "component_id")


_DIGEST, _PARITY = ["d0", "d1"], [f"p{i}" for i in range(WORDS)]


def _shingle_set(text: bytes | None, words_in_shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", words_in_shingle))


def described(docs: DataFrame, row: str, words_in_shingle: int) -> DataFrame:
    """(row, doc_id, n, d0, d1, p0 ..., odd, sample): of each row's set of shingles the size, a digest and parity bits, 256 and again at
    least two for each shingle; a sample of the rows has the shingles too. A parity bit is set if an odd number of hashes fall on it."""
    share = max(1, docs.count() // SAMPLE)
    names = [row, "doc_id", "n", *_DIGEST, *_PARITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                sizes, told, odds, sample = [], [], [], []
                for x, asked in zip(part.column(3), part.column(2).to_pylist()):
                    found = _shingle_set(x.as_py(), words_in_shingle)
                    bits = max(64 * WORDS, 1 << max(2 * len(found) - 1, 0).bit_length())
                    odd = np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))
                    sizes.append(len(found))
                    told.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() + _folded(odd, 8 * WORDS).tobytes())
                    odds.append(odd.tobytes())
                    sample.append(found[:SAMPLE_SHINGLES].tobytes() if asked else None)
                longs = np.frombuffer(b"".join(told), dtype="<i8").reshape(-1, len(_DIGEST) + WORDS)
                columns = [*part.columns[:2], pa.array(sizes, pa.int64()), *(pa.array(longs[:, i]) for i in range(longs.shape[1])), pa.array(odds, pa.binary()), pa.array(sample, pa.binary())]
                yield pa.record_batch(columns, names=[*names, "odd", "sample"])

    asked = F.pmod(F.xxhash64(row), F.lit(share)) == 0
    texts = docs.select(F.col(row).cast("long").alias(row), F.col("doc_id").cast("long").alias("doc_id"), asked.alias("asked"), _utf8())
    return map_arrow(texts, run, ", ".join(f"`{c}` long" for c in names) + ", odd binary, sample binary")


def _folded(odd: np.ndarray, size: int) -> np.ndarray:
    """Parity bits over fewer places: `size` bytes of them, a power of two as their number was."""
    return np.bitwise_xor.reduce(odd.reshape(-1, size), axis=0)


def _utf8() -> Column:
    return F.encode(F.col("text").cast("string"), "UTF-8").alias("text")


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that texts of the sample share, sorted, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.record_batch([pa.array(np.frombuffer(x.as_py(), dtype="<i8"))], names=["h"])

    counts = map_arrow(rows.filter("sample IS NOT NULL").select("sample"), run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    top = counts.filter("c > 1").orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    h, c = (top.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], c[order]


def prefixes(docs: DataFrame, row: str, words_in_shingle: int, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(cell, node, place): of each set of n shingles, in one order for all sets, the first n - ceil(least * n) + 1.

    Two sets that are similar enough share one of those. The order is by hash; `frequent` shingles come last, the most frequent
    at the end. `place` is n and, in its low 32 bits, the shingle's place in the order.
    """
    known, counts = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                chosen, sizes = [np.zeros(0, dtype=np.uint64)], []
                for x in part.column(1):
                    found = _shingle_set(x.as_py(), words_in_shingle)
                    if len(known):
                        at = np.searchsorted(known, found)
                        at[at == len(known)] = 0
                        if (hit := known[at] == found).any():
                            found = found[np.lexsort((found, np.where(hit, counts[at], 0)))]
                    chosen.append(found[: len(found) - math.ceil(least * len(found) - SLACK) + 1])
                    sizes.append((len(found), len(chosen[-1])))
                n, p = np.array(sizes, dtype=np.int64).reshape(-1, 2).T
                node = np.repeat(part.column(0).to_numpy(), p)
                i = np.arange(len(node)) - np.repeat(np.cumsum(p) - p, p)
                yield pa.record_batch([pa.array(np.concatenate(chosen).view(np.int64)), pa.array(node), pa.array((np.repeat(n, p) << 32) + i)], names=["cell", "node", "place"])

    return map_arrow(docs.select(row, _utf8()), run, "cell long, node long, place long")


def _may_fit(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets can be similar enough, given the places of a shingle that is the first they share; a pair passes at least there."""
    rest = np.minimum((a >> 32) - (a & 0xFFFFFFFF), (b >> 32) - (b & 0xFFFFFFFF))
    return rest >= ((a >> 32) + (b >> 32)) * (least / (1 + least)) - SLACK


def _pairs_of_runs(least: float):
    """For batches (cell, node, place) sorted by cell: the pairs of each cell that may be similar as (null, a, b, null); of a cell above SMALL its rows as (cell, node, null, place)."""
    schema = pa.schema([(c, pa.int64()) for c in ("cell", "a", "b", "place")])
    small = SMALL

    def members(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[0]), pa.array(columns[1]), pa.nulls(len(columns[0]), pa.int64()), pa.array(columns[2])], schema=schema)

    def whole(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell = columns[0]
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        length = np.diff(np.append(start, len(cell)))
        each = np.repeat(length, length)
        if (each > small).any():
            yield members([c[each > small] for c in columns])
        mine = (each > 1) & (each <= small)
        cell, node, place = (c[mine] for c in columns)
        out = []
        for shift in range(1, int(length[length <= small].max(initial=1))):
            at = np.flatnonzero(cell[shift:] == cell[:-shift])
            at = at[_may_fit(place[at], place[at + shift], least)]
            out.append(np.sort(np.stack([node[at], node[at + shift]]), axis=0))
        if out and (pairs := np.unique(np.concatenate(out, axis=1), axis=1)).shape[1]:
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.record_batch([none, pa.array(pairs[0]), pa.array(pairs[1]), none], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        large = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
                kept = None
            if large is not None:
                rest = int(np.searchsorted(now[0], large, side="right"))
                if rest:
                    yield members([c[:rest] for c in now])
                now = [c[rest:] for c in now]
            if not len(now[0]):
                continue
            cut, large = int(np.searchsorted(now[0], now[0][-1])), None
            if cut:
                yield from whole([c[:cut] for c in now])
            kept = [c[cut:] for c in now]
            if len(kept[0]) > small:
                large = int(kept[0][0])
                yield members(kept)
                kept = None
        if kept is not None:
            yield from whole(kept)

    return run


def _most_apart(least: float) -> float:
    """The share of two sets' sizes, added up, in which they differ at most; each differing shingle changes one parity bit."""
    return (1 - least) / (1 + least)


def _within_parity(pairs: DataFrame, odd: DataFrame, least: float) -> DataFrame:
    """The pairs without those that differ in more parity bits than similar sets can; `odd` has node, n and odd."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * _most_apart(least) + SLACK
            kept = []
            for x, y, m in zip(batch.column(4), batch.column(5), most.tolist()):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint8), np.frombuffer(y.as_py(), dtype=np.uint8)
                size = min(len(x), len(y))
                kept.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= m)
            yield pa.record_batch([c.filter(pa.array(kept, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    asked = written(_asked(odd, pairs), "parities")
    for side in "ab":
        mine = asked.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("odd").alias(f"odd_{side}"))
        pairs = pairs.join(mine.hint("merge"), side)
    return map_arrow(pairs.select("a", "b", "n_a", "n_b", "odd_a", "odd_b"), compare, "a long, b long")


def _asked(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose `node` is in a pair, and some others. Rows are not shuffled: nodes are looked up in a table of LOOKUP bits, which is broadcast."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(LOOKUP))
    word = lambda c: F.shiftright(place(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(c), F.lit(64)).cast("int"))
    named = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    bits = named.groupBy(word("node").alias("word")).agg(F.bit_or(bit("node")).alias("bits"))
    found = rows.withColumn("word", word("node")).join(F.broadcast(bits), "word")
    return found.filter(F.col("bits").bitwiseAND(bit("node")) != 0).select(*rows.columns)


def _in_block(least: float):
    """For batches (cell, i, j, node, place, parity ...) sorted by the first three: pairs that are likely to join a block's sets, NEAREST of each one and a forest."""

    def compare(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        node, place = columns[3], columns[4]
        bits, out, forest = np.stack(columns[5:], axis=1).view(np.uint64), [], Forest()
        covered = np.zeros(len(node), dtype=bool)
        for x in range(len(node)):
            apart = _hamming(bits[x], bits).astype(np.int64)
            near = _may_fit(place[x], place, least) & (apart <= ((place[x] >> 32) + (place >> 32)) * _most_apart(least) + SLACK)
            near[x] = False
            near = np.flatnonzero(near)
            out += [(x, y) for y in near[np.argsort(apart[near], kind="stable")[:NEAREST]].tolist()]
            if not covered[x]:
                covered[near] = True
                out += [(x, y) for y in near.tolist() if forest.join(x, y)]
        found = np.unique(np.sort(node[np.array(out, dtype=np.int64).reshape(-1, 2)], axis=1), axis=0)
        yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return _by_task(compare)


def _between_blocks(least: float):
    """For batches (cell, i, j, side, node, label, place, parity ...) sorted by the first four: all pairs of the sides 0 and 1 of different labels that may be similar."""

    def compare(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        one, other = columns[3] == 0, columns[3] == 1
        node, label, place = columns[4:7]
        bits = np.stack(columns[7:], axis=1).view(np.uint64)
        for x in np.flatnonzero(one).tolist():
            near = np.flatnonzero(other & (label != label[x]) & _may_fit(place[x], place, least))
            near = near[_hamming(bits[x], bits[near]) <= ((place[x] >> 32) + (place[near] >> 32)) * _most_apart(least) + SLACK]
            if len(near):
                yield pa.record_batch([pa.array(np.minimum(node[x], node[near])), pa.array(np.maximum(node[x], node[near]))], names=["a", "b"])

    return _by_task(compare)


def _similar_in_large_cells(members: DataFrame, linked: DataFrame, check: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """`linked` and the links of cells above SMALL, from their rows (cell, node, place, parity ...). First the pairs that join most of a
    cell, block by block; what these leave in other components than the cell's largest is then held against all of the cell."""
    more, by = ["node", "place", *_PARITY], ["cell", "i", "j"]
    mine = written(members.select("cell", *more), "large_cells")
    size, spot = max(CELL // 2, 1), F.xxhash64("node")
    blocks = mine.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    inside = mine.join(blocks, "cell").select("cell", F.pmod(spot, "blocks").alias("i"), F.lit(0).cast("long").alias("j"), *more)
    pairs = map_arrow(inside.repartition(*by).sortWithinPartitions(*by), _in_block(least), "a long, b long")
    linked = written(linked.unionByName(check(pairs)), "similar")
    labels = written(components(linked), "labels")
    named = mine.join(labels, "node", "left").select("cell", F.coalesce("component", "node").alias("label"), *more)
    counted = named.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("c"))
    cells_ = counted.groupBy("cell").agg(F.max_by("label", "c").alias("most"), F.sum("c").alias("n"), F.max("c").alias("top")).filter("top < n")
    cells_ = cells_.select("cell", "most", F.ceil((F.col("n") - F.col("top")) / size).alias("bi"), F.ceil(F.col("n") / size).alias("bj"))
    dealt = written(named.join(cells_, "cell"), "apart")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    some = dealt.filter("label <> most").select("cell", F.pmod(spot, "bi").alias("i"), upto("bj").alias("j"), F.lit(0).alias("side"), "label", *more)
    every = dealt.select("cell", upto("bi").alias("i"), F.pmod(spot, "bj").alias("j"), F.lit(1).alias("side"), "label", *more)
    tasks = some.unionByName(every).select(*by, "side", "node", "label", "place", *_PARITY).repartition(*by).sortWithinPartitions(*by, "side")
    return written(linked.unionByName(check(map_arrow(tasks, _between_blocks(least), "a long, b long"))), "similar")


def verified(docs: DataFrame, row: str, pairs: DataFrame, words_in_shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets have a Jaccard similarity of `least` or more.

    The sets of a component of pairs meet in one task, each once; components of more than TOGETHER shingles are compared by joins, pair by pair.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [_shingle_set(x.as_py(), words_in_shingle) for x in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(map(len, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "n", "shingles"])

    def similar(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (len(x) + len(y) - both) - SLACK

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [similar(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.record_batch([c.filter(pa.array(kept, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of batches (component, node, b, shingles) sorted by component: a row is a set, or a pair of node and b."""

        def ended() -> pa.RecordBatch:
            out = [(a, b) for a, b in asked if similar(held[a], held[b])]
            return pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        now, held, asked = None, {}, []
        for batch in batches:
            for component, node, b, found in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                if component != now:
                    if asked:
                        yield ended()
                    now, held, asked = component, {}, []
                if b is None:
                    held[node] = found.as_py()
                else:
                    asked.append((node, b))
        if asked:
            yield ended()

    known = written(map_arrow(_asked(docs.select(F.col(row).alias("node"), _utf8()), pairs), sets, "node long, n long, shingles binary"), "shingle_sets")
    labels = written(components(pairs), "labels")
    labels = F.broadcast(labels) if labels.count() <= GONE else labels
    sizes = known.select("node", "n").join(labels, "node").groupBy("component").agg(F.sum("n").alias("total"))
    large = written(sizes.filter(F.col("total") > TOGETHER).select("component"), "large_components")
    placed = lambda df, key: df.join(labels.withColumnRenamed("node", key), key)
    one = placed(known, "node").select("component", "node", F.lit(None).cast("long").alias("b"), "shingles")
    asked = placed(pairs, "a").select("component", F.col("a").alias("node"), "b", F.lit(None).cast("binary").alias("shingles"))
    tasks = without(one.unionByName(asked), large, "component").repartition("component").sortWithinPartitions("component")
    found = map_arrow(tasks, within, "a long, b long")
    if not large.take(1):
        return found
    rest = placed(pairs, "a").join(large, "component", "left_semi").select("a", "b")
    for side, name in (("a", "x"), ("b", "y")):
        rest = rest.join(known.select(F.col("node").alias(side), F.col("shingles").alias(name)).hint("merge"), side)
    return found.unionByName(map_arrow(rest.select("a", "b", "x", "y"), compare, "a long, b long"))


def _named(firsts: DataFrame, found: DataFrame, words: list[str]) -> DataFrame:
    """(words, component_id) of all distinct fingerprints. Fingerprints that link to none are their own component and need no
    aggregation; a large component's least id is one partial aggregation, and comes back through a join that can be split."""
    labels = written(components(found), "labels")
    linked = written(firsts.join(labels, firsts.node == labels.node).select(*words, "first_id", "component"), "linked")
    least = written(linked.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    alone = firsts.join(labels.select("node"), "node", "left_anti").select(*words, F.col("first_id").alias("component_id"))
    return written(alone.unionByName(linked.join(least, "component").select(*words, "component_id")), "component_ids")


def near_dedup(docs: DataFrame, words_in_shingle: int = 5, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, one document of each group of similar texts: the one with the smallest doc_id.

    Rows without a doc_id are kept, as they cannot be named. Rows go one by one: of repeated doc_ids all rows of the kept
    id in the group stay, and so does a row whose text is unlike that of a dropped row of its doc_id.
    """
    row = free(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "near_rows", "zstd")
    gone = similar_groups(rows, row, words_in_shingle, least).filter("doc_id <> component_id").select(row)
    return without(rows, gone, row).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
