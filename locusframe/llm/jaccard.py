"""N-gram Jaccard join: exact components of documents whose shingle sets are nearly equal.

The join is a recursive metric join. Documents drawn as pivots would separate nothing: texts that share nothing are
all at Jaccard distance 1 from each other and from every pivot (the README has figures). So the pivots
of the first level are the one-shingle sets {e}, in a metric in which they do separate: the weighted symmetric
difference, where shingles are ordered (the corpus's common ones last) and each weighs more than all behind
it together. A set's nearest pivot is its first shingle: that is its Voronoi region. A partner lies at a bounded
distance, it lacks at most n - ceil(num n / den) of the set's shingles, so by the triangle inequality the
partner's region is that of one of so many shingles more: the window into which the set is replicated. Two
linked sets meet in the region of their first common shingle.

A region joins on. The empty set is its next pivot: distances to it are the sizes, which linked sets
have in proportion, so a region falls apart at gaps between sizes. What stays together is joined in the Hamming
metric of parity sketches, which never exceeds the number of shingles in which two sets differ: Voronoi regions of
members drawn as pivots, windows d(x, q) <= d(x, home) + 2 k and d(x, q) <= radius(q) + k, recursively until few
members are left or regions no longer shrink. The sets themselves decide on what the sketches let through.
Regions too large for a task are first collapsed by the links to one of their members; the others' blocks are dealt
against all blocks. Equal sets count as one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Scratch, flat_text, mix64, parts, span_hashes, words_of

SHINGLE = 3
#: Two sets link when NUM * |union| <= DEN * |intersection|.
NUM, DEN = 90, 100
#: Shingles that a task counts at once to find common ones, the least count there, the share of documents from which a
#: shingle is common, and how many may be broadcast. They choose the order of shingles alone: no link depends on them.
CHUNK, LEAST, SHARE, COMMON = 2_000_000, 3, 8000, 1 << 21
#: Words of 64 bits of the shortest and longest parity sketch.
SKETCH = (4, 64)
#: Members of a region that one task joins, pivots of a region, members that are compared directly, and shingles of sets that may be broadcast.
TASK_MEMBERS, PIVOTS, DIRECT, BROADCAST_SHINGLES = 1024, 4, 32, 1 << 21
#: Bits of a broadcast filter of ids: eight a key, at most so many (beyond, it lets more through, and the join behind it decides).
FILTER_BITS = 1 << 26
_U = np.uint64
_SEP = np.ones(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, none without words."""
    data, offsets = flat_text(column)
    data = LOWER[data]
    starts, ends, rows = words_of(data, offsets, _SEP)
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    grams = np.zeros(max(0, len(words) - k + 1), _U)
    for i in range(k):
        grams = mix64(grams + words[i : i + len(grams)] * _U(0x9E3779B97F4A7C15 + 2 * i))
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= k:
            yield np.unique(grams[a : z - k + 1])
        elif z > a:
            h = np.full(1, z - a, _U)
            for i in range(a, z):
                h = mix64(h * _U(0xD6E8FEB86659FD93) + words[i : i + 1])
            yield h
        else:
            yield np.zeros(0, _U)


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit id of a set."""
    x = mix64(s)
    return int((mix64(x.sum(keepdims=True) * _U(0xA24BAED4963EE407) + np.bitwise_xor.reduce(x, keepdims=True) + _U(len(s)))).astype(np.int64)[0]) if len(s) else 0


def parity(s: np.ndarray) -> np.ndarray:
    """Sketch of a set: each shingle flips one of at least as many bits, a power of two between the bounds of SKETCH. Halves of a longer sketch add up to the shorter one."""
    words = min(max(SKETCH[0], 1 << max(0, (len(s) - 1).bit_length() - 6)), SKETCH[1])
    slot = mix64(s ^ _U(0x2545F4914F6CDD1D)) & _U(words * 64 - 1)
    flips = np.bincount((slot).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(_U)


class Common:
    """Hashes of the corpus's common shingles and how common each is, for the order of shingles."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def window(self, s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """The set's first shingles in order, one more than a partner may lack, and whether each is common."""
        most = len(s) - -(-num * len(s) // den) + 1
        if len(self.hashes) and len(s):
            at = np.searchsorted(self.hashes, s)
            at[at == len(self.hashes)] = 0
            count = np.where(self.hashes[at] == s, self.counts[at], 0)
            if count.any():
                order = np.lexsort((s, count))[:most]
                return s[order], count[order] > 0
        return s[:most], np.zeros(min(most, len(s)), bool)


class Filter:
    """A bitmap of hashed keys; keys that are in it are never missed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: DataFrame, column: str, n: int) -> Filter:
        """At most n / 64 numbers come to the driver, whatever the number of keys."""
        slot = F.pmod(F.col(column), F.lit(n))
        words = keys.select(F.floor(slot / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        bits = np.zeros(n // 64, np.int64)
        bits[words["w"].to_numpy()] = words["b"].to_numpy()
        return cls(bits.view(np.uint64))

    @staticmethod
    def size(keys: int, most: int = FILTER_BITS) -> int:
        return min(most, 1 << max(16, (8 * keys).bit_length()))

    def has(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.bits) * 64
        slot = np.mod(keys.astype(np.int64), n)
        return (self.bits[slot // 64] >> (slot % 64).astype(_U)) & _U(1) == 1


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=schema.split())


def describe(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Of each row of docs (id, h, text): id, h, n (its set's size), c (its id) and sk (its sketch). Besides, rows (n, c) of common
    alone: a shingle and in how many different sets of a stretch of rows it was met, if in LEAST."""
    kind = docs.schema["id"].dataType.simpleString()
    chunk, least = CHUNK, LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "common id h n c sk"
        held: list[np.ndarray] = []
        size, seen, id_type = 0, set(), pa.null()

        def count() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            u, n = u[n >= least], n[n >= least]
            held.clear()
            return _batch(names, pa.array(np.ones(len(u), bool)), pa.nulls(len(u), id_type), pa.nulls(len(u), pa.int64()), pa.array(n.astype(np.int64)), pa.array(u.astype(np.int64)), pa.nulls(len(u), pa.binary()))

        for b in batches:
            for part in parts(b, 2):
                sets = list(shingle_sets(part.column(2), k))
                c, id_type = [set_id(s) for s in sets], part.column(0).type
                sk = pa.array([parity(s).tobytes() for s in sets], pa.binary())
                yield _batch(names, pa.array(np.zeros(len(sets), bool)), part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(c, pa.int64()), sk)
                for one, s in zip(c, sets, strict=True):
                    if one not in seen:
                        seen.add(one)
                        held.append(s)
                        size += len(s)
                if size > chunk:
                    yield count()
                    size = 0
                    seen.clear()
        if held:
            yield count()

    return docs.mapInArrow(run, f"common boolean, id {kind}, h long, n long, c long, sk binary")


def common_shingles(described: DataFrame, documents: int) -> Common:
    """Those of the counted shingles that a share of all documents has; a bounded number, the most common ones if there are more."""
    counts = described.where("common").groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") * SHARE >= documents)
    t = counts.orderBy(F.desc("n"), "c").limit(COMMON).toArrow()
    return Common(t["c"].to_numpy().view(_U), t["n"].to_numpy())


def windows(docs: DataFrame, common, num: int, den: int, k: int = SHINGLE) -> DataFrame:
    """(e, c, n, pos, hot) for each set met in a task (once, as a rule) and each shingle of its window: the regions that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for part in parts(b, 2):
                out: list[tuple] = []
                for s in shingle_sets(part.column(2), k):
                    c = set_id(s)
                    if c not in seen and len(s):
                        seen.add(c)
                        e, hot = common.value.window(s, num, den)
                        out.append((e, np.full(len(e), c, np.int64), np.full(len(e), len(s), np.int32), np.arange(len(e), dtype=np.int32), hot))
                if len(seen) > 200_000:
                    seen.clear()
                if out:
                    e, c, n, pos, hot = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield _batch("e c n pos hot", pa.array(e.view(np.int64)), pa.array(c), pa.array(n), pa.array(pos), pa.array(hot))

    return docs.mapInArrow(run, "e long, c long, n int, pos int, hot boolean")


def regions(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(region, c, n, pos): the regions that may hold a link, cut at gaps between sizes.

    A common shingle's region isn't gathered by the shingle: it is known to have several members. No other
    shingle belongs to more than a small share of the documents.
    """
    # each row of a common shingle is a group of its own here
    order = Window.partitionBy("g").orderBy("n", "c")
    once = rows.withColumn("g", F.when(F.col("hot"), F.xxhash64("e", "c")).otherwise(F.col("e"))).withColumn("again", F.lag("c").over(order)).where("again is null or again <> c")
    gapped = once.withColumn("gap", F.coalesce(F.lag("n").over(order) * den < F.col("n") * num, F.lit(True)))
    back, ahead, far = F.lag("gap").over(order), F.coalesce(F.lead("gap").over(order), F.lit(True)), F.coalesce(F.lead("gap", 2).over(order), F.lit(True))
    # two members, whose shingles before the common one differ: they may differ in too many
    apart = lambda side: (F.col("pos") + side("pos").over(order)) * (den + num) > (F.col("n") + side("n").over(order)) * (den - num)
    alone = F.col("gap") & ahead
    two = F.when(F.col("gap") & ~ahead & far, apart(F.lead)).when(~F.col("gap") & ahead & F.coalesce(back, F.lit(False)), apart(F.lag)).otherwise(F.lit(False))
    chained = gapped.withColumns({"chain": F.sum(F.col("gap").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "out": alone | two}).where("hot or not out")
    return chained.select(F.when(F.col("hot"), F.xxhash64("e")).otherwise(F.xxhash64("e", "chain")).alias("region"), "c", "n", "pos")


def sets_of(docs: DataFrame, wanted: DataFrame, count: int, k: int = SHINGLE) -> DataFrame:
    """(c, s) of the wanted sets (c, h), read from the documents that stand for them."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter.of(wanted, "h", Filter.size(count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(pa.array(shared.value.has(b.column(1).to_numpy())))
            for part in parts(some, 2):
                sets = list(shingle_sets(part.column(2), k))
                yield _batch("h c s", part.column(1), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))

    found = docs.mapInArrow(run, "h long, c long, s array<long>")
    return found.join(wanted, ["c", "h"], "left_semi").groupBy("c").agg(F.first("s").alias("s"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, root) for each end of the edges (a, b): root is the smallest node that it is connected to.

    Large-star and small-star steps in turn until nothing changes.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("c"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        last, now = now, scratch.keep(small)
        scratch.drop(last)


def fold(flat: np.ndarray, start: np.ndarray, words: np.ndarray, to: int) -> np.ndarray:
    """Sketches of so many words each, which stand in flat, as an array of sketches of to words."""
    out = np.empty((len(start), to), _U)
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        out[at] = np.bitwise_xor.reduce(flat[start[at][:, None] + np.arange(w)].reshape(len(at), w // to, to), axis=1)
    return out


class Sketches:
    """The sketches of a number of members, which may differ in length."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 8
        self.flat = np.frombuffer(data, _U) if data is not None and data.size else np.zeros(0, _U)
        self.start, self.words = offsets[:-1], np.diff(offsets)

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hamming distance of each pair, at the shorter one's length."""
        out = np.empty(len(i), np.int64)
        to = np.minimum(self.words[i], self.words[j])
        for w in np.unique(to).tolist():
            for at in np.array_split(np.flatnonzero(to == w), 1 + len(i) // 50_000):
                a, b = (fold(self.flat, self.start[x], self.words[x], w) for x in (i[at], j[at]))
                out[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        return out

    def table(self, rows: np.ndarray) -> np.ndarray:
        return fold(self.flat, self.start[rows], self.words[rows], int(self.words[rows].min()))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of two arrays of sketches."""
    out = np.empty((len(a), len(b)), np.int64)
    for at in range(0, len(a), 32):
        out[at : at + 32] = np.bitwise_count(a[at : at + 32, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
    return out


def near_pairs(k: np.ndarray, n: np.ndarray, num: int, den: int, direct_: int = DIRECT, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of all members whose sketches (uint64) allow a link: the recursive Voronoi join. tally counts what was done."""

    def direct(left: np.ndarray, right: np.ndarray) -> None:
        d = distances(k[left], k[right])
        i, j = np.nonzero(d * (den + num) <= (n[left][:, None] + n[right][None, :]) * (den - num))
        pairs.append(np.stack([left[i], right[j]]))

    def split(members: np.ndarray, native: np.ndarray) -> None:
        """All near pairs of a native and any other member."""
        if len(members) <= direct_:
            direct(native, members)
            return
        pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(int)]
        d = distances(k[members], k[pivots])
        most = int(2 * n[members].max() * (den - num) // (den + num))
        home = d.argmin(1)
        at_home = d[np.arange(len(members)), home]
        is_native = np.isin(members, native)
        for q in range(PIVOTS):
            own = (home == q) & is_native
            if own.any():
                inside = (d[:, q] <= at_home + 2 * most) & (d[:, q] <= at_home[own].max() + most)
                if tally is not None:
                    tally["regions"] = tally.get("regions", 0) + 1
                    tally["outside"] = tally.get("outside", 0) + int((~inside).sum())
                if inside.sum() <= 0.7 * len(members):
                    split(members[inside], members[own])
                else:
                    direct(members[own], members[inside])

    pairs: list[np.ndarray] = []
    everyone = np.arange(len(n))
    split(everyone, everyone)
    found = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    found = found[:, found[0] != found[1]]
    i, j = np.minimum(found[0], found[1]), np.maximum(found[0], found[1])
    one = np.unique(i * len(n) + j)
    return one // max(1, len(n)), one % max(1, len(n))


def forest(i: np.ndarray, j: np.ndarray, d: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Places of the pairs, nearest first, that connect members not yet connected (root: component of each)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    out = []
    order = np.argsort(d, kind="stable")
    for e, x, y in zip(order.tolist(), root[i[order]].tolist(), root[j[order]].tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append(e)
    return np.array(out, np.int64)


def join_regions(t: pa.Table, num: int, den: int, every: bool, direct_: int = DIRECT, tally: dict | None = None) -> pa.RecordBatch:
    """(region, a, b) of whole regions' members (region, c, root, n, pos, sk; regions one after the other): the pairs of different roots
    that sizes, places and sketches allow. Of each region a forest of the nearest, or all."""
    region, c, root, n, pos = (t[x].to_numpy() for x in ("region", "c", "root", "n", "pos"))
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    sketches = Sketches(t["sk"].combine_chunks())
    start = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
    size = np.diff(np.append(start, len(region)))
    lefts, rights = [], []
    small = size <= direct_
    a = np.repeat(start[small], size[small])  # first member of each small region's member
    row = np.arange(len(region))[np.repeat(small, size)]
    ahead = np.repeat(size[small], size[small]) - (row - a) - 1
    lefts.append(np.repeat(row, ahead))
    rights.append(np.repeat(row + 1, ahead) + np.arange(ahead.sum()) - np.repeat(np.cumsum(ahead) - ahead, ahead))
    for s, m in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
        members = np.arange(s, s + m)
        i, j = near_pairs(sketches.table(members), n[members], num, den, direct_, tally)
        lefts.append(i + s)
        rights.append(j + s)
    i, j = np.concatenate(lefts), np.concatenate(rights)
    both = n[i] + n[j]
    ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
    ok &= (pos[i] + pos[j]) * (den + num) <= both * (den - num)  # what stands before a first common shingle differs
    i, j, both = i[ok], j[ok], both[ok]
    d = sketches.distances(i, j)
    ok = d * (den + num) <= both * (den - num)
    i, j, d = i[ok], j[ok], d[ok]
    if not every and len(i):
        order = np.argsort(region[i], kind="stable")
        i, j, d = i[order], j[order], d[order]
        at = np.flatnonzero(np.concatenate([[True], region[i][1:] != region[i][:-1]]))
        keep = [b + (forest(i[b:z], j[b:z], d[b:z], root) if z - b > 1 else np.zeros(1, np.int64)) for b, z in zip(at.tolist(), [*at[1:].tolist(), len(i)], strict=True)]
        keep = np.concatenate(keep)
        i, j = i[keep], j[keep]
    return _batch("region a b", pa.array(region[i]), pa.array(np.minimum(c[i], c[j])), pa.array(np.maximum(c[i], c[j])))


def candidates(members: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """join_regions() of all regions of members (region, c, root, n, pos, sk), a batch of regions at a time."""
    direct_ = DIRECT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            region = b.column(0).to_numpy()
            if not len(region):
                continue
            begin = len(region) - int((region[::-1] == region[-1]).argmin()) if region[0] != region[-1] else 0  # where the last region starts
            if held and region[0] != held[-1].column(0)[-1].as_py():
                yield join_regions(pa.Table.from_batches(held), num, den, every, direct_)
                held = []
            if begin:
                yield join_regions(pa.Table.from_batches([*held, b.slice(0, begin)]), num, den, every, direct_)
                held = []
            held.append(b.slice(begin))
        if held:
            yield join_regions(pa.Table.from_batches(held), num, den, every, direct_)

    dealt = members.select("region", "c", "root", "n", "pos", "sk").repartition("region").sortWithinPartitions("region")
    return dealt.mapInArrow(run, "region long, a long, b long")


class Sets:
    """All distinct sets (c, rep, h, n, sk) of docs (id, h, text), and the sets themselves on demand."""

    def __init__(self, docs: DataFrame, table: DataFrame, scratch: Scratch, num: int, den: int, k: int):
        self.docs, self.table, self.scratch, self.num, self.den, self.k = docs, table, scratch, num, den, k

    def linked(self, pairs: DataFrame) -> DataFrame:
        """(a, b, link) of distinct pairs, by the sets."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        wanted = self.scratch.keep(self.table.join(ends, "c").select("c", "h"))
        count = wanted.count()
        sets = self.scratch.keep(sets_of(self.docs, wanted, count, self.k))
        left = sets.join(pairs.select(F.col("a").alias("c")).distinct(), "c", "left_semi").select(F.col("c").alias("a"), F.col("s").alias("sa"))
        if (left.agg(F.sum(F.size("sa"))).first()[0] or 0) <= BROADCAST_SHINGLES:
            left = F.broadcast(left)
        full = pairs.select("a", "b").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b").join(left, "a")
        counted = full.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
        out = self.scratch.keep(counted.select("a", "b", (F.lit(self.den) * F.col("i") >= F.lit(self.num) * (F.col("t") - F.col("i"))).alias("link")))
        self.scratch.drop(wanted, sets)
        return out


def rooted(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """members with root: the component of each, itself where none is known yet."""
    if comps is None:
        return members.withColumn("root", F.col("c"))
    return members.join(comps, "c", "left").withColumn("root", F.coalesce("root", "c"))


def deal(members: DataFrame, comps: DataFrame, task: int) -> DataFrame:
    """The members of large regions dealt to regions of about task members in which every two of different components meet.

    Members of the component of a region's smallest member need not meet each other: only the others' blocks meet all blocks.
    """
    known = rooted(members, comps)
    main = known.groupBy("region").agg(F.min(F.struct("c", "root"))["root"].alias("main"))
    known = known.join(main, "region").withColumn("rest", F.col("root") != F.col("main"))
    half = max(1, task // 2)
    sizes = known.groupBy("region").agg(F.ceil(F.sum(F.col("rest").cast("int")) / half).cast("int").alias("others"), F.ceil(F.sum((~F.col("rest")).cast("int")) / half).cast("int").alias("mains")).where("others > 0")
    known = known.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("c", F.lit(11)), F.when(F.col("rest"), F.col("others")).otherwise(F.col("mains"))).cast("int"))
    # a meeting is (block of others, block of others) or (block of others, block of the main component), the latter's numbers behind the former's
    own = F.transform(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1), lambda x: F.struct(F.least(F.col("block"), x).alias("i"), F.greatest(F.col("block"), x).alias("j")))
    theirs = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: F.struct(x.alias("i"), (F.col("others") + F.col("block")).alias("j")))
    met = known.withColumn("at", F.explode(F.when(F.col("rest"), own).otherwise(theirs)))
    return met.select(F.xxhash64("region", "at.i", "at.j").alias("region"), "c", "n", "pos")


def collapse(members: DataFrame, sets: Sets, task: int) -> tuple[DataFrame, DataFrame | None]:
    """members without regions of more than task members, and the components found on the way: by links to the smallest member of each large region."""
    scratch = sets.scratch
    large = scratch.keep(members.groupBy("region").agg(F.count("*").alias("size"), F.min("c").alias("p")).where(F.col("size") > task))
    if large.isEmpty():
        scratch.drop(large)
        return members, None
    big = members.join(large.select("region", "p"), "region")
    stars = big.where("c <> p").select(F.col("p").alias("a"), F.col("c").alias("b"), "n").distinct()
    sizes = sets.table.select(F.col("c").alias("a"), F.col("n").alias("na"))
    fits = stars.join(sizes, "a").where(F.least("n", "na") * sets.den >= F.greatest("n", "na") * sets.num)
    checked = sets.linked(scratch.keep(fits.select("a", "b").distinct()))
    comps = scratch.keep(components(checked.where("link").select("a", "b"), scratch))
    small = members.join(large.select("region"), "region", "left_anti")
    out = scratch.keep(small.union(deal(big.drop("p"), comps, task)))
    scratch.drop(large, checked)
    return out, comps


def links(members: DataFrame, sets: Sets, task: int) -> DataFrame | None:
    """Components (c, root) of the members (region, c, n, pos): every pair that links shares a region. None if there are no links."""
    scratch = sets.scratch
    members, comps = collapse(members, sets, task)
    found = None if comps is None else comps.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b"))
    sketches = sets.table.select("c", "sk")
    for every in (False, True):
        cands = scratch.keep(candidates(rooted(members, comps).join(sketches, "c"), sets.num, sets.den, every))
        pairs = cands.select("a", "b").distinct()
        if every:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs)
        checked = sets.linked(pairs)
        new = checked.where("link").select("a", "b")
        if not new.isEmpty():
            found = new if found is None else found.union(new)
            comps = scratch.keep(components(found, scratch))
        if every:
            break
        # A region whose forest holds is connected as far as it can be; only the others need all their pairs.
        failed = cands.join(checked.where("not link"), ["a", "b"], "left_semi").select("region").distinct()
        members = scratch.keep(members.join(failed, "region", "left_semi"))
        if members.isEmpty():
            break
    return comps


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key)).alias("h"), F.col(text).cast("string").alias("text"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", num: int = NUM, den: int = DEN, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, c) of all documents, and (c, rep, root, component) of all sets that have words: the smallest ids of the set and of all that links connect (root is the same for those); a null is larger than any."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = _rows(docs, text, key)
    described = scratch.keep(describe(rows, k))
    all_rows = scratch.keep(described.where("not common").select("id", "n", "c"))
    one = described.where("not common and n > 0").groupBy("c").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.min("sk").alias("sk"))
    table = scratch.keep(one.withColumn("h", F.xxhash64("rep")))
    common = spark.sparkContext.broadcast(common_shingles(described, all_rows.count()))
    scratch.drop(described)
    members = scratch.keep(regions(windows(rows, common, num, den, k), num, den))
    comps = links(members, Sets(rows, table, scratch, num, den, k), TASK_MEMBERS)
    reps = table.select("c", "rep")
    if comps is None:
        return all_rows, reps.withColumns({"root": F.col("c"), "component": F.col("rep")})
    out = reps.join(comps, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = out.groupBy("root").agg(F.min("rep").alias("component"))
    found = scratch.keep(out.join(least, "root").select("c", "rep", "root", "component"))
    scratch.drop_all_but(all_rows, found)
    return all_rows, found


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", num: int = NUM, den: int = DEN, k: int = SHINGLE) -> DataFrame:
    """key, n_shingles, component_id for every row: the smallest id that links reach from it.

    Documents link when den * |intersection| >= num * |union| of their sets of k-word shingles. Null and empty texts have no
    shingles and are linked with nothing; rows may repeat; ids may be of any type, a null counts as the largest. Sets are compared
    by 64-bit hashes of their shingles.
    """
    rows, found = classes(docs, text, key, num, den, k)
    joined = rows.join(found.select("c", "component"), "c", "left")
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", num: int = NUM, den: int = DEN, k: int = SHINGLE) -> DataFrame:
    """The rows of docs, with their columns, less all but one of each component, the one with the smallest id; rows without words stay.

    Ids may be null or repeat; of rows with equal ids and sets one stays.
    """
    rows, found = classes(docs, text, key, num, den, k)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "c")).alias("x")).select("x.c", F.col("x.rep").alias("id"))
    if rows.where("id is null").isEmpty() and rows.groupBy("id").count().where("count > 1").isEmpty():
        gone = rows.where("n > 0").join(first.select("id"), "id", "left_anti").select(F.col("id").alias("__lf_id"))
        return docs.join(gone, docs[key].eqNullSafe(F.col("__lf_id")), "left_anti")
    columns = docs.columns
    packed = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, 1):
                sets = list(shingle_sets(part.column(1), k))
                yield _batch("id n c doc", part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), part.column(2))

    schema = T.StructType([packed.schema["id"], *(T.StructField(x, T.LongType()) for x in ("n", "c")), packed.schema["doc"]])
    tagged = packed.mapInArrow(run, schema)
    same = first.select(F.col("c").alias("fc"), F.col("id").alias("fid"))
    stays = tagged.where("n > 0").join(same, (F.col("c") == F.col("fc")) & F.col("id").eqNullSafe(F.col("fid")), "left_semi")
    one = stays.groupBy("c").agg(F.first("doc").alias("doc")).select("doc")
    return tagged.where("n = 0").select("doc").unionByName(one).select("doc.*")
