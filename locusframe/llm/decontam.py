"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words. For each pattern length m a shift table, indexed by
the hash of a block of two words, holds how far a window's end may move when that block ends there: m - 1
for a block in no pattern, 0 for one that ends a pattern. A shift of 0 sends the position to the bucket of
patterns with that suffix hash, and the words' bytes decide. Many stretches of text move in step, so that
each move is one array operation; the stretches overlap nowhere and miss no end position.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, flat_text, map_batches, mix64, parts, span_hashes, words_of

WINDOW = 8
SLOTS = 1 << 18
#: Window ends that one stretch covers, and benchmark bytes in one broadcast block of patterns (about 150 times as much memory on the driver).
STRETCH = 128
BLOCK_BYTES = 2 << 20
_U = np.uint64

#: After lower-casing A-Z: digits, a-z and all bytes of characters beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, the words' starts, ends and hashes, and for each row the number of the first word (and at the end the total)."""
    data, offsets = flat_text(column)
    data = LOWER[data]
    starts, ends, rows = words_of(data, offsets, IS_WORD)
    return data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(rows, np.arange(len(offsets)))


def blocks(words: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of size words that ends at each of the given words."""
    h = words[ends]
    return mix64(h + words[ends - 1] * _U(0x9E3779B97F4A7C15)) if size == 2 else mix64(h)


def window_hashes(words: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros(len(ends), _U)
    for k in range(m):
        out = mix64(out + words[ends - k] * _U(0xD6E8FEB86659FD93 + 2 * k))
    return out


class Patterns:
    """The distinct windows of a set of items, with shift tables and suffix buckets for each length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        hashes: dict[bytes, np.ndarray] = {}
        data, starts, ends, words, first = tokens(pa.array([t for _, t in items], pa.string()))
        for row, (item, _) in enumerate(items):
            a, z = int(first[row]), int(first[row + 1])
            m = min(window, z - a)
            for i in range(a, z - m + 1) if m else ():
                text = b" ".join(data[starts[k] : ends[k]].tobytes() for k in range(i, i + m))
                found[m][text].add(item)
                hashes[text] = words[i : i + m]
        self.matchers = [Matcher(m, list(by), np.array([hashes[t] for t in by]), [sorted(s) for s in by.values()]) for m, by in sorted(found.items())]


class Matcher:
    """All patterns of m words."""

    def __init__(self, m: int, texts: list[bytes], words: np.ndarray, items: list[list[str]]):
        self.m, self.size = m, min(2, m)
        self.full = m - self.size + 1
        self.shift = np.full(SLOTS, self.full, np.int64)
        flat = words.ravel()
        at = np.arange(len(texts)) * m
        for j in range(self.size - 1, m):
            np.minimum.at(self.shift, self.slot(blocks(flat, at + j, self.size)), m - 1 - j)
        whole = window_hashes(flat, at + m - 1, m)
        order = np.argsort(whole, kind="stable")
        self.suffixes = np.unique(blocks(flat, at + m - 1, self.size))
        self.whole, self.texts, self.items = whole[order], [texts[i] for i in order], [items[i] for i in order]

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(46)).astype(np.int64)

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the windows that have a pattern's hash, and the first pattern with it."""
        a, z = first[:-1] + self.m - 1, first[1:]
        n = np.maximum(0, -(-(z - a) // STRETCH))
        begin = np.repeat(a, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        stop = np.minimum(begin + STRETCH, np.repeat(z, n))
        hits = []
        while len(begin):
            h = blocks(words, begin, self.size)
            move = self.shift[self.slot(h)]
            stay = np.flatnonzero(move == 0)
            if len(stay):
                near = np.searchsorted(self.suffixes, h[stay])
                near[near == len(self.suffixes)] = 0
                hits.append(begin[stay[self.suffixes[near] == h[stay]]])
            begin = begin + np.maximum(move, 1)
            more = begin < stop
            begin, stop = begin[more], stop[more]
        ends = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        whole = window_hashes(words, ends, self.m)
        at = np.searchsorted(self.whole, whole)
        at[at == len(self.whole)] = 0
        same = self.whole[at] == whole
        return ends[same], at[same]


def find(patterns: Patterns, column: pa.Array) -> tuple[np.ndarray, list[list[int]], list[set[str]]]:
    """For each row: number of words, the hit words' runs as [first, behind, first, ...], and the items with a window in it."""
    data, starts, ends, words, first = tokens(column)
    items: list[set[str]] = [set() for _ in range(len(column))]
    edge = np.zeros(len(words) + 1, np.int64)
    for matcher in patterns.matchers:
        for end, p in zip(*(x.tolist() for x in matcher.search(words, first)), strict=True):
            begin = end - matcher.m + 1
            text = b" ".join([data[starts[k] : ends[k]].tobytes() for k in range(begin, end + 1)])
            q = p
            while q < len(matcher.texts) - 1 and matcher.texts[q] != text and matcher.whole[q + 1] == matcher.whole[p]:
                q += 1
            if matcher.texts[q] == text:
                edge[begin] += 1
                edge[end + 1] -= 1
                items[int(np.searchsorted(first, begin, "right")) - 1].update(matcher.items[q])
    hit = np.diff(np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]]))
    on, off = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    runs: list[list[int]] = [[] for _ in range(len(column))]
    rows = np.searchsorted(first, on, "right") - 1
    for r, a, z in zip(rows.tolist(), on.tolist(), off.tolist(), strict=True):
        while a < z:  # a run may go on in the next row
            behind = min(z, int(first[r + 1]))
            if a < behind:
                runs[r] += [a - int(first[r]), behind - int(first[r])]
            a, r = behind, r + 1
    return np.diff(first), runs, items


def union(a: list[int], b: list[int]) -> list[int]:
    """Of two sorted lists of runs."""
    out: list[int] = []
    for x, y in sorted(zip((a + b)[::2], (a + b)[1::2], strict=True)):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


def read_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about block_bytes, one after the other; a row without a text has no words."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["i"], r["t"]) for r in part.collect()]


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted), runs (of hit words); docs' columns of these names are replaced.

    Null texts have no words; an empty benchmark hits nothing; items with the same id count once; rows may
    repeat. A benchmark beyond block_bytes is searched in blocks, one after the other, each against all
    rows; what has been found travels with the row, so nothing is shuffled.
    """
    own = ["n_words", "n_hit", "n_items", "items", "runs"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "runs": F.array().cast("array<int>")})
    at = docs.columns.index(text)
    for block in read_blocks(benchmark, item, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Patterns(block, window))

        def run(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            done = []
            for p in parts(b, at):
                n, runs, items = find(shared.value, p.column(at).cast(pa.string()))
                before = [p.column(p.num_columns - 2).to_pylist(), p.column(p.num_columns - 1).to_pylist()]
                items = [sorted(i | set(o)) if o else sorted(i) for i, o in zip(items, before[0], strict=True)]
                runs = [union(r, o) if o else r for r, o in zip(runs, before[1], strict=True)]
                columns = p.columns[:-5] + [pa.array(n, pa.int64()), pa.array([sum(r[1::2]) - sum(r[::2]) for r in runs], pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int32()))]
                done.append(pa.RecordBatch.from_arrays(columns, names=p.schema.names))
            return pa.Table.from_batches(done).combine_chunks().to_batches()[0]

        out = map_batches(out, run, out.schema)
    return out


def digest(found: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """The report: counts, the items' digest, and whether least items or more have a window in the text."""
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(key, "n_words", "n_hit", "n_items", items.alias("items_sha256"), (F.col("n_items") >= least).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = 2, **names: str) -> DataFrame:
    """The rows of docs, with their columns, that hold windows of fewer than least items."""
    found = search(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(names.get("text", "text")).cast("string").alias("text")), benchmark, **(names | {"text": "text"}))
    return found.where(F.col("n_items") < least).select("doc.*")
