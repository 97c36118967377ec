"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Characters are folded to 256 symbols, so an n-gram of ORDER symbols is one integer and nothing needs a
dictionary. Every task counts its own distinct n-grams, for the model (by language, trusted rows only) and for
scoring (by language and document, in blocks). Both go to shards by the two symbols before the last one:
there, all counts that an n-gram's probability needs above bigrams meet (its suffixes end in the same
symbols, its contexts in the same two), and the bigrams' own table is bounded by the 256 symbols. A
shard returns for each block one partial sum a document; the sums over shards are the documents'
log-probabilities. No text and no single occurrence is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, cut, flat_text, parts
from .jaccard import Filter

ORDER = 4
#: Documents and characters of a block, shards, share of trusted documents that set the thresholds and are not counted, and their quantile.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 19
SHARDS = 32
#: Blocks that one task of a shard scores; a shard of a larger language is dealt to several.
TASK_BLOCKS = 512
#: Languages whose two lowest orders (at most 3 MB each) are broadcast together; more languages are scored one such group after the other.
TASK_LANGS = 64
#: Languages whose thresholds are broadcast; beyond, they are joined.
BROADCAST_LANGS = 10_000
HELD_OUT = 5
QUANTILE, MARGIN = 0.99, 1.25
_FOLD: list[np.ndarray] = []


def fold() -> np.ndarray:
    """Symbol of each code point: Latin letters lower-cased, digits as one, white space as one, the rest by remainder."""
    if not _FOLD:
        out = (np.arange(0x110000) % 128 + 128).astype(np.uint8)
        for c in range(256):
            ch = chr(c)
            low = ch.lower()
            out[c] = 32 if ch.isspace() else 48 if ch.isdigit() else ord(low) if len(low) == 1 and ord(low) < 256 else c
        out[0] = 1  # 0 is the mark before and behind a text
        _FOLD.append(out)
    return _FOLD[0]


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character and at each text's end, as an integer of ORDER bytes, and its row."""
    data, offsets = flat_text(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=ends[1:])
    bounds = ends[offsets]
    n = np.diff(bounds)
    rows = np.repeat(np.arange(len(n)), n)
    sym = np.zeros(len(points) + ORDER * len(n), np.int64)  # ORDER - 1 marks before each text and one behind it
    sym[np.arange(len(points)) + ORDER * rows + ORDER - 1] = fold()[points]
    begin = bounds[:-1] + ORDER * np.arange(len(n))
    of = np.repeat(np.arange(len(n)), n + 1)
    at = np.arange(len(points) + len(n)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1) + begin[of] + ORDER - 1
    out = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        out = out << 8 | sym[at - (ORDER - 1 - k)]
    return out, of


def shard_of(grams: np.ndarray) -> np.ndarray:
    """By the two symbols before the last one."""
    mid = (grams >> 8) & 0xFFFF
    return (mid * 40503 >> 4) % SHARDS


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[start], np.diff(np.append(start, len(values)))


def pack(grams: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> bytes:
    """Postings as bytes: distinct n-grams by difference, documents of each, counts."""
    import zstandard

    names, n = runs(grams)
    parts = [np.diff(names, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), n.astype("<u2").tobytes(), docs.astype("<u2").tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<u4").tobytes()]
    head = np.array([len(names), len(grams), int((counts >= 255).sum())], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, their places among the postings, documents, counts."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    names_n, n, big = np.frombuffer(raw, "<u4", 3).tolist()
    at = 12
    names = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * names_n, at).reshape(8, -1).T).view("<u8").ravel().astype(np.int64).cumsum()
    at += 8 * names_n
    each = np.frombuffer(raw, "<u2", names_n, at).astype(np.int64)
    at += 2 * names_n
    docs = np.frombuffer(raw, "<u2", n, at).astype(np.int64)
    at += 2 * n
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    at += n
    counts[counts == 255] = np.frombuffer(raw, "<u4", big, at)
    return names, np.repeat(np.arange(names_n), each), docs, counts


def model_counts(docs: DataFrame) -> DataFrame:
    """(lang, shard, gram, n) over docs (lang, text): each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams = np.concatenate([p[0] for p in parts])
                order = np.argsort(grams, kind="stable")
                names, n = runs(grams[order])
                total = np.add.reduceat(np.concatenate([p[1] for p in parts])[order], np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(shard_of(names).astype(np.int32)), pa.array(names), pa.array(total)], names=["lang", "shard", "gram", "n"])
            held.clear()

        for b in (p for batch in batches for p in parts(batch, 1)):
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                rows = b.column(1).filter(pa.array(langs == lang))
                for at in range(0, len(rows), BLOCK_ROWS):
                    got = runs(np.sort(packed(rows.slice(at, BLOCK_ROWS))[0]))
                    held.setdefault(lang, []).append(got)
                    size += len(got[0])
            if size > 1_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, shard int, gram long, n long").groupBy("lang", "shard", "gram").agg(F.sum("n").alias("n"))


class Order:
    """Counts of one order by n-gram, with each context's total, and the three modified discounts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, discounts: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.grams, self.counts = grams[order], counts[order]
        context = self.grams >> 8
        self.contexts, n = runs(context)
        start = np.cumsum(n) - n
        add = lambda x: np.add.reduceat(x.astype(np.float64), start) if len(start) else np.zeros(0)
        self.totals = add(self.counts)
        held = discounts[np.minimum(self.counts, 3) - 1] if len(self.counts) else np.zeros(0)
        self.seen = np.maximum(self.counts - held, 0)
        self.left = add(held)

    def interpolate(self, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probability of each n-gram's last symbol, given that of the next lower order."""
        if not len(self.grams):
            return lower
        c = grams >> 8
        at = np.minimum(np.searchsorted(self.contexts, c), len(self.contexts) - 1)
        known = self.contexts[at] == c
        g = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        seen = np.where(self.grams[g] == grams, self.seen[g], 0.0)
        return np.where(known, (seen + self.left[at] * lower) / self.totals[at], lower)


def discounts(counts: np.ndarray) -> np.ndarray:
    return _discounts([int((counts == k).sum()) for k in (1, 2, 3, 4)])


def _discounts(n: list[int]) -> np.ndarray:
    """Of n-grams seen once, twice and more often, from the counts of counts."""
    if not all(n):
        return np.array([0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip(np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]), 0.05, [0.95, 1.9, 2.85])


class Shard:
    """The model of one language in one shard; shared: what all its shards have in common."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, shared: Shared):
        levels = [(grams, counts)]
        for k in range(ORDER - 1, 2, -1):  # continuation counts: distinct symbols before each shorter n-gram
            levels.append(runs(np.sort(levels[-1][0] & ((1 << 8 * k) - 1))))
        self.orders = [Order(g, n, shared.discounts[k]) for k, (g, n) in zip(range(3, ORDER + 1), reversed(levels), strict=True)]
        self.shared = shared

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        p = self.shared.two.interpolate(grams & 0xFFFF, self.shared.one[grams & 0xFF])
        for k, order in enumerate(self.orders, 3):
            p = order.interpolate(grams & ((1 << 8 * k) - 1), p)
        return np.log(p)


class Shared:
    """The two lowest orders of a language (at most 65,536 bigrams), and the discounts of the others."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, discounts_: dict[int, np.ndarray]):
        self.discounts = discounts_
        self.two = Order(grams, counts, discounts(counts))
        symbols, n = runs(np.sort(grams & 0xFF))
        d = discounts(n)
        held = d[np.minimum(n, 3) - 1] if len(n) else np.zeros(0)
        total = max(1, n.sum())
        self.one = np.zeros(256)
        self.one[symbols] = np.maximum(n - held, 0) / total
        self.one += (held.sum() / total if len(n) else 1.0) / 256


def shared_tables(counts: DataFrame) -> dict[str, Shared]:
    """From (lang, gram, n): bigrams' continuation counts and, of each higher order, how many n-grams were seen once to four times; a bounded number of rows for a language."""
    levels = {ORDER: counts.select("lang", "gram", "n")}
    for k in range(ORDER - 1, 1, -1):
        levels[k] = levels[k + 1].groupBy("lang", F.expr(f"gram & {(1 << 8 * k) - 1}").alias("gram")).agg(F.count("*").alias("n"))
    of: dict[str, dict[int, np.ndarray]] = {}
    for k in range(3, ORDER + 1):
        for r in levels[k].where("n <= 4").groupBy("lang", "n").agg(F.count("*").alias("m")).collect():
            of.setdefault(r["lang"], {}).setdefault(k, np.zeros(5, np.int64))[r["n"]] = r["m"]
    two = levels[2].toArrow()
    langs, grams, n = np.array(two["lang"].to_pylist(), object), two["gram"].to_numpy(), two["n"].to_numpy()
    out = {}
    for lang in dict.fromkeys(langs):
        mine = langs == lang
        out[lang] = Shared(grams[mine], n[mine], {k: _discounts(of.get(lang, {}).get(k, np.zeros(5, np.int64))[1:].tolist()) for k in range(3, ORDER + 1)})
    return out


def postings(docs: DataFrame) -> DataFrame:
    """(lang, shard, block, size, ids, data) of docs (id, lang, text): for each block of documents of a language its n-grams by shard, with the ids once."""

    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32  # the same if the task runs again
        for b in (p for batch in batches for p in parts(batch, 2, BLOCK_ROWS * 8, 8 * BLOCK_CHARS)):
            langs = np.array(b.column(1).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                part = b.filter(pa.array(langs == lang))
                size = pc.fill_null(pc.utf8_length(part.column(2)), 0).to_numpy(zero_copy_only=False)
                at = 0
                while at < part.num_rows:
                    stop = at + max(1, int(np.searchsorted(np.cumsum(size[at : at + BLOCK_ROWS]), BLOCK_CHARS, "right")))
                    rows = part.slice(at, stop - at)
                    shards, data = block_postings(rows.column(2))
                    m = len(shards)
                    ids = pa.concat_arrays([pa.ListArray.from_arrays([0, rows.num_rows], rows.column(0)), pa.nulls(m - 1, pa.list_(rows.column(0).type))])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(shards, pa.int32()), pa.array([block] * m, pa.int64()), pa.array([rows.num_rows] * m, pa.int32()), ids, pa.array(data, pa.binary())], names=["lang", "shard", "block", "size", "ids", "data"])
                    at = stop
                    block += 1

    return docs.mapInArrow(run, f"lang string, shard int, block long, size int, ids array<{kind}>, data binary")


def block_postings(column: pa.Array) -> tuple[list[int], list[bytes]]:
    """The shards that a block's texts have n-grams in, and the postings for each."""
    grams, of = packed(column)
    key, n = runs(np.sort(grams << 16 | of))
    shards = shard_of(key >> 16).astype(np.int16)
    order = np.argsort(shards, kind="stable")
    cuts = np.searchsorted(shards[order], np.arange(SHARDS + 1))
    have = [s for s in range(SHARDS) if cuts[s] < cuts[s + 1]]
    return have, [pack(key[o] >> 16, key[o] & 0xFFFF, n[o]) for o in (order[cuts[s] : cuts[s + 1]] for s in have)]


def log_probabilities(docs: DataFrame, trusted: DataFrame, most: int = TASK_LANGS) -> DataFrame:
    """(id, lang, events, log_prob) of every row of docs (id, lang, text) under the model of its language, counted on trusted (lang, text)."""
    model = cut(model_counts(trusted))
    langs = sorted(r["lang"] for r in model.select("lang").distinct().collect())  # a row for each language
    if len(langs) <= most:
        return _log_probabilities(docs, model)
    out = None
    for at in range(0, len(langs), most):
        some = langs[at : at + most]
        mine = F.col("lang").isin(some)
        part = _log_probabilities(docs.where(mine if at else mine | ~F.col("lang").isin(langs)), model.where(mine))
        out = part if out is None else out.union(part)
    return out


def _log_probabilities(docs: DataFrame, model: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(shared_tables(model))
    tasks = int(docs.count() // (BLOCK_ROWS // 2 * TASK_BLOCKS)) + 1  # a language's blocks of one shard are dealt to so many tasks
    part = F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int")
    left = postings(docs).withColumn("part", part).groupBy("lang", "shard", "part")
    right = model.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).groupBy("lang", "shard", "part")

    def score(key: tuple, blocks: pa.Table, counts: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        sums, events = [], []
        if blocks.num_rows:
            common = shared.value.get(lang) or Shared(np.zeros(0, np.int64), np.zeros(0, np.int64), {k: _discounts([0]) for k in range(3, ORDER + 1)})
            shard = Shard(*_sorted(counts["gram"].to_numpy(), counts["n"].to_numpy()), common)
            for data, size in zip(blocks["data"].to_pylist(), blocks["size"].to_pylist(), strict=True):
                names, place, of, n = unpack(data)
                sums.append(np.bincount(of, shard.log_probability(names)[place] * n, size))
                events.append(np.bincount(of, n, size).astype(np.int64))
        return pa.table({"lang": pa.array([lang] * len(sums), pa.string()), "block": blocks["block"], "ids": blocks["ids"], "sums": pa.array(sums, pa.list_(pa.float64())), "events": pa.array(events, pa.list_(pa.int64()))})

    kind = docs.schema["id"].dataType.simpleString()
    scored = left.cogroup(right).applyInArrow(score, f"lang string, block long, ids array<{kind}>, sums array<double>, events array<long>")

    def gather(t: pa.Table) -> pa.Table:
        """The shards' sums of one block, in a fixed order."""
        sums = np.array(sorted(t["sums"].to_pylist())).sum(0)
        events = np.array(t["events"].to_pylist()).sum(0)
        ids = pc.drop_null(t["ids"].combine_chunks()).flatten()
        return pa.table({"id": ids, "lang": pa.array([t["lang"][0].as_py()] * len(ids), pa.string()), "events": events, "log_prob": sums})

    return scored.groupBy("block").applyInArrow(gather, f"id {kind}, lang string, events long, log_prob double")


def _sorted(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    return grams[order], counts[order]


def trusted_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(lang, text) of the rows of docs (id, lang, text) whose id is among ids. A filter of bounded size goes first, so that few other texts are shuffled."""
    kind = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Filter.of(ids.select(F.xxhash64("id").alias("k")), "k", Filter.size(ids.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = pa.array(shared.value.has(b.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays(b.columns[1:], names=b.schema.names[1:]).filter(some)

    maybe = docs.select(F.xxhash64("id").alias("h"), "id", "lang", "text").where("id is not null").mapInArrow(run, f"id {kind}, lang string, text string")
    return maybe.join(ids.hint("merge"), "id", "left_semi").select("lang", "text")  # one plan at every size: ids grow with the table


def classify(docs: DataFrame, trusted: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """key, lang, n_events, log_prob, perplexity, threshold and keep for every row.

    trusted: ids (one column named as key) of the documents that good text is learned from. Four fifths of them are counted;
    the others' perplexities give each language's threshold: their quantile times margin. A null text is
    empty and has one event, its end; null languages form one of their own. Where that would hold out
    nothing of a language's trusted documents, one is held out; where there is but one, it is counted and the held-out ones
    of all languages give the threshold. A language without any has no threshold, and its documents are kept.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ids = trusted.select(F.col(key).cast(docs.schema[key].dataType).alias("id")).where("id is not null").distinct()
    known = cut(rows.select("id", "lang").join(ids, "id", "left_semi").distinct().withColumn("held", crc_remainder(F.col("id"), HELD_OUT) == 0))
    langs = cut(known.groupBy("lang").agg(F.count("*").alias("n"), F.max("held").alias("any"), F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("id")))  # a row for each language
    held = cut(known.where("held").select("id").union(langs.where("n > 1 and not any").select("id")).distinct())
    scored = cut(log_probabilities(rows, trusted_rows(rows, ids.join(held, "id", "left_anti"))).withColumn("perplexity", F.exp(-F.col("log_prob") / F.col("events"))))
    limit = (F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("threshold")
    apart = cut(scored.join(held, "id", "left_semi").select("lang", "perplexity"))
    overall = apart.agg(limit).first()[0]
    limits = langs.select("lang").join(apart.groupBy("lang").agg(limit), "lang", "left").select("lang", F.coalesce("threshold", F.lit(overall).cast("double")).alias("threshold"))
    limits = cut(limits)
    out = scored.join(F.broadcast(limits) if limits.count() <= BROADCAST_LANGS else limits, "lang", "left")
    return out.select(F.col("id").alias(key), F.when(F.col("lang") != "", F.col("lang")).alias("lang"), F.col("events").alias("n_events"), "log_prob", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))
