"""Sharding by sampled splitters.

Records are ordered by (hash of the text, row number), so equal texts stand together. A sample that prefers large
records gives boundaries near the quantiles of size and rows; a key that the sample often holds gets a boundary on each side;
records are range-partitioned by them; ranges that turn out overfull are subdivided by a sample of their
own, and a range of one key by row number. Within each range a window gives every record its exact
place in bytes and rows, and from that its shard: the law is equal bytes, so two shards' sizes differ by
about one record.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions
from .ranges import element, placement, quantiles, range_id

#: Sampled keys per range, and the share of an even range from which a range is overfull.
SAMPLE_PER_RANGE = 64
OVERFULL = 1.5


def records(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, size (UTF-8 bytes and 8), unsigned crc32, order keys a (by text) and b (by row)."""
    t = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("crc"), F.xxhash64(t).alias("a"))
    return rows.withColumn("b", F.monotonically_increasing_id())


def sample(rows: DataFrame, n: int) -> list[int]:
    """At most n keys, each row's chance growing with its load: the n smallest of -ln(u)/load, u a hash of the row."""
    u = (F.pmod(F.xxhash64("a", "id", "b", F.lit(7)), F.lit(1 << 52)) + 1) / float(1 << 52)
    return [r["a"] for r in rows.select("a", (-F.log(u) / F.col("load")).alias("w")).orderBy("w", "a").limit(n).collect()]


def bounds_of(some: list[int], ranges: int) -> set[int]:
    """Quantiles of a sample, and both sides of each key that fills a quarter of a range in it."""
    often = [k for k, n in Counter(some).items() if n * ranges * 4 >= len(some) and n > 2]
    return {*quantiles(some, ranges), *often, *(k + 1 for k in often)}


def splitters(rows: DataFrame, ranges: int) -> list[int]:
    """Sorted boundaries; ranges over OVERFULL even shares are subdivided until none is left, or only single keys."""
    bounds = sorted(bounds_of(sample(rows, ranges * SAMPLE_PER_RANGE), ranges))
    while True:
        sizes = rows.withColumn("r", F.expr(range_id("a", bounds))).groupBy("r").agg(F.sum("load").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi")).collect()
        even = sum(s["n"] for s in sizes) / ranges
        full = [s for s in sizes if s["n"] > OVERFULL * even and s["lo"] < s["hi"]]
        if not full:
            return bounds
        more: set[int] = set()
        for s in full:  # fewer than `ranges`
            n = int(s["n"] / even) + 2
            more |= {k for k in bounds_of(sample(rows.where(F.col("a").between(s["lo"], s["hi"])), n * SAMPLE_PER_RANGE), n) if s["lo"] < k <= s["hi"]} | {s["hi"]}
        bounds = sorted({*bounds, *more})


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law 'bytes', shard, slot and grown_shard (null) for every row.

    Null texts count as empty with size 8. Rows may repeat and ids be null; each row has its slot. Slots run from 0 without a
    gap in each shard; which of several equal texts comes first depends on the files' partitioning. At most shards - 1
    groups of equal texts are cut, those that a shard's end falls into. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tasks = max(2 * shards, partitions(spark))
    rows = cut(records(docs, key, text))
    all_ = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    rows = rows.withColumn("load", F.col("size") + F.lit((all_["bytes"] or 0) / max(1, all_["rows"])))
    bounds = splitters(rows, tasks)
    ranged = rows.withColumn("r", F.expr(range_id("a", bounds)))
    # A run of equal texts may exceed a range: its rows are dealt to sub-ranges by row, in order of b.
    even = 2 * (all_["bytes"] or 0) / tasks
    stats = ranged.groupBy("r").agg(F.sum("load").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi")).collect()
    hot = {s["r"]: int(s["n"] / even) + 1 for s in stats if s["lo"] == s["hi"] and s["n"] > OVERFULL * even}
    cuts: dict[int, list[int]] = {}
    if hot:
        shares = [i / max(hot.values()) for i in range(1, max(hot.values()))]
        for x in ranged.where(F.col("r").isin(list(hot))).groupBy("r").agg(F.percentile_approx("b", shares, 10_000).alias("q")).collect():
            cuts[x["r"]] = sorted(set(x["q"]))
    sub = " ".join(f"WHEN r = {r} THEN {range_id('b', q)}" for r, q in cuts.items())
    ranged = ranged.withColumn("q", F.expr(f"CASE {sub} ELSE 0 END" if sub else "0"))
    # ranges are numbered without a gap and dealt to tasks in turn
    first, n = [], 0
    for r in range(len(bounds) + 1):
        first.append(n)
        n += len(cuts.get(r, ())) + 1
    ranged = ranged.withColumn("g", F.expr(element(placement(spark, n, partitions(spark)), f"{element(first, 'r')} + q")))
    w = Window.partitionBy("g").orderBy("a", "b")
    placed = ranged.withColumns({"place": F.row_number().over(w).cast("long"), "bytes": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    totals = sorted(((s["r"], s["q"], s["n"], s["m"]) for s in ranged.groupBy("r", "q").agg(F.count("*").alias("n"), F.sum("size").alias("m")).collect()))
    base, n, m = [], 0, 0
    for r, q, rows_in, bytes_in in totals:
        base.append((r, q, n, m))
        n, m = n + rows_in, m + bytes_in
    before = F.broadcast(spark.createDataFrame(base, "r int, q int, n0 long, m0 long"))  # a row for each range
    at = placed.join(before, ["r", "q"]).withColumn("rank", F.col("place") + F.col("n0") - 1).withColumn("mid", F.col("bytes") + F.col("m0") - F.col("size") / 2)
    out = at.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("mid") * shards / F.lit(float(max(m, 1))))).cast("int")).select("id", "size", "crc", "shard", "rank")
    first = F.broadcast(out.groupBy("shard").agg(F.min("rank").alias("first")))  # a row for each shard
    return out.join(first, "shard").select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
