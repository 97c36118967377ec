"""Range partitioning by explicit boundaries, in SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _literal(value: int | bytes) -> str:
    return f"X'{value.hex()}'" if isinstance(value, bytes) else f"{int(value)}L"


def range_id(key: str, bounds: Sequence[int | bytes], least: int = 0) -> str:
    """SQL text: how many of the sorted bounds are <= key, as a balanced tree of comparisons."""
    if not bounds:
        return str(least)
    mid = len(bounds) // 2
    return f"IF({key} < {_literal(bounds[mid])}, {range_id(key, bounds[:mid], least)}, {range_id(key, bounds[mid + 1 :], least + mid + 1)})"


def quantiles(sample: list, n: int) -> list:
    """At most n - 1 distinct boundaries that split the sorted sample into n parts."""
    ordered = sorted(sample)
    return sorted({ordered[len(ordered) * i // n] for i in range(1, n)}) if ordered else []


def placement(spark: SparkSession, groups: int, parts: int) -> list[int]:
    """A distinct integer for each group such that, hash-partitioned by it into parts, group g goes to part g modulo parts: even groups stay even tasks."""
    at: list[list[int]] = [[] for _ in range(parts)]
    need, n = -(-groups // parts), max(64, 4 * parts)
    while min(len(x) for x in at[: min(groups, parts)] or [[0] * need]) < need:
        at = [[] for _ in range(parts)]
        n *= 4
        t = spark.range(n).select(F.col("id").cast("int").alias("v")).select("v", F.pmod(F.hash("v"), F.lit(parts)).alias("p")).toArrow()
        for v, p in zip(t["v"].to_pylist(), t["p"].to_pylist(), strict=True):
            at[p].append(v)
    return [at[g % parts][g // parts] for g in range(groups)]


def element(values: Sequence[int], index: str) -> str:
    """SQL text: the value at index (from 0)."""
    return f"element_at(array({', '.join(map(str, values))}), CAST({index} AS INT) + 1)"
