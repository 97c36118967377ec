"""Signature refit: sparse non-negative least squares by sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """argmin |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ (b - a @ x)
    tol = 1e-12 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(30 * n):
        if free.all() or gradient[~free].max(initial=-1) <= tol:
            break
        free[np.flatnonzero(~free)[gradient[~free].argmax()]] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 0:
                break
            bad = free & (s <= 0)
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            free &= x > 1e-12
            if not free.any():
                s = np.zeros(n)
                break
        x = s
        gradient = a.T @ (b - a @ x)
    return np.maximum(x, 0)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size else 0.0


def refit(table: np.ndarray, counts: np.ndarray, gain: float = 0.01, least: float = 0.05) -> tuple[np.ndarray, float]:
    """Activities of the table's columns and the cosine: signatures join while the cosine grows by gain, then those under the least share go."""
    out = np.zeros(table.shape[1])

    def fit(cols: list[int]) -> tuple[np.ndarray, float]:
        h = nnls(table[:, cols], counts)
        return h, cosine(counts, table[:, cols] @ h)

    chosen: list[int] = []
    best = 0.0
    while counts.sum() and len(chosen) < table.shape[1]:
        tries = [(fit([*chosen, c])[1], -c) for c in range(table.shape[1]) if c not in chosen]
        got, c = max(tries)
        if got - best < gain:
            break
        best = got
        chosen.append(-c)
    while chosen:
        h, best = fit(chosen)
        if not h.sum():
            return out, 0.0
        stay = [c for c, x in zip(chosen, h, strict=True) if x / h.sum() >= least] or [chosen[int(h.argmax())]]
        if len(stay) == len(chosen):
            out[chosen] = h
            return out, best
        chosen = stay
    return out, 0.0


def assign(matrix: DataFrame, signatures: DataFrame, gain: float = 0.01, least: float = 0.05) -> DataFrame:
    """(sample_id, signature, activity, cosine) from counts (sample_id, code, n) and signatures (signature, code, weight): one row for each sample's catalogue, at most a few hundred counts; a batch of samples is one call of Python."""
    book = signatures.toPandas().pivot(index="code", columns="signature", values="weight").sort_index()
    if book.isna().any().any():
        raise ValueError("a signature lacks some codes")
    shared = matrix.sparkSession.sparkContext.broadcast((book.index.to_numpy(), list(book.columns), book.to_numpy()))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, names, table = shared.value
        for b in batches:
            of, rows = b["counts"].offsets.to_numpy(), b["counts"].values
            code, n = rows.field("code").to_numpy(zero_copy_only=False), rows.field("n").to_numpy(zero_copy_only=False).astype(float)
            at = np.searchsorted(codes, code).clip(max=len(codes) - 1)
            n = np.where(codes[at] == code, n, 0.0)  # codes that no signature has don't count
            found = [refit(table, np.bincount(at[i:j], n[i:j], len(codes)), gain, least) for i, j in zip(of[:-1], of[1:], strict=True)]
            k = len(names)
            yield pa.RecordBatch.from_arrays([b["sample_id"].take(pa.array(np.repeat(np.arange(len(b)), k))), pa.array(names * len(b), pa.string()), pa.array(np.concatenate([h for h, _ in found]) if found else np.empty(0)), pa.array(np.repeat([c for _, c in found], k).astype(float))], ["sample_id", "signature", "activity", "cosine"])

    kind = matrix.schema["sample_id"].dataType.simpleString()
    lists = matrix.groupBy("sample_id").agg(F.collect_list(F.struct(F.col("code").cast("long").alias("code"), F.col("n").cast("double").alias("n"))).alias("counts"))
    return lists.mapInArrow(fitted, f"sample_id {kind}, signature string, activity double, cosine double")


def cosine_of(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Cosine similarity of two arrays, 0 where either is zero."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (u, v) -> CAST(u AS DOUBLE) * v), 0D, (s, v) -> s + v)"
    size = f"sqrt({dot(a, a)}) * sqrt({dot(b, b)})"
    return df.withColumn(name, F.expr(f"IF({size} = 0, 0D, {dot(a, b)} / ({size}))"))
