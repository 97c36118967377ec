"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from every learning row: each task sums its own and Spark adds them up by language and
bucket. The model, a matrix of at most MAX_LANGS x BUCKETS log-probabilities, is broadcast; a batch is
scored by gathering the matrix's rows for its n-grams and summing them per document. More languages make
several such matrices, one broadcast after the other; the best so far and the sum of all travel with the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat_text, parts

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages of one matrix (64 MB).
MAX_LANGS = 256
#: Add-this smoothing, and characters that are scored at once.
ALPHA = 0.5
STEP = 1 << 18
_SYMBOLS: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """By code point: the lower-case letter's code point, or 0 for all that are not letters."""
    if not _SYMBOLS:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _SYMBOLS.append(out)
    return _SYMBOLS[0]


def grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket at each character (BUCKETS where there is none), the rows' bounds, and whether each row has letters."""
    data, offsets = flat_text(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=ends[1:])
    bounds = ends[offsets]
    sym = symbols()[points]
    n = len(sym)
    out = []
    for k in ORDERS:
        h = np.zeros(n, np.uint32)
        some = np.zeros(n, bool)
        for i in range(k):
            part = sym[i:] if i else sym
            h[: n - i] = h[: n - i] * np.uint32(0x01000193) ^ part
            some[: n - i] |= part != 0
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
        bucket = ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32)
        bucket[~some] = BUCKETS
        for i in range(1, k):  # those that would reach into the next row
            at = bounds[1:] - i
            bucket[at[at >= 0]] = BUCKETS
        out.append(bucket)
    letters = np.zeros(n + 1, np.int64)
    np.cumsum(sym != 0, out=letters[1:])
    return out, bounds, letters[bounds[1:]] > letters[bounds[:-1]]


def pieces(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about STEP characters together."""
    row = 0
    while row < len(bounds) - 1:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + STEP, "right")) - 1)
        yield row, stop
        row = stop


def count(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n) and, as bucket -1, the number of rows, over all rows with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in (p for batch in batches for p in parts(batch, 0)):
            langs = np.array(b.column(1).to_pylist(), object)
            for name in dict.fromkeys(langs):
                rows = b.column(0).filter(pa.array(langs == name))
                counts = total.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                buckets, _, _ = grams(rows)
                for x in buckets:
                    counts[:BUCKETS] += np.bincount(x, minlength=BUCKETS + 1)[:BUCKETS]
                counts[BUCKETS] += len(rows)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            ids = np.where(at == BUCKETS, -1, at).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(ids), pa.array(counts[at])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Part:
    """Some of the languages: for each bucket and language the log-probability (the row behind the last bucket is zero), and the priors."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def sums(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each row with each language, and whether the row has letters."""
        buckets, bounds, letters = grams(column)
        sums = np.tile(self.prior, (len(column), 1))
        for row, stop in pieces(bounds):
            a, z = bounds[row], bounds[stop]
            starts = bounds[row:stop] - a
            full = bounds[row:stop] < bounds[row + 1 : stop + 1]
            if full.any():
                for x in buckets:
                    sums[row:stop][full] += np.add.reduceat(self.weights.take(x[a:z], axis=0), starts[full], axis=0)
        return sums, letters


class Model:
    """The counts of all languages (lang, bucket, n), read part by part."""

    def __init__(self, counts: DataFrame, langs: list[str], seen: np.ndarray, most: int = MAX_LANGS):
        self.counts, self.langs, self.most = counts, langs, most
        self.prior = np.log(seen / seen.sum()) if len(seen) else np.zeros(0)

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MAX_LANGS) -> Model:
        """From all rows of docs."""
        counts = cut(count(docs, text, lang))
        rows = sorted((r["lang"], r["n"]) for r in counts.where("bucket = -1").collect())  # a row for each language
        return cls(counts, [r[0] for r in rows], np.array([r[1] for r in rows], np.float64), most)

    def parts(self) -> Iterator[Part]:
        for at in range(0, len(self.langs), self.most):
            langs = self.langs[at : at + self.most]
            rows = self.counts.where(F.col("lang").between(langs[0], langs[-1]) & (F.col("bucket") >= 0)).toArrow()
            counts = np.zeros((BUCKETS + 1, len(langs)))
            counts[rows["bucket"].to_numpy(), np.searchsorted(langs, np.array(rows["lang"].to_pylist(), object)).astype(int)] = rows["n"].to_numpy()
            weights = np.log(counts + ALPHA) - np.log(counts[:BUCKETS].sum(0) + ALPHA * BUCKETS)
            weights[BUCKETS] = 0
            yield Part(langs, weights, self.prior[at : at + self.most])


_OWN = ("__lf_lang", "__lf_best", "__lf_all")


def scored(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """docs with the best language ('und' without letters or learned languages), its log-probability and the logarithm of the sum over all languages. Ties: the first language by name."""
    out = docs.withColumns({_OWN[0]: F.lit("und"), _OWN[1]: F.lit(float("-inf")), _OWN[2]: F.lit(float("-inf"))})
    at = docs.columns.index(text)
    for part in model.parts():
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in (p for batch in batches for p in parts(batch, at)):
                sums, letters = shared.value.sums(b.column(at).cast(pa.string()))
                best, place = sums.max(1), sums.argmax(1)
                total = best + np.log(np.exp(sums - best[:, None]).sum(1))
                names, before, rest = b.column(b.num_columns - 3).to_pylist(), *(b.column(b.num_columns - k).to_numpy() for k in (2, 1))
                better = letters & (best > before)
                names = [shared.value.langs[i] if new else old for i, new, old in zip(place.tolist(), better.tolist(), names, strict=True)]
                own = [pa.array(names, pa.string()), pa.array(np.maximum(best, before)), pa.array(np.logaddexp(total, rest))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], *own], schema=b.schema)

        out = out.mapInArrow(run, out.schema)
    return out


def _posterior():
    return F.when(F.col(_OWN[0]) == "und", F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.exp(F.col(_OWN[1]) - F.col(_OWN[2]))))


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for each row; 'und' with score 0 for null texts and texts without a letter. Ties: the first language by name."""
    found = scored(docs.select(F.col(key), F.col(text).cast("string")), model, text)
    return found.select(F.col(key), F.col(_OWN[0]).alias("lang_pred"), _posterior().alias("score"))


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is found with a posterior of least at least.

    Null texts and texts without a letter go; repeated rows stay repeated; an empty table stays empty.
    """
    return scored(docs, model, text).where((F.col(_OWN[0]) != "und") & (_posterior() >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
