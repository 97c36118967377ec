"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector, if the vocabulary has it, plus those of its known character n-grams (with a
mark at the word's start), so that unseen forms of a known stem still count. Windows of WINDOW words,
each overlapping the next, cover the whole text; a document scores as its worst window. The
network learns from windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, mix64, span_hashes, words_of

WINDOW, STRIDE = 32, 24
#: Labelled documents of each class to learn from (those with the smallest hashes of the id).
SAMPLE = 1200
VOCAB, GRAMS = 8_000, 9_000
TELLING = 5.0
DIM, HIDDEN, ATTEND = 8, 8, 8
SIZES = (3, 4, 5)
EPOCHS, BATCH, RATE = 10, 64, 0.01
#: Words of a batch, and windows that move in step (their states stay in the processor's cache).
CHUNK_WORDS = 400_000
STEP = 1024
_U = np.uint64

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Texts:
    """Words of a batch of texts: hash and row of each, and the distinct words with their n-grams' hashes."""

    def __init__(self, column: pa.Array):
        data, offsets = flat_text(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
        self.starts, self.ends, rows = words_of(data, offsets, IS_WORD)
        self.words = span_hashes(data, self.starts, self.ends)
        self.first = np.searchsorted(rows, np.arange(len(offsets)))
        self.data = data
        self.distinct, at, self.index = np.unique(self.words, return_index=True, return_inverse=True)
        self.a, self.z = self.starts[at], self.ends[at]

    def grams(self, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct words' byte n-grams, those at the start marked, and the distinct word of each."""
        out, of = [], []
        for size in sizes:
            n = np.maximum(0, self.z - self.a - size + 1)
            word = np.repeat(np.arange(len(n)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = self.a[word] + place
            h = span_hashes(self.data, begin, begin + size)
            out.append(np.where(place == 0, mix64(h + _U(1)), h) if size < max(SIZES) else h)
            of.append(word)
        return np.concatenate(out), np.concatenate(of)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and length of each window, and its row; a text without words has one window of length 0."""
        n = np.diff(self.first)
        count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.first[row] + k * STRIDE, np.minimum(WINDOW, n[row] - k * STRIDE), row


class Lookup:
    """Numbers of known hashes; len(known) for all others."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> _U(44)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), len(self.known))
        near = np.flatnonzero(self.maybe[(hashes >> _U(44)).astype(np.int64)])
        if len(self.known) and len(near):
            at = np.minimum(np.searchsorted(self.known, hashes[near]), len(self.known) - 1)
            ok = self.known[at] == hashes[near]
            out[near[ok]] = at[ok]
        return out


class Network:
    """The parameters, and the forward and backward passes."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.words, self.grams = Lookup(words), Lookup(grams)
        r = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"E": np.zeros((len(words) + len(grams) + 2, DIM), np.float32), "v": r(ATTEND), "A": r(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "o": r(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        self.p["E"][:] = rng.normal(0, 0.05, self.p["E"].shape)
        for d in "fb":
            self.p |= {f"W{d}": r(DIM, 3 * HIDDEN), f"U{d}": r(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def members(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Rows of E that add up to each distinct word's input: (distinct word, row)."""
        h, of = t.grams()
        g = self.grams(h)
        known = g < len(self.grams.known)
        w = self.words(t.distinct)
        seen = np.flatnonzero(w < len(self.words.known))
        return np.concatenate([seen, of[known]]), np.concatenate([w[seen], g[known] + len(self.words.known)])

    def inputs(self, count: int, members: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Input vector of each distinct word, and behind them that of the padding (zero)."""
        out = np.zeros((count + 1, DIM), np.float32)
        for d in range(DIM):
            out[:count, d] = np.bincount(members[0], self.p["E"][members[1], d], count)[:count]
        return out

    def gru(self, x: np.ndarray, ids: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, HIDDEN, window) for ids (window, time), in text order for both directions."""
        w, u, c = self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"c{d}"]
        half = np.ones(3 * HIDDEN, x.dtype)
        half[: 2 * HIDDEN] = 0.5  # a sigmoid is a tanh of half the argument
        table, ut = (x @ w + c) * half, np.ascontiguousarray((u * half).T)
        n, steps = ids.shape
        h = np.zeros((HIDDEN, n), x.dtype)
        out, kept = np.empty((steps, HIDDEN, n), x.dtype), []
        places = np.ascontiguousarray(ids.T)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = table.take(places[t], axis=0).T
            s = ut @ h
            zr = s[: 2 * HIDDEN] + g[: 2 * HIDDEN]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            m = r * s[2 * HIDDEN :]
            m += g[2 * HIDDEN :]
            np.tanh(m, out=m)
            if keep:
                kept.append((t, h, z, r, m, s[2 * HIDDEN :]))
            h = np.add(h, z * (m - h), out=out[t])
        return out, kept

    def forward(self, x: np.ndarray, ids: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logit of each window."""
        f, kf = self.gru(x, ids, "f", keep)
        b, kb = self.gru(x, ids, "b", keep)
        at, av = self.p["A"].T, self.p["v"]
        u = np.tanh(at[:, :HIDDEN] @ f + at[:, HIDDEN:] @ b + self.p["a"][:, None])
        s = np.where(np.arange(ids.shape[1])[:, None] < length, av @ u, -1e9)
        e = np.exp(s - s.max(0)) * (length > 0)
        w = (e / np.maximum(e.sum(0), 1e-9)).astype(x.dtype)
        pooled = np.concatenate([np.einsum("tn,tkn->kn", w, f), np.einsum("tn,tkn->kn", w, b)])
        logit = self.p["o"] @ pooled + self.p["b"][0]
        return logit, (f, b, u, w, pooled, kf, kb) if keep else None

    def backward(self, x: np.ndarray, ids: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters but E, and of x."""
        f, b, u, w, pooled, kf, kb = kept
        p, n = self.p, HIDDEN
        h = np.concatenate([f, b], axis=1)
        g = {"o": pooled @ dlogit, "b": np.array([dlogit.sum()], x.dtype)}
        dpool = p["o"][:, None] * dlogit
        dw = np.einsum("tkn,kn->tn", h, dpool)
        dh = w[:, None, :] * dpool
        ds = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tkn,tn->k", u, ds)
        du = ds[:, None, :] * p["v"][:, None] * (1 - u * u)
        g["A"] = np.einsum("thn,tkn->hk", h, du)
        g["a"] = du.sum((0, 2))
        dh = dh + p["A"] @ du
        dx = np.zeros_like(x)
        for d, steps, part in (("f", kf, dh[:, :n]), ("b", kb, dh[:, n:])):
            wx, uu = p[f"W{d}"], p[f"U{d}"]
            gu = np.zeros_like(uu)
            flow, times = [], []
            back = np.zeros((n, ids.shape[0]), x.dtype)
            for t, h0, z, r, m, sm in reversed(steps):
                dn = back + part[t]
                dz = dn * (m - h0) * z * (1 - z)
                dm = dn * z * (1 - m * m)
                dr = dm * sm * r * (1 - r)
                ds3 = np.concatenate([dz, dr, dm * r])
                gu += h0 @ ds3.T
                back = dn * (1 - z) + uu @ ds3
                flow.append(np.concatenate([dz, dr, dm]))
                times.append(t)
            where, flows = ids.T[times].ravel(), np.concatenate(flow, axis=1)
            dtable = np.stack([np.bincount(where, flows[k], len(x)) for k in range(3 * n)], axis=1).astype(x.dtype)
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = gu, x.T @ dtable, dtable.sum(0)
            dx += dtable @ wx.T
        return g, dx

    def score(self, column: pa.Array) -> np.ndarray:
        """Highest window probability of each text; 0 for one without words."""
        t = Texts(column)
        x = self.inputs(len(t.distinct), self.members(t))
        start, length, row = t.windows()
        index = np.append(t.index, len(t.distinct))
        best = np.zeros(len(column))
        for at in range(0, len(start), STEP):
            s, n = start[at : at + STEP], length[at : at + STEP]
            ids = window_ids(index, s, n)
            np.maximum.at(best, row[at : at + STEP], sigmoid(self.forward(x, ids, n)[0].astype(np.float64)) * (n > 0))
        return best


def window_ids(index: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Distinct words of each window, the padding behind its end; index: that of each word, then the padding."""
    place = start[:, None] + np.arange(WINDOW)
    return index[np.where(np.arange(WINDOW) < length[:, None], place, len(index) - 1)]


def log_odds(items: np.ndarray, rows: np.ndarray, toxic: np.ndarray, most: int, least: int = 8) -> dict[int, float]:
    """The most telling items and their log-odds, by the documents that have them; only those whose share of toxic documents is TELLING deviations from chance."""
    names, index = np.unique(items, return_inverse=True)
    pairs = np.unique(index.astype(np.int64) * len(toxic) + rows)
    item, hit = pairs // len(toxic), toxic[pairs % len(toxic)]
    one, zero = np.bincount(item[hit], minlength=len(names)), np.bincount(item[~hit], minlength=len(names))
    raw = np.log((one + 0.5) / (toxic.sum() + 1)) - np.log((zero + 0.5) / ((~toxic).sum() + 1))
    share = toxic.mean()
    away = np.abs(one - share * (one + zero)) / np.sqrt(np.maximum(1, one + zero) * share * (1 - share) + 1e-9)
    sure = np.where((away >= TELLING) & (one + zero >= least), np.abs(raw), 0)
    order = np.lexsort((names, -sure * np.sqrt(one + zero)))[:most]
    return {int(names[i]): float(np.sign(raw[i]) * sure[i]) for i in order if sure[i] > 0}


def one_of_each(texts: list[str], hashes: int = 4) -> list[int]:
    """One text of each group of copies, which would pass off their own words as telling: texts that share one of a few smallest shingle hashes."""
    t = Texts(pa.array(texts, pa.string()))
    triple = mix64(mix64(t.words[:-2]) + t.words[1:-1] * _U(3) + t.words[2:] * _U(5)) if len(t.words) > 2 else t.words[:0]
    seen: set[int] = set()
    out = []
    for row in range(len(texts)):
        own = triple[t.first[row] : max(t.first[row], t.first[row + 1] - 2)]
        marks = {int(mix64(own + _U(k)).min()) for k in range(1, hashes + 1)} if len(own) else set()
        if not marks & seen:
            out.append(row)
        seen |= marks
    return out


def train(texts: list[str], toxic: np.ndarray, seed: int = 0) -> Network:
    """Fit on the windows of labelled texts: of toxic ones those with the most telling words, of clean ones those and others at random."""
    rng = np.random.default_rng(seed)
    single = one_of_each(texts)
    t = Texts(pa.array([*(texts[i] for i in single), ""], pa.string()))
    toxic = np.append(np.asarray(toxic, bool)[single], False)
    rows = np.repeat(np.arange(len(toxic)), np.diff(t.first))
    words = log_odds(t.words, rows, toxic, VOCAB)
    met = np.unique(t.index.astype(np.int64) * len(toxic) + rows)  # distinct words of each document, to count n-grams by document
    word, doc = (met // len(toxic)).astype(np.int32), (met % len(toxic)).astype(np.int32)
    begin = np.searchsorted(word, np.arange(len(t.distinct) + 1)).astype(np.int32)
    grams: dict[int, float] = {}
    for size in SIZES:  # one after the other, for memory
        h, of = t.grams((size,))
        held = np.isin(h, _frequent(h))
        h, of = h[held], of[held].astype(np.int32)
        n = np.diff(begin)[of]
        docs = doc[np.repeat(begin[of] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        grams |= log_odds(np.repeat(h, n), docs, toxic, GRAMS // len(SIZES))
        del h, of, docs
    net = Network(np.array(list(words), _U), np.array(list(grams), _U), seed)
    nw = len(net.words.known)
    for known, odds, base in ((net.words.known, words, 0), (net.grams.known, grams, nw)):
        net.p["E"][base : base + len(known), 0] = [np.clip(odds[int(k)], -4, 8) / 8 for k in known]
    members = net.members(t)
    start, length, row = t.windows()
    telling = net.inputs(len(t.distinct), members)[:, 0]
    ids = window_ids(np.append(t.index, len(t.distinct)), start, length)
    strength = np.sort(telling[ids], axis=1)[:, -4:].sum(1)
    order = np.lexsort((-strength, row))
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    top = order[rank < np.where(toxic[row[order]], 1, 2)]
    free = rng.permutation(np.flatnonzero(~toxic[row]))[: 2 * len(toxic)]
    chosen = np.unique(np.concatenate([top, free]))
    y = toxic[row[chosen]].astype(np.float32)
    ids, length = ids[chosen], length[chosen]
    weight = np.where(y > 0, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, (1 - y).sum())).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    sort = np.argsort(members[0], kind="stable")
    m_word, m_row = members[0][sort], members[1][sort]
    step = 0
    for _ in range(EPOCHS):
        for pick in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            step += 1
            used, local = np.unique(ids[pick], return_inverse=True)
            local = local.reshape(len(pick), WINDOW)
            real = used[used < len(t.distinct)]
            lo, hi = np.searchsorted(m_word, real), np.searchsorted(m_word, real, "right")
            at = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            mine = (np.repeat(np.arange(len(real)), hi - lo), m_row[at])
            x = net.inputs(len(real), mine)[: len(used)] if len(real) < len(used) else net.inputs(len(real), mine)[:-1]
            logit, kept = net.forward(x, local, length[pick], keep=True)
            d = ((sigmoid(logit) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g, dx = net.backward(x, local, kept, d)
            g["E"] = np.stack([np.bincount(mine[1], dx[mine[0], k], len(net.p["E"])) for k in range(DIM)], axis=1).astype(np.float32)
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return net


def _frequent(h: np.ndarray, least: int = 2) -> np.ndarray:
    values, n = np.unique(h, return_counts=True)
    return values[n >= least]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Network:
    """Learn from at most sample documents of each class among the labelled rows, their whole texts.

    Labels other than 0 and 1 and rows without an id are left out, and repeated label rows count once. Of documents that share
    text one is learned from; one labelled both ways counts as clean if it has three words, else once each way. Null texts are empty.
    """
    rows = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    picked = None
    for y in (0, 1):  # two bounded sets of ids
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.union(part)
    found = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(picked), "id").select("id", "y", "t").toArrow()
    rows = sorted(zip(found["id"].to_pylist(), found["t"].to_pylist(), found["y"].to_pylist(), strict=True))
    del found
    return train([t for _, t, _ in rows], np.array([y == 1 for *_, y in rows], bool))


def score(docs: DataFrame, net: Network, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) for every row's whole text; a null text or one without words scores 0. Rows may repeat and ids be null: every row gives a row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 6 * CHUNK_WORDS)))
                part = b.slice(at, stop - at)
                got = shared.value.score(part.column(1)).round(6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])
                at = stop

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
