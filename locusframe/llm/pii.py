"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what repeats them.

The patterns give the base spans. The field's nodes are the tokens of a text that hold a digit or an at sign;
its labels are none and the four kinds. Node potentials weigh the token's shape, chain edges join
neighbours, and skip edges join distant tokens that are equal or alike (same letters and digits, or one
held by an observed other). Loopy sum-product passes messages over all edges; tokens under a base span are
observed. A token that comes out as a kind, and touches no base span, is an added span. All potentials
are learned together, by penalised pseudo-likelihood (each token's label given its shape and the labels of its neighbours on
all edges), from the base spans of a bounded sample of rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sha256_hex

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Rows with an at sign or six digits in a row that the weights are learned from: those with the smallest hashes.
SAMPLE_ROWS = 2000
#: Messages that change less than this have converged; a text's rounds are bounded by its nodes, since a message moves one edge a round.
SETTLED, ROUNDS_A_NODE = 1e-4, 4
#: Characters of a key from which a part of an observed token counts as a repeat of it.
HELD = 8

#: The patterns, written so that a run of any length is read a bounded number of times: runs are taken whole (++),
#: and an address or number starts where its run does.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All matches of the four patterns that hold, by start, then kind. A match that fails is dropped, and the search goes on behind it."""
    out: list[Span] = []
    at, low = text.find("@"), 0
    while at >= 0:  # the local part begins where its run of characters does, behind the last at sign and address
        begin = low + len(text[low:at].rstrip(LOCAL))
        low = at + 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, 0, m.end()))
            low = m.end()
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def spans_text(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{z}" for a, k, z in spans])


class Nodes:
    """A text's tokens: bounds, shapes, keys, and the label of the base span that each touches (0: none)."""

    def __init__(self, text: str, spans: list[Span]):
        bounds: list[tuple[int, int, int]] = []
        behind = 0
        free: list[tuple[int, int]] = []
        for a, _, z in spans:
            if a >= behind:
                free.append((behind, a))
            behind = max(behind, z)
        free.append((behind, len(text)))
        for a, z in free:  # outside the base spans
            for m in TOKEN.finditer(text[a:z]):
                got = m.group()
                lead = len(got) - len(got.lstrip("\"'([{<*#$%&!?.,;:="))
                tail = len(got.rstrip("\"')]}>*#$%&!?.,;:="))
                if lead < tail:
                    bounds.append((a + m.start() + lead, a + m.start() + tail, 0))
        bounds += [(a, z, k + 1) for a, k, z in spans]
        bounds.sort()
        self.bounds = bounds
        self.texts = [text[a:z] for a, z, _ in bounds]
        self.labels = np.array([k for _, _, k in bounds], np.int64)
        self.keys = [re.sub(r"[\W_]+", "", t.lower()) for t in self.texts]
        self.digits = [NOT_DIGIT.sub("", t) for t in self.texts]

    def shapes(self) -> np.ndarray:
        """A row of 0 and 1 for each token."""
        out = np.zeros((len(self.texts), SHAPES), np.float64)
        for row, (t, d) in enumerate(zip(self.texts, self.digits, strict=True)):
            n = len(d)
            letters = any(c.isalpha() for c in t)
            out[row, [0, 1 + sum(n > x for x in (0, 3, 6, 9, 12, 13, 19))]] = 1
            out[row, 9:] = ["@" in t, "@" in t and "." in t.rpartition("@")[2], t.count(".") == 3 and not letters, t.startswith("+"), letters, not letters and 13 < n < 20 and luhn(d), "(" in t or "-" in t]
        return out

    def names(self, i: int) -> set[str]:
        """What a token is repeated by: its key, and its digits if they are many."""
        return {x for x in ({self.keys[i], self.digits[i]} if len(self.digits[i]) >= 7 else {self.keys[i]}) if len(x) >= 6}

    def repeats(self) -> list[tuple[int, int]]:
        """Each token of some length to the one before with its key or its digits."""
        edges: set[tuple[int, int]] = set()
        last: dict[str, int] = {}
        for i in range(len(self.keys)):
            for name in self.names(i):
                if name in last:
                    edges.add((last[name], i))
                last[name] = i
        return sorted(edges)

    def held(self) -> list[tuple[int, int]]:
        """Each other token of at least HELD characters to the first observed one whose key holds its key."""
        whole = [i for i in range(len(self.keys)) if self.labels[i] and len(self.keys[i]) >= HELD]
        starts = np.cumsum([0, *(len(self.keys[i]) + 1 for i in whole)])
        joined = "\n".join([self.keys[i] for i in whole])  # keys have no white space
        grams: dict[str, int] = {}
        for k in range(len(joined) - HELD, -1, -1):
            grams[joined[k : k + HELD]] = k  # where it is met first
        found: dict[str, int] = {}
        edges: list[tuple[int, int]] = []
        for i, key in enumerate(self.keys):
            if not self.labels[i] and key[:HELD] in grams and key[-HELD:] in grams:
                if key not in found:
                    at = joined.find(key, grams[key[:HELD]])
                    found[key] = whole[int(np.searchsorted(starts, at, "right")) - 1] if at >= 0 else -1
                if found[key] >= 0:
                    edges.append((min(found[key], i), max(found[key], i)))
        return edges

    def skips(self) -> list[tuple[int, int]]:
        """repeats(), held(), and each other token with the key or digits of an observed one to it (the nearest before, else the first): few edges, however often a token repeats."""
        edges = {*self.repeats(), *self.held()}
        first: dict[str, int] = {}
        for i in np.flatnonzero(self.labels).tolist():
            for name in self.names(i):
                first.setdefault(name, i)
        seen: dict[str, int] = {}
        for i in range(len(self.keys)):
            for name in self.names(i):
                if self.labels[i]:
                    seen[name] = i
                elif name in first:
                    hub = seen.get(name, first[name])
                    edges.add((min(hub, i), max(hub, i)))
        return sorted(edges)


#: Features of a token; neighbours on skip edges with one label that count, when learning; strength of the penalty, and the
#: prior mean of the weight by which the ends of a skip edge share a label.
SHAPES, SKIPS, PENALTY, PRIOR = 16, 3, 2e-3, 8.0


def statistics(texts: list[str]) -> Counter:
    """What the field learns from whole texts: how often each (label, label before, label behind, skip neighbours by label, shape) is met; 5: no neighbour.

    There are few distinct ones, whatever the texts' number and length. A token without a label that repeats an
    observed one teaches nothing: it may be what the patterns missed. Tokens on skip edges count a second time without
    their shape, since what the field is to find are repeats whose shape the patterns don't know.
    """
    out: Counter = Counter()
    for t in texts:
        n = Nodes(t, base_spans(t))
        if n.texts:
            labels = [5, *n.labels.tolist(), 5]
            near = np.zeros((len(n.texts), 5), np.int64)
            for i, j in {*n.repeats(), *n.held()}:
                near[i, n.labels[j]] += 1
                near[j, n.labels[i]] += 1
            shapes = n.shapes().astype(int).tolist()
            for i, by in enumerate(np.minimum(near, SKIPS).tolist()):
                y = labels[i + 1]
                if y or not any(by[1:]):
                    out[(y, labels[i], labels[i + 2], *by, *shapes[i])] += 1
                    if any(by):
                        out[(y, labels[i], labels[i + 2], *by, *[0] * SHAPES)] += 1
    return out


class Field:
    """Potentials of the skip-chain field: of a token's shape and label, of neighbours' labels, and of the labels at a skip edge's ends."""

    def __init__(self, nodes: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.nodes, self.chain, self.skip = nodes, chain, skip

    @classmethod
    def fit(cls, texts: list[str]) -> Field:
        return cls.learned(statistics(texts))

    @classmethod
    def learned(cls, counts: Counter, rounds: int = 400) -> Field:
        """All potentials at the largest penalised pseudo-likelihood of counts (statistics()), by gradient ascent."""
        keys = sorted(counts)
        each = np.array([counts[k] for k in keys], np.float64)
        t = np.array(keys, np.int64).reshape(-1, 8 + SHAPES)
        y, before, behind, by, x = np.eye(5)[t[:, 0]], np.eye(6)[t[:, 1]][:, :5], np.eye(6)[t[:, 2]][:, :5], t[:, 3:8].astype(np.float64), t[:, 8:].astype(np.float64)
        each /= max(1.0, each.sum())
        # every label weighs as much as the square root of its share: kinds are rare beside other tokens
        share = each @ y if len(keys) else np.ones(5)
        each = each / np.sqrt(np.maximum(y @ share, 1e-12)) if len(keys) else each
        each /= max(each.sum(), 1e-12)
        w, chain, skip = np.zeros((SHAPES, 5)), np.zeros((5, 5)), np.full(5, PRIOR)
        for _ in range(rounds):
            s = x @ w + before @ chain + behind @ chain.T + by * skip
            p = np.exp(s - s.max(1, keepdims=True, initial=-1e9))
            gap = each[:, None] * (y - p / p.sum(1, keepdims=True))
            w += x.T @ gap - PENALTY * w
            chain += 0.5 * (before.T @ gap + gap.T @ behind) - PENALTY * chain
            skip += (by * gap).sum(0) - PENALTY * (skip - PRIOR)
        return cls(w, chain, np.diag(np.maximum(skip, 0)))

    def marginals(self, n: Nodes) -> np.ndarray:
        """Loopy sum-product over chain and skip edges; tokens with a base label are observed."""
        unary = n.shapes() @ self.nodes
        seen = n.labels > 0
        unary[seen] = np.where(np.arange(5) == n.labels[seen, None], 0.0, -1e9)  # more than all its repeats can send
        count = len(unary)
        skips = n.skips()
        a = np.array([*range(count - 1), *(i for i, _ in skips)], np.int64)
        z = np.array([*range(1, count), *(j for _, j in skips)], np.int64)
        pots = np.concatenate([np.tile(np.exp(self.chain), (max(count - 1, 0), 1, 1)), np.tile(np.exp(self.skip), (len(skips), 1, 1))])
        there, back = np.zeros((len(a), 5)), np.zeros((len(a), 5))
        for _ in range(ROUNDS_A_NODE * count + 50):
            belief = unary.copy()
            np.add.at(belief, z, there)
            np.add.at(belief, a, back)
            new_there = self.send(belief[a] - back, pots)
            new_back = self.send(belief[z] - there, pots.transpose(0, 2, 1))
            gap = max(np.abs(new_there - there).max(initial=0), np.abs(new_back - back).max(initial=0))
            there, back = 0.5 * there + 0.5 * new_there, 0.5 * back + 0.5 * new_back
            if gap < SETTLED:
                break
        belief = unary.copy()
        np.add.at(belief, z, there)
        np.add.at(belief, a, back)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    @staticmethod
    def send(log_belief: np.ndarray, pots: np.ndarray) -> np.ndarray:
        p = np.exp(log_belief - log_belief.max(1, keepdims=True, initial=-1e9))
        m = np.log(np.einsum("ei,eij->ej", p, pots) + 1e-30)
        return m - m.max(1, keepdims=True, initial=-1e9)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the field finds besides the base ones."""
        if not base and "@" not in text and not DIGIT.search(text):
            return []
        n = Nodes(text, base)
        if not n.texts or n.labels.all():
            return []
        best = self.marginals(n)
        label = best.argmax(1)
        return [(a, int(k) - 1, z) for (a, z, seen), k, p in zip(n.bounds, label, best.max(1), strict=True) if k and not seen and p > 0.5]


def fit(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> Field:
    """Learn from at most rows texts of docs with an at sign or a number, those whose hash is smallest; whole texts, counted on the executors."""
    some = docs.select(F.col(text).cast("string").alias("t")).where(F.col("t").rlike("[0-9]{6}|@|[0-9][.][0-9]")).withColumn("h", F.xxhash64("t"))
    least = [r["h"] for r in some.select("h").orderBy("h").limit(rows).collect()]
    chosen = some.where(F.col("h") <= (least[-1] if least else 0)).groupBy("h").agg(F.min("t").alias("t")).select("t")  # the hashes first, so that no task shuffles texts that others beat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            found += statistics(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(k) for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["k", "c"])

    counted = chosen.mapInArrow(run, "k string, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    return Field.learned(Counter({tuple(json.loads(r["k"])): r["c"] for r in counted}))


def _each(df: DataFrame, schema, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                yield f(b.slice(at, 1000))

    return df.mapInArrow(run, schema)


def detect(docs: DataFrame, field: Field, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, base_spans for each row's whole text.

    Counts and digest are those of the base spans; spans also has what the field adds. Offsets count code
    points, ends are exclusive. A null text is empty: no spans, the digest of the empty string.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[int, list[int]] = defaultdict(list)
        digests, alls, bases = [], [], []
        for t in b.column(1).to_pylist():
            base = base_spans(t) if t else []
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in base))
            bases.append(spans_text(base))
            digests.append(sha256_hex(bases[-1].encode()))
            alls.append(spans_text(sorted(base + shared.value.added(t, base))) if t else "")
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(alls, pa.string()), pa.array(bases, pa.string())], names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "base_spans"])

    return _each(docs.select(F.col(key), F.col(text).cast("string")), f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, base_spans string", f)


def masked(text: str, spans: list[Span]) -> str:
    """The text with [EMAIL] and the like in place of its spans; spans that overlap become one, named after the first."""
    out, behind = [], 0
    for a, k, z in spans:
        if a >= behind:
            out += [text[behind:a], f"[{KINDS[k].upper()}]"]
        behind = max(behind, z)
    return "".join([*out, text[behind:]])


def redact(docs: DataFrame, field: Field, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with all spans masked in the text, and the length column, if there is one, set to match; all rows and columns stay."""
    at = docs.columns.index(text)
    size = docs.columns.index(length) if length in docs.columns else None
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(at).to_pylist()
        done = []
        for t in texts:
            base = base_spans(t) if t else []
            spans = sorted(base + shared.value.added(t, base)) if t else []
            done.append(masked(t, spans) if spans else t)
        columns = list(b.columns)
        columns[at] = pa.array(done, b.column(at).type)
        if size is not None:
            old = b.column(size).to_pylist()
            columns[size] = pa.array([len(d) if d is not None and d != t else n for t, d, n in zip(texts, done, old, strict=True)], b.column(size).type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return _each(docs, docs.schema, f)
