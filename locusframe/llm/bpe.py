"""BPE encoding and decoding with tree concatenation.

A byte-pair encoding is right when every pair of neighbouring tokens is what the two tokens' joint text
encodes to. Hence a text that no white space or pre-tokenizer splits can be halved anywhere: encode both
halves on their own, then, around the join, encode a window of the last i tokens of the left half and the
first j of the right one. If the window's first token is the left half's token at that place and its last one
is the right half's, all pairs across the window's edges are known to be right and the join is exact;
else the window grows (i and j double). Leaves do not depend on each other, nor do the joins of one level.

Texts are split at white space in whole batches, and each distinct word of a batch is encoded once: its pieces of up to
LEAF_CHARS characters by the library's model, longer ones by the tree. Words stay in a cache of bounded size.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, parts, sha256_hex, words_of

#: Bytes of words and their codes kept per Python worker, the longest word that is kept, and the longest piece that is encoded without halving it.
CACHE_BYTES = 64 << 20
CACHE_CHARS = 256
LEAF_CHARS = 16
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 0x0A, 0x09, 0x0D]] = False


#: The splits of the files' pre-tokenizer, and words that Unicode normalisation leaves as they are.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LETTERS = re.compile("[A-Za-z]+")
PLAIN = regex.compile("[!-~\u00a1-\u00ac\u00ae-\u00ff]*")


class Merges:
    """Greedy merging by rank over symbols, and the tree of halves for long ones."""

    def __init__(self, model: dict, leaf: int = LEAF_CHARS):
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {v: k for k, v in self.vocab.items()}
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.leaf = max(2, leaf)

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the lowest-ranked merge, leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if best[0] == 1 << 60:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def join(self, left: list[str], right: list[str], units: dict[str, list[str]]) -> list[str]:
        """Tokens of the joint text of two encoded texts, by growing windows around the join."""
        if not left or not right:
            return left + right
        width = 1
        while True:
            i, j = min(width, len(left)), min(width, len(right))
            window = self.merge([u for t in left[-i:] + right[:j] for u in self.split(t, units)])
            left_agrees = i == len(left) or (len(window) > 1 and window[0] == left[-i])
            right_agrees = j == len(right) or (len(window) > 1 and window[-1] == right[j - 1])
            if left_agrees and right_agrees:
                return left[: len(left) - i] + window + right[j:]
            width *= 2

    def split(self, token: str, units: dict[str, list[str]]) -> list[str]:
        """The symbols that a token was merged from."""
        if token not in units:
            body, end = (token[:-4], "</w>") if token.endswith("</w>") and len(token) > 4 else (token, "")
            units[token] = [*body[:-1], body[-1] + end] if body else [token]
        return units[token]

    def tree(self, symbols: list[str], units: dict[str, list[str]] | None = None) -> list[str]:
        """Tokens of any number of symbols: leaves on their own, then one level of joins after the other."""
        units = {} if units is None else units
        parts = [self.merge(symbols[a : a + self.leaf]) for a in range(0, len(symbols), self.leaf)]
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1], units) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []


class Encoder:
    """Ids and decoded text of whole texts, as the library gives them without special tokens added.

    For files whose pre-tokenizer drops white space (so a text's ids are those of its words one after
    another) and that name no decoder (so decoding joins the tokens' strings with blanks).
    """

    def __init__(self, path: str, leaf: int = LEAF_CHARS, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if spec.get("decoder") or model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("a BPE file with word ends and without a decoder is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != SPLIT.pattern:
            raise ValueError("this file splits text in another way")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.names = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.merges = Merges(model, leaf)
        self.tokenize = self.library.model.tokenize
        self.names |= self.merges.names
        self.leaf, self.cache_bytes = leaf, cache_bytes
        self.alphabet = byte_alphabet()
        self.new: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.held = 0
        self.trees = 0

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer, in its byte alphabet: by the library's model, or by the tree for a long one."""
        if len(piece) > self.leaf:
            self.trees += 1
            vocab = self.merges.vocab
            return [vocab[t] for t in self.merges.tree([*piece[:-1], piece[-1] + "</w>"]) if t in vocab]  # no unknown token in these files: others vanish
        return [t.id for t in self.tokenize(piece)]

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids, as little-endian 32-bit integers, and names of a run without white space."""
        if self.special.search(word):
            ids = self.library.encode(word, add_special_tokens=False).ids
        elif LETTERS.fullmatch(word):  # one piece, the commonest case
            ids = self.piece(word.lower())
        else:
            if PLAIN.fullmatch(word):  # composed already, lower case letter by letter, and the same splits in any Unicode version
                pieces = [p if p.isascii() else p.encode().decode("latin-1").translate(self.alphabet) for p in SPLIT.findall(word.lower())]
            else:
                pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]
            ids = [i for p in pieces for i in self.piece(p)]
        names = self.names
        return pack_ids(ids), " ".join([names[i] for i in ids])

    def known(self, word: str) -> tuple[bytes, str]:
        """word(), from the cache if it is there."""
        got = self.new.get(word)
        if got is None:
            got = self.old.get(word) or self.word(word)
            if len(word) <= CACHE_CHARS:
                self.new[word] = got
                self.held += 300 + 2 * len(word) + len(got[0]) + 2 * len(got[1])
                if 2 * self.held > self.cache_bytes:  # two generations: what was not met again goes
                    self.old, self.new, self.held = self.new, {}, 0
        return got

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch of texts: all ids, where each text's begin (and the last one's end), the bytes of all decoded texts, and where each one begins and, a blank before the next, ends."""
        data, offsets = flat_text(column)
        starts, ends, rows = words_of(data, offsets, IN_WORD)
        first = np.searchsorted(rows, np.arange(len(column) + 1))
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[IN_WORD[data]].tobytes())).dictionary_encode()
        got = [self.known(w) for w in words.dictionary.to_pylist()]
        index = words.indices.to_numpy(zero_copy_only=False)
        ids, at = gather(np.frombuffer(b"".join([x[0] for x in got]), "<u4"), np.array([len(x[0]) // 4 for x in got], np.int64), index)
        names = [x[1].encode() + b" " if x[1] else b"" for x in got]
        text, to = gather(np.frombuffer(b"".join(names), np.uint8), np.array([len(x) for x in names], np.int64), index)
        return ids, at[first], text, to[first]


def pack_ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def gather(values: np.ndarray, length: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values (each of a length, one after the other) that index names, and where each of them begins (and the last one ends)."""
    start, n = np.cumsum(length) - length, length[index]
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return values[np.repeat(start[index] - at[:-1], n) + np.arange(at[-1])], at


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins that byte-level BPE files use for the 256 bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, leaf: int = LEAF_CHARS, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """One per worker process and file."""
    key = (path, leaf, cache_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, leaf, cache_bytes)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_tokens: bool = True, leaf: int = LEAF_CHARS) -> DataFrame:
    """Encode and decode each row's whole text: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    path: a tokenizers file, at the same place on every executor. Null texts count as empty (no ids, empty
    decoded text). Keys may be null or repeat; every row gives a row. No row leaves its task.
    """
    more = ", ids array<int>, decoded string" if with_tokens else ""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for part in (p for b in batches for p in parts(b, 1)):
            ids, at, decoded, to = enc.encode(part.column(1))
            rows = range(part.num_rows)
            code = [ids[at[r] : at[r + 1]] for r in rows]
            plain = [decoded[to[r] : max(to[r], to[r + 1] - 1)].tobytes() for r in rows]
            out = [part.column(0), pa.array(np.diff(at)), pa.array([sha256_hex(c.tobytes()) for c in code], pa.string()), pa.array([sha256_hex(d) for d in plain], pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_tokens:
                out += [pa.array([c.astype(np.int32) for c in code], pa.list_(pa.int32())), pa.array([d.decode() for d in plain], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
