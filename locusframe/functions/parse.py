"""Driver-side parsers: sizes, regions, field names, narrow types."""

from __future__ import annotations

import re

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12}


def memory(text: str | int) -> int:
    """Bytes of '4g' (binary) or '4gb' (decimal)."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*([0-9.]+)\s*([a-zA-Z]*)\s*", text)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * _UNITS[m[2].lower()])


def memory_text(size: int) -> str:
    for unit, n in (("T", 40), ("G", 30), ("M", 20), ("K", 10)):
        if size >= 1 << n:
            return f"{size / (1 << n):.2f} {unit}iB"
    return f"{size} B"


def region(text: str) -> tuple[str, int, int]:
    """'chr1:101-200' (1-based, inclusive) as ('chr1', 100, 200)."""
    m = re.fullmatch(r"([^:]+):([\d,]+)-([\d,]+)", text)
    if not m:
        raise ValueError(f"not a region: {text!r}")
    start, end = int(m[2].replace(",", "")) - 1, int(m[3].replace(",", ""))
    if start < 0 or end <= start:
        raise ValueError(f"an empty or negative region: {text!r}")
    return m[1], start, end


def fields(names: list[str]) -> list[tuple[str, str]]:
    """('INFO' or 'FORMAT', name) of specs such as INFO/DP or FMT/DS; the first of equal ones stays."""
    out: list[tuple[str, str]] = []
    for n in names:
        kind, _, name = n.partition("/")
        kind = {"INFO": "INFO", "FORMAT": "FORMAT", "FMT": "FORMAT"}.get(kind, "")
        if not kind or not name:
            raise ValueError(f"a field is INFO/x or FORMAT/x: {n!r}")
        if (kind, name) not in out:
            out.append((kind, name))
    return out


def chunk_size(samples: int, ploidy: int, fields_: int, budget: int) -> int:
    """Variants of a chunk that fit the budget: genotype bits and four bytes for each field and sample."""
    return max(1, min(25_000, budget // max(1, samples * ploidy // 8 + fields_ * samples * 4)))


def file_kind(path: str) -> str:
    """vcf, bcf, pgen, store or parquet by name."""
    for kind, ends in {"vcf": (".vcf", ".vcf.gz", ".vcf.bgz"), "bcf": (".bcf",), "pgen": (".pgen", ".pvar", ".pvar.zst", ".psam"), "store": (".store",), "parquet": (".parquet",)}.items():
        if path.lower().endswith(ends):
            return kind
    raise ValueError(f"an unknown kind of file: {path}")
