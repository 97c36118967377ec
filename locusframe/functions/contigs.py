"""Contig names: aliases and natural order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the mitochondrial contig that mean the same. Fixed values.
MITO = ("M", "MT", "chrM", "chrMT")


def canonical(name: Column) -> Column:
    """One spelling for all aliases: without a chr prefix, mitochondrion as MT."""
    return F.when(name.isin(*MITO), F.lit("MT")).otherwise(F.regexp_replace(name, "^chr", ""))


def resolve(name: str, present: list[str]) -> str | None:
    """The spelling among present that name stands for: itself, with or without chr, or any mitochondrial one."""
    if name in MITO:
        return name if name in present else next((p for p in present if p in MITO), None)
    other = name[3:] if name.startswith("chr") else f"chr{name}"
    return name if name in present else other if other in present else None


def natural_key(name: str) -> tuple:
    """Sort key under which chr2 stands before chr10."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", name) if p)


def natural_order(name: Column) -> Column:
    """A sortable text: digit runs padded to the same width."""
    return F.regexp_replace(F.regexp_replace(name, r"(\d+)", "000000000$1"), r"0*(\d{9})(?!\d)", "$1")
