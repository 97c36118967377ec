"""Variant predicates and lengths as Column builders over ref STRING, alt ARRAY<STRING>, ilen ARRAY<INT>, info STRING."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Breakend notation: a bracket, or a base with a leading or trailing dot. Fixed by the file format.
BREAKEND = r"[\[\]]|^\.[A-Za-z]|[A-Za-z]\.$"


def is_snp(ilen: str = "ilen") -> Column:
    return F.forall(ilen, lambda x: x.isNotNull() & (x == 0))


def is_indel(ilen: str = "ilen") -> Column:
    return F.forall(ilen, lambda x: x.isNotNull() & (x != 0))


def is_biallelic(alt: str = "alt") -> Column:
    return F.size(alt) == 1


def is_symbolic(alt: str = "alt") -> Column:
    return F.exists(alt, lambda a: F.startswith(a, F.lit("<")))


def is_breakend(alt: str = "alt") -> Column:
    return F.exists(alt, lambda a: a.rlike(BREAKEND))


def is_imprecise(ilen: str = "ilen") -> Column:
    return F.exists(ilen, lambda x: x.isNull())


def literal_ilen(ref: str = "ref", alt: str = "alt") -> Column:
    return F.transform(alt, lambda a: F.octet_length(a) - F.octet_length(F.col(ref)))


def info_int(info: str, name: str) -> Column:
    """The integer of a NAME=value entry of an INFO text, else null."""
    sign = "-?" if name == "SVLEN" else ""
    return F.expr(rf"try_cast(nullif(regexp_extract({info}, '(?:^|;){name}=({sign}\\d+)', 1), '') AS INT)")


def info_flag(info: str, name: str) -> Column:
    return F.coalesce(F.col(info).rlike(f"(?:^|;){name}(?:;|$)"), F.lit(False))


def symbolic_ilen(ref: str = "ref", alt: str = "alt", info: str = "info", pos: str = "pos") -> Column:
    """Length change of each ALT: literal alleles by length, symbolic ones by SVLEN or END; null for breakends and whatever is imprecise or of another type."""
    magnitude = F.coalesce(F.abs(info_int(info, "SVLEN")), F.abs(info_int(info, "END") - F.col(pos))).cast("int")

    def one(a: Column) -> Column:
        kind = F.regexp_extract(a, "^<([^:>]*)", 1)
        sized = F.when(kind == "DEL", -magnitude).when(kind.isin("INS", "DUP"), magnitude)
        return (
            F.when(a.rlike(BREAKEND), F.lit(None).cast("int"))
            .when(F.startswith(a, F.lit("<")), F.when(~info_flag(info, "IMPRECISE"), sized))
            .otherwise(F.octet_length(a) - F.octet_length(F.col(ref)))
        )

    return F.transform(alt, one)


def extent(pos: Column, ilen: Column) -> tuple[Column, Column]:
    """0-based half-open extent; an unknown length is a point."""
    return pos - 1, pos - F.least(ilen, F.lit(0))
