"""Normalisation of records to biallelic atoms, keys, and storage routes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases that an indel may move to the left.
MOST_SHIFT = 1000


def split_alleles(records: DataFrame) -> DataFrame:
    """One row for each ALT, with its number from 1 as source_alt."""
    return records.select("*", F.posexplode("alt").alias("__i", "alt_i")).withColumn("source_alt", F.col("__i") + 1).drop("__i", "alt").withColumnRenamed("alt_i", "alt")


def out_of_scope(alt: Column) -> Column:
    """skip for * and ., unsupported for symbolic alleles and breakends, else null."""
    from ..functions.predicates import BREAKEND

    return F.when(alt.isin("*", "."), "skip").when(F.startswith(alt, F.lit("<")) | alt.rlike(BREAKEND), "unsupported")


def check_reference(records: DataFrame, sequence: Column, policy: str) -> DataFrame:
    """Compare ref (any case) with the reference's bases there: policy e raises on the first difference, x drops the record."""
    ok = F.upper("ref") == F.upper(sequence)
    if policy == "x":
        return records.where(F.coalesce(ok, F.lit(False)))
    return records.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("REF differs from the reference at "), F.col("pos").cast("string")))))


def atoms(records: DataFrame) -> DataFrame:
    """Biallelic (pos 1-based, ref, alt, source_alt) as atoms (atom_pos 0-based, atom_ilen, atom_alt).

    The alleles' common suffix goes, one base staying; each differing aligned base is a SNV; the rest is one
    indel anchored at the last aligned base. A deletion whose anchor differs is a SNV and a clean deletion; an
    insertion whose anchor differs stays one insertion with the new anchor. All in SQL expressions.
    """
    suffix = "aggregate(sequence(1, least(length(ref), length(alt)) - 1), 0, (n, i) -> IF(n = i - 1 AND substring(ref, -i, 1) = substring(alt, -i, 1), i, n))"
    r = records.withColumn("__n", F.expr(f"IF(least(length(ref), length(alt)) > 1, {suffix}, 0)"))
    r = r.withColumns({"__r": F.expr("substring(ref, 1, length(ref) - __n)"), "__a": F.expr("substring(alt, 1, length(alt) - __n)")}).withColumn("__k", F.expr("least(length(__r), length(__a))"))
    atom = "named_struct('atom_pos', CAST({p} AS BIGINT), 'atom_ilen', {l}, 'atom_alt', {s})"
    snv = atom.format(p="pos - 1 + i - 1", l="0", s="substring(__a, i, 1)")
    last = "IF(length(__a) > length(__r), __k - 1, __k)"  # an insertion keeps its anchor, whatever it is
    snvs = f"transform(filter(IF({last} >= 1, sequence(1, {last}), CAST(array() AS array<int>)), i -> substring(__r, i, 1) <> substring(__a, i, 1)), i -> {snv})"
    indel = "CASE WHEN length(__r) = length(__a) THEN array() WHEN length(__a) > length(__r) THEN array({i}) ELSE array({d}) END".format(
        i=atom.format(p="pos - 1 + __k - 1", l="length(__a) - length(__r)", s="substring(__a, __k, length(__a))"),
        d=atom.format(p="pos - 1 + __k - 1", l="length(__a) - length(__r)", s="substring(__r, __k, 1)"),
    )
    return r.withColumn("__atom", F.explode(F.expr(f"concat({snvs}, {indel})"))).select(*[c for c in records.columns], "__atom.*")


def with_sequence(records: DataFrame, reference: DataFrame, size: int) -> DataFrame:
    """records (chrom, pos 1-based, ref) with __seen: the reference's bases (chrom, chunk, seq of size bases) under ref, shorter at a contig's end.

    A REF meets the chunks that it covers (one, as a rule) by an equi-join.
    """
    at = F.col("pos") - 1
    r = records.withColumn("__row", F.monotonically_increasing_id())
    met = r.withColumn("chunk", F.explode(F.sequence(F.floor(at / size), F.floor((at + F.length("ref") - 1) / size)))).join(reference.select("chrom", "chunk", "seq"), ["chrom", "chunk"], "left")
    lo = F.greatest(at - F.col("chunk") * size, F.lit(0)).cast("int")
    part = F.substring(F.coalesce("seq", F.lit("")), lo + 1, F.least(F.length("ref").cast("long"), at + F.length("ref") - F.greatest(at, F.col("chunk") * size)).cast("int"))
    keep = [F.first(c).alias(c) for c in records.columns]
    joined = met.withColumn("__part", F.struct("chunk", part.alias("s"))).groupBy("__row").agg(*keep, F.array_join(F.transform(F.array_sort(F.collect_list("__part")), lambda x: x["s"]), "").alias("__seen"))
    return joined.drop("__row")


def left_align(atoms_: DataFrame, reference: DataFrame, size: int | None = None) -> DataFrame:
    """Move indels (chrom, atom_pos, atom_ilen, atom_alt) as far left as the reference (chrom, chunk, seq of size bases) lets them, at most MOST_SHIFT.

    SNVs pass by. Each indel meets the chunks that hold the MOST_SHIFT bases to its left and what it deletes, by an
    equi-join, and takes these bases along; the rotation runs on Arrow batches.
    """
    size = size or reference.agg(F.max(F.length("seq"))).first()[0] or 1
    keep = list(atoms_.columns)
    indels = atoms_.where("atom_ilen <> 0").withColumn("__row", F.monotonically_increasing_id())
    lo, hi = F.greatest(F.col("atom_pos") - MOST_SHIFT - 1, F.lit(0)), F.col("atom_pos") + F.greatest(-F.col("atom_ilen"), F.lit(0)) + 1
    spread = indels.withColumns({"__lo": lo, "__hi": hi}).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__lo") / size), F.floor(F.col("__hi") / size))))
    met = spread.join(reference.select("chrom", "chunk", "seq"), ["chrom", "chunk"], "left")
    begin = F.greatest(F.col("__lo") - F.col("chunk") * size, F.lit(0)).cast("int")
    part = F.substring(F.coalesce("seq", F.lit("")), begin + 1, (F.least(F.col("__hi") + 1, (F.col("chunk") + 1) * size) - F.col("chunk") * size - begin).cast("int"))
    near = met.withColumn("__part", F.struct("chunk", part.alias("s"))).groupBy("__row").agg(*[F.first(c).alias(c) for c in keep], F.first("__lo").alias("__lo"), F.array_join(F.transform(F.array_sort(F.collect_list("__part")), lambda x: x["s"]), "").alias("__seq"))
    windowed = near.withColumn("__at", F.col("atom_pos") - F.col("__lo")).select(*keep, "__seq", "__at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in atoms_.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            moved = [aligned(s, a, n, x) for s, a, n, x in zip(b["__seq"], b["__at"], b["atom_ilen"], b["atom_alt"], strict=True)]
            b["atom_pos"] += [m[0] for m in moved]
            b["atom_alt"] = [m[1] for m in moved]
            yield b[keep]

    return atoms_.where("atom_ilen = 0").union(windowed.mapInPandas(run, schema))


def aligned(seq: str | None, at: int, ilen: int, alt: str) -> tuple[int, str]:
    """(shift, allele) of an indel anchored at seq[at]: the anchor is the base before it."""
    if seq is None or ilen == 0 or at < 0 or at >= len(seq):
        return 0, alt
    shift = 0
    if ilen < 0:
        n = -ilen
        while at + shift >= 1 and -shift < MOST_SHIFT and at + shift + n < len(seq) and seq[at + shift] == seq[at + shift + n]:
            shift -= 1
        return shift, seq[at + shift] if shift else alt
    if alt[0] != seq[at]:
        return 0, alt
    body = alt[1:]
    while at + shift >= 1 and -shift < MOST_SHIFT and seq[at + shift] == body[-1]:
        body = body[-1] + body[:-1]
        shift -= 1
    return shift, seq[at + shift] + body


def base_code(base: str) -> str:
    """SQL: the two-bit code of a base, A 0, C 1, T 2, G 3."""
    return f"((ascii({base}) >> 1) & 3)"


def encode_key(ilen: str = "ilen", alt: str = "alt") -> Column:
    """The 32-bit key: a pure deletion as its length shifted by one; an insertion or SNV of up to 13 bases inline, its bases from bit 25 down; null for longer ones, which go to a table."""
    code = base_code(f"substring({alt}, i, 1)")
    bases = f"aggregate(sequence(1, length({alt})), 0, (k, i) -> k | shiftleft({code}, 27 - 2 * i))"
    return F.expr(f"CASE WHEN {ilen} < 0 THEN shiftleft({ilen}, 1) WHEN length({alt}) <= 13 THEN shiftleft({ilen}, 27) | {bases} END")


def decode_key(key: str = "key", anchor: str = "''") -> tuple[Column, Column]:
    """(ilen, alt) of an inline key; a deletion's allele is its anchor, which the key doesn't hold."""
    ilen = f"IF({key} & 1 = 0 AND {key} < 0, shiftright({key}, 1), shiftright({key}, 27))"
    bases = f"array_join(transform(sequence(1, greatest({ilen}, 0) + 1), i -> substring('ACTG', (shiftright({key}, 27 - 2 * i) & 3) + 1, 1)), '')"
    return F.expr(ilen).cast("int"), F.expr(f"IF({ilen} < 0, {anchor}, {bases})")


def long_alleles(variants: DataFrame) -> DataFrame:
    """(row, alt): the distinct alleles without an inline key, numbered by themselves; found again by joining on alt."""
    from .indexing import row_index

    some = variants.where(encode_key().isNull()).select("alt").distinct()
    return row_index(some, [F.substring("alt", 1, 8)], ["alt"], "row").select("row", "alt")


def vcf_form(variants: DataFrame, reference: DataFrame, size: int) -> DataFrame:
    """variants (chrom, pos, ilen, alt) with ref, and alt as a VCF spells it: a deletion's REF is its anchor and the deleted bases."""
    spelled = variants.withColumn("ref", F.repeat(F.lit("N"), F.greatest(-F.col("ilen"), F.lit(0)) + 1))
    seen = with_sequence(spelled, reference, size).withColumn("ref", F.col("__seen")).drop("__seen")
    return seen.withColumn("alt", F.when(F.col("ilen") < 0, F.substring("ref", 1, 1)).otherwise(F.col("alt")))


#: Bits of the cost model: key and sidecar of a SNP and of an indel. Fixed values of the format.
KEY_BITS = {"snp": 2, "indel": 32}
SIDECAR_BITS = {"snp": 10, "indel": 8}


def route(x: str, is_indel: str, samples: int, ploidy: int, info_bits: int = 0, format_bits: int = 0, sidecar: bool = False) -> Column:
    """dense where a bit for every haplotype is strictly cheaper than a key for each of x carriers, else var_key; with a sidecar if mutation codes are stored too."""
    kb = f"IF({is_indel}, {KEY_BITS['indel']}, {KEY_BITS['snp']})"
    side = f"IF({is_indel}, {SIDECAR_BITS['indel']}, {SIDECAR_BITS['snp']})" if sidecar else "0"
    sparse = f"CAST({x} AS BIGINT) * (32 + {kb} + {side} + {info_bits} + {format_bits})"
    packed = f"(32 + {kb} + {samples * ploidy} + {side} + {info_bits} + {format_bits * samples})"
    return F.expr(f"IF({packed} < {sparse}, 'dense', 'var_key')")


def scalar_field(values: str, source_alt: str, default: str = "NULL") -> Column:
    """A field's value for one ALT: the only one of a list of one, else that of the ALT; default where there is none."""
    return F.expr(f"coalesce(CASE WHEN size({values}) = 1 THEN {values}[0] ELSE try_element_at({values}, {source_alt}) END, {default})")


def field_range(table: DataFrame, field: str, *by: str) -> DataFrame:
    """(by, lo, hi, missing): a numeric field's least and largest value, and whether it is missing anywhere."""
    return table.groupBy(*by).agg(F.min(field).alias("lo"), F.max(field).alias("hi"), F.max(F.col(field).isNull()).alias("missing"))


def narrow_type(low: str, high: str, missing: str) -> Column:
    """The narrowest integer type that holds low to high, unsigned first, one value kept back where some are missing."""
    more = f"IF({missing}, 1, 0)"
    arms = [f"WHEN {low} IS NULL THEN 'u8'"]
    arms += [f"WHEN {low} >= 0 AND {high} + {more} <= {(1 << b) - 1} THEN 'u{b}'" for b in (8, 16, 32)]
    arms += [f"WHEN {low} - {more} >= {-(1 << b - 1)} AND {high} <= {(1 << b - 1) - 1} THEN 'i{b}'" for b in (8, 16, 32)]
    return F.expr(f"CASE {' '.join(arms)} ELSE 'i64' END")
