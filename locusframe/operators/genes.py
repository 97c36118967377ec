"""Annotation with gene models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import closed_join


def codon_position(pos: str, start: str, frame: str, strand: str, ilen: str) -> Column:
    """0 to 2 within the codon, on + from the start and on - twice that, modulo 3 from below; null without a frame and for indels."""
    off = f"({pos} - {start} - {frame})"
    return F.expr(f"CASE WHEN {frame} BETWEEN 0 AND 2 AND {ilen} = 0 THEN pmod(IF({strand} = '-', 2, 1) * {off}, 3) END")


def ranks() -> list[Column]:
    """Sort keys, best first: protein coding, canonical, support level, length, name."""
    return [
        F.when(F.col("gene_biotype") == "protein_coding", 0).otherwise(1),
        F.when(F.coalesce(F.col("tag"), F.lit("")).rlike("^(canonical|appris_principal)"), 0).otherwise(1),
        F.coalesce(F.expr("try_cast(nullif(regexp_extract(tsl, '([0-9]+)', 1), '') AS INT)"), F.lit(9999)),
        -(F.col("c_end") - F.col("c_start")),
        F.col("transcript_id"),
    ]


def annotate(variants: DataFrame, cds: DataFrame, level: int | None = None) -> DataFrame:
    """(v_idx, gene_id, strand, codon_pos) for every variant: the best coding interval over it, nulls where there is none; one sort key a variant, no window."""
    if level is not None:
        cds = cds.where(F.col("level") <= level)
    met = closed_join(variants, cds)
    best = met.groupBy("v_idx").agg(F.min_by(F.struct("gene_id", "strand", codon_position("pos", "c_start", "frame", "strand", "ilen").cast("int").alias("codon_pos")), F.struct(*ranks())).alias("b"))
    return variants.select("v_idx").join(best, "v_idx", "left").select("v_idx", "b.gene_id", "b.strand", "b.codon_pos")


def strand_number(strand: str) -> Column:
    return F.expr(f"CASE {strand} WHEN '+' THEN 0 WHEN '-' THEN 1 END")
