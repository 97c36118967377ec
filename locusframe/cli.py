"""Command line: index, write, view, concat, split."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.contigs import natural_order, resolve
from .operators import cohort, intervals
from .sources import files
from .sources.convert import convert
from .sources.store import Store, concat, fresh, publish, split, write

#: One past the last position that a region may have.
LAST = (1 << 31) - 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        c.add_argument("--overwrite", action="store_true")
        return c

    def subset(c: argparse.ArgumentParser) -> None:
        r, s = c.add_mutually_exclusive_group(), c.add_mutually_exclusive_group()
        r.add_argument("--regions", nargs="+")
        r.add_argument("--regions-file")
        s.add_argument("--samples", nargs="+")
        s.add_argument("--samples-file")
        c.add_argument("--mode", choices=["pos", "record", "variant"], default="pos")
        c.add_argument("--merge-overlapping", action="store_true")

    command("index", "vcf", "out")
    w = command("write", "source", "out")
    w.add_argument("--dosage")
    w.add_argument("--haploid", action="store_true")
    w.add_argument("--raw", action="store_true", help="records as they are, with the first ALT's calls")
    w.add_argument("--reference")
    w.add_argument("--same-names", action="store_true", help="a name in several files is a sample in each")
    w.add_argument("--alt-policy", choices=["skip", "error"], default="skip")
    w.add_argument("--ref-policy", choices=["e", "x", "none"], default="e")
    w.add_argument("--route", choices=["auto", "dense", "var_key"], default="auto")
    subset(w)
    subset(command("view", "store", "out"))
    c = command("concat", "out")
    c.add_argument("stores", nargs="+")
    s = command("split", "store", "out")
    s.add_argument("--contigs", nargs="+", required=True)
    return p


def _regions(spark: SparkSession, args, contigs: list[str]) -> DataFrame | None:
    if args.regions_file:
        found = files.bed(spark, args.regions_file)
    elif args.regions:
        found = files.regions(spark, args.regions)
    else:
        return None
    names = {r["chrom"]: resolve(r["chrom"], contigs) for r in found.select("chrom").distinct().collect()}
    if lost := sorted(a for a, b in names.items() if not b):
        raise ValueError(f"no such contigs: {lost}")
    known = spark.createDataFrame([(a, b) for a, b in names.items() if b], "chrom string, name string")
    found = found.join(F.broadcast(known), "chrom").drop("chrom").withColumnRenamed("name", "chrom")
    merged = intervals.check_regions(found, args.merge_overlapping)
    return merged.withColumn("q", F.monotonically_increasing_id())


def _samples(args, all_: list[str]) -> list[str]:
    names = args.samples or ([x.strip() for x in open(args.samples_file) if x.strip()] if args.samples_file else all_)
    unknown = [n for n in names if n not in all_]
    if unknown:
        raise ValueError(f"unknown samples: {unknown}")
    return list(dict.fromkeys(names))


def _cut(variants: DataFrame, calls: DataFrame, regions: DataFrame | None, args, names: list[str], all_: list[str]) -> tuple[DataFrame, DataFrame]:
    """Variants and calls of the regions and samples: variants that nobody carries go, the others and the samples are renumbered."""
    order = calls.sparkSession.createDataFrame([(all_.index(n), i) for i, n in enumerate(names)], "sample_id long, new_id long")
    kept = cohort.slice_store(variants, calls, regions, args.mode) if regions is not None else calls
    kept = kept.join(F.broadcast(order), "sample_id").drop("sample_id").withColumnRenamed("new_id", "sample_id")
    new = cohort.compact(variants, kept).select("v_idx", "new_idx")
    move = lambda df: df.join(new, "v_idx").drop("v_idx").withColumnRenamed("new_idx", "v_idx")
    return move(variants), move(kept)


def _read(spark: SparkSession, args) -> tuple[DataFrame, DataFrame, list[str]]:
    """Variants, calls and sample names of a VCF, a .pgen with its .pvar and .psam, or a folder or manifest of VCFs of other samples each."""
    if args.source.endswith(".pgen"):
        base = args.source.removesuffix(".pgen")
        names = [r["name"] for r in files.psam(spark, f"{base}.psam").orderBy("sample_ord").collect()]
        records = files.pvar(spark, f"{base}.pvar").withColumnRenamed("v_idx", "rec")
        genotypes = files.pgen(spark, args.source, len(names), carried=True).withColumnsRenamed({"v_idx": "rec", "sample_ord": "sample_id"}).withColumn("dosage", F.lit(None).cast("float"))
        rank = natural_order(F.col("chrom"))
    else:
        vcf = files.vcf(spark, args.source, args.same_names)
        if args.raw:
            return vcf.variants(), vcf.calls(dosage=args.dosage), vcf.samples
        names, records, rank = vcf.samples, vcf.records(), vcf.contig_rank()
        genotypes = vcf.genotypes(args.dosage, carried=True).select("rec", F.col("sample_ord").cast("long").alias("sample_id"), "hap", "allele", "dosage")
    reference = files.fasta(spark, args.reference) if args.reference else None
    variants, calls = convert(records, genotypes, rank, len(names), 1 if args.haploid else 2, reference, alt_policy=args.alt_policy, ref_policy=None if args.ref_policy == "none" else args.ref_policy, policy=args.route)
    return variants, calls, names


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("locusframe").getOrCreate()
    if args.command == "index":
        if args.overwrite or not fresh(spark, args.out, args.vcf):
            publish(files.Vcf(spark, args.vcf).variants(), args.out, True)
    elif args.command == "write":
        variants, calls, all_ = _read(spark, args)
        calls = calls if args.dosage else calls.drop("dosage")
        if args.haploid:
            calls = calls.select("sample_id", F.lit(0).alias("hap"), "v_idx", "chrom", "pos").distinct()
        names = _samples(args, all_)
        present = [r["chrom"] for r in variants.select("chrom").distinct().collect()]
        regions = _regions(spark, args, present)
        if regions is not None or names != all_:
            variants, calls = _cut(variants, calls, regions, args, names, all_)
        write(args.out, variants, calls, names, 1 if args.haploid else 2, args.overwrite)
    elif args.command == "view":
        if not any((args.regions, args.regions_file, args.samples, args.samples_file)):
            raise SystemExit("view needs regions or samples")
        store = Store(spark, args.store)
        names = _samples(args, store.samples)
        variants, calls = _cut(store.variants, store.calls, _regions(spark, args, store.contigs), args, names, store.samples)
        write(args.out, variants, calls, names, store.ploidy, args.overwrite)
    elif args.command == "concat":
        stores = [Store(spark, s) for s in args.stores]
        if len({(tuple(s.samples), s.ploidy, tuple(sorted(s.meta["fields"].items()))) for s in stores}) != 1:
            raise ValueError("the stores' samples, ploidy or fields differ")
        shift, variants, calls = 0, [], []
        for s in stores:  # one number each
            variants.append(s.variants.withColumn("v_idx", F.col("v_idx") + shift))
            calls.append(s.calls.withColumn("v_idx", F.col("v_idx") + shift))
            shift += s.n_variants()
        write(args.out, concat(variants), concat(calls), stores[0].samples, stores[0].ploidy, args.overwrite)
    elif args.command == "split":
        store = Store(spark, args.store)
        write(args.out, split(store.variants, args.contigs), split(store.calls, args.contigs), store.samples, store.ploidy, args.overwrite)


if __name__ == "__main__":
    main()
