"""The Parquet store: variants and calls by contig, with a metadata file beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contigs import natural_key, resolve

VERSION = 1


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def write(path: str, variants: DataFrame, calls: DataFrame, samples: list[str], ploidy: int = 2, overwrite: bool = False) -> None:
    """Write a store to a sibling folder and rename it into place; an existing one is an error unless overwrite is set."""
    spark = variants.sparkSession
    target, fs, hadoop = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    temp = f"{path.rstrip('/')}__writing"
    fs.delete(hadoop.Path(temp), True)
    variants.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "v_idx").write.partitionBy("chrom").parquet(f"{temp}/variants")
    calls.repartitionByRange("chrom", "sample_id", "hap").sortWithinPartitions("chrom", "sample_id", "hap", "v_idx").write.partitionBy("chrom").parquet(f"{temp}/calls")
    meta = {"version": VERSION, "samples": samples, "ploidy": ploidy, "contigs": sorted((r["chrom"] for r in variants.select("chrom").distinct().collect()), key=natural_key), "fields": {f.name: f.dataType.simpleString() for f in calls.schema if f.name not in ("sample_id", "hap", "v_idx", "chrom", "pos")}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{temp}/meta")
    _swap(fs, hadoop, temp, target, f"{path.rstrip('/')}__old")


def _swap(fs, hadoop, temp: str, target, old: str) -> None:
    """Put temp in target's place. What was there is kept aside until the new one stands, and put back if that fails."""
    backup = hadoop.Path(old)
    if fs.exists(target):
        fs.delete(backup, True)  # left by a run that ended behind its swap, since the target is there
        if not fs.rename(target, backup):
            raise OSError(f"can't move {target} aside")
    elif fs.exists(backup) and not fs.rename(backup, target):  # a run ended between the two renames
        raise OSError(f"can't restore {target}")
    elif fs.exists(target):
        return _swap(fs, hadoop, temp, target, old)
    if not fs.rename(hadoop.Path(temp), target):
        if fs.exists(backup):
            fs.rename(backup, target)
        raise OSError(f"can't move {temp} into place")
    fs.delete(backup, True)


def publish(df: DataFrame, path: str, overwrite: bool = False, by: str = "chrom") -> None:
    """Write a table beside path and rename it into place."""
    spark = df.sparkSession
    target, fs, hadoop = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    temp = f"{path.rstrip('/')}__writing"
    fs.delete(hadoop.Path(temp), True)
    df.write.partitionBy(by).parquet(temp)
    _swap(fs, hadoop, temp, target, f"{path.rstrip('/')}__old")


def fresh(spark: SparkSession, made: str, source: str) -> bool:
    """Whether made is there and no older than its source."""
    a, fs, _ = _fs(spark, made)
    b, other, _ = _fs(spark, source)
    return fs.exists(a) and fs.getFileStatus(a).getModificationTime() >= other.getFileStatus(b).getModificationTime()


def annotate(spark: SparkSession, path: str, columns: DataFrame) -> None:
    """Write columns (v_idx, ...) back to the store's variants, replacing those of the same names; variants without a row get nulls."""
    target, fs, hadoop = _fs(spark, f"{path.rstrip('/')}/variants")
    old = spark.read.parquet(str(target))
    new = old.drop(*[c for c in columns.columns if c != "v_idx"]).join(columns, "v_idx", "left")
    temp = f"{path.rstrip('/')}/variants__writing"
    fs.delete(hadoop.Path(temp), True)
    new.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "v_idx").write.partitionBy("chrom").parquet(temp)
    _swap(fs, hadoop, temp, target, f"{path.rstrip('/')}/variants__old")


def beside(stores: list[tuple[DataFrame, DataFrame, int]]) -> tuple[DataFrame, DataFrame]:
    """Stores (variants, calls, samples) of the same variants and other samples as one; variants that differ in number, position or allele are an error.

    The first store's variants stay; each next one's samples are numbered behind those before.
    """
    variants, calls, shift = stores[0]
    for v, c, n in stores[1:]:
        a, b = (x.select("v_idx", "chrom", "pos", "ilen", "alt") for x in (variants, v))
        both = a.withColumn("side", F.lit(1)).union(b.withColumn("side", F.lit(-1))).groupBy("v_idx", "chrom", "pos", "ilen", "alt").agg(F.sum("side").alias("side"))
        if not both.where("side <> 0").isEmpty():
            raise ValueError("the stores' variants differ")
        calls = calls.unionByName(c.withColumn("sample_id", F.col("sample_id") + shift))
        shift += n
    return variants, calls


def check_samples(have: list[str], want: list[str]) -> None:
    """Samples must be the same in the same order; what differs first is told."""
    if len(have) != len(want) or (off := [i for i, (a, b) in enumerate(zip(have, want, strict=False)) if a != b]):
        at = off[0] if len(have) == len(want) else min(len(have), len(want))
        raise ValueError(f"samples differ from number {at} on: {have[at : at + 1]} and {want[at : at + 1]}")


class Store:
    """An open store: lazy variants and calls, projected to the fields asked for."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str] | None = None):
        self.meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        if self.meta["version"] != VERSION:
            raise ValueError(f"store version {self.meta['version']}, not {VERSION}")
        unknown = set(fields or ()) - set(self.meta["fields"])
        if unknown:
            raise ValueError(f"no such fields: {sorted(unknown)}")
        self.variants = spark.read.parquet(f"{path}/variants")
        calls = spark.read.parquet(f"{path}/calls")
        keep = self.meta["fields"] if fields is None else fields
        self.calls = calls.select("sample_id", "hap", "v_idx", "chrom", "pos", *keep)
        self.samples, self.contigs, self.ploidy = self.meta["samples"], self.meta["contigs"], self.meta["ploidy"]

    def n_variants(self) -> int:
        return self.variants.count()


def concat(stores: list[DataFrame]) -> DataFrame:
    """Tables of disjoint contigs as one; a contig in two of them is an error, and so are other columns."""
    names = {tuple(sorted(s.dtypes)) for s in stores}
    if len(names) != 1:
        raise ValueError("the tables' columns differ")
    seen = None
    for i, s in enumerate(stores):
        part = s.select("chrom").distinct().withColumn("i", F.lit(i))
        seen = part if seen is None else seen.union(part)
    twice = [r["chrom"] for r in seen.groupBy("chrom").count().where("count > 1").collect()]
    if twice:
        raise ValueError(f"contigs in more than one table: {sorted(twice)}")
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out


def split(table: DataFrame, contigs: list[str]) -> DataFrame:
    """The rows of the named contigs, in any of their spellings; an unknown one is an error."""
    present = [r["chrom"] for r in table.select("chrom").distinct().collect()]
    found = [resolve(c, present) for c in contigs]
    if None in found:
        raise ValueError(f"no such contigs: {[c for c, f in zip(contigs, found, strict=True) if f is None]}")
    return table.where(F.col("chrom").isin(found))
