"""Readers of variant, sample, region, gene, sequence and signature files as DataFrames.

Text formats go through Spark's text reader (which also opens gzip files), so that columns and rows are
pruned before anything is parsed twice; only headers come to the driver.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.contigs import natural_order
from ..functions.predicates import symbolic_ilen
from ..operators.indexing import row_index


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a text file, plain, gzip or zstandard."""
    if not path.endswith(".zst"):
        return spark.read.text(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import zstandard

        for b in batches:
            for content in b["content"]:
                reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)), encoding="utf-8")
                while part := reader.readlines(1 << 22):
                    yield pd.DataFrame({"value": [x.rstrip("\r\n") for x in part]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string")


def _columns(value: Column, names: list[str]) -> list[Column]:
    parts = F.split(value, "\t")
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def _dot(c: Column) -> Column:
    return F.when(c != ".", c)


class Vcf:
    """A text VCF: samples and declared fields from the header, records and genotypes as DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = lines(spark, path).withColumns({"rec": F.monotonically_increasing_id(), "first": F.lit(0)})  # which record a line is, which sample its first cell
        head = [r["value"] for r in self.rows.where("value LIKE '#%'").collect()]
        named = [h for h in head if h.startswith("#CHROM")]
        if not named:
            raise ValueError(f"no header line in {path}")
        self.samples = named[0].split("\t")[9:]
        self.width = len(self.samples)
        self.info = [h.split("ID=")[1].split(",")[0] for h in head if h.startswith("##INFO=")]
        self.format = [h.split("ID=")[1].split(",")[0] for h in head if h.startswith("##FORMAT=")]
        self.contigs = [h.split("ID=")[1].split(",")[0].rstrip(">") for h in head if h.startswith("##contig=")]

    def records(self, info: list[str] | None = None, condition: Column | None = None) -> DataFrame:
        """rec (its number in the file, with gaps), chrom, pos, id, ref, alt (list), qual, filter, info, ilen (list), and the asked-for INFO fields as text; condition filters them."""
        unknown = set(info or ()) - set(self.info)
        if unknown:
            raise ValueError(f"not declared as INFO: {sorted(unknown)}")
        r = self.rows.where("NOT startswith(value, '#')").select("rec", *_columns(F.col("value"), ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]))
        r = r.select("rec", "chrom", F.col("pos").try_cast("long").alias("pos"), _dot(F.col("id")).alias("id"), F.upper("ref").alias("ref"), F.split("alt", ",").alias("alt"), _dot(F.col("qual")).try_cast("double").alias("qual"), _dot(F.col("filter")).alias("filter"), "info")
        r = r.withColumn("ilen", symbolic_ilen())
        for name in info or []:
            r = r.withColumn(name, F.expr(f"nullif(regexp_extract(info, '(?:^|;){name}=([^;]*)', 1), '')"))
        return r if condition is None else r.where(condition)

    def contig_rank(self) -> Column:
        """Sort key of chrom: the header's order, and natural order behind it for contigs that the header doesn't declare."""
        declared = F.array(*[F.lit(c) for c in self.contigs]) if self.contigs else F.array().cast("array<string>")
        at = F.array_position(declared, F.col("chrom"))
        return F.concat(F.lpad(F.when(at > 0, at).otherwise(len(self.contigs) + 1).cast("string"), 9, "0"), natural_order(F.col("chrom")))

    def variants(self) -> DataFrame:
        """records numbered by contig (in the header's order) and position (v_idx), with their extents; the first ALT counts."""
        r = self.records()
        v = row_index(r.withColumn("__a", F.array_join("alt", ",")), [self.contig_rank(), F.floor(F.col("pos") / 65536)], ["pos", "ref", "__a", "rec"], "v_idx").drop("__a")
        first = F.get("ilen", F.lit(0))
        return v.withColumns({"v_start": F.col("pos") - 1, "v_end": F.col("pos") - F.least(first, F.lit(0))})

    def fetch(self, regions: DataFrame, info: list[str] | None = None) -> DataFrame:
        """The records whose first ALT's extent overlaps any of the regions (q, chrom, q_start, q_end), each once; contigs in either spelling."""
        from ..functions.contigs import canonical
        from ..operators.intervals import overlap_join

        r = self.records(info)
        extent = r.select("rec", canonical(F.col("chrom")).alias("chrom"), (F.col("pos") - 1).alias("v_start"), (F.col("pos") - F.least(F.coalesce(F.get("ilen", F.lit(0)), F.lit(0)), F.lit(0))).alias("v_end"))
        hit = overlap_join(extent, regions.select("q", canonical(F.col("chrom")).alias("chrom"), "q_start", "q_end")).select("rec").distinct()
        return r.join(hit, "rec", "left_semi")

    def genotypes(self, dosage: str | None = None, carried: bool = False) -> DataFrame:
        """rec, chrom, pos, ref, alt (text), sample_ord, sample, hap, allele (null if missing), phased, dosage. carried: only cells whose
        genotype names an ALT, chosen before cells become rows."""
        parts = F.split("value", "\t")
        body = self.rows.where("NOT startswith(value, '#')").select("rec", "first", *_columns(F.col("value"), ["chrom", "pos", "id", "ref", "alt"]), F.split(F.get(parts, F.lit(8)), ":").alias("keys"), F.slice(parts, 10, max(1, self.width)).alias("cells"))
        cells = F.transform("cells", lambda c, i: F.struct((F.col("first") + i).alias("sample_ord"), c.alias("cell")))
        if carried:  # genotypes come first in a cell, as the format asks
            cells = F.filter(cells, lambda c: (c["cell"] != "0|0") & ~c["cell"].startswith("0|0:") & c["cell"].rlike("^[^:]*[1-9]"))  # the commonest cell without a pattern
        one = body.select("rec", "chrom", F.col("pos").try_cast("long").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), "keys", F.explode(cells).alias("c")).select("*", "c.*").drop("c")
        field = lambda name: F.get(F.split("cell", ":"), F.array_position("keys", name).cast("int") - 1)
        gt = one.withColumn("gt", F.when(F.array_contains("keys", "GT"), field("GT")))
        ds = F.expr("try_cast(nullif(__ds, '.') AS FLOAT)")
        gt = gt.withColumn("__ds", F.when(F.array_contains("keys", dosage), field(dosage)) if dosage else F.lit(None).cast("string")).withColumn("dosage", ds)
        names = F.split(F.lit("\t".join(self.samples)), "\t")  # one literal, however many samples
        out = gt.select("rec", "chrom", "pos", "ref", "alt", "sample_ord", F.get(names, F.col("sample_ord")).alias("sample"), F.contains("gt", F.lit("|")).alias("phased"), "dosage", F.posexplode(F.split("gt", "[/|]")).alias("hap", "a"))
        return out.withColumn("allele", F.expr("try_cast(a AS INT)")).drop("a")

    def calls(self, allele: int = 1, dosage: str | None = None) -> DataFrame:
        """Carriers of the given ALT: sample_id (ordinal), hap, v_idx, chrom, pos, dosage. A call belongs to its own record, however many are equal."""
        g = self.genotypes(dosage, carried=allele > 0).where(F.col("allele") == allele).select("rec", F.col("sample_ord").cast("long").alias("sample_id"), "hap", "dosage")
        return g.join(self.variants().select("rec", "v_idx", "chrom", "pos"), "rec").select("sample_id", "hap", "v_idx", "chrom", "pos", "dosage")


class VcfList:
    """Text VCFs of other samples each as one cohort: the same interface as a Vcf, all files read in one scan.

    Samples stand in the order of the paths, then of their columns; a name that is given twice is an error unless same_names
    is set (each is a sample of its own then), and so is a file without samples. A file may be a folder of parts whose name ends as a VCF's. A record that several files have is several records here.
    """

    def __init__(self, spark: SparkSession, paths: list[str], same_names: bool = False):
        self.paths = paths
        plain = lambda path: F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), r"(\.vcf(\.gz)?)/[^/]*$", "$1")
        order = spark.createDataFrame(list(enumerate(paths)), "file int, path string").withColumn("path", plain(F.col("path")))
        read = spark.read.text(paths).select("value", plain(F.col("_metadata.file_path")).alias("path")).withColumn("rec", F.monotonically_increasing_id())
        rows = read.join(F.broadcast(order), "path")
        named = rows.where("startswith(value, '#CHROM')").select("file", F.expr("slice(split(value, '\t'), 10, greatest(1, size(split(value, '\t'))))").alias("names")).orderBy("file").collect()  # a row for each file
        if [r["file"] for r in named] != list(range(len(paths))) or any(not r["names"] for r in named):
            raise ValueError("each file needs a header line with its samples")
        self.samples = [n for r in named for n in r["names"]]
        if not same_names and len(set(self.samples)) < len(self.samples):
            raise ValueError("two files give the same sample")
        self.width = max(len(r["names"]) for r in named)
        first = np.cumsum([0, *(len(r["names"]) for r in named)]).tolist()
        self.rows = rows.join(F.broadcast(spark.createDataFrame([(r["file"], n) for r, n in zip(named, first, strict=False)], "file int, first int")), "file")
        heads = rows.where("startswith(value, '##')").select("value").distinct().collect()
        self.info, self.format = (sorted({h["value"].split("ID=")[1].split(",")[0] for h in heads if h["value"].startswith(f"##{k}=")}) for k in ("INFO", "FORMAT"))
        self.contigs: list[str] = []

    contig_rank, records, genotypes = Vcf.contig_rank, Vcf.records, Vcf.genotypes


def vcf(spark: SparkSession, path: str, same_names: bool = False) -> Vcf | VcfList:
    """The VCF that path is, or all those that it stands for."""
    paths = sources(spark, path)
    return Vcf(spark, paths[0]) if paths == [path] else VcfList(spark, paths, same_names)


def sources(spark: SparkSession, path: str) -> list[str]:
    """The files that a path stands for: a folder's VCFs by name, the lines of a manifest (.txt), or itself."""
    if path.endswith(".txt"):
        base = path.rpartition("/")[0]
        names = [r["value"].strip() for r in spark.read.text(path).collect()]
        return [n if n.startswith("/") or "://" in n or not base else f"{base}/{n}" for n in names if n and not n.startswith("#")]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(at).isDirectory() or path.endswith((".vcf", ".vcf.gz")):  # a file in parts is one file
        return [path]
    found = sorted(f"{path.rstrip('/')}/{s.getPath().getName()}" for s in fs.listStatus(at) if s.getPath().getName().endswith((".vcf", ".vcf.gz")))
    if not found:
        raise FileNotFoundError(f"no VCF files in {path}")
    return found


def pvar(spark: SparkSession, path: str) -> DataFrame:
    """A .pvar (or .pvar.zst) or .bim file: v_idx, chrom, pos, id, ref, alt (list), info. A .bim has no header and ALT before REF; its rows at position 0 or less go."""
    rows = lines(spark, path).withColumn("__n", F.monotonically_increasing_id()).where("NOT startswith(value, '##')")
    head = rows.where("startswith(value, '#CHROM')").first()
    if head is None:
        parts = F.split("value", "\t")
        six = F.size(parts) == 6
        at = lambda i: F.when(six, F.get(parts, F.lit(i))).otherwise(F.get(parts, F.lit(i - 1)))
        r = rows.select("__n", F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).alias("id"), at(3).cast("long").alias("pos"), at(4).alias("alt"), at(5).alias("ref"), F.lit(None).cast("string").alias("info")).where("pos > 0")
    else:
        names = [n.lstrip("#").lower() for n in head["value"].split("\t")]
        r = rows.where("NOT startswith(value, '#')").select("__n", *[_dot(c).alias(n) for c, n in zip(_columns(F.col("value"), names), names, strict=True)]).withColumn("pos", F.col("pos").cast("long"))
        r = r if "info" in names else r.withColumn("info", F.lit(None).cast("string"))
    r = r.select("__n", "chrom", "pos", "id", F.upper("ref").alias("ref"), F.split(F.upper("alt"), ",").alias("alt"), "info")
    return row_index(r, [F.floor(F.col("__n") / 65536)], ["__n"], "v_idx").drop("__n").withColumn("ilen", symbolic_ilen())


def psam(spark: SparkSession, path: str) -> DataFrame:
    """(sample_ord, name) of a .psam (with a header that has IID) or .fam file."""
    rows = lines(spark, path).withColumn("__n", F.monotonically_increasing_id()).where("NOT startswith(value, '##')")
    head = rows.where("startswith(value, '#')").first()
    at = [n.lstrip("#") for n in head["value"].split()].index("IID") if head else 1
    names = rows.where("NOT startswith(value, '#')").select("__n", F.get(F.split("value", "\\s+"), F.lit(at)).alias("name"))
    return row_index(names, [F.floor(F.col("__n") / 65536)], ["__n"], "sample_ord").drop("__n")


#: Allele pairs of the two-bit codes, as (haplotype 0, haplotype 1); None is missing. Fixed by the formats.
PGEN_CODES = {2: [(0, 0), (0, 1), (1, 1), (None, None)], 1: [(1, 1), (None, None), (0, 1), (0, 0)]}


#: Bytes of the header: two of magic, the mode; in mode 2 also the counts of variants and samples and a control byte. Fixed by the formats.
PGEN_HEADER = {1: 3, 2: 12}


def pgen(spark: SparkSession, path: str, samples: int, carried: bool = False) -> DataFrame:
    """(v_idx, sample_ord, hap, allele) of a fixed-width genotype file (mode 1 or 2); variable-width files are not read. carried: only alleles that are 1.

    A file is one task. A folder of parts (pgen_write) is one file too: each part is read on its own.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, part in _pgen_parts(batches, samples):
            if carried:
                row, byte = np.nonzero(part)  # most bytes are four samples without ALT
                codes = part[row, byte][:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
                i, j = np.nonzero((codes == 1) | (codes == 2))
                i, j = (x[byte[i] * 4 + j < samples] for x in (i, j))
                v, s, two = at + row[i], byte[i] * 4 + j, codes[i, j] == 2
                yield _alleles(np.concatenate([v, v[two]]), np.concatenate([s, s[two]]), np.concatenate([np.ones(len(v), int), np.zeros(int(two.sum()), int)]), np.ones(len(v) + int(two.sum()), int))
            else:
                table = np.array([[-1 if a is None else a for a in p] for p in PGEN_CODES[2]])
                codes = np.stack([part >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(part), -1)[:, :samples]
                yield _alleles(np.repeat(np.arange(at, at + len(part)), 2 * samples), np.tile(np.repeat(np.arange(samples), 2), len(part)), np.tile([0, 1], samples * len(part)), table[codes].ravel())

    return _binary(spark, path).mapInArrow(decode, "v_idx long, sample_ord long, hap int, allele int")


def pgen_texts(spark: SparkSession, path: str, samples: int) -> DataFrame:
    """(v_idx, dosages): the copies of ALT of all samples by space (NaN missing), each variant's record turned into its text where it is read."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, part in _pgen_parts(batches, samples):
            for i in range(len(part)):
                codes = (part[i][:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:samples]
                text = np.full(2 * samples, 32, np.uint8)
                text[::2] = codes + 48
                yield pa.RecordBatch.from_pydict({"v_idx": pa.array([at + i], pa.int64()), "dosages": pa.array([text[:-1].tobytes().decode("ascii").replace("3", "NaN")])})

    return _binary(spark, path).mapInArrow(decode, "v_idx long, dosages string")


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _alleles(v: np.ndarray, sample: np.ndarray, hap: np.ndarray, allele: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(sample, pa.int64()), pa.array(hap, pa.int32()), pa.array(allele, pa.int32(), mask=allele < 0)], ["v_idx", "sample_ord", "hap", "allele"])


def _pgen_parts(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first variant, bytes by variant) of a file's or part's records, a bounded number at a time, in the codes of mode 2."""
    import gzip

    width = -(-samples // 4)
    for b in batches:
        for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
            content = content.as_buffer()
            named = re.search(r"/f=v(\d+)\.part/[^/]*$", path)
            content = base64.b64decode(bytes(content)) if named else content  # as pgen_write has it
            content = gzip.decompress(content) if bytes(content[:2]) == b"\x1f\x8b" else content
            head = bytes(content[:12])
            if head[:2] != b"\x6c\x1b" or head[2] not in PGEN_HEADER:
                raise ValueError("not a genotype file of fixed width")
            mode = head[2]
            if mode == 2 and int.from_bytes(head[7:11], "little") != samples:
                raise ValueError(f"the file has {int.from_bytes(head[7:11], 'little')} samples, not {samples}")
            body = np.frombuffer(content, np.uint8, offset=PGEN_HEADER[mode])
            if len(body) % max(1, width) or mode == 2 and len(body) != width * int.from_bytes(head[3:7], "little"):
                raise ValueError("the file's length isn't that of its records")
            step, first = max(1, (1 << 20) // max(1, samples)), int(named[1]) if named else 0
            for at in range(0, len(body) // max(1, width), step):
                part = body[at * width : (at + step) * width].reshape(-1, width)
                yield first + at, part if mode == 2 else BIM_CODES[part]


#: Bytes of mode 1 in the codes of mode 2: 0, 1, 2, 3 (two of ALT, missing, one, none) become 2, 3, 1, 0.
BIM_CODES = np.array([sum((2, 3, 1, 0)[x >> s & 3] << s for s in (0, 2, 4, 6)) for x in range(256)], np.uint8)
#: Bytes of records that a part of a written genotype file holds.
PGEN_PART = 1 << 24


def pgen_write(carried: DataFrame, variants: DataFrame, samples: int, path: str) -> None:
    """A fixed-width genotype file (mode 2) of carried (v_idx, sample_ord, hap; all else is reference), in parts of a block of variants each; variants: v_idx, numbered from 0.

    Each part is a file with a header of its own, gzipped and as base64 since Spark's writers make no plain binary files; an executor writes it, and its name says its first variant.
    """
    width = max(1, -(-samples // 4))
    block = max(1, min(1 << 14, PGEN_PART // width))
    cells = carried.groupBy("v_idx", "sample_ord").agg(F.count("*").alias("__n")).select("v_idx", F.struct("sample_ord", "__n").alias("__c"))
    of = F.floor(F.col("v_idx") / block).alias("__b")
    each = variants.select("v_idx").join(cells, "v_idx", "left").select(of, F.when(F.col("__c").isNotNull(), (F.col("v_idx") % block * width * 4 + F.col("__c.sample_ord")) * 4 + F.col("__c.__n")).alias("__at"), (F.col("v_idx") % block + 1).alias("__i"))
    blocks = each.groupBy("__b").agg(F.max("__i").alias("__n"), F.collect_list("__at").alias("__cells"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for k, n, at in zip(b["__b"].to_pylist(), b["__n"].to_pylist(), b["__cells"], strict=True):
                x = at.values.to_numpy(zero_copy_only=False).astype(np.int64) if len(at) else np.empty(0, np.int64)
                cell, copies = x >> 2, x & 3
                body = np.zeros(n * width, np.uint8)
                np.bitwise_or.at(body, cell >> 2, (np.minimum(copies, 2) << (cell & 3) * 2).astype(np.uint8))
                whole = b"\x6c\x1b\x02" + n.to_bytes(4, "little") + samples.to_bytes(4, "little") + b"\x40" + body.tobytes()
                yield pa.RecordBatch.from_pydict({"f": pa.array([f"v{k * block:012d}.part"]), "value": pa.array([base64.b64encode(gzip.compress(whole, 1)).decode("ascii")])})

    blocks.mapInArrow(packed, "f string, value string").write.partitionBy("f").text(path)


#: What a read of hard calls may return for each variant: alleles by haplotype (-1 missing), copies of ALT by sample (NaN missing), whether each sample's alleles are phased.
PGEN_MODES = {"genos": ("alleles",), "dosages": ("dosages",), "genos_phasing": ("alleles", "phased"), "genos_dosages": ("alleles", "dosages"), "genos_phasing_dosages": ("alleles", "phased", "dosages")}


def pgen_read(genotypes: DataFrame, mode: str = "genos", regions: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """One row for each variant (of those that overlap regions, if given) with the mode's lists; genotypes: pgen()."""
    from ..operators.intervals import overlap_join

    if mode not in PGEN_MODES:
        raise ValueError(f"a mode is one of {sorted(PGEN_MODES)}")
    if regions is not None:
        genotypes = genotypes.join(overlap_join(variants, regions).select("v_idx").distinct(), "v_idx", "left_semi")
    cells = F.array_sort(F.collect_list(F.struct("sample_ord", "hap", F.coalesce("allele", F.lit(-1)).alias("a"))))
    alleles = genotypes.groupBy("v_idx").agg(F.transform(cells, lambda x: x["a"]).alias("alleles"))
    samples = "sequence(0, size(alleles) div 2 - 1)"
    full = alleles.withColumns({
        "dosages": F.expr(f"transform({samples}, i -> IF(alleles[CAST(2 * i AS INT)] < 0 OR alleles[CAST(2 * i + 1 AS INT)] < 0, CAST('NaN' AS FLOAT), CAST(alleles[CAST(2 * i AS INT)] + alleles[CAST(2 * i + 1 AS INT)] AS FLOAT)))"),
        "phased": F.expr(f"transform({samples}, i -> alleles[CAST(2 * i AS INT)] = alleles[CAST(2 * i + 1 AS INT)])"),
    })
    return full.select("v_idx", *PGEN_MODES[mode])


def pgen_bytes(alleles: np.ndarray) -> bytes:
    """A fixed-width genotype file (mode 2) of alleles (variants, samples, 2), -1 missing."""
    variants, samples = alleles.shape[:2]
    a = alleles.sum(2)
    codes = np.where((alleles < 0).any(2), 3, a).astype(np.uint8)
    full = np.zeros((variants, -(-samples // 4) * 4), np.uint8)
    full[:, :samples] = codes
    body = (full.reshape(variants, -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2).astype(np.uint8)
    return b"\x6c\x1b\x02" + variants.to_bytes(4, "little") + samples.to_bytes(4, "little") + b"\x40" + body.tobytes()


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(q, chrom, q_start, q_end) of a BED file, numbered in file order."""
    rows = lines(spark, path).withColumn("__n", F.monotonically_increasing_id()).where("NOT value RLIKE '^(#|track|browser|\\\\s*$)'")
    parts = F.split("value", "\\s+")
    r = rows.select("__n", F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).cast("long").alias("q_start"), F.get(parts, F.lit(2)).cast("long").alias("q_end"))
    return row_index(r, [F.floor(F.col("__n") / 65536)], ["__n"], "q").drop("__n")


def regions(spark: SparkSession, items: list[str | tuple[str, int, int]]) -> DataFrame:
    """(q, chrom, q_start, q_end) of texts such as chr1:101-200 or of half-open tuples."""
    rows = [(i, *(parse.region(x) if isinstance(x, str) else x)) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "q long, chrom string, q_start long, q_end long")


#: Attributes of a gene model that are kept. Fixed names of the format.
GTF_ATTRIBUTES = ("gene_id", "transcript_id", "gene_name", "gene_biotype", "transcript_support_level", "level", "tag")


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, feature, start, end (1-based, closed), strand, frame and the kept attributes."""
    r = lines(spark, path).where("NOT startswith(value, '#')").select(*_columns(F.col("value"), ["chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attrs"]))
    attrs = [F.expr(f"nullif(regexp_extract(attrs, '(?:^|; ?){n} \"?([^\";]+)', 1), '')").alias(n) for n in GTF_ATTRIBUTES]
    return r.select("chrom", "feature", F.col("start").cast("long"), F.col("end").cast("long"), "strand", F.expr("try_cast(frame AS INT)").alias("frame"), *attrs).withColumn("level", F.expr("try_cast(level AS INT)")).withColumnRenamed("transcript_support_level", "tsl")


def genes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, strand) of genes, 0-based half-open."""
    return gtf(spark, path).where("feature = 'gene'").select("chrom", (F.col("start") - 1).alias("start"), "end", "strand")


def fasta(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """(chrom, chunk, seq): sequences in chunks of size bases, upper case; the chunks are cut on Arrow batches of one file's lines."""
    from pyspark.sql import Window

    from ..operators.indexing import running_start
    from ..operators.intervals import points_in

    rows = lines(spark, path).withColumn("__n", F.monotonically_increasing_id())
    heads = rows.where("startswith(value, '>')").select("__n", F.regexp_extract("value", "^>(\\S+)", 1).alias("name"))
    spans = heads.select(F.lit(0).alias("chrom"), F.col("__n").alias("start"), F.lead("__n", 1, 1 << 62).over(Window.orderBy("__n")).alias("end"), "name")  # a row for each sequence
    body = rows.where("NOT startswith(value, '>') AND value <> ''").select(F.lit(0).alias("chrom"), "__n", F.upper(F.trim("value")).alias("seq"))
    named = points_in(body, "__n", spans, "start", "end").select(F.col("name").alias("chrom"), "__n", "seq")
    placed = running_start(named.withColumn("__l", F.length("seq")), "chrom", "__n", "__l", "at")
    cut = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.length("seq") - 1) / size))))
    lo = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0)).cast("int")
    part = F.substring(F.col("seq"), lo + 1, F.least(F.length("seq") - lo, ((F.col("chunk") + 1) * size - F.greatest("at", F.col("chunk") * size)).cast("int")))
    return cut.withColumn("part", part).groupBy("chrom", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("seq"))


def fetch(reference: DataFrame, chrom: str, start: int, end: int, size: int = 1 << 16) -> str:
    """Bases [start, end) of a sequence; N outside it."""
    near = reference.where((F.col("chrom") == chrom) & F.col("chunk").between(max(start, 0) // size, max(end - 1, 0) // size))
    found = {r["chunk"]: r["seq"] for r in near.collect()}
    out = []
    for p in range(start, end):
        seq = found.get(p // size, "") if p >= 0 else ""
        out.append(seq[p % size] if p % size < len(seq) else "N")
    return "".join(out)


def signatures(spark: SparkSession, path: str, kind: str = "SBS96") -> DataFrame:
    """(signature, code, weight) of a tab-separated table whose first column names mutation types; a missing type is an error."""
    from ..operators.mutcat import codebook

    t = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    names = t.columns[1:]
    long = t.select(F.col(t.columns[0]).alias("label"), F.explode(F.array(*[F.struct(F.lit(n).alias("signature"), F.col(f"`{n}`").cast("double").alias("weight")) for n in names])).alias("s")).select("label", "s.*")
    book = codebook(spark).where(F.col("kind") == kind).select("label", "code")
    missing = [r["label"] for r in book.join(long.select("label").distinct(), "label", "left_anti").collect()]
    if missing:
        raise ValueError(f"{len(missing)} mutation types lack weights, such as {sorted(missing)[0]}")
    return book.join(long, "label").select("signature", "code", "weight")
