"""Mutation catalogues: codebook, classification, strand, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .haplotype import doublets

# The published order of substitution types, and of the 78 doublet types (the COSMIC catalogue DBS78); code ranges.
SUBSTITUTIONS = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")
DOUBLETS = (
    "AC>CA", "AC>CG", "AC>CT", "AC>GA", "AC>GG", "AC>GT", "AC>TA", "AC>TG", "AC>TT",
    "AT>CA", "AT>CC", "AT>CG", "AT>GA", "AT>GC", "AT>TA",
    "CC>AA", "CC>AG", "CC>AT", "CC>GA", "CC>GG", "CC>GT", "CC>TA", "CC>TG", "CC>TT",
    "CG>AT", "CG>GC", "CG>GT", "CG>TA", "CG>TC", "CG>TT",
    "CT>AA", "CT>AC", "CT>AG", "CT>GA", "CT>GC", "CT>GG", "CT>TA", "CT>TC", "CT>TG",
    "GC>AA", "GC>AG", "GC>AT", "GC>CA", "GC>CG", "GC>TA",
    "TA>AT", "TA>CG", "TA>CT", "TA>GC", "TA>GG", "TA>GT",
    "TC>AA", "TC>AG", "TC>AT", "TC>CA", "TC>CG", "TC>CT", "TC>GA", "TC>GG", "TC>GT",
    "TG>AA", "TG>AC", "TG>AT", "TG>CA", "TG>CC", "TG>CT", "TG>GA", "TG>GC", "TG>GT",
    "TT>AA", "TT>AC", "TT>AG", "TT>CA", "TT>CC", "TT>CG", "TT>GA", "TT>GC", "TT>GG",
)
STRANDS = ("T", "U", "N", "B")
OFFSETS = {"SBS96": (0, 96), "DBS78": (96, 174), "ID83": (174, 257), "SBS384": (257, 641), "SBS192": (257, 449)}
PARTNER, UNCLASSIFIED, NOT_ANNOTATED = -1, -2, -4
#: Largest microhomology that counts, by size of the deletion from 2 to 5 and more.
HOMOLOGY = (1, 2, 3, 5)


def labels(kind: str) -> list[str]:
    """The labels of a kind in code order."""
    sbs = [f"{f}[{s}]{t}" for s in SUBSTITUTIONS for f in "ACGT" for t in "ACGT"]
    if kind == "SBS96":
        return sbs
    if kind == "DBS78":
        return list(DOUBLETS)
    if kind == "ID83":
        one = [f"1:{k}:{b}:{n}" for k in ("Del", "Ins") for b in "CT" for n in range(6)]
        more = [f"{s}:{k}:R:{n}" for k in ("Del", "Ins") for s in range(2, 6) for n in range(6)]
        return one + more + [f"{s}:Del:M:{m}" for s, top in zip(range(2, 6), HOMOLOGY, strict=True) for m in range(1, top + 1)]
    if kind in ("SBS384", "SBS192"):
        return [f"{s}:{x}" for s in STRANDS[: 4 if kind == "SBS384" else 2] for x in sbs]
    raise ValueError(f"an unknown kind of catalogue: {kind}")


def codebook(spark: SparkSession) -> DataFrame:
    """(kind, ordinal, code, label) of all kinds: a few hundred rows."""
    rows = [(k, i, OFFSETS[k][0] + i, x) for k in OFFSETS for i, x in enumerate(labels(k))]
    return spark.createDataFrame(rows, "kind string, ordinal int, code int, label string")


def revcomp(col: str) -> str:
    return f"reverse(translate({col}, 'ACGT', 'TGCA'))"


def sbs96(five: str, ref: str, alt: str, three: str) -> Column:
    """Code of a SNV by its neighbours, on the pyrimidine's strand; UNCLASSIFIED for other letters, no change, or no neighbour."""
    ok = " AND ".join(f"length({x}) = 1 AND instr('ACGT', {x}) > 0" for x in (five, ref, alt, three)) + f" AND {ref} <> {alt}"
    py = f"instr('CT', {ref}) > 0"
    at = lambda x: f"(instr('ACGT', {x}) - 1)"
    co = lambda x: f"(4 - instr('ACGT', {x}))"
    r, a = f"IF({py}, {at(ref)}, {co(ref)})", f"IF({py}, {at(alt)}, {co(alt)})"
    f, t = f"IF({py}, {at(five)}, {co(three)})", f"IF({py}, {at(three)}, {co(five)})"
    sub = f"(IF({r} = 1, 0, 3) + {a} - IF({a} > {r}, 1, 0))"
    return F.expr(f"CASE WHEN {ok} THEN {sub} * 16 + {f} * 4 + {t} ELSE {UNCLASSIFIED} END")


def dbs78(df: DataFrame, ref: str, alt: str, name: str) -> DataFrame:
    """df with the code of a doublet REF>ALT, by table or by the reverse complement's entry."""
    book = F.broadcast(codebook(df.sparkSession).where("kind = 'DBS78'").select(F.col("label").alias("__l"), F.col("code").alias("__c")))
    a = df.join(book, F.concat(ref, F.lit(">"), alt) == F.col("__l"), "left").drop("__l").withColumnRenamed("__c", "__c1")
    rc = F.concat(F.expr(revcomp(ref)), F.lit(">"), F.expr(revcomp(alt)))
    b = a.join(book, rc == F.col("__l"), "left").drop("__l")
    return b.withColumn(name, F.coalesce("__c1", "__c", F.lit(UNCLASSIFIED))).drop("__c1", "__c")


def indel_code(window: str, ref: str, alt: str) -> Column:
    """Code of an indel (SQL expressions); window: the reference from the base behind the anchor on, long enough for six repeats of the unit.

    UNCLASSIFIED without a window or a common anchor, for other letters, and for a deleted base that the window does not start with.
    """
    first = OFFSETS["ID83"][0]
    deletion, unit = f"(length({ref}) > length({alt}))", f"substring(IF(length({ref}) > length({alt}), {ref}, {alt}), 2)"
    ok = f"{window} IS NOT NULL AND length({ref}) <> length({alt}) AND left({ref}, 1) = left({alt}, 1) AND left({ref}, 1) <> '' AND __u RLIKE '^[ACGT]+$'"
    copies = f"aggregate(sequence(0, 5), 0, (k, i) -> IF(k = i AND substring({window}, i * length(__u) + 1, length(__u)) = __u, k + 1, k))"
    match = f"IF(length(__u) > 1, aggregate(sequence(1, greatest(length(__u) - 1, 1)), 0, (m, k) -> IF(m = k - 1 AND substring({window}, k, 1) = substring(__u, k, 1), k, m)), 0)"
    before = [sum(HOMOLOGY[:i]) for i in range(len(HOMOLOGY))]
    pick = lambda values, size: f"element_at(array({', '.join(map(str, values))}), {size})"
    size = "(least(length(__u), 5) - 1)"  # from 1 for two bases
    repeats = "least(__k - CAST(__d AS INT), 5)"
    code = f"""CASE WHEN NOT ({ok}) THEN {UNCLASSIFIED}
        WHEN __d AND length(__u) > 1 AND __k <= 1 AND __m > 0 THEN {first + 71} + {pick(before, size)} + least(__m, {pick(HOMOLOGY, size)})
        WHEN __d AND __k = 0 THEN {UNCLASSIFIED}
        WHEN length(__u) = 1 THEN {first} + IF(__d, 0, 12) + IF(__u IN ('C', 'G'), 0, 6) + {repeats}
        ELSE {first + 24} + IF(__d, 0, 24) + ({size} - 1) * 6 + {repeats} END"""
    # names for what recurs, by way of lists of one
    named = f"transform(array(named_struct('u', {unit}, 'd', {deletion})), __a -> {{}})[0]"
    inner = code.replace("__u", "__a.u").replace("__d", "__a.d").replace("__k", f"({copies.replace('__u', '__a.u')})").replace("__m", f"({match.replace('__u', '__a.u')})")
    return F.expr(f"CAST({named.format(inner)} AS INT)")


def classify(variants: DataFrame) -> DataFrame:
    """variants (v_idx, ref, alt, five, three, window) with code: SNVs, two-base substitutions and indels; the rest is UNCLASSIFIED."""
    both = dbs78(variants, "ref", "alt", "__dbs")
    code = (
        F.when((F.length("ref") == 1) & (F.length("alt") == 1), sbs96("five", "ref", "alt", "three"))
        .when((F.length("ref") == 2) & (F.length("alt") == 2), F.col("__dbs"))
        .when(F.length("ref") != F.length("alt"), indel_code("window", "ref", "alt"))
        .otherwise(UNCLASSIFIED)
    )
    return both.withColumn("code", code.cast("int")).drop("__dbs")


#: Calls that a task of call_codes() sorts, about.
ROWS = 1_000_000


def call_codes(calls: DataFrame, classified: DataFrame) -> DataFrame:
    """Calls (sample_id, hap, v_idx) with chrom, pos, and the code that counts: neighbouring SNVs become one doublet, whose second half is PARTNER.

    The other half's bases come from the same window, not by a join in which all calls without one would have the same key. A task gets
    some ROWS calls, however many there are.
    """
    rows = -(-calls.count() // ROWS)
    parts = rows if rows > int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    full = (calls.repartition(parts, "v_idx") if parts else calls).join(classified.select("v_idx", "chrom", "pos", "ilen", "ref", "alt", "code"), "v_idx")
    joined = doublets(full, ["ref", "alt"], parts).withColumnsRenamed({"mate_ref": "__r", "mate_alt": "__a"})
    pair = F.when(F.col("half") == 5, F.concat("ref", "__r")).when(F.col("half") == 3, F.concat("__r", "ref"))
    pair_alt = F.when(F.col("half") == 5, F.concat("alt", "__a")).when(F.col("half") == 3, F.concat("__a", "alt"))
    coded = dbs78(joined.withColumns({"__pr": pair, "__pa": pair_alt}), "__pr", "__pa", "__dbs")
    final = F.when(F.col("__dbs") >= 0, F.when(F.col("half") == 5, F.col("__dbs")).when(F.col("half") == 3, F.lit(PARTNER)).otherwise(F.col("code"))).otherwise(F.col("code"))
    return coded.withColumn("code", final.cast("int")).drop("__pr", "__pa", "__r", "__a", "__dbs", "mate", "half")


def matrix(coded: DataFrame, kind: str, count: str = "allele") -> DataFrame:
    """(sample_id, code, n) of a kind: every carried copy, or with count sample 1 where there is any."""
    lo, hi = OFFSETS[kind]
    inside = coded.where(F.col("code").between(lo, hi - 1))
    n = F.count("*") if count == "allele" else F.lit(1).cast("long")
    return inside.groupBy("sample_id", "code").agg((F.count("*") if count == "allele" else F.max(n)).alias("n"))


def wide(long: DataFrame, kind: str, samples: list) -> DataFrame:
    """MutationType and one column a sample, all labels in order: for a bounded number of samples only."""
    book = codebook(long.sparkSession).where(F.col("kind") == kind)
    table = long.groupBy("code").pivot("sample_id", samples).agg(F.sum("n"))
    out = book.join(table, "code", "left").orderBy("ordinal")
    return out.select(F.col("label").alias("MutationType"), *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(str(s)) for s in samples])


def strand_class(ref: str, gene: str) -> Column:
    """T, U, N or B: whether the pyrimidine of a SNV lies on the transcribed strand of the genes there (1 +, 2 -, 3 both, else none)."""
    py = f"instr('CT', {ref}) > 0"
    return F.expr(f"CASE WHEN {gene} = 3 THEN 'B' WHEN {gene} = 1 THEN IF({py}, 'U', 'T') WHEN {gene} = 2 THEN IF({py}, 'T', 'U') ELSE 'N' END")


def stranded(code: str, strand: str) -> Column:
    """SBS384 code of an SBS96 code and its strand class."""
    return F.expr(f"IF({code} BETWEEN 0 AND 95, {OFFSETS['SBS384'][0]} + (instr('TUNB', {strand}) - 1) * 96 + {code}, {code})")


def reference_context(variants: DataFrame, reference: DataFrame, size: int) -> DataFrame:
    """variants (chrom, pos) with five and three, the reference's bases beside pos, from chunks (chrom, chunk, seq) of size bases; empty at the ends."""
    base = lambda p: (reference.select("chrom", F.col("chunk").alias("__c"), F.col("seq").alias(f"__s{p}")))
    out = variants
    for name, shift in (("five", -2), ("three", 0)):
        at = F.col("pos") + shift
        out = out.withColumn("__c", F.floor(at / size)).join(base(name), ["chrom", "__c"], "left")
        out = out.withColumn(name, F.when(at < 0, "").otherwise(F.coalesce(F.substring(F.upper(f"__s{name}"), (F.pmod(at, F.lit(size)) + 1).cast("int"), F.lit(1)), F.lit("")))).drop("__c", f"__s{name}")
    return out
