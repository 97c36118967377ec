"""Range search, reads, normalisation and catalogues on literal cases, brute force and the SQL twins."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from locusframe import catalog
from locusframe.functions import contigs, parse, predicates
from locusframe.operators import cohort, genes, haplotype, intervals, mutcat, normalize, signatures
from locusframe.operators.indexing import row_index
from locusframe.plans import derive, stored
from locusframe.sources import files

DATA = "/root/testdata/sf0.001"


def plain(value):
    return None if value is None or value != value else round(value, 5) if isinstance(value, float) else value


def rows(df, *columns):
    return sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    want = duck.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, DATA)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    at = [want.columns.index(n) for n in names]
    assert rows(got, *names) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", ["s1_vcf_genotypes", "s22_write_vcf", "n5_genotype_remap", "n10_route_policy", "n12_fields", "w4_sorted_emission"])
def test_cohort_files_equal_the_sql(spark, duck, name, monkeypatch):
    """Several files of several samples each, the last one smaller."""
    monkeypatch.setattr(stored, "BATCH", 4)
    test_query_equals_its_sql(spark, duck, name)


def test_vcf_text_follows_the_calls(spark, monkeypatch):
    """One file has the records of its samples only, the first one all: no line for each variant with all samples."""
    monkeypatch.setattr(stored, "BATCH", 2)
    texts = spark.read.text(files.sources(spark, stored._vcf(spark, DATA))).where("NOT startswith(value, '#')")
    got = texts.agg(F.sum(F.expr("size(split(value, '\t')) - 9"))).first()[0]
    calls, variants, samples = (derive.load(spark, DATA, t) for t in ("calls", "variants", "samples"))
    order = {r["sample_id"]: i // 2 for i, r in enumerate(samples.orderBy("sample_id").collect())}
    held = {(order[r["sample_id"]], r["v_idx"]) for r in calls.collect()}
    first = {(0, i) for i in range(variants.count())}
    assert got == 2 * len(held | first) < variants.count() * samples.count()


@pytest.mark.parametrize("name", ["s2_vcf_records", "c1_index", "s8_multi_region_fetch"])
def test_record_queries_write_no_genotypes(spark, name, monkeypatch):
    seen = []
    monkeypatch.setattr(files.Vcf, "__init__", lambda self, spark, path, old=files.Vcf.__init__: (seen.append(spark.read.text(path).agg(F.max(F.size(F.split("value", "\t")))).first()[0]), old(self, spark, path))[1])
    catalog.QUERIES[name](spark, DATA)
    assert seen == [8]


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("parts", ["1", "8", "64"])
def test_same_rows_at_any_partitioning(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [catalog.QUERIES[n](spark, DATA).agg(F.sum(F.xxhash64("*").cast("decimal(20,0)"))).first()[0] for n in ("q7_var_idxs", "w3_dbs_pairs", "f16_merge_regions")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == test_same_rows_at_any_partitioning.__dict__.setdefault("seen", got)


# predicates and parsers


def test_symbolic_lengths(spark):
    cases = [("<DEL>", "SVLEN=100;END=1100", -100), ("<INS>", "SVLEN=50", 50), ("<DUP>", "SVLEN=30;END=1030", 30), ("<DEL>", "SVLEN=200;IMPRECISE", None), ("<CNV>", "SVLEN=40", None), ("<INV>", "END=1050", None), ("G[chr1:500000[", "", None), ("<DEL:ME>", "END=1010", -10), ("<DEL>", ".", None), ("GAT", "SVLEN=9", 2)]
    df = spark.createDataFrame([(i, 1000, "G", [a], x) for i, (a, x, _) in enumerate(cases)], "i int, pos long, ref string, alt array<string>, info string")
    assert [r["l"][0] for r in df.select("i", predicates.symbolic_ilen().alias("l")).orderBy("i").collect()] == [c[2] for c in cases]


def test_predicates_with_nulls(spark):
    df = spark.createDataFrame([([0, 0],), ([0, None],), ([],), (None,), ([1, -2],)], "ilen array<int>")
    got = [tuple(r) for r in df.select(predicates.is_snp(), predicates.is_indel(), predicates.is_imprecise()).collect()]
    assert got == [(True, False, False), (False, False, True), (True, True, False), (None, None, None), (False, True, False)]


def test_parsers():
    assert parse.memory("4g") == 4 << 30 and parse.memory("2gb") == 2 * 10**9 and parse.memory("512") == 512
    assert parse.region("chr1:101-200") == ("chr1", 100, 200)
    assert parse.fields(["INFO/DP", "FMT/DS", "FORMAT/DS", "INFO/DP"]) == [("INFO", "DP"), ("FORMAT", "DS")]
    assert parse.file_kind("a.vcf.gz") == "vcf" and parse.chunk_size(1000, 2, 0, 250) == 1
    for bad in (lambda: parse.memory("x"), lambda: parse.region("chr1"), lambda: parse.fields(["DP"]), lambda: parse.region("1:0-5")):
        with pytest.raises(ValueError):
            bad()


def test_contigs(spark):
    assert contigs.resolve("1", ["chr1", "chrM"]) == "chr1" and contigs.resolve("MT", ["chr1", "chrM"]) == "chrM" and contigs.resolve("chr9", ["chr1"]) is None
    names = ["chr10", "chr2", "chr1", "chrX"]
    assert sorted(names, key=contigs.natural_key) == ["chr1", "chr2", "chr10", "chrX"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(contigs.natural_order(F.col("n")))
    assert [r["n"] for r in df.collect()] == ["chr1", "chr2", "chr10", "chrX"]


# intervals


def test_overlap_join_is_brute_force(spark):
    r = random.Random(3)
    v = [(i, f"c{r.randint(1, 2)}", s := r.randint(0, 400), s + r.randint(1, 60)) for i in range(150)]
    q = [(i, f"c{r.randint(1, 3)}", s := r.randint(-20, 400), s + r.randint(-3, 90)) for i in range(120)]
    variants = spark.createDataFrame(v, "v_idx long, chrom string, v_start long, v_end long")
    regions = spark.createDataFrame(q, "q long, chrom string, q_start long, q_end long")
    want = sorted((a, b) for a, qc, s, e in q for b, vc, x, y in v if qc == vc and e > max(s, 0) and x < e and y > max(s, 0))
    assert rows(intervals.overlap_join(variants, regions), "q", "v_idx") == sorted(want, key=str)


def test_gathered_is_the_overlap_join(spark):
    """Variants and regions of all lengths, longer than the widest tiles too, empty and negative ones, with and without those that meet nothing."""
    r = random.Random(8)
    v = [(i, f"c{r.randint(1, 2)}", s := r.randint(0, 300_000), s + int(10 ** r.uniform(0, 5.3)), [i, -i]) for i in range(120)]
    q = [(i, f"c{r.randint(1, 3)}", s := r.randint(-50, 300_000), s + int(10 ** r.uniform(0, 5.5)) - 3) for i in range(150)] + [(200, "c1", -9, 500), (201, "c1", 7, 7), (202, "c2", 0, 1 << 20)]
    variants = spark.createDataFrame(v, "v_idx long, chrom string, v_start long, v_end long, cells array<int>")
    regions = spark.createDataFrame(q, "q long, chrom string, q_start long, q_end long")
    want = {a: [(b, c) for b, vc, x, y, c in v if qc == vc and e > max(s, 0) and x < e and y > max(s, 0)] for a, qc, s, e in q}
    got = {x["q"]: [(h["v_idx"], h["cells"]) for h in x["hits"]] for x in intervals.gathered(variants, regions, ["cells"], outer=True).collect()}
    assert got == want
    some = {x["q"]: [(h["v_idx"], h["cells"]) for h in x["hits"]] for x in intervals.gathered(variants, regions, ["cells"]).collect()}
    assert some == {a: h for a, h in want.items() if h}


@pytest.mark.parametrize("name", ["j4_carriers", "j4_range_carriers", "q13_decode", "q14_region_counts", "q9_sparse_read", "q13_decode_cells", "q5_chunk_ranges", "q11_with_length"])
def test_pairs_of_regions_and_carriers_are_not_shuffled(spark, name):
    """Above the join of a tile's regions and variants nothing is exchanged, sorted or put into a window."""
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("SortMergeJoin")[0]
    assert "SortMergeJoin" in plan and not any(x in above for x in ("Exchange", "Sort ", "Window", "Aggregate"))


def test_a_walk_is_over_when_its_bases_are_enough(spark, monkeypatch):
    """A haplotype without a variant behind the region needs no second round, however far its contig goes on."""
    from locusframe import runtime

    rounds = []
    monkeypatch.setattr(runtime, "cut", lambda df, old=runtime.cut: (rounds.append(1), old(df))[1])
    variants = spark.createDataFrame([(0, "c", 11, 0, 10, 11), (1, "c", 13, -2, 12, 15), (2, "c", 1_000_000, 0, 999_999, 1_000_000)], "v_idx long, chrom string, pos long, ilen int, v_start long, v_end long")
    regions = spark.createDataFrame([(0, "c", 9, 20)], "q long, chrom string, q_start long, q_end long")
    calls = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 1, 0), (1, 1, 1)], "sample_id long, hap int, v_idx long")
    assert rows(haplotype.with_length(variants, regions, calls), "sample_id", "hap", "v_idx") == [(0, 0, 0), (0, 1, 1), (1, 1, 0), (1, 1, 1)]
    assert len(rounds) == 1


@pytest.mark.parametrize("name", ["q1_dense_read", "q4_read_ranges", "w2_dense2sparse"])
def test_no_grid_of_variants_and_samples(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "explode([0,1])" not in plan  # the two haplotypes of every sample at every variant


def test_dense_text(spark):
    ids = np.array([3, 8, 9, 20])
    at = {0: [], 1: [0, 3, 7], 2: [4, 4, 5], 13: [0, 1, 2, 3, 4, 5, 6, 7]}
    df = spark.createDataFrame(list(at.items()), "v_idx long, at array<int>")
    want = {v: " ".join("1" if 2 * i + h in c else "-1" if (v + s) % 11 == 0 else "0" for i, s in enumerate(ids) for h in (0, 1)) for v, c in at.items()}
    assert {r["v_idx"]: r["alleles"] for r in cohort.dense_text(df, ids, 11).collect()} == want


def test_calls_without_a_mate_are_not_joined_by_it(spark):
    """One join of calls with their variants, none by the other half, which most calls lack; and many small tasks give the same codes."""
    plan = catalog.QUERIES["a6_matrix_allele"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "mate" not in plan.replace("mate_", "") or not any("mate#" in line for line in plan.split("\n") if "Join" in line)
    want = rows(catalog.QUERIES["m2_annotate_calls"](spark, DATA), "sample_id", "hap", "v_idx", "code")
    before, mutcat.ROWS = mutcat.ROWS, 100
    try:
        assert rows(catalog.QUERIES["m2_annotate_calls"](spark, DATA), "sample_id", "hap", "v_idx", "code") == want
    finally:
        mutcat.ROWS = before


def test_refit_calls_python_by_batches(spark):
    plan = catalog.QUERIES["w6_refit"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_overlap_join_tries_few_pairs_on_dense_data(spark):
    """All positions within a few thousand bases, extents from 1 to the whole contig: pairs that are tried stay near those that overlap."""
    r = random.Random(4)
    v = [(i, "c", s := r.randint(0, 3000), s + r.choice([1, 1, 1, 8, 40, 2900])) for i in range(3000)]
    q = [(i, "c", s := r.randint(0, 3000), s + r.choice([1, 5, 30, 60])) for i in range(3000)]
    variants = spark.createDataFrame(v, "v_idx long, chrom string, v_start long, v_end long")
    regions = spark.createDataFrame(q, "q long, chrom string, q_start long, q_end long")
    want = sum(x < e and y > s for _, _, s, e in q for _, _, x, y in v)
    tried = 0
    for a, at, b, start, end in ((variants, "v_start", regions, "q_start", "q_end"), (regions, "q_start", variants.where("v_end > v_start + 1"), "v_start", "v_end")):
        tried += intervals._within(a, at, b, start, end, F.lit(True), every=True).count()
    assert intervals.overlap_join(variants, regions).count() == want
    assert tried < 4 * want + 20 * (len(v) + len(q)) < len(v) * len(q) / 2


def test_region_modes(spark):
    v = spark.createDataFrame([(0, "chr1", 4, 8), (1, "chr1", 9, 10), (2, "chr1", 12, 13), (3, "chr1", 20, 21)], "v_idx long, chrom string, v_start long, v_end long")
    q = spark.createDataFrame([(0, "chr1", 6, 12)], "q long, chrom string, q_start long, q_end long")
    got = {m: [x for _, x in rows(intervals.position_members(v, q, m), "q", "v_idx")] for m in ("pos", "record", "variant")}
    assert got == {"pos": [1], "record": [1, 2], "variant": [0, 1]}


def test_regions_must_not_overlap(spark):
    q = spark.createDataFrame([(0, "a", 0, 5), (1, "a", 5, 9), (2, "a", 8, 12)], "q long, chrom string, q_start long, q_end long")
    with pytest.raises(ValueError):
        intervals.check_regions(q, merge=False)
    assert rows(intervals.check_regions(q, merge=True), "q_start", "q_end", "n") == [(0, 12, 3)]
    with pytest.raises(ValueError):
        intervals.check_regions(q.withColumn("q_end", F.lit(0)), merge=True)


def test_regions_merge_across_blocks(spark):
    """Regions of all lengths, over many blocks of positions, against a plain sweep."""
    r = random.Random(8)
    q = [(i, r.choice("ab"), s := r.randint(0, 30 << 20), s + r.choice([1, 50, 1 << 17, 3 << 20] if i % 20 else [5 << 20])) for i in range(60)]
    frame = spark.createDataFrame(q, "q long, chrom string, q_start long, q_end long")
    want, over = [], []
    for c in "ab":
        end, island = -1, None
        for i, _, s, e in sorted((x for x in q if x[1] == c), key=lambda x: (x[2], x[3], x[0])):
            over += [(i,)] if s < end else []
            if s <= end and island:
                island[1:] = [c, island[2], max(island[3], e), island[4] + 1]
            else:
                island = [0, c, s, e, 1]
                want.append(island)
            end = max(end, e)
    assert rows(intervals.merge_regions(frame), "chrom", "q_start", "q_end", "n") == sorted((tuple(x[1:]) for x in want), key=str)
    assert rows(intervals.overlapping_regions(frame), "q") == sorted(over, key=str)


def test_strand_intervals(spark):
    g = spark.createDataFrame([("a", 0, 20, "+"), ("a", 30, 40, "+"), ("a", 25, 45, "-")], "chrom string, start long, end long, strand string")
    assert rows(intervals.strand_intervals(g), "start", "end", "value") == [(0, 20, 1), (25, 30, 2), (30, 40, 3), (40, 45, 2)]


def test_row_index(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS k").repartition(7)
    assert all(r["k"] == r["at"] for r in row_index(df, [F.floor(F.col("k") / 37)], ["k"], "at").collect())


# haplotypes


def size(bases):
    return sum(-1 if b == "erased" else 1 for b in bases)


def walk(variants, start, end):
    """What a haplotype takes over (v_idx, v_start, ilen), by laying its bases out one by one.

    Each reference base between two variants is a base of the haplotype, a variant's own base and what it inserts too,
    deleted ones are not. As soon as the region is behind and the haplotype long enough, it ends; variants that
    start before the region are taken, their bases don't count.
    """
    need, bases, out, at = end - start, [], [], start  # at: the next reference base
    for v, s, l in variants:
        if s < start:
            out.append(v)
            at = max(at, s + max(0, -l))
            continue
        between = s - at
        laid = ["r"] * between + ["erased"] * -between  # a variant under an earlier deletion takes bases away again
        if s >= end and size(bases + laid) >= need:
            return out
        bases += laid + ["v"] * (1 + max(0, l))
        out.append(v)
        at = max(at, s + 1 + max(0, -l))
        if s >= end and size(bases) >= need:
            return out
    return out


def test_reads_reach_their_length(spark):
    r = random.Random(5)
    for _ in range(3):
        pos = sorted(r.sample(range(1, 300), 70))
        v = [(i, "c", p, r.choice([0, 0, 0, -r.randint(1, 25), r.randint(1, 6)])) for i, p in enumerate(pos)]
        c = [(s, h, i) for s in range(3) for h in range(2) for i in range(70) if r.random() < 0.5]
        q = [(k, "c", s := r.randint(0, 280), s + r.randint(1, 30)) for k in range(20)]
        variants = spark.createDataFrame([(i, ch, p, l, p - 1, p - min(l, 0)) for i, ch, p, l in v], "v_idx long, chrom string, pos long, ilen int, v_start long, v_end long")
        got = haplotype.with_length(variants, spark.createDataFrame(q, "q long, chrom string, q_start long, q_end long"), spark.createDataFrame(c, "sample_id long, hap int, v_idx long"))
        want = []
        for k, _, s, e in q:
            hit = [i for i, _, p, l in v if p - 1 < e and p - min(l, 0) > s]
            if hit:
                for sample in range(3):
                    for hap in range(2):
                        mine = [(i, v[i][2] - 1, v[i][3]) for a, b, i in c if (a, b) == (sample, hap) and i >= min(hit)]
                        want += [(k, sample, hap, i) for i in walk(mine, s, e)]
        assert rows(got, "q", "sample_id", "hap", "v_idx") == sorted(want, key=str)


def test_doublets_need_exactly_two(spark):
    calls = [(0, 0, "c", 0, 100, 0), (0, 0, "c", 1, 101, 0), (0, 0, "c", 2, 200, 0), (0, 1, "c", 0, 100, 0), (0, 1, "c", 1, 101, 0), (0, 1, "c", 3, 102, 0)]
    d = haplotype.doublets(spark.createDataFrame(calls, "sample_id int, hap int, chrom string, v_idx long, pos long, ilen int"))
    assert rows(d, "hap", "v_idx", "half", "mate") == [(0, 0, 5, 1), (0, 1, 3, 0), (0, 2, 0, None), (1, 0, 0, None), (1, 1, 0, None), (1, 3, 0, None)]


# normalisation


@pytest.mark.parametrize(
    "ref, alt, want",
    [("A", "C", [(100, 0, "C")]), ("AC", "GT", [(100, 0, "G"), (101, 0, "T")]), ("ACA", "ATA", [(101, 0, "T")]), ("A", "AT", [(100, 1, "AT")]), ("ATG", "A", [(100, -2, "A")]), ("GAT", "A", [(100, -2, "G"), (100, 0, "A")]), ("A", "GT", [(100, 1, "GT")]), ("AC", "AC", [])],
)
def test_atoms(spark, ref, alt, want):
    df = spark.createDataFrame([(101, ref, alt, 1)], "pos long, ref string, alt string, source_alt int")
    assert rows(normalize.atoms(df), "atom_pos", "atom_ilen", "atom_alt") == sorted(want, key=str)


def applied(seq, p, ilen, alt):
    return seq[:p] + alt + seq[p + 1 + max(0, -ilen) :]


def test_left_alignment_keeps_the_haplotype(spark):
    cases = [("CAAAATCAGAGT", 3, -1, "A", 0), ("CAAAATCAGAGT", 3, 1, "AA", 0), ("CAAAATCAGAGT", 8, -2, "G", 6)]
    for seq, at, n, alt, want in cases:
        assert at + normalize.aligned(seq, at, n, alt)[0] == want
    r = random.Random(1)
    for _ in range(2000):
        seq = "".join(r.choice("AC") for _ in range(40))
        at = r.randint(1, 30)
        n = r.choice([-3, -2, -1, 1, 2, 3])
        alt = seq[at] if n < 0 else seq[at] + "".join(r.choice("AC") for _ in range(n))
        shift, moved = normalize.aligned(seq, at, n, alt)
        assert shift <= 0 and applied(seq, at, n, alt) == applied(seq, at + shift, n, moved)
    ref = spark.createDataFrame([("c", 0, "CAAAATCAGAGT")], "chrom string, chunk long, seq string")
    a = spark.createDataFrame([("c", p, n, x) for _, p, n, x, _ in cases], "chrom string, atom_pos long, atom_ilen int, atom_alt string")
    assert [x for x, _ in rows(normalize.left_align(a, ref), "atom_pos", "atom_ilen")] == [0, 0, 6]


def test_reference_check(spark):
    df = spark.createDataFrame([(1, "ac", "AC"), (2, "A", "T"), (3, "A", "")], "pos long, ref string, seq string")
    assert rows(normalize.check_reference(df, F.col("seq"), "x"), "pos") == [(1,)]
    with pytest.raises(Exception, match="differs"):
        normalize.check_reference(df, F.col("seq"), "e").collect()


def test_route_crossovers(spark):
    df = spark.createDataFrame([(59, False), (60, False), (32, True), (33, True)], "x long, is_indel boolean")
    got = [r["r"] for r in df.select(normalize.route("x", "is_indel", 1000, 2).alias("r")).collect()]
    assert got == ["var_key", "dense", "var_key", "dense"]


def test_narrow_types(spark):
    cases = [(0, 255, False, "u8"), (0, 255, True, "u16"), (-1, 127, False, "i8"), (-128, 1, True, "i16"), (0, 70000, False, "u32"), (None, None, False, "u8")]
    df = spark.createDataFrame([c[:3] for c in cases], "lo long, hi long, m boolean")
    assert [r[0] for r in df.select(normalize.narrow_type("lo", "hi", "m")).collect()] == [c[3] for c in cases]


# catalogues


def test_codebook():
    assert [len(mutcat.labels(k)) for k in ("SBS96", "DBS78", "ID83", "SBS384", "SBS192")] == [96, 78, 83, 384, 192]
    assert mutcat.labels("SBS96")[:2] == ["A[C>A]A", "A[C>A]C"] and len(set(mutcat.labels("ID83"))) == 83
    with pytest.raises(ValueError):
        mutcat.labels("X")


def test_substitution_codes(spark):
    comp = str.maketrans("ACGT", "TGCA")
    cases = [(f, r, a, t) for f in "ACGT" for r in "ACGT" for a in "ACGT" for t in "ACGT" if a != r]
    df = spark.createDataFrame([*cases, ("N", "C", "A", "A"), ("", "C", "A", "A"), ("A", "C", "C", "A")], "f string, r string, a string, t string")
    got = {tuple(x[:4]): x[4] for x in df.select("f", "r", "a", "t", mutcat.sbs96("f", "r", "a", "t")).collect()}
    index = {x: i for i, x in enumerate(mutcat.labels("SBS96"))}
    for f, r, a, t in cases:
        key = (f, r, a, t) if r in "CT" else (t.translate(comp), r.translate(comp), a.translate(comp), f.translate(comp))
        assert got[f, r, a, t] == index[f"{key[0]}[{key[1]}>{key[2]}]{key[3]}"]
    assert got["N", "C", "A", "A"] == got["", "C", "A", "A"] == got["A", "C", "C", "A"] == mutcat.UNCLASSIFIED


@pytest.mark.parametrize(
    "seq, ref, alt, want",
    [("ACCCCCG", "AC", "A", "1:Del:C:4"), ("AGGGG", "A", "AT", "1:Ins:T:0"), ("AGGGG", "A", "AG", "1:Ins:C:4"), ("AACACACT", "AAC", "A", None), ("GACACACT", "GAC", "G", "2:Del:R:2"), ("GACATT", "GACT", "G", "3:Del:M:2"), ("GACTACCC", "GACT", "G", "3:Del:M:2"), ("GAAAAAAAAAAT", "GA", "G", "1:Del:T:5"), ("GTTTTTTC", "G", "GTTTTTT", "5:Ins:R:1"), ("GACG", "GC", "G", None), ("G", "G", "GAC", "2:Ins:R:0")],
)
def test_indel_codes(spark, seq, ref, alt, want):
    code = spark.createDataFrame([(seq[1:], ref, alt)], "w string, r string, a string").select(mutcat.indel_code("w", "r", "a")).first()[0]
    if want:
        assert mutcat.labels("ID83")[code - mutcat.OFFSETS["ID83"][0]] == want
    elif seq == "GACG":
        assert code == mutcat.UNCLASSIFIED


def test_doublet_catalogue(spark):
    v = spark.createDataFrame([(0, "c", 100, 0, "A", "G", 10), (1, "c", 101, 0, "C", "T", 11), (2, "c", 200, 0, "G", "A", 12)], "v_idx long, chrom string, pos long, ilen int, ref string, alt string, code int")
    calls = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 0, 2)], "sample_id int, hap int, v_idx long")
    got = rows(mutcat.call_codes(calls, v), "v_idx", "code")
    assert got == [(0, 96 + mutcat.labels("DBS78").index("AC>GT")), (1, -1), (2, 12)]


def test_wide_matrix(spark):
    long = spark.createDataFrame([("a", 0, 3), ("b", 95, 1)], "sample_id string, code int, n long")
    w = mutcat.wide(long, "SBS96", ["a", "b"]).collect()
    assert len(w) == 96 and w[0]["a"] == 3 and w[95]["b"] == 1 and w[5]["a"] == 0


def test_refit_finds_the_mixture(spark):
    r = np.random.default_rng(0)
    table = r.dirichlet(np.full(96, 0.1), 4).T
    truth = np.array([300.0, 0, 700, 0])
    h, c = signatures.refit(table, table @ truth)
    assert np.allclose(h, truth, atol=1e-6) and c == pytest.approx(1)
    assert signatures.refit(table, np.zeros(96)) == (pytest.approx(np.zeros(4)), 0.0)
    for _ in range(30):
        a, b = r.random((12, 5)), r.normal(size=12)
        x = signatures.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g > -1e-8).all() and abs(g @ x) < 1e-8  # optimality
    sig = spark.createDataFrame([(f"S{k}", i, float(table[i, k])) for k in range(4) for i in range(96)], "signature string, code int, weight double")
    counts = spark.createDataFrame([("x", i, float((table @ truth)[i])) for i in range(96)], "sample_id string, code int, n double")
    got = {x["signature"]: x["activity"] for x in signatures.assign(counts, sig).collect()}
    assert got["S2"] == pytest.approx(700, rel=1e-6)


def test_codon_positions(spark):
    df = spark.createDataFrame([(1000, 1000, f, s, 0) for f in (0, 1, 2, None) for s in "+-"], "pos int, start int, frame int, strand string, ilen int")
    got = [r[0] for r in df.select(genes.codon_position("pos", "start", "frame", "strand", "ilen")).collect()]
    assert got == [0, 0, 2, 1, 1, 2, None, None]


def test_counts_have_all_cells(spark):
    v = spark.createDataFrame([(0, "c", 5, 6), (1, "c", 7, 9), (2, "d", 1, 2)], "v_idx long, chrom string, v_start long, v_end long")
    q = spark.createDataFrame([(0, "c", 0, 20), (1, "c", 8, 9), (2, "e", 0, 9)], "q long, chrom string, q_start long, q_end long")
    s = spark.createDataFrame([(10,), (20,), (30,)], "sample_id long")
    c = spark.createDataFrame([(30, 1, 0), (30, 1, 1), (10, 0, 1), (20, 0, 2)], "sample_id long, hap int, v_idx long")
    got = {r["q"]: r["counts"] for r in cohort.region_counts(v, q, c, s).collect()}
    assert got == {0: [1, 0, 0, 0, 0, 2], 1: [1, 0, 0, 0, 0, 1], 2: [0] * 6}


def test_cohort_cases(spark):
    files_ = [(0, 0, "c", 5, 0, "A", "x=0", 0, 0, 0), (0, 1, "c", 5, 0, "A", "x=0b", 0, 0, 1), (1, 0, "c", 5, 0, "A", "x=1", 1, 0, 1), (1, 1, "c", 9, 1, "AT", "y=1", 1, 0, 0)]
    f = spark.createDataFrame(files_, "file_ord int, record_ord int, chrom string, pos long, ilen int, alt string, info string, sample_id int, hap int, allele int")
    assert rows(cohort.merge_atoms(f), "pos", "info", "files", "carriers") == [(5, "x=0", 2, 2), (9, "y=1", 1, 0)]
    s = spark.createDataFrame([(0, "b"), (1, "a")], "sample_ord int, name string")
    assert rows(cohort.pick_samples(s, ["a", "b", "a"]), "sample_ord", "name") == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        cohort.pick_samples(s, ["z"])
