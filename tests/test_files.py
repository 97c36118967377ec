"""File readers, the store, the command line and arrivals, on literal files."""

import gzip

import numpy as np
import pytest

from locusframe import cli
from locusframe.sources import files
from locusframe.sources.store import Store, concat, write
from locusframe.streaming.arrivals import follow

HEAD = """##fileformat=VCFv4.2
##contig=<ID=chr2>
##contig=<ID=chr10>
##INFO=<ID=DP,Number=1,Type=Integer,Description="d">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=DS,Number=A,Type=Float,Description="s">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tann\tbob
"""
#: Two equal records, an indel, a missing genotype, and chr10 behind chr2 and before it in the file.
VCF = HEAD + """chr10\t700\t.\tC\tCTT\t.\t.\tDP=8\tGT:DS\t0|1:1.0\t0|0:0.0
chr2\t4001\tv1\tACG\tA\t7.25\tPASS\tDP=5;H\tGT:DS\t1|1:1.9\t0|1:1.0
chr2\t4001\t.\tT\tG\t.\t.\t.\tGT:DS\t./.:.\t1|0:0.8
chr2\t4001\t.\tT\tG\t.\t.\t.\tGT:DS\t./1:0.7\t0/0:0.1
chr2\t4050\t.\tg\ta\t.\t.\tDP=2\tGT:DS\t1|0:0.9\t1|1:2.0
"""


@pytest.fixture(scope="module")
def vcf(tmp_path_factory):
    p = tmp_path_factory.mktemp("vcf") / "a.vcf.gz"
    p.write_bytes(gzip.compress(VCF.encode()))
    return str(p)


def test_vcf(spark, vcf):
    v = files.Vcf(spark, vcf)
    assert v.samples == ["ann", "bob"] and v.info == ["DP"] and v.contigs == ["chr2", "chr10"]
    assert sorted([(r["DP"], r["qual"]) for r in v.records(["DP"]).where("chrom = 'chr2'").collect()], key=str) == [("2", None), ("5", 7.25), (None, None), (None, None)]
    with pytest.raises(ValueError):
        v.records(["GT"])
    order = sorted((r["v_idx"], r["chrom"], r["pos"], r["ref"]) for r in v.variants().collect())
    assert order == [(0, "chr2", 4001, "ACG"), (1, "chr2", 4001, "T"), (2, "chr2", 4001, "T"), (3, "chr2", 4050, "G"), (4, "chr10", 700, "C")]
    calls = sorted((r["sample_id"], r["hap"], r["v_idx"], round(r["dosage"], 1)) for r in v.calls(dosage="DS").collect())
    assert calls == [(0, 0, 0, 1.9), (0, 0, 3, 0.9), (0, 1, 0, 1.9), (0, 1, 2, 0.7), (0, 1, 4, 1.0), (1, 0, 1, 0.8), (1, 0, 3, 2.0), (1, 1, 0, 1.0), (1, 1, 3, 2.0)]
    g = v.genotypes().where("chrom = 'chr2' AND pos = 4001 AND ref = 'T'").orderBy("rec", "sample_ord", "hap").collect()
    assert [(r["allele"], r["phased"]) for r in g] == [(None, False), (None, False), (1, True), (0, True), (None, False), (1, False), (0, False), (0, False)]


def test_undeclared_contigs_in_natural_order(spark, tmp_path):
    lines = "".join(f"{c}\t5\t.\tA\tC\t.\t.\t.\tGT\t0|1\t0|0\n" for c in ("chr11", "chrX", "chr3", "chr10", "chr2"))
    (tmp_path / "a.vcf").write_text(HEAD + lines)
    got = sorted((r["v_idx"], r["chrom"]) for r in files.Vcf(spark, str(tmp_path / "a.vcf")).variants().collect())
    assert [c for _, c in got] == ["chr2", "chr10", "chr3", "chr11", "chrX"]


def test_pvar_bim_psam(spark, tmp_path):
    import zstandard

    (tmp_path / "a.pvar").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tINFO\n1\t10\t.\tg\tA,C\tSVLEN=3\n1\t12\trs1\tGA\tG\t.\n")
    got = files.pvar(spark, str(tmp_path / "a.pvar")).orderBy("v_idx").collect()
    assert [(r["v_idx"], r["ref"], r["alt"], r["ilen"], r["id"]) for r in got] == [(0, "G", ["A", "C"], [0, 0], None), (1, "GA", ["G"], [-1], "rs1")]
    (tmp_path / "b.pvar.zst").write_bytes(zstandard.compress((tmp_path / "a.pvar").read_bytes()))
    assert files.pvar(spark, str(tmp_path / "b.pvar.zst")).count() == 2
    (tmp_path / "a.bim").write_text("1\trs1\t0\t10\tA\tG\n1\trs2\t0\t0\tA\tG\n")
    assert [(r["ref"], r["alt"], r["pos"]) for r in files.pvar(spark, str(tmp_path / "a.bim")).collect()] == [("G", ["A"], 10)]
    (tmp_path / "a.psam").write_text("#FID\tIID\tSEX\n0\ts1\t1\n0\ts2\t2\n")
    assert [r["name"] for r in files.psam(spark, str(tmp_path / "a.psam")).orderBy("sample_ord").collect()] == ["s1", "s2"]


def test_fixed_width_genotypes(spark, tmp_path):
    r = np.random.default_rng(1)
    for samples in (1, 4, 5, 9):
        codes = r.integers(0, 4, (7, samples))
        body = bytearray()
        for row in codes:
            for k in range(0, samples, 4):
                body.append(sum(int(c) << 2 * i for i, c in enumerate(row[k : k + 4])))
        # twelve bytes: magic, mode, both counts, a control byte
        head = b"\x6c\x1b\x02" + (7).to_bytes(4, "little") + samples.to_bytes(4, "little") + b"\x40"
        (tmp_path / "a.pgen").write_bytes(head + bytes(body))
        got = {(r["v_idx"], r["sample_ord"], r["hap"]): r["allele"] for r in files.pgen(spark, str(tmp_path / "a.pgen"), samples).collect()}
        pairs = [(0, 0), (0, 1), (1, 1), (None, None)]
        want = {(v, s, h): pairs[codes[v, s]][h] for v in range(7) for s in range(samples) for h in range(2)}
        assert got == want
        full = np.array([[[-1 if want[v, s, h] is None else want[v, s, h] for h in range(2)] for s in range(samples)] for v in range(7)])
        assert files.pgen_bytes(full) == head + bytes(body)
    for bad, text in ((b"\x6c\x1b\x10" + bytes(9), "fixed width"), (head + bytes(body)[:-1], "length"), (head[:7] + (3).to_bytes(4, "little") + b"\x40" + bytes(body), "samples")):
        (tmp_path / "b.pgen").write_bytes(bad)
        with pytest.raises(Exception, match=text):
            files.pgen(spark, str(tmp_path / "b.pgen"), 9).collect()


def test_fasta_of_many_sequences(spark, tmp_path):
    (tmp_path / "m.fa").write_text("".join(f">s{k} x\n{'ACGT' * (k % 5)}\n{'TT' * (k % 3)}\n" for k in range(1500)))
    got = {r["chrom"]: r["seq"] for r in files.fasta(spark, str(tmp_path / "m.fa")).collect()}
    assert got == {f"s{k}": s for k in range(1500) if (s := "ACGT" * (k % 5) + "TT" * (k % 3))}


def test_indexes_are_made_again_when_old(spark, vcf, tmp_path):
    import os

    from locusframe.sources.store import fresh

    out = str(tmp_path / "i")
    assert not fresh(spark, out, vcf)
    cli.main(["index", vcf, out], spark)
    assert fresh(spark, out, vcf) and spark.read.parquet(out).count() == 5
    os.utime(out, (0, 0))
    assert not fresh(spark, out, vcf)
    cli.main(["index", vcf, out], spark)
    assert fresh(spark, out, vcf)


def test_written_genotype_files(spark, tmp_path, monkeypatch):
    """Parts of a few variants each, 2 and 3 of them and the last one's cells padded; all cells, carried ones and texts agree."""
    monkeypatch.setattr(files, "PGEN_PART", 6)
    r = np.random.default_rng(2)
    full = (r.random((7, 5, 2)) < 0.4).astype(int)
    full[4] = 0
    full[:, :, 0] &= full[:, :, 1]  # a file doesn't say which haplotype carries one copy
    carried = spark.createDataFrame([tuple(map(int, x)) for x in np.argwhere(full)], "v_idx long, sample_ord long, hap int")
    path = str(tmp_path / "a.pgen")
    files.pgen_write(carried, spark.range(7).withColumnRenamed("id", "v_idx"), 5, path)
    assert len(list((tmp_path / "a.pgen").glob("f=*"))) == 3
    want = {(v, s, h): int(full[v, s, h]) for v in range(7) for s in range(5) for h in range(2)}
    assert {tuple(x)[:3]: x[3] for x in files.pgen(spark, path, 5).collect()} == want
    assert sorted(tuple(x) for x in files.pgen(spark, path, 5, carried=True).collect()) == sorted((*k, 1) for k, a in want.items() if a)
    assert {x["v_idx"]: x["dosages"] for x in files.pgen_texts(spark, path, 5).collect()} == {v: " ".join(map(str, full[v].sum(1))) for v in range(7)}


def test_file_lists(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "b.vcf").write_text(head + "bob\nc\t9\t.\tGA\tG\t.\t.\t.\tGT\t0|1\nc\t3\t.\tA\tT\t.\t.\t.\tGT\t1|1\n")
    (tmp_path / "a.vcf").write_text(head + "ann\nc\t3\t.\tAC\tTC,<DEL>\t.\t.\t.\tGT\t1|2\n")
    assert [p.rpartition("/")[2] for p in files.sources(spark, str(tmp_path))] == ["a.vcf", "b.vcf"]
    (tmp_path / "list.txt").write_text("# mine\nb.vcf\na.vcf\n")
    assert files.VcfList(spark, files.sources(spark, str(tmp_path / "list.txt"))).samples == ["bob", "ann"]
    cli.main(["write", str(tmp_path), str(tmp_path / "s")], spark)
    s = Store(spark, str(tmp_path / "s"))
    assert s.samples == ["ann", "bob"]
    assert sorted((r["v_idx"], r["pos"], r["ilen"], r["alt"]) for r in s.variants.collect()) == [(0, 3, 0, "T"), (1, 9, -1, "G")]
    assert sorted((r["sample_id"], r["hap"], r["v_idx"]) for r in s.calls.collect()) == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1)]
    with pytest.raises(Exception, match="unsupported"):
        cli.main(["write", str(tmp_path), str(tmp_path / "t"), "--alt-policy", "error"], spark)
    (tmp_path / "c.vcf").write_text(head + "bob\n")
    with pytest.raises(ValueError, match="same sample"):
        files.VcfList(spark, files.sources(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="contigs"):
        cli.main(["view", str(tmp_path / "s"), str(tmp_path / "v"), "--regions", "zz:1-5"], spark)


def test_conversion_checks_the_reference(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c\nACGTTTTGCA\n")
    body = "c\t7\t.\tTG\tTTG,T\t.\t.\t.\tGT\t1|2\nc\t2\t.\tT\tG\t.\t.\t.\tGT\t0|1\n"  # the second REF is wrong
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tann\n" + body)
    with pytest.raises(Exception, match="differs"):
        cli.main(["write", str(tmp_path / "a.vcf"), str(tmp_path / "e"), "--reference", str(tmp_path / "r.fa")], spark)
    cli.main(["write", str(tmp_path / "a.vcf"), str(tmp_path / "s"), "--reference", str(tmp_path / "r.fa"), "--ref-policy", "x"], spark)
    s = Store(spark, str(tmp_path / "s"))
    assert sorted((r["v_idx"], r["pos"], r["ilen"], r["alt"]) for r in s.variants.collect()) == [(0, 3, 1, "GT"), (1, 7, -1, "T")]
    assert sorted((r["hap"], r["v_idx"]) for r in s.calls.collect()) == [(0, 0), (1, 1)]


def test_a_store_survives_a_failed_swap(spark, tmp_path):
    v = spark.createDataFrame([(0, "c", 5)], "v_idx long, chrom string, pos long")
    c = spark.createDataFrame([(0, 0, 0, "c", 5)], "sample_id long, hap int, v_idx long, chrom string, pos long")
    out = tmp_path / "s"
    write(str(out), v, c, ["a"])
    out.rename(tmp_path / "s__old")  # a run that ended between its two renames
    with pytest.raises(Exception, match="s"):
        Store(spark, str(out))
    write(str(out), v, c, ["b"])
    assert Store(spark, str(out)).samples == ["b"] and not (tmp_path / "s__old").exists()
    (tmp_path / "s__old").mkdir()  # left by a run that ended behind its swap
    write(str(out), v, c, ["d"], overwrite=True)
    assert Store(spark, str(out)).samples == ["d"] and sorted(x.name for x in tmp_path.iterdir() if x.name.startswith("s")) == ["s"]


def test_regions_genes_sequences(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchr1\t5\t9\tname\n\nchr2\t0\t3\n")
    assert [tuple(r) for r in files.bed(spark, str(tmp_path / "a.bed")).select("q", "chrom", "q_start", "q_end").orderBy("q").collect()] == [(0, "chr1", 5, 9), (1, "chr2", 0, 3)]
    assert [tuple(r) for r in files.regions(spark, ["chr1:11-20", ("2", 0, 5)]).collect()] == [(0, "chr1", 10, 20), (1, "2", 0, 5)]
    (tmp_path / "a.gtf").write_text('#x\nchr1\ts\tgene\t11\t20\t.\t+\t.\tgene_id "G1"; level 2;\nchr1\ts\tCDS\t12\t14\t.\t+\t1\tgene_id "G1"; transcript_id "T1"; tag "canonical"; transcript_support_level "1 (x)";\n')
    assert [tuple(r) for r in files.genes(spark, str(tmp_path / "a.gtf")).collect()] == [("chr1", 10, 20, "+")]
    cds = files.gtf(spark, str(tmp_path / "a.gtf")).where("feature = 'CDS'").first()
    assert (cds["frame"], cds["transcript_id"], cds["tag"], cds["tsl"], cds["gene_name"]) == (1, "T1", "canonical", "1 (x)", None)
    (tmp_path / "a.fa").write_text(">c1 first\nacgta\nCGTAC\nG\n>c2\nTTT\n")
    ref = files.fasta(spark, str(tmp_path / "a.fa"), size=4)
    assert sorted(tuple(r) for r in ref.collect()) == [("c1", 0, "ACGT"), ("c1", 1, "ACGT"), ("c1", 2, "ACG"), ("c2", 0, "TTT")]
    assert files.fetch(ref, "c1", -2, 13, size=4) == "NNACGTACGTACGNN" and files.fetch(ref, "zz", 0, 2, size=4) == "NN"


def test_signature_table(spark, tmp_path):
    from locusframe.operators.mutcat import labels

    text = "Type\tS1\n" + "".join(f"{x}\t{i}\n" for i, x in enumerate(reversed(labels("SBS96"))))
    (tmp_path / "s.txt").write_text(text)
    got = {r["code"]: r["weight"] for r in files.signatures(spark, str(tmp_path / "s.txt")).collect()}
    assert len(got) == 96 and got[0] == 95.0
    (tmp_path / "bad.txt").write_text(text.rsplit("\n", 3)[0] + "\n")
    with pytest.raises(ValueError):
        files.signatures(spark, str(tmp_path / "bad.txt"))


def test_command_line(spark, vcf, tmp_path):
    out = str(tmp_path / "store")
    cli.main(["write", vcf, out, "--dosage", "DS"], spark)
    s = Store(spark, out)
    assert s.samples == ["ann", "bob"] and s.contigs == ["chr2", "chr10"] and s.n_variants() == 4 and s.calls.count() == 9
    with pytest.raises(FileExistsError):
        cli.main(["write", vcf, out], spark)
    with pytest.raises(ValueError):
        Store(spark, out, fields=["XX"])
    assert "dosage" not in Store(spark, out, fields=[]).calls.columns
    cli.main(["view", out, str(tmp_path / "v"), "--regions", "2:4050-4050", "--samples", "ann"], spark)
    v = Store(spark, str(tmp_path / "v"))
    assert [(r["v_idx"], r["pos"]) for r in v.variants.collect()] == [(0, 4050)] and v.calls.count() == 1 and v.samples == ["ann"]
    with pytest.raises(SystemExit):
        cli.main(["view", out, str(tmp_path / "w")], spark)
    for c in ("chr2", "chr10"):
        cli.main(["split", out, str(tmp_path / c), "--contigs", c.removeprefix("chr")], spark)
    cli.main(["concat", str(tmp_path / "both"), str(tmp_path / "chr2"), str(tmp_path / "chr10")], spark)
    assert Store(spark, str(tmp_path / "both")).calls.count() == 9
    with pytest.raises(ValueError):
        concat([s.calls, s.calls])
    cli.main(["write", vcf, str(tmp_path / "hap"), "--haploid"], spark)
    h = Store(spark, str(tmp_path / "hap"))
    assert h.ploidy == 1 and h.calls.count() == 7
    cli.main(["index", vcf, str(tmp_path / "idx")], spark)


def test_arrivals(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "sample_id long, hap int, v_idx long, chrom string"
    for k in range(2):
        spark.createDataFrame([(0, 0, 1, "c"), (k, 1, 2, "c"), (k, 1, 2, "c")], schema).write.mode("append").parquet(src)
        follow(spark, src, out, ck).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("sample_id", "hap", "v_idx").collect()) == [(0, 0, 1), (0, 1, 2), (1, 1, 2)]
