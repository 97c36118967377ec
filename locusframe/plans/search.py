"""Queries on predicates, ranges and joins, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contigs, predicates
from ..operators import cohort, intervals, normalize
from ..operators.indexing import chunks, row_index
from .derive import load, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql, *tables) if tables else sql
        return f

    return add


BREAK = predicates.BREAKEND
ILENS = "list_transform(alt, lambda a: CASE WHEN a LIKE '<%' OR regexp_matches(a, '{b}') THEN NULL ELSE CAST(strlen(a) - strlen(ref) AS INT) END)".replace("{b}", BREAK)
MAG = "coalesce(abs(TRY_CAST(nullif(regexp_extract(info, '(?:^|;)SVLEN=(-?\\d+)', 1), '') AS INT)), abs(TRY_CAST(nullif(regexp_extract(info, '(?:^|;)END=(\\d+)', 1), '') AS INT) - pos))"
SYM = f"list_transform(alt, lambda a: CASE WHEN regexp_matches(a, '{BREAK}') THEN NULL WHEN a LIKE '<%' THEN CASE WHEN regexp_matches(info, '(?:^|;)IMPRECISE(?:;|$)') THEN NULL WHEN regexp_extract(a, '^<([^:>]*)', 1) = 'DEL' THEN -{MAG} WHEN regexp_extract(a, '^<([^:>]*)', 1) IN ('INS', 'DUP') THEN {MAG} END ELSE strlen(a) - strlen(ref) END)"
#: What stands for no id.
NONE = 2147483647
HIT = "v.chrom = r.chrom AND v.v_start < r.q_end AND v.v_end > r.q_start"


def _ilens(spark, d):
    return load(spark, d, "records").withColumn("ilen", predicates.symbolic_ilen())


@query("f1_is_snp", f"SELECT rec, len(list_filter(x, lambda i: i IS NULL OR i <> 0)) = 0 AS is_snp FROM (SELECT rec, {SYM} AS x FROM records)", "records")
def f1(spark, d):
    return _ilens(spark, d).select("rec", predicates.is_snp().alias("is_snp"))


@query("f2_is_indel", f"SELECT rec, len(list_filter(x, lambda i: i IS NULL OR i = 0)) = 0 AS is_indel FROM (SELECT rec, {SYM} AS x FROM records)", "records")
def f2(spark, d):
    return _ilens(spark, d).select("rec", predicates.is_indel().alias("is_indel"))


@query("f3_is_biallelic", "SELECT rec, len(alt) = 1 AS is_biallelic FROM records", "records")
def f3(spark, d):
    return load(spark, d, "records").select("rec", predicates.is_biallelic().alias("is_biallelic"))


@query("f4_is_symbolic", "SELECT rec, len(list_filter(alt, lambda a: a LIKE '<%')) > 0 AS is_symbolic FROM records", "records")
def f4(spark, d):
    return load(spark, d, "records").select("rec", predicates.is_symbolic().alias("is_symbolic"))


@query("f5_is_breakend", f"SELECT rec, len(list_filter(alt, lambda a: regexp_matches(a, '{BREAK}'))) > 0 AS is_breakend FROM records", "records")
def f5(spark, d):
    return load(spark, d, "records").select("rec", predicates.is_breakend().alias("is_breakend"))


@query("f6_is_imprecise", f"SELECT rec, len(list_filter(x, lambda i: i IS NULL)) > 0 AS is_imprecise FROM (SELECT rec, {SYM} AS x FROM records)", "records")
def f6(spark, d):
    return _ilens(spark, d).select("rec", predicates.is_imprecise().alias("is_imprecise"))


@query("f7_literal_ilen", "SELECT rec, i AS alt_no, CAST(strlen(alt[i]) - strlen(ref) AS INT) AS ilen FROM (SELECT *, unnest(range(1, len(alt) + 1)) AS i FROM records)", "records")
def f7(spark, d):
    r = load(spark, d, "records").withColumn("l", predicates.literal_ilen())
    return r.select("rec", F.posexplode("l").alias("i", "ilen")).select("rec", (F.col("i") + 1).cast("long").alias("alt_no"), "ilen")


@query("f8_symbolic_ilen", f"SELECT rec, i AS alt_no, x[i] IS NOT NULL AS known, CAST(coalesce(x[i], 0) AS INT) AS ilen FROM (SELECT rec, {SYM} AS x, unnest(range(1, len(alt) + 1)) AS i FROM records)", "records")
def f8(spark, d):
    return _ilens(spark, d).select("rec", F.posexplode("ilen").alias("i", "l")).select("rec", (F.col("i") + 1).cast("long").alias("alt_no"), F.col("l").isNotNull().alias("known"), F.coalesce("l", F.lit(0)).alias("ilen"))


@query("f9_user_filter", "SELECT CAST(row_number() OVER (ORDER BY v_idx) - 1 AS BIGINT) AS v_pos, v_idx AS v_phys FROM variants WHERE ilen <> 0 AND p_size > 10", "variants")
def f9(spark, d):
    kept = load(spark, d, "variants").where((F.col("ilen") != 0) & (F.col("p_size") > 10))
    return row_index(kept, [F.floor(F.col("v_idx") / 65536)], ["v_idx"], "v_pos").select("v_pos", F.col("v_idx").alias("v_phys"))


for _mode, _cond in (("pos", "v.v_start >= r.q_start AND v.v_start < r.q_end"), ("record", "v.v_start >= r.q_start AND v.v_start < r.q_end + 1"), ("variant", "v.v_start < r.q_end AND v.v_end > r.q_start")):
    _id = {"pos": "f11", "record": "f12", "variant": "f13"}[_mode]

    @query(f"{_id}_member_{_mode}", f"SELECT q, v_idx FROM variants v JOIN regions r ON v.chrom = r.chrom AND {_cond}", "variants", "regions")
    def _member(spark, d, mode=_mode):
        return intervals.position_members(load(spark, d, "variants"), load(spark, d, "regions"), mode)


@query(
    "f14_member_allele",
    """SELECT DISTINCT q, v_idx FROM (SELECT *, pos - 1 + p AS s, greatest(pos - 1 + greatest(length(ref), p), pos - 1 + p) AS e FROM
  (SELECT *, CASE WHEN ref[1:1] <> alt[1:1] THEN 0 ELSE coalesce(list_min(list_filter(range(1, least(length(ref), length(alt)) + 1), lambda i: substr(ref, i, 1) <> substr(alt, i, 1))) - 1, least(length(ref), length(alt))) END AS p FROM variants)) v
  JOIN regions r ON v.chrom = r.chrom AND CASE WHEN e > s THEN s < q_end AND e > q_start ELSE s > q_start AND s < q_end END""",
    "variants",
    "regions",
)
def f14(spark, d):
    return intervals.allele_members(load(spark, d, "variants"), load(spark, d, "regions"))


@query("f15_multi_region_contigs", "SELECT chrom, count(*) AS n FROM regions GROUP BY chrom HAVING count(*) > 1", "regions")
def f15(spark, d):
    return intervals.single_region_contigs(load(spark, d, "regions"))


ISLANDS = "islands AS (SELECT *, sum(CASE WHEN e >= q_start THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY q_start, q_end, q) AS i FROM (SELECT *, max(q_end) OVER (PARTITION BY chrom ORDER BY q_start, q_end, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM regions))"


@query("f16_merge_regions", f"WITH {ISLANDS} SELECT chrom, min(q_start) AS q_start, max(q_end) AS q_end, count(*) AS n FROM islands GROUP BY chrom, i", "regions")
def f16(spark, d):
    return intervals.merge_regions(load(spark, d, "regions"))


@query("f17_overlapping_regions", f"WITH {ISLANDS} SELECT q, chrom, q_start, q_end FROM islands WHERE q_start < e", "regions")
def f17(spark, d):
    return intervals.overlapping_regions(load(spark, d, "regions"))


@query("f18_covered_contigs", f"WITH {ISLANDS}, m AS (SELECT chrom, min(q_start) AS s, max(q_end) AS e FROM islands GROUP BY chrom, i) SELECT v.chrom, coalesce(bool_or(s <= 0 AND e >= last), false) AS covered FROM (SELECT chrom, max(pos) AS last FROM variants GROUP BY chrom) v LEFT JOIN m USING (chrom) GROUP BY v.chrom", "regions", "variants")
def f18(spark, d):
    return intervals.covered_contigs(load(spark, d, "variants"), load(spark, d, "regions"))


@query("f20_haploid", "SELECT DISTINCT sample_id, CAST(0 AS INT) AS hap, v_idx FROM calls", "calls")
def f20(spark, d):
    return cohort.haploid(load(spark, d, "calls"))


@query("f19_sample_subset", "SELECT sample_id, name, CAST(row_number() OVER (ORDER BY nation, sample_id DESC) - 1 AS BIGINT) AS sample_ord FROM samples WHERE nation < 5", "samples")
def f19(spark, d):
    s = load(spark, d, "samples")
    chosen = [r["name"] for r in s.where("nation < 5").orderBy("nation", F.desc("sample_id")).collect()]
    return cohort.pick_samples(s, chosen).select("sample_id", "name", F.col("sample_ord").cast("long"))


@query("f21_alt_policy", f"SELECT chrom, count(*) FILTER (a IN ('*', '.')) AS n_skip, count(*) FILTER (a NOT IN ('*', '.') AND (a LIKE '<%' OR regexp_matches(a, '{BREAK}'))) AS n_unsupported FROM (SELECT chrom, unnest(alt) AS a FROM records) GROUP BY chrom", "records")
def f21(spark, d):
    r = normalize.split_alleles(load(spark, d, "records")).withColumn("p", normalize.out_of_scope(F.col("alt")))
    return r.groupBy("chrom").agg(F.count_if(F.col("p") == "skip").alias("n_skip"), F.count_if(F.col("p") == "unsupported").alias("n_unsupported"))


@query("f23_contig_alias", "SELECT chrom, CASE WHEN chrom IN ('M', 'MT', 'chrM', 'chrMT') THEN 'MT' ELSE regexp_replace(chrom, '^chr', '') END AS canonical, count(*) AS n FROM (SELECT CASE WHEN v_idx % 3 = 0 THEN substr(chrom, 4) WHEN v_idx % 7 = 0 THEN 'chrM' WHEN v_idx % 11 = 0 THEN 'MT' ELSE chrom END AS chrom FROM variants) GROUP BY 1, 2", "variants")
def f23(spark, d):
    v = load(spark, d, "variants").select(F.expr("CASE WHEN v_idx % 3 = 0 THEN substr(chrom, 4) WHEN v_idx % 7 = 0 THEN 'chrM' WHEN v_idx % 11 = 0 THEN 'MT' ELSE chrom END").alias("chrom"))
    return v.groupBy("chrom", contigs.canonical(F.col("chrom")).alias("canonical")).agg(F.count("*").alias("n"))


@query("f24_mixed_spellings", "SELECT regexp_replace(c, '^chr', '') AS canonical, count(DISTINCT c) AS spellings FROM (SELECT CASE WHEN v_idx % 3 = 0 AND chrom <> 'chr2' THEN substr(chrom, 4) ELSE chrom END AS c FROM variants) GROUP BY 1 HAVING count(DISTINCT c) > 1", "variants")
def f24(spark, d):
    v = load(spark, d, "variants").select(F.expr("CASE WHEN v_idx % 3 = 0 AND chrom <> 'chr2' THEN substr(chrom, 4) ELSE chrom END").alias("c"))
    return v.groupBy(contigs.canonical(F.col("c")).alias("canonical")).agg(F.countDistinct("c").alias("spellings")).where("spellings > 1")


@query("f25_numeric_attrs", "SELECT v_idx, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM variants", "variants")
def f25(spark, d):
    v = load(spark, d, "variants")
    numeric = [f.name for f in v.select("p_size", "p_retailprice", "ref").schema if f.dataType.typeName() in ("integer", "long", "short", "float", "double")]
    return v.select("v_idx", *[F.col(c).cast("long") if c == "p_size" else F.col(c) for c in numeric])


@query("j1_overlap", f"SELECT r.q, v.v_idx FROM variants v JOIN regions r ON {HIT}", "variants", "regions")
def j1(spark, d):
    return intervals.overlap_join(load(spark, d, "variants"), load(spark, d, "regions")).select("q", "v_idx")


@query("j2_counts", f"SELECT r.q, count(v.v_idx) AS n FROM regions r LEFT JOIN variants v ON {HIT} GROUP BY r.q", "variants", "regions")
def j2(spark, d):
    return intervals.count_overlaps(load(spark, d, "variants"), load(spark, d, "regions"))


@query("j3_var_ranges", f"SELECT r.q, coalesce(min(v.v_idx), {NONE}) AS first_v, coalesce(max(v.v_idx) + 1, {NONE}) AS end_v FROM regions r LEFT JOIN variants v ON {HIT} GROUP BY r.q", "variants", "regions")
def j3(spark, d):
    return intervals.id_ranges(load(spark, d, "variants"), load(spark, d, "regions")).fillna(NONE)


CARRIED = f"carried AS (SELECT r.q, c.sample_id, c.hap, v.v_idx, v.pos, v.ilen, v.alt FROM variants v JOIN regions r ON {HIT} JOIN calls c ON c.v_idx = v.v_idx)"


def _carried(spark, d):
    c = load(spark, d, "calls").select("sample_id", "hap", "v_idx")
    return cohort.carriers(load(spark, d, "variants"), load(spark, d, "regions"), c)


@query("j4_carriers", f"WITH {CARRIED} SELECT q, count(*) AS n, CAST(sum(v_idx) AS BIGINT) AS ids, count(DISTINCT sample_id) AS samples FROM carried GROUP BY q", "calls", "regions")
def j4(spark, d):
    return cohort.carrier_totals(load(spark, d, "variants"), load(spark, d, "regions"), load(spark, d, "calls").select("sample_id", "hap", "v_idx"))


@query("j4_range_carriers", f"WITH x AS (SELECT r.q, min(v.v_idx) AS a, max(v.v_idx) AS z FROM regions r JOIN variants v ON {HIT} GROUP BY r.q) SELECT q, sample_id, hap, count(*) AS n FROM x JOIN calls c ON c.v_idx BETWEEN a AND z GROUP BY 1, 2, 3", "calls", "regions")
def j4r(spark, d):
    return cohort.range_counts(load(spark, d, "variants"), load(spark, d, "regions"), load(spark, d, "calls").select("sample_id", "hap", "v_idx"))


ROUTED = "SELECT c.*, CASE WHEN v_idx % 3 = 0 THEN 'dense' ELSE 'var_key' END AS route FROM calls c"


@query("j5_route_union", f"SELECT sample_id, hap, v_idx, route, row_number() OVER (PARTITION BY sample_id, hap, chrom ORDER BY pos, ilen <> 0, v_idx) - 1 AS ord FROM ({ROUTED})", "calls")
def j5(spark, d):
    from pyspark.sql import Window

    c = load(spark, d, "calls")
    dense, keyed = c.where("v_idx % 3 = 0").withColumn("route", F.lit("dense")), c.where("v_idx % 3 <> 0").withColumn("route", F.lit("var_key"))
    w = Window.partitionBy("sample_id", "hap", "chrom").orderBy("pos", F.col("ilen") != 0, "v_idx")
    return keyed.unionByName(dense).select("sample_id", "hap", "v_idx", "route", (F.row_number().over(w) - 1).cast("long").alias("ord"))


FILES = "SELECT c.sample_id AS file_ord, c.v_idx AS record_ord, c.chrom, c.pos, c.ilen, v.alt, c.sample_id, c.hap, CAST(CASE WHEN (c.sample_id + c.v_idx) % 5 = 0 THEN 0 ELSE 1 END AS INT) AS allele, concat('DP=', CAST(c.sample_id * 7 % 50 AS {t})) AS info FROM {calls} c JOIN {variants} v ON c.v_idx = v.v_idx"


@query("j6_atom_merge", f"WITH f AS ({FILES.format(t='VARCHAR', calls='calls', variants='variants')}) SELECT chrom, pos, ilen, alt, arg_min(info, file_ord) AS info, count(DISTINCT file_ord) AS files, sum(allele)::BIGINT AS carriers FROM f GROUP BY chrom, pos, ilen, alt", "calls")
def j6(spark, d):
    files = spark.sql(FILES.format(t="STRING", calls="{calls}", variants="{variants}"), calls=load(spark, d, "calls"), variants=load(spark, d, "variants"))
    return cohort.merge_atoms(files)


@query("j7_cds_join", 'SELECT v_idx, transcript_id FROM variants v JOIN cds k ON v.chrom = k.chrom AND v.pos <= k."end" AND v.v_end >= k.start', "variants", "cds")
def j7(spark, d):
    return intervals.closed_join(load(spark, d, "variants"), load(spark, d, "cds")).select("v_idx", "transcript_id")


@query("j9_index_subset", "SELECT v_idx, count(*) AS n, any_value(pos) AS pos FROM calls WHERE dosage > 0.05 GROUP BY v_idx", "calls")
def j9(spark, d):
    kept = load(spark, d, "calls").where("dosage > 0.05").groupBy("v_idx").agg(F.count("*").alias("n"))
    return kept.join(load(spark, d, "variants").select("v_idx", "pos"), "v_idx")


@query("j11_semi_join", f"SELECT v_idx, sample_id, hap FROM calls WHERE v_idx IN (SELECT v.v_idx FROM variants v JOIN regions r ON {HIT})", "calls", "regions")
def j11(spark, d):
    kept = intervals.overlap_join(load(spark, d, "variants"), load(spark, d, "regions")).select("v_idx").distinct()
    return load(spark, d, "calls").join(kept, "v_idx", "left_semi").select("v_idx", "sample_id", "hap")


GENES = 'SELECT chrom, start - 1 AS start, "end", strand FROM cds'
SWEEP = f"""ends AS (SELECT chrom, start AS x, CASE strand WHEN '+' THEN 1 ELSE 0 END AS p, CASE strand WHEN '-' THEN 1 ELSE 0 END AS m FROM ({GENES}) UNION ALL SELECT chrom, "end", CASE strand WHEN '+' THEN -1 ELSE 0 END, CASE strand WHEN '-' THEN -1 ELSE 0 END FROM ({GENES})),
 steps AS (SELECT chrom, x, sum(p) AS p, sum(m) AS m FROM ends GROUP BY chrom, x), lev AS (SELECT chrom, x, lead(x) OVER (PARTITION BY chrom ORDER BY x) AS nx, CASE WHEN sum(p) OVER w > 0 THEN 1 ELSE 0 END + CASE WHEN sum(m) OVER w > 0 THEN 2 ELSE 0 END AS value FROM steps WINDOW w AS (PARTITION BY chrom ORDER BY x ROWS UNBOUNDED PRECEDING)),
 isl AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY x ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY chrom ORDER BY x) = value THEN 0 ELSE 1 END AS n FROM lev)),
 strands AS (SELECT chrom, min(x) AS start, max(nx) AS "end", CAST(value AS INT) AS value FROM isl WHERE value > 0 AND nx IS NOT NULL GROUP BY chrom, i, value)"""


def _genes(spark, d):
    return load(spark, d, "cds").select("chrom", (F.col("start") - 1).alias("start"), "end", "strand")


@query("a8_strand_intervals", f"WITH {SWEEP} SELECT * FROM strands", "cds")
def a8(spark, d):
    return intervals.strand_intervals(_genes(spark, d))


@query("j12_point_in_interval", f"WITH {SWEEP} SELECT v_idx, coalesce(value, 0) AS value FROM variants v LEFT JOIN strands s ON s.chrom = v.chrom AND v.v_start >= s.start AND v.v_start < s.\"end\"", "cds", "variants")
def j12(spark, d):
    points = load(spark, d, "variants").select(F.col("v_idx").alias("p"), "chrom", F.col("v_start").alias("pos0"))
    return intervals.point_lookup(points, intervals.strand_intervals(_genes(spark, d))).select(F.col("p").alias("v_idx"), F.coalesce("value", F.lit(0)).alias("value"))


@query("q7_var_idxs", f"SELECT r.q, v.v_idx, row_number() OVER (ORDER BY r.q, v.v_idx) - 1 AS at FROM variants v JOIN regions r ON {HIT}", "variants", "regions")
def q7(spark, d):
    hits = intervals.overlap_join(load(spark, d, "variants"), load(spark, d, "regions")).select("q", "v_idx")
    return row_index(hits, [F.floor(F.col("q") / 256)], ["q", "v_idx"], "at")


@query("w5_offsets", f"SELECT q, n, CAST(sum(n) OVER (ORDER BY q) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY q) AS BIGINT) AS stop FROM (SELECT r.q, count(v.v_idx) AS n FROM regions r LEFT JOIN variants v ON {HIT} GROUP BY r.q)", "variants", "regions")
def w5(spark, d):
    return cohort.read_offsets(load(spark, d, "variants"), load(spark, d, "regions"))


@query("w8_chunks", f"SELECT r.q, v.v_idx, CAST(ntile(3) OVER (PARTITION BY r.q ORDER BY v.v_idx) - 1 AS INT) AS chunk FROM variants v JOIN regions r ON {HIT}", "variants", "regions")
def w8(spark, d):
    hits = intervals.overlap_join(load(spark, d, "variants"), load(spark, d, "regions")).select("q", "v_idx")
    return chunks(hits, ["q"], ["v_idx"], 3)


@query("q18_max_end_key", f"SELECT r.q, coalesce(max((v.pos - 1) * 2097152 + (1 - least(v.ilen, 0))), 0) AS end_key FROM regions r LEFT JOIN variants v ON {HIT} GROUP BY r.q", "variants", "regions")
def q18(spark, d):
    return cohort.end_keys(load(spark, d, "variants"), load(spark, d, "regions"))
