"""Variant tables read out of the star schema: parts are variants, line items calls, events regions, suppliers samples.

Each table is one SQL text for both engines; what differs is spelled by a dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indexing import row_index
from ..runtime import Scratch


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark
        self.text = "STRING" if spark else "VARCHAR"

    def sequence(self, a: str, b: str, expr: str) -> str:
        """expr of x for x from a to b, joined to one text."""
        if self.spark:
            return f"array_join(transform(sequence({a}, {b}), x -> {expr}), '')"
        return f"array_to_string(list_transform(range({a}, {b} + 1), lambda x: {expr}), '')"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"


SPARK, DUCK = Dialect(True), Dialect(False)


def base(x: str, c: str = "c", shift: str = "0") -> str:
    """The base at 1-based position x of chromosome c."""
    return f"substr('ACGT', CAST(1 + (({x}) * 7 + ({c}) * 3 + CAST(floor(({x}) / 5) AS BIGINT) + CAST(floor(({x}) * ({x}) / 7) AS BIGINT) + {shift}) % 4 AS INT), 1)"


def variants(d: Dialect) -> str:
    """Numbered by chromosome and position; load() numbers them for Spark, without one global sort."""
    deleted = d.sequence("pos", "pos - ilen", base("x"))
    number = "" if d.spark else "CAST(row_number() OVER (ORDER BY chrom, pos, p_partkey) - 1 AS BIGINT) AS v_idx, "
    return f"""SELECT {number}p_partkey, p_size, p_retailprice, chrom, c, pos, ilen,
  CASE WHEN ilen < 0 THEN {deleted} ELSE {base("pos")} END AS ref,
  CASE WHEN ilen < 0 THEN {base("pos")} WHEN ilen > 0 THEN {base("pos")} || substr('ACGTTGCAACGTA', CAST(1 + k % 3 AS INT), ilen) ELSE {base("pos", shift="1 + p_size % 3")} END AS alt,
  CASE WHEN pos > 1 THEN {base("pos - 1")} ELSE '' END AS five, {base("pos + 1")} AS three, pos - 1 AS v_start, pos - least(ilen, 0) AS v_end
FROM (SELECT p_partkey, p_size, p_retailprice, p_partkey % 4 + 1 AS c, concat('chr', CAST(p_partkey % 4 + 1 AS {d.text})) AS chrom, k, k * 2 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + 2 AS pos,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN -(p_size % 13 + 1) WHEN p_partkey % 5 = 1 THEN p_size % 7 + 1 ELSE 0 END AS INT) AS ilen
  FROM (SELECT *, CAST(floor(p_partkey / 4) AS BIGINT) AS k FROM part) t) u"""


def calls(d: Dialect) -> str:
    return "SELECT l_suppkey AS sample_id, CAST(l_linenumber % 2 AS INT) AS hap, v.v_idx, v.chrom, v.pos, v.ilen, max(l_discount) AS dosage FROM lineitem l JOIN variants v ON v.p_partkey = l.l_partkey GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY l_suppkey, CAST(l_linenumber % 2 AS INT), v.v_idx, v.chrom, v.pos, v.ilen")


def regions(d: Dialect) -> str:
    return f"SELECT event_id AS q, concat('chr', CAST(event_id % 4 + 1 AS {d.text})) AS chrom, CAST(event_id * 13 % (np / 2 + 50) AS BIGINT) AS q_start, CAST(event_id * 13 % (np / 2 + 50) AS BIGINT) + event_id % 50 + 1 AS q_end FROM events CROSS JOIN (SELECT CAST(count(*) AS BIGINT) * 2 AS np FROM part) s".replace("np / 2 + 50", "CAST(floor(np / 4) AS BIGINT) + 50")


def samples(d: Dialect) -> str:
    return "SELECT s_suppkey AS sample_id, s_name AS name, CAST(s_nationkey AS INT) AS nation FROM supplier"


def records(d: Dialect) -> str:
    """Records with several, symbolic and breakend alleles and INFO texts."""
    a = d.array
    return f"""SELECT p_partkey AS rec, concat('chr', CAST(p_partkey % 4 + 1 AS {d.text})) AS chrom, CAST(p_partkey * 3 + 10 AS BIGINT) AS pos, CASE WHEN p_size % 4 = 0 THEN 'GAT' ELSE 'G' END AS ref,
  CASE p_partkey % 10 WHEN 0 THEN {a("'<DEL>'")} WHEN 1 THEN {a("'A'", "'<INS>'")} WHEN 2 THEN {a("'G[chr1:5['")} WHEN 3 THEN {a("'.'")} WHEN 4 THEN {a("'AT'", "'C'")} WHEN 5 THEN {a("'<DUP:TANDEM>'")} WHEN 6 THEN {a("'<CNV>'")} WHEN 7 THEN {a("'A.'")} WHEN 8 THEN {a("'GTT'")} ELSE {a("'T'", "'C'", "'A'")} END AS alt,
  concat('NS=3', CASE WHEN p_size % 3 = 0 THEN concat(';SVLEN=-', CAST(p_size + 1 AS {d.text})) ELSE '' END, CASE WHEN p_size % 2 = 0 THEN concat(';END=', CAST(p_partkey * 3 + 10 + p_size AS {d.text})) ELSE '' END, CASE WHEN p_size % 7 = 0 THEN ';IMPRECISE' ELSE '' END) AS info
FROM part"""


def cds(d: Dialect) -> str:
    """Coding intervals, 1-based and closed, with what a gene model says of them."""
    return f"""SELECT concat('chr', CAST(c_custkey % 4 + 1 AS {d.text})) AS chrom, c_custkey * 11 % (CAST(floor(np / 2) AS BIGINT) + 50) + 1 AS start, c_custkey * 11 % (CAST(floor(np / 2) AS BIGINT) + 50) + 31 + c_custkey % 90 AS "end",
  CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(CASE WHEN c_custkey % 4 < 3 THEN c_custkey % 4 END AS INT) AS frame, concat('G', CAST(c_custkey % 97 AS {d.text})) AS gene_id, concat('T', CAST(c_custkey AS {d.text})) AS transcript_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS gene_biotype, CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE CAST(c_custkey % 5 AS {d.text}) END AS tsl, CASE WHEN c_custkey % 7 = 0 THEN 'canonical' WHEN c_custkey % 7 = 1 THEN 'basic' END AS tag, CAST(c_custkey % 3 + 1 AS INT) AS level
FROM customer CROSS JOIN (SELECT count(*) AS np FROM part) s""".replace('"end"', "`end`" if d.spark else '"end"')


TABLES = {"variants": variants, "calls": calls, "regions": regions, "samples": samples, "records": records, "cds": cds}
#: Tables that each text reads.
READS = {"variants": ["part"], "calls": ["lineitem", "variants"], "regions": ["events", "part"], "samples": ["supplier"], "records": ["part"], "cds": ["customer", "part"]}


#: Derived tables that are written once per session and folder, as an index or a store would be, and read by all queries.
KEPT = ("variants", "calls")
_MADE: dict[tuple[str, str, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the files."""
    sf_dir = sf_dir.rstrip("/")
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in KEPT:
        return _derived(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        _MADE[key] = Scratch(spark).keep(_derived(spark, sf_dir, name))
    return _MADE[key]


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TABLES[name](SPARK)
    parts = {n: load(spark, sf_dir, n) for n in READS[name]}
    for n in parts:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    df = spark.sql(text, **parts)
    return row_index(df, [F.col("chrom"), F.floor(F.col("pos") / 4096)], ["pos", "p_partkey"], "v_idx") if name == "variants" else df


def oracle(body: str, *names: str) -> str:
    """body behind the derived tables it names, in the other dialect."""
    need: list[str] = []
    for n in names:
        for x in [*(r for r in READS[n] if r in TABLES), n]:
            if x not in need:
                need.append(x)
    head = ", ".join(f"{n} AS ({TABLES[n](DUCK)})" for n in need)
    return f"WITH {head} {body}" if not body.lstrip().startswith("WITH ") else f"WITH {head}, {body.lstrip()[5:]}"
