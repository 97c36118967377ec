"""URL filters: a sort-merge range join of canonical keys with nested prefix rules, in SQL expressions only.

A rule's key is its host with the labels reversed, a separator, and its path; it fits all keys in the interval
[key, key + 0xFF). A URL has such a key for each of its host's trailing parts that is no longer than the longest
rule's host. Keys of both kinds are dealt to ranges, a rule to every range that its interval meets.
A range with more keys than an even share, as where one URL holds many rows, is dealt to as many parts as
it has shares, each with all its rules. Each part is swept in order: a rule's start pushes it, its end pops it, the running sum of both is the
stack's depth, and the last start at each depth is the stack's entry there.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions
from .ranges import element, placement, quantiles, range_id

DEFAULT = "allow"
#: Sampled keys per range, and bytes of a key that a boundary keeps.
SAMPLE_PER_RANGE = 32
BOUND_BYTES = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: str) -> dict:
    """Columns host and path of a url column."""
    rest = f"IF(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')"
    host = f"regexp_extract({rest}, '^[^/?#]*', 0)"
    path = f"regexp_extract(substring({rest}, length({host}) + 1), '^[^?#]*', 0)"
    return {"host": F.expr(f"coalesce(translate({host}, '{_UPPER}', '{_LOWER}'), '')"), "path": F.expr(f"coalesce({path}, '')")}


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) pairs such as ('com/en/', 'block') as a DataFrame."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def _keys(rules: DataFrame) -> DataFrame:
    """One row for each rule: key, labels, rule, verdict; of rules that differ in the verdict alone, allow stays."""
    host, path = "translate(regexp_extract(rule, '^[^/]*', 0), '%s', '%s')" % (_UPPER, _LOWER), "regexp_extract(rule, '/.*', 0)"
    parts = rules.select(F.expr(host).alias("host"), F.expr(path).alias("path"), "verdict").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    return parts.selectExpr("CAST(concat(array_join(reverse(split(host, '[.]')), '.'), '#', path) AS BINARY) AS key", "size(split(host, '[.]')) AS labels", "concat(host, path) AS rule", "verdict")


def _events(rules: DataFrame, bounds: list[bytes], first: list[int], salts: list[int]) -> DataFrame:
    """A start and an end for each rule in each part of each range that its interval meets; first, salts: number of each range's first part, and its parts."""
    ranged = rules.withColumn("hi", F.expr("concat(key, X'FF')")).withColumn("r", F.explode(F.sequence(F.expr(range_id("key", bounds)), F.expr(range_id("hi", bounds)))))
    salted = ranged.withColumn("g", F.explode(F.expr(f"sequence({element(first, 'r')}, {element(first, 'r')} + {element(salts, 'r')} - 1)")))
    ends = F.explode(F.array(F.struct(F.col("key").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("hi").alias("at"), F.lit(2).alias("kind"))))
    return salted.withColumn("e", ends).select("g", F.col("e.at").alias("at"), F.col("e.kind").alias("kind"), F.struct("key", "rule", "verdict").alias("push"))


def _depth():
    step = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    return F.sum(step).over(_order().rowsBetween(Window.unboundedPreceding, 0))


def _order():
    return Window.partitionBy("g").orderBy("at", "kind")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """key, host, path, rule (null if none fits) and verdict for every row.

    rules: (rule, verdict), a rule being host and path. A rule fits its host and its subdomains where the
    path starts with the rule's; the longest that fits decides, of two as long the one with the longer host.
    A null url, or one without '://', has an empty host and path. Rows may repeat and keys may be null.
    """
    spark = pages.sparkSession
    rules = _keys(rules)
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url")).withColumns(parse("url")).select(F.monotonically_increasing_id().alias("row"), "id", "host", "path")
    labels = rules.agg(F.max("labels")).first()[0] or 1
    cuts = f"transform(sequence(1, least({labels}, size(split(host, '[.]')))), n -> CAST(concat(array_join(reverse(slice(split(host, '[.]'), -n, n)), '.'), '#', path) AS BINARY))"
    keyed = rows.withColumn("at", F.explode(F.expr(cuts)))
    ranges = partitions(spark)
    some = keyed.select(F.expr(f"substring(at, 1, {BOUND_BYTES})").alias("k"), F.xxhash64("row", "at").alias("h")).orderBy("h").limit(ranges * SAMPLE_PER_RANGE)
    bounds = quantiles([bytes(r["k"]) for r in some.collect()], ranges)
    dealt = keyed.withColumn("r", F.expr(range_id("at", bounds)))
    count = [0] * (len(bounds) + 1)
    for x in dealt.groupBy("r").count().collect():
        count[x["r"]] = x["count"]
    salts = [max(1, -(-n * ranges // max(1, sum(count)))) for n in count]
    first = [sum(salts[:r]) for r in range(len(salts))]
    events = _events(rules, bounds, first, salts)
    deepest = events.withColumn("depth", _depth()).agg(F.max("depth")).first()[0] or 0
    place = element(placement(spark, sum(salts), ranges), "g")
    part = F.expr(f"{element(first, 'r')} + pmod(xxhash64(row), {element(salts, 'r')})")
    urls = dealt.withColumns({"g": part.cast("int"), "kind": F.lit(1)}).drop("r").withColumn("g", F.expr(place))
    events = events.withColumn("g", F.expr(place))
    swept = events.unionByName(urls, allowMissingColumns=True).withColumn("depth", _depth())
    upto = _order().rowsBetween(Window.unboundedPreceding, 0)
    stack = {f"s{j}": F.last(F.when((F.col("kind") == 0) & (F.col("depth") == j), F.col("push")), ignorenulls=True).over(upto) for j in range(1, deepest + 1)}
    stacked = swept.withColumns(stack).where("kind = 1") if stack else swept.where("kind = 1")
    active = [F.when((F.col("depth") >= j) & F.expr(f"startswith(at, s{j}.key)"), F.struct(F.length(f"s{j}.rule").alias("n"), F.length(F.substring_index(f"s{j}.rule", "/", 1)).alias("h"), F.col(f"s{j}.rule").alias("rule"), F.col(f"s{j}.verdict").alias("verdict"))) for j in range(1, deepest + 1)]
    best = F.greatest(*active) if len(active) > 1 else active[0] if active else F.lit(None).cast("struct<n:int,h:int,rule:string,verdict:string>")
    per_row = stacked.withColumn("best", best).groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return per_row.select(F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
