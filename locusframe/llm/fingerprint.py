"""Document fingerprints: bottom-k sketches of hashed five-word shingles, in SQL expressions only.

A fingerprint is the sorted k smallest of the distinct 64-bit hashes of a text's shingles. Two fingerprints
merge into that of the union. Below the smaller of two sketches' largest hashes (if they are full) both
know every hash, so counts there estimate resemblance and containment, and are exact for short texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions
from .ranges import quantiles, range_id

K = 128
SHINGLE = 5
_SPACE = r" \t\n\x0B\f\r"
#: Text between 0 and 1 of the range of signed 64-bit hashes.
_LOW, _SPAN = "-9223372036854775808", "18446744073709551616.0D"


def sketch(text: str, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<long>: the fingerprint of a string column (SQL expression). Words are split at white space and lower-cased; a text of fewer words is one shingle; none (null, empty, blank): an empty array."""
    trimmed = f"btrim(lower(coalesce({text}, '')), ' \\t\\n\\u000B\\f\\r')"
    words = f"IF({trimmed} = '', CAST(array() AS array<string>), split({trimmed}, '\\\\s+'))"
    hashed = f"transform({words}, w -> xxhash64(w))"
    several = ", ".join(f"element_at(h, i + {j})" for j in range(1, shingle + 1))
    of = f"transform(array({hashed}), h -> CASE WHEN size(h) = 0 THEN h WHEN size(h) < {shingle} THEN array(xxhash64(array_join(transform(h, x -> hex(x)), ' '))) ELSE transform(sequence(0, size(h) - {shingle}), i -> xxhash64({several})) END)[0]"
    return F.expr(f"slice(sort_array(array_distinct({of})), 1, {k})")


def hexed(sk: str) -> Column:
    """The fingerprint as a string: 16 hexadecimal digits a hash."""
    return F.expr(f"lower(array_join(transform({sk}, __lf_v -> lpad(hex(__lf_v), 16, '0')), ''))")


def _known(a: str, b: str, k: int) -> str:
    """The largest hash up to which both sketches know all of theirs."""
    top = lambda s: f"IF(size({s}) < {k}, 9223372036854775807L, element_at({s}, -1))"
    return f"least({top(a)}, {top(b)})"


def _below(a: str, b: str, what: str, k: int) -> str:
    return f"size(filter({what}, __lf_v -> __lf_v <= {_known(a, b, k)}))"


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated Jaccard similarity of the two shingle sets, 0 to 1; two empty ones are alike."""
    return F.expr(f"IF(size({a}) = 0 AND size({b}) = 0, 1.0D, CAST({_below(a, b, f'array_intersect({a}, {b})', k)} AS DOUBLE) / {_below(a, b, f'array_union({a}, {b})', k)})")


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    return F.expr(f"IF(size({a}) = 0, 1.0D, CAST({_below(a, b, f'array_intersect({a}, {b})', k)} AS DOUBLE) / greatest(1, {_below(a, b, a, k)}))")


def distinct_count(a: str, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch isn't full."""
    return F.expr(f"IF(size({a}) < {k}, CAST(size({a}) AS DOUBLE), {k - 1} / ((CAST(element_at({a}, -1) AS DOUBLE) - ({_LOW})) / {_SPAN}))")


def merge(a: str, b: str, k: int = K) -> Column:
    """The fingerprint of the union of two parts."""
    return F.expr(f"slice(sort_array(array_union({a}, {b})), 1, {k})")


def merge_groups(df: DataFrame, by: str, sk: str, k: int = K) -> DataFrame:
    """(by, sketch) of the union of each group's fingerprints: hashes are made distinct before the k smallest are picked, in two steps so that a hot group is spread."""
    h = df.select(F.col(by), F.explode(F.col(sk)).alias("__lf_h")).distinct()
    part = Window.partitionBy(by, F.pmod(F.col("__lf_h"), F.lit(64))).orderBy("__lf_h")
    some = h.withColumn("__lf_r", F.row_number().over(part)).where(F.col("__lf_r") <= k)
    return some.groupBy(by).agg(F.expr(f"slice(sort_array(collect_list(__lf_h)), 1, {k})").alias("sketch"))


def with_next(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """(key, text, next_text, own columns for order) where the next row is that of the next key, and the first one's after the last.

    Rows are dealt to ranges of keys; each range also gets the first row of the next one, so no row is
    needed from elsewhere. Null keys stand first; equal keys are ordered by text, nulls first. Keys that aren't
    whole numbers are ordered as text.
    """
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    order_key = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))) if whole else F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("__lf_id"), F.col(text).cast("string").alias("__lf_t"), order_key.alias("__lf_k"))
    if whole:
        shares = [i / parts for i in range(1, parts)] or [0.5]
        found = rows.agg(F.percentile_approx("__lf_k", shares, F.lit(10_000)).alias("q"), F.min("__lf_k").alias("least")).first()
        least, some = found["least"], found["q"] or []
    else:
        least = rows.agg(F.min("__lf_k")).first()[0]
        least = None if least is None else bytes(least)
        some = quantiles([bytes(r["__lf_k"]) for r in rows.select("__lf_k").orderBy(F.xxhash64("__lf_k")).limit(32 * parts).collect()], parts)
    bounds = sorted({b for b in some if b > least}) if parts > 1 else []  # each is a key that there is
    spell = lambda v: f"X'{v.hex()}'" if isinstance(v, bytes) else f"{v}L" if v > -(1 << 63) else "CAST(-9223372036854775808 AS BIGINT)"
    at = range_id("__lf_k", bounds)
    last = len(bounds)
    copies = "array(named_struct('r', {at}, 's', 0))".format(at=at)
    if least is not None:
        copies = f"CASE WHEN __lf_k = {spell(least)} THEN array(named_struct('r', {at}, 's', 0), named_struct('r', {last}, 's', 1))"
        if bounds:
            copies += f" WHEN __lf_k IN ({', '.join(map(spell, bounds))}) THEN array(named_struct('r', {at}, 's', 0), named_struct('r', {at} - 1, 's', 1))"
        copies += f" ELSE array(named_struct('r', {at}, 's', 0)) END"
    dealt = rows.withColumn("__lf_c", F.explode(F.expr(copies))).selectExpr("__lf_id", "__lf_t", "__lf_k", "__lf_c.r AS __lf_r", "__lf_c.s AS __lf_s")
    return dealt.withColumn("__lf_next", F.lead("__lf_t").over(order()))


def order():
    return Window.partitionBy("__lf_r").orderBy("__lf_s", "__lf_k", F.col("__lf_t").asc_nulls_first())


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """For each row: its fingerprint, that of its edited text (the last quarter replaced from the next document), and likenesses.

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts
    count as empty; a table of one row has itself as its next document.
    """
    rows = with_next(docs, key, text, 3 * partitions(docs.sparkSession))
    full = rows.withColumn("__lf_x", F.coalesce("__lf_t", F.lit(""))).withColumn("__lf_n", F.length("__lf_x").cast("long"))
    edited = "concat(substring(__lf_x, 1, CAST(__lf_n - __lf_n div 4 AS INT)), substring(coalesce(__lf_next, ''), 1, CAST(__lf_n div 4 AS INT)))"
    full = full.withColumn("__lf_e", F.expr(edited)).withColumn("__lf_a", sketch("__lf_x", k))
    full = full.withColumn("__lf_b", F.lead("__lf_a").over(order())).where("__lf_s = 0")
    full = full.withColumn("__lf_f", sketch("__lf_e", k))
    return full.select(
        F.col("__lf_id").alias(key),
        F.col("__lf_n").alias("n_chars"),
        F.sha2(F.col("__lf_e").cast("binary"), 256).alias("edited_sha256"),
        hexed("__lf_a").alias("fingerprint"),
        hexed("__lf_f").alias("edited_fingerprint"),
        resemblance("__lf_a", "__lf_f", k).alias("near_edited"),
        resemblance("__lf_a", "__lf_b", k).alias("near_next"),
    )
