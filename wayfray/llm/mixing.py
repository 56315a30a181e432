"""Mixing sources to target weights (operator 1).

Every document gets a hash-random key; each source's documents stand in key order (range
buckets of the uniform key, so a source that holds a third of all rows is spread evenly);
prefix sums of word counts are taken over bucket totals and within buckets; each source is
cut at its exact budget, after as many whole epochs as fit.

Defined cases: null texts and texts without words have size 0 and take 0; a null source is
a source of its own, ordered last; repeated rows each count; null ids hash as an empty
string; an empty table gives an empty result; columns besides the named ones are carried
along by ``mixed_documents`` and ignored by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, frozen, null_safe, ranked


def targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """totals (g, source, source_size) with ``target`` (double).

    Weights repeat in code-point order of the sources, null last. Whatever a source would get
    above ``cap`` times its size is dealt to the rest by weight, until none is above."""
    by = ranked(totals, [F.col("source").asc_nulls_last()], "_i")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    by = frozen(by.withColumn("_w", w).drop("_i"))
    most = F.col("source_size") * F.lit(float(cap))
    level = 0.0
    all_size = by.agg(F.sum("source_size")).first()[0] or 0
    while True:  # each round caps at least one more source or is the last; two or three rounds are usual
        over = F.col("_w") * F.lit(level) > most
        at_cap, free = by.agg(F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("_w")))).first()
        if not free:
            break
        new = (share * all_size - (at_cap or 0.0)) / free
        if new <= level:  # the level only rises, but for rounding
            break
        level = new
    return by.withColumn("target", F.least(most, F.col("_w") * F.lit(level))).drop("_w")


def _taken(docs: DataFrame, carry: list[str], weights, share: float, cap: float, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """_row (a struct of the columns ``carry``), size, source_size, target and taken."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select(F.struct(*carry).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), null_safe(source_col).alias("_g"), key.alias("_key"), size.alias("size"))
    slim = frozen(keyed.select("_g", F.col("_source").alias("source"), "_key", "size"))
    n = slim.count()
    bits = max(8, math.ceil(math.log2(max(1, n / 100_000))))
    bucket = F.shiftrightunsigned("_key", 52 - bits).alias("_bucket")
    sums = frozen(slim.groupBy("_g", bucket).agg(F.first("source").alias("source"), F.sum("size").alias("_sum")))
    per_source = targets(sums.groupBy("_g").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size")), weights, share, cap)
    before = F.sum("_sum").over(W.partitionBy("_g").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    base = (
        sums.select("_g", "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
        .join(per_source.select("_g", "source_size", "target"), "_g")
    )
    at = W.partitionBy("_g", "_bucket").orderBy("_key", "_id", "size").rowsBetween(W.unboundedPreceding, -1)
    out = keyed.withColumn("_bucket", bucket).join(base, ["_g", "_bucket"]).withColumn("_at", F.col("_base") + F.coalesce(F.sum("size").over(at), F.lit(0)))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size") - F.col("_at")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select("_row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return _taken(docs, [id_col], weights, share, cap, id_col, source_col, text_col).select(F.col("_row")[id_col].alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself, with the columns of docs: a row per epoch of each document taken.

    The one document of a source at its budget's edge is cut after the words that remain, so
    that every source holds its budget exactly. Documents of no words take no words of any
    budget and are passed on once."""
    out = _taken(docs, docs.columns, weights, share, cap, id_col, source_col, text_col)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    out = out.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    left = F.col("taken") - (F.col("_copy") - 1) * F.col("size")
    text = F.col("_row")[text_col]
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1), F.lit(1), F.greatest(left, F.lit(0)).cast("int")), "")
    new = F.when(left < F.col("size"), head).otherwise(text)
    return out.select(*[(new if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
