"""Aggregations of the workload; all have map-side partial forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, key: str, *order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def use_policy(df: DataFrame, key: str, is_test: Column, is_type: Column, guarded: Column) -> DataFrame:
    """(key, policy): test-only if all uses are tests, type-only if all are for types, optional-guarded if any is guarded."""
    flags = df.groupBy(key).agg(F.every(is_test).alias("t"), F.every(is_type).alias("y"), F.some(guarded).alias("g"))
    return flags.select(key, F.when(F.col("t"), "test-only").when(F.col("y"), "type-only").when(F.col("g"), "optional-guarded").otherwise("runtime").alias("policy"))


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst", distinct: bool = True) -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours, or edges counted as often as they stand."""
    pairs = edges.select(src, dst).distinct() if distinct else edges.select(src, dst)
    ends = pairs.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col(dst).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def counted(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def in_buckets(df: DataFrame, bucket: Column, buckets: tuple[str, ...]) -> DataFrame:
    """(bucket, n) with a row for each of ``buckets``, empty ones too."""
    sums = df.agg(*(F.count_if(bucket == b).alias(b) for b in buckets))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in buckets))).alias("x")).select("x.*")


def signature(df: DataFrame, key: str, text: str, parts: int = 256) -> DataFrame:
    """One digest over all rows in key order, as a tree: rows are digested by key range-free buckets, buckets by number.

    Bucket ``key % parts`` holds its rows' digests; a bucket is as large as the table over ``parts``.
    """
    row = df.select(F.pmod(F.col(key), F.lit(parts)).alias("part"), F.struct(F.col(key), F.md5(F.coalesce(text, F.lit(""))).alias("digest")).alias("r"))
    part = row.groupBy("part").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["digest"]), "")).alias("digest"))
    return part.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda r: r["digest"]), "")).alias("signature"))
