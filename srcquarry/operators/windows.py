"""Sliding token windows, ordered selection and top rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcquarry.functions.text import words


def token_windows(df: DataFrame, key: str, text: str, size: int = 40, hop: int = 20) -> DataFrame:
    """(key, start, digest): every ``hop``-th window of ``size`` words."""
    w = df.select(key, words(F.col(text)).alias("w")).where(F.size("w") >= size)
    w = w.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - size, F.lit(hop))).alias("start"))
    return w.select(key, "start", F.substring(F.sha1(F.array_join(F.slice("w", F.col("start") + 1, size), " ")), 1, 20).alias("digest"))


def duplicate_windows(df: DataFrame, key: str, text: str, size: int = 40, hop: int = 20) -> DataFrame:
    """(digest, n, n_docs, first_doc) of windows that several documents have.

    Windows are counted for each document first, so that one text full of repeats sends one row.
    """
    each = token_windows(df, key, text, size, hop).groupBy("digest", key).agg(F.count("*").alias("c"))
    return each.groupBy("digest").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"), F.min(key).alias("first_doc")).where("n_docs >= 2")


def greedy_apart(df: DataFrame, key: str, start: str, length: int, *ties: str) -> DataFrame:
    """Of each key's rows in order of ``start`` (an integer), those that begin at least ``length`` after the last kept one.

    The choice depends on all earlier ones; sorted partitions are read as a stream, with one number of state.
    """
    schema, at_key, at_start = df.schema, df.columns.index(key), df.columns.index(start)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            keep = []
            for k, s in zip(b.column(at_key).to_pylist(), b.column(at_start).to_pylist()):
                fits = k != now or last is None or s >= last + length
                keep.append(fits)
                if fits:
                    now, last = k, s
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.repartition(key).sortWithinPartitions(key, start, *ties).mapInArrow(run, schema)


def top_rows(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """Spark keeps the ``k`` best of each key in each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def running_total(df: DataFrame, keys: list[str], value: Column, name: str, *order: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
