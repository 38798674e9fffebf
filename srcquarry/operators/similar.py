"""Names that are alike, without comparing all names: an index of rare letters, a bound, then the exact ratio."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def letters(name: Column) -> Column:
    """The name's letters, each with how often it has stood so far: ``abca`` gives a1 b1 c1 a2."""
    chars = F.split(name, "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def shared(size: Column, other: Column, cutoff: Column) -> Column:
    """Letters that names of these sizes share at least if twice their number over both sizes reaches the cutoff."""
    return F.ceil(cutoff * (size + other) / 2 - 1e-9)


def similar(asked: DataFrame, known: DataFrame, on: list[str], n: int = 3) -> DataFrame:
    """(on, name, cutoff, close): for each ``asked`` (on, name, cutoff) the up to ``n`` names of ``known`` (on, name) with the
    same ``on`` whose Ratcliff-Obershelp ratio reaches the cutoff, best first, of equal ones the last in order.

    The ratio is at most that of the letters that two names share, counted.  Names are therefore known by their rarest letters:
    of those that must be shared, one at least is among the first (size - shared + 1) of both, in order of rarity.  What meets
    there is held against the bound with all letters, and only then is the ratio worked out.  Null names ask for nothing.
    """
    size = F.size("letters")
    ask = asked.select(*on, "name", F.col("cutoff").cast("double").alias("cutoff")).where("name <> ''").distinct().withColumn("letters", letters(F.col("name")))
    have = known.select(*on, F.col("name").alias("other")).where("other <> ''").distinct().withColumn("letters", letters(F.col("other")))
    least = ask.agg(F.min("cutoff")).first()[0]
    rarity = have.select(*on, F.explode("letters").alias("letter")).groupBy(*on, "letter").agg(F.count("*").alias("uses"))

    def indexed(df: DataFrame, key: list[str], cutoff: Column) -> DataFrame:
        """One row for each letter of a name that others may meet it at."""
        rows = df.select(*on, *key, F.explode("letters").alias("letter"), size.alias("size"), cutoff.alias("least"))
        rows = rows.join(rarity, [*on, "letter"], "left").groupBy(*on, *key, "size", "least").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "letter"))).alias("rare"))
        shortest = F.ceil(F.col("size") * F.col("least") / (2 - F.col("least")) - 1e-9)
        first = F.col("size") - shared(F.col("size"), shortest, F.col("least")) + 1
        return rows.select(*on, *key, F.explode(F.slice("rare", F.lit(1), F.least(F.greatest(first, F.lit(1)), F.col("size")).cast("int"))["letter"]).alias("letter"))

    if least is None:
        return ask.select(*on, "name", "cutoff", F.array().cast("array<string>").alias("close"))
    meet = indexed(ask, ["name", "cutoff"], F.col("cutoff")).join(indexed(have, ["other"], F.lit(float(least))), [*on, "letter"]).select(*on, "name", "cutoff", "other").distinct()
    pairs = meet.join(ask.withColumnRenamed("letters", "a"), [*on, "name", "cutoff"]).join(have.withColumnRenamed("letters", "b"), [*on, "other"])
    pairs = pairs.where(F.size(F.array_intersect("a", "b")) >= shared(F.size("a"), F.size("b"), F.col("cutoff"))).select(*on, "name", "cutoff", "other")

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = difflib.SequenceMatcher()
        for b in batches:
            values = []
            for name, other in zip(b.column("name").to_pylist(), b.column("other").to_pylist()):
                ratio.set_seq2(name)
                ratio.set_seq1(other)
                values.append(ratio.ratio())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64())], names=[*b.schema.names, "ratio"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", ratio double"
    best = Window.partitionBy(*on, "name", "cutoff").orderBy(F.desc("ratio"), F.desc("other"))
    top = pairs.mapInArrow(exact, kinds).where("ratio >= cutoff").withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
    close = top.groupBy(*on, "name", "cutoff").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]).alias("close"))
    return ask.drop("letters").join(close, [*on, "name", "cutoff"], "left").withColumn("close", F.coalesce("close", F.array().cast("array<string>")))
