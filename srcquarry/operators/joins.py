"""Joins of the workload over arbitrary tables and keys.  None compares all pairs: prefixes, candidates and ranges become keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcquarry.functions.text import glob_regex


def first_candidate(df: DataFrame, key: str, candidates: Column, targets: DataFrame, target: str, *carried: str) -> DataFrame:
    """(key, target columns, rank) for each distinct ``key``: the first of its ordered ``candidates`` that ``targets`` has.

    One equi-join on exploded candidates; keys without any are left out.
    """
    asked = df.select(key).where(F.col(key).isNotNull()).distinct().select(key, F.posexplode(candidates).alias("rank", target))
    found = asked.join(targets.select(target, *carried), target)
    return found.groupBy(key).agg(F.min_by(F.struct(target, *carried, "rank"), "rank").alias("hit")).select(key, "hit.*")


def missing(df: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    return df.join(others.select(*keys), list(keys), "left_anti")


def matching(df: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    return df.join(others.select(*keys), list(keys), "left_semi")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Pairs of rows (structs ``a``, ``b``) that share ``keys`` and whose closed integer ranges overlap.

    Ranges are dealt into stretches of ``width``; a pair meets in the stretch where the later of the two begins.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    deal = lambda df, name: df.select(*keys, F.struct(*df.columns).alias(name), F.explode(F.sequence(cell(start), cell(end))).alias("_cell"))
    both = deal(a, "a").join(deal(b, "b"), [*keys, "_cell"])
    later = F.greatest(F.col(f"a.{start}"), F.col(f"b.{start}"))
    return both.where((F.col(f"a.{start}") <= F.col(f"b.{end}")) & (F.col(f"b.{start}") <= F.col(f"a.{end}")) & (F.floor(later / width) == F.col("_cell"))).select("a", "b")


def matching_rules(value: Column, rules: list[tuple[str, str]]) -> Column:
    """Array of the names of the (name, glob) ``rules`` that match, in their order.  Rules are literals of the plan: no join."""
    return F.array_compact(F.array(*(F.when(value.rlike(glob_regex(p)), F.lit(n)) for n, p in rules)))


def apply_first(df: DataFrame, key: list[str], rules: DataFrame, on: list[str], fits: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """Each row takes the first rule (by ``order``) that shares ``on`` and ``fits``.

    Returns (the rows without a rule, the rules that no row took).  ``fits`` speaks of the aliases ``d`` and ``r``.
    """
    pairs = df.alias("d").join(rules.alias("r"), on=[F.col(f"d.{c}") == F.col(f"r.{c}") for c in on]).where(fits)
    taken = pairs.groupBy(*(F.col(f"d.{c}").alias(c) for c in key)).agg(F.min(f"r.{order}").alias(order))
    return df.join(taken.select(*key), key, "left_anti"), rules.join(taken.select(order).distinct(), order, "left_anti")


def first_of_branches(branches: list[DataFrame], key: str, *order: str) -> DataFrame:
    """The union of ``branches`` with one row for each ``key``, from the earliest branch, then by ``order``."""
    both = None
    for n, b in enumerate(branches):
        b = b.withColumn("branch", F.lit(n))
        both = b if both is None else both.unionByName(b)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("branch", *order)).alias("x")).select(key, "x.*")


def with_status(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """``current`` with baseline_status ``existing`` or ``new``."""
    known = baseline.select(key).distinct().withColumn("_known", F.lit(True))
    return current.join(known, key, "left").withColumn("baseline_status", F.when(F.col("_known"), "existing").otherwise("new")).drop("_known")


def ranked_rows(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The rows with their number ``_n`` among those of their key, and the first one's ``order`` columns as ``kept_*``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).select("*", *(F.first(c).over(w).alias(f"kept_{c}") for c in order))


def first_rows(df: DataFrame, keys: list[str], *order: str) -> tuple[DataFrame, DataFrame]:
    """(the first row of each key, the other rows with the first one's ``order`` columns as ``kept_*``)."""
    ranked = ranked_rows(df, keys, *order)
    return ranked.where("_n = 1").select(df.columns), ranked.where("_n > 1").drop("_n")
